"""Several values packed in one field: one row per value, with its position and an error flag.

A parsing expression grammar with ordered alternatives; the first alternative that matches wins, and an alternative that
fails gives its input back (backtracking):

    field   <- item (sep item)* eof
    item    <- ws (entry / quoted / bare)? ws         an empty item is no value and takes no position
    entry   <- a word of the vocabulary, whatever delimiters it holds        &(ws (sep / eof))
    quoted  <- '"' (any but '"' / '""')* '"'                                 &(ws (sep / eof))
    bare    <- (bracketed / nested quote / not sep)+
    bracketed <- '(' (bracketed / any but brackets)* ')'  delimiters within brackets do not divide; an unclosed one is text
    sep     <- ';' / '|' / newline / tab / bullet / ',' / '/'

A quote that opens but never closes properly fails the quoted alternative; the text is then read as a bare value, the
stray quote is dropped and the value is flagged `malformed_quote`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ";|\n\r\t•·,/"
_BLANK = " \u00a0\u2007\u2009\u202f\u200b\ufeff"


class Grammar:
    """The grammar above over one vocabulary of entries (longest entry first)."""

    def __init__(self, entries: Sequence[str] = (), separators: str = SEPARATORS) -> None:
        self.seps = frozenset(separators)
        self.entries = sorted({e for e in entries if any(ch in self.seps for ch in e)}, key=lambda e: (-len(e), e))
        self.lowered = [e.lower() for e in self.entries]

    def _ws(self, s: str, i: int) -> int:
        while i < len(s) and s[i] in _BLANK:
            i += 1
        return i

    def _ends(self, s: str, i: int) -> bool:
        i = self._ws(s, i)
        return i >= len(s) or s[i] in self.seps

    def _entry(self, s: str, i: int) -> tuple[str, int] | None:
        for e, low in zip(self.entries, self.lowered):
            if s[i : i + len(e)].lower() == low and self._ends(s, i + len(e)):
                return s[i : i + len(e)], i + len(e)
        return None

    def _quoted(self, s: str, i: int) -> tuple[str, int] | None:
        if i >= len(s) or s[i] != '"':
            return None
        j = i + 1
        while True:
            k = s.find('"', j)
            if k < 0:
                return None
            if s[k + 1 : k + 2] == '"':
                j = k + 2
                continue
            if self._ends(s, k + 1):
                return s[i + 1 : k].replace('""', '"').strip(), k + 1
            return None

    def _bracketed(self, s: str, i: int) -> int | None:
        depth, j = 0, i
        while j < len(s):
            if s[j] == "(":
                depth += 1
            elif s[j] == ")":
                depth -= 1
                if not depth:
                    return j + 1
            j += 1
        return None

    def _bare(self, s: str, i: int) -> tuple[str, int, bool]:
        j, odd, closed = i, False, None
        while j < len(s) and s[j] not in self.seps:
            if s[j] == "(" and closed != -1:
                closed = self._bracketed(s, j)
                if closed is None:
                    closed = -1  # no later bracket can close either
                    j += 1
                else:
                    j = closed
            elif s[j] == '"':
                k = s.find('"', j + 1)  # a nickname in quotes inside a bare value
                if k < 0:
                    odd, j = True, j + 1
                elif any(ch in self.seps for ch in s[j + 1 : k]):
                    odd, j = True, j + 1
                else:
                    j = k + 1
            else:
                j += 1
        text = s[i:j].strip()
        if odd and text.count('"') % 2:
            text = (text[1:] if text.startswith('"') else text[:-1] if text.endswith('"') else text.replace('"', "", 1)).strip()
        return text, j, odd

    def parse(self, s: str | None) -> list[tuple[str, str]]:
        """(value, error) pairs in order; error is '' or malformed_quote."""
        out: list[tuple[str, str]] = []
        if not s:
            return out
        i = 0
        while i <= len(s):
            i = self._ws(s, i)
            if i >= len(s):
                break
            if s[i] in self.seps:
                i += 1
                continue
            if (m := self._entry(s, i)) or (m := self._quoted(s, i)):
                (value, i), error = m, ""
                if value:
                    out.append((value, error))
                continue
            value, i, odd = self._bare(s, i)
            if value:
                out.append((value, "malformed_quote" if odd else ""))
        return out


def split_cells(df: DataFrame, src: Column | str, key: Column | str, cells: Column | str, entries: Sequence[str] = ()) -> DataFrame:
    """(src, rec_key, pos, item, error): one row per value of the packed cells of each row.

    cells is a string or an array of strings; positions run from 1 through all elements in order. Null and blank cells give
    no row. entries is the vocabulary (a bounded table) whose words are one value even if they hold a delimiter. Repeated
    values and repeated rows stay. Extra columns of df are not carried. The parser runs in Arrow batches
    on the rows as they are read; nothing is shuffled.
    """
    lit = lambda c: F.col(c) if isinstance(c, str) else c
    words = list(entries)
    rows = df.select(lit(src).alias("src"), lit(key).cast("string").alias("rec_key"), lit(cells).alias("cells"))
    if not rows.schema["cells"].dataType.typeName() == "array":
        rows = rows.withColumn("cells", F.array("cells"))
    rows = rows.where(F.exists("cells", lambda x: F.coalesce(F.length(F.trim(x)) > 0, F.lit(False))))

    @F.pandas_udf("array<array<struct<item:string,error:string>>>")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(words)
        for batch in batches:
            yield batch.map(lambda xs: [[{"item": v, "error": e} for v, e in grammar.parse(x)] for x in xs])

    return rows.select("src", "rec_key", F.posexplode(F.flatten(values("cells"))).alias("p", "v")).select("src", "rec_key", (F.col("p") + 1).alias("pos"), F.col("v.item").alias("item"), F.col("v.error").alias("error"))
