"""Per-document text quality statistics and posterior text types (prose, list, table, junk).

Statistics are JVM expressions. For the type, a document is cut into units (lines, wrapped lines joined). Single thresholds on a
unit's statistics are noisy labelling functions, each meant for one type; many fire on units of other types as well. How often each
fires on each type - its accuracy and its errors - is learned by expectation-maximisation on their agreements and disagreements; a
unit's posterior follows from which fire and which do not, and a document's type is the one with the larger share of its characters.

The EM runs on the counts of distinct firing patterns (bounded by 2^functions, some hundreds in practice), not on rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("prose", "list", "table", "junk")
COMMON_WORDS = 300  # top words by number of documents
MAX_PATTERNS = 200_000
HIT, MISS = 0.6, 0.12  # how often a function fires on units of its type and of others, before anything is learned
PULL = 0.11  # weight of that beside what is learned, as a share of all units
_SPACE = "[ \\t\\n\\f\\r\u00a0]+"
_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def _lower(s: Column) -> Column:
    return F.lower(F.replace(s, F.lit("İ"), F.lit("i")))


def common_words(docs: DataFrame, text: str = "text", top: int = COMMON_WORDS) -> list[str]:
    """The words most documents hold (lower case); the report is a top-k over counts of all documents, ties by word."""
    words = F.array_distinct(F.transform(F.split(_lower(F.col(text)), _SPACE), lambda w: F.regexp_replace(w, _EDGE, "")))
    counts = docs.where(F.col(text).isNotNull()).select(F.explode(words).alias("w")).where("w != '' AND w NOT RLIKE '[0-9]'").groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(top).collect()]


def statistics(docs: DataFrame, common: list[str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_chars, n_words, mean_word_length, symbol_ratio, line_end_ratio, common_ratio: one row per document.

    Null text has null statistics; empty or blank text has 0 words and null ratios. symbol_ratio counts characters that are
    neither letters, digits nor white space; line_end_ratio the non-blank lines that end in . ! ? or an ellipsis.
    """
    t = F.col("_t")
    words = F.filter(F.split(t, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, r"[\n\r]+"), lambda x: x.rlike("[^ \\t\\f\u00a0]"))
    d = docs.select(*keep, F.col(text).alias("_t")).select(*keep, "_t", words.alias("_w"), lines.alias("_l"))
    bare = F.transform("_w", lambda w: F.regexp_replace(_lower(w), _EDGE, ""))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return d.select(
        *keep,
        F.length("_t").cast("long").alias("n_chars"),
        F.when(t.isNotNull(), F.size("_w").cast("long")).alias("n_words"),
        F.round(ratio(F.aggregate("_w", F.lit(0), lambda a, w: a + F.length(w)), F.size("_w")), 6).alias("mean_word_length"),
        F.round(ratio(F.length(F.regexp_replace(t, r"[\p{L}\p{N} \t\n\f\r\x{a0}]", "")), F.length(t)), 6).alias("symbol_ratio"),
        F.round(ratio(F.size(F.filter("_l", lambda x: F.rtrim(x).rlike(r"[.!?…]$"))), F.size("_l")), 6).alias("line_end_ratio"),
        F.round(ratio(F.size(F.filter(bare, lambda w: w.isin(*(common or [""])))), F.size("_w")), 6).alias("common_ratio"),
    )


# ---- units and labelling functions -------------------------------------------------------------------------------------

_bullet = re.compile(r"^\s*(?:[-*•+–—·▪◦>]|\(?\d{1,4}[.)\]]|\[\d{1,4}\]|\(?[a-zA-Z][.)])\s+\S")
_end = re.compile(r"[.!?…][\"'”»)\]]*\s*$")
_url = re.compile(r"^\s*(?:https?://|www\.)\S+\s*$")
_keyed = re.compile(r"^\s*[^\W\d_][\w .'’/()-]{0,28}?\s*[:=]\s*\S.{0,80}$")
_log = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\b(?:INFO|WARN|ERR|ERROR|DEBUG|TRACE|GET|POST)\b.*(?:=|0x|/)|0x[0-9a-f]{4,}|\bpid=")
_code = re.compile(r"[{}]|=>|==|&&|\|\||\(\)|function\b|\breturn\b|\bvar\b|</|/>")
_value = re.compile(r"^(?:[+\d().,:/%\s-]*\d[+\d().,:/%\s-]*|-|yes|no|unknown|evet|hayır|ja|nein|oui|non)?$", re.I)
_wordish = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_items = re.compile(r"\s*(?:[,;·•|]|\s[>/–-]\s)\s*")
_hex = re.compile(r"[0-9a-f]{2}")
_vowel = re.compile(r"[aeıioöuüâîûáéíóúàèìòùäëïêôyAEIİOÖUÜÂÎÛÁÉÍÓÚÀÈÄËÏÊÔY]")


def _cells(line: str) -> tuple[str, list[str]]:
    """The delimiter that gives the most cells (tab, bar, semicolon, comma, runs of spaces) and the cells."""
    best: tuple[str, list[str]] = ("", [line])
    for d, parts in (("\t", line.split("\t")), ("|", line.strip().strip("|").split("|")), (";", line.split(";")), (",", line.split(",")), ("  ", re.split(r" {2,}", line.strip()))):
        if len(parts) > len(best[1]) and (d != "," or all(len(p) < 60 for p in parts)):
            best = (d, parts)
    return best


def _variety(words: list[str], window: int = 40) -> float:
    """Mean share of distinct words in windows, so that it does not fall with length."""
    if len(words) <= window:
        return len(set(words)) / max(len(words), 1)
    parts = [words[i : i + window] for i in range(0, len(words) - window // 2, window)]
    return sum(len(set(p)) / len(p) for p in parts) / len(parts)


def units(text: str) -> list[str]:
    """Lines, with wrapped prose joined: a line of over 40 characters that does not end a sentence goes on in the next one
    unless that begins like an item, a field or a row."""
    out: list[str] = []
    go_on = False
    for line in re.split("[\n\r\x0b\x0c\x85\u2028\u2029]+", text):
        if not line.strip():
            continue
        cells = _cells(line)
        rowlike = len(cells[1]) >= 4 and cells[0] != ","
        if go_on and not _bullet.match(line) and not rowlike and not _url.match(line) and (line[:1].islower() or not _keyed.match(line)):
            out[-1] += " " + line.strip()
        else:
            out.append(line)
        words = line.split()
        go_on = len(line.strip()) > 40 and len(words) >= 5 and not _end.search(line) and not rowlike and not _url.match(line) and not _bullet.match(line) and not _log.search(line)
        go_on = go_on and sum(w[:1].islower() for w in words) >= len(words) * 0.4
    return out


NAMES = (
    "prose_ended", "prose_common", "prose_lower", "prose_long", "prose_varied",
    "list_short", "list_neighbours", "list_bullet", "list_items", "list_url", "list_unknown", "list_even", "list_parts",
    "table_cells", "table_many", "table_key", "table_keys", "table_values",
    "junk_symbols", "junk_token", "junk_repeats", "junk_letters", "junk_code", "junk_log", "junk_same", "junk_unended", "junk_few", "junk_wide", "junk_coded",
)
_OF = [KINDS.index(n.split("_")[0]) for n in NAMES]


def votes(text: str, common: frozenset[str]) -> list[tuple[int, int]]:
    """(firing pattern, characters) of each unit of a text; the whole text is read."""
    us = units(text)
    n = len(us)
    cells = [_cells(u) for u in us]
    split = [u.split() for u in us]
    ended = [bool(_end.search(u)) for u in us]
    keyed = [bool(_keyed.match(u)) and "://" not in u for u in us]
    short = [len(w) <= 7 and len(u) <= 90 and not e and not k for u, w, e, k in zip(us, split, ended, keyed)]
    out = []
    for i, u in enumerate(us):
        s, words = u.strip(), split[i]
        m, chars = max(len(words), 1), max(len(s.replace(" ", "")), 1)
        letters = sum(map(len, _wordish.findall(s)))
        vowels = len(_vowel.findall(s)) / letters if letters else 0.0
        near = [j for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < n]
        d, c = cells[i]
        same = any(cells[j][0] == d and abs(len(cells[j][1]) - len(c)) <= (0 if d != "  " else 1) for j in near)
        low = [w.strip(".,;:!?\"'()[]«»“”…-–").lower() for w in words]
        known, variety = sum(w in common for w in low), _variety(low)
        lower = sum(w[:1].islower() for w in words)
        symbols = sum(1 for ch in s if not (ch.isalnum() or ch.isspace()))
        items = [x for x in _items.split(s) if x.strip()]
        item_words = sum(len(x.split()) for x in items) / max(len(items), 1)
        longest, kinds = max(map(len, words), default=0), len(set(s))
        fire = {
            "prose_ended": ended[i] and m >= 5,
            "prose_common": known >= 0.15 * m and known >= 2,
            "prose_lower": lower >= 0.5 * m and m >= 4 and item_words >= 3 and letters >= 0.6 * chars,
            "prose_long": m >= 12 and item_words >= 5 and letters >= 0.6 * chars and variety > 0.6,
            "prose_varied": m >= 8 and variety > 0.7 and item_words >= 3 and letters >= 0.6 * chars,
            "list_short": short[i],
            "list_neighbours": sum(short[j] for j in near) >= 2,
            "list_bullet": bool(_bullet.match(u)),
            "list_items": len(items) >= 5 and item_words <= 4.5,
            "list_url": bool(_url.match(u)),
            "list_unknown": known == 0 and letters > 0 and m <= 7 and not keyed[i] and symbols <= 0.25 * chars,
            "list_even": len(items) >= 4 and item_words <= 4.5 and d in ("", ",", ";"),
            "list_parts": len(items) >= 8 and item_words <= 3.5,
            "table_cells": len(c) >= 3 and same,
            "table_many": len(c) >= 4 and same,
            "table_key": keyed[i],
            "table_keys": keyed[i] and any(keyed[j] for j in near),
            "table_values": len(c) >= 3 and same and sum(1 for x in c if _value.match(x.strip())) >= 0.3 * len(c),
            "junk_symbols": symbols > 0.3 * chars,
            "junk_token": longest > 40 and "://" not in s,
            "junk_repeats": m >= 8 and variety < 0.5 or len(s) >= 12 and kinds <= 4,
            "junk_letters": letters >= 10 and vowels < 0.22 or m >= 6 and all(_hex.fullmatch(w) for w in low),
            "junk_code": len(_code.findall(s)) >= 2,
            "junk_log": bool(_log.search(s)),
            "junk_same": m >= 6 and variety < 0.65 and item_words > 3,
            "junk_unended": m >= 12 and not ended[i] and item_words > 8,
            "junk_few": len(s) >= 12 and kinds <= 4,
            "junk_coded": len(_code.findall(s)) >= 4,
            "junk_wide": letters >= 10 and letters / m > 13 and "." not in s,
        }
        out.append((sum(1 << k for k, name in enumerate(NAMES) if fire[name]), len(s)))
    return out


def start() -> np.ndarray:
    """Firing rates by function and type before anything is learned."""
    rates = np.full((len(NAMES), len(KINDS)), MISS)
    rates[np.arange(len(NAMES)), _OF] = HIT
    return rates


def fit(patterns: dict[int, float], steps: int = 60) -> np.ndarray:
    """EM over firing patterns: P(function fires | type of the unit), functions by types.

    The types are equally likely beforehand. The start counts as PULL of all units, so that a type keeps its name and rare
    functions do not run off; it is a share, so the result does not depend on the size of the corpus.
    """
    rates = start()
    keys = sorted(patterns)
    if not keys:
        return rates
    x, w = firing(keys), np.array([patterns[p] for p in keys], dtype=float)
    pull, first = PULL * w.sum(), rates
    for _ in range(steps):
        q = posterior(x, rates) * w[:, None]
        rates = np.clip((x.T @ q + pull * first) / (q.sum(0) + pull), 0.002, 0.998)
    return rates


def firing(keys: list[int]) -> np.ndarray:
    return np.array([[(p >> k) & 1 for k in range(len(NAMES))] for p in keys], dtype=float).reshape(len(keys), len(NAMES))


def posterior(x: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Types of units given which functions fire and which do not, the types equally likely beforehand."""
    logs = x @ np.log(rates) + (1 - x) @ np.log(1 - rates)
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def text_types(docs: DataFrame, common: list[str], text: str = "text", key: str = "doc_id", learned: bool = True) -> DataFrame:
    """(key, kind, prose, list, table, junk): expected share of each type in the characters of each non-blank document and
    the type with the larger share (junk, table, list where non-prose is over a half). Null and blank texts give no row;
    repeated rows are rows of their own; an empty table gives none. learned=False leaves the functions at their start, to measure
    what the learning adds."""
    from veyra.session import cut

    words = frozenset(common)

    @F.pandas_udf("array<struct<pattern:int,n:int>>")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in it:
            yield batch.map(lambda t: [{"pattern": p, "n": n} for p, n in votes(t, words)])

    rows = docs.select(key, F.col(text).alias("t")).where(F.col("t").rlike(r"(?U)[^\s]"))
    fired = cut(rows.select(key, F.monotonically_increasing_id().alias("row"), of("t").alias("u")), "units")
    # A pattern counts once a document, else the rows of a few long tables would teach it all.
    counts = fired.select(F.explode(F.array_distinct("u.pattern")).alias("p")).groupBy("p").agg(F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(counts) > MAX_PATTERNS:
        raise ValueError("more firing patterns than labelling functions allow")
    model = fit({r["p"]: r["n"] for r in counts}) if learned else start()
    known = {}
    if counts:
        keys = [r["p"] for r in counts]
        known = {p: tuple(map(float, row)) for p, row in zip(keys, posterior(firing(keys), model))}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("struct<prose:double,list:double,table:double,junk:double>")
    def shares(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in it:
            got = []
            for us in batch:
                total = np.zeros(len(KINDS))
                for u in us:
                    total += u["n"] * np.array(shared.value[u["pattern"]])
                got.append(total / max(total.sum(), 1e-9))
            yield pd.DataFrame(np.array(got).reshape(-1, len(KINDS)), columns=list(KINDS))

    shares = shares.asNondeterministic()  # once, also where the kind is filtered on
    out = fired.select(key, shares("u").alias("s")).select(key, "s.*")
    top = F.when(F.col("prose") >= 0.5, "prose").when((F.col("list") >= F.col("table")) & (F.col("list") >= F.col("junk")), "list").when(F.col("table") >= F.col("junk"), "table").otherwise("junk")
    return out.select(key, top.alias("kind"), *KINDS)
