"""Text expressions: Turkish-aware folding, phrase patterns, match offsets, span merging.

All are JVM columns. Folding takes characters that fold to one character through a translate table made from the Unicode
database; a text with any other foldable character is mapped character by character with a literal map, in the JVM as well.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that differ between Turkish and ASCII spelling.
TURKISH = "ıİşŞğĞüÜöÖçÇâÂîÎûÛ"
ASCII = "iIsSgGuUoOcCaAiIuU"
BUCKETS = 64


def tr_lower(s: Column) -> Column:
    """Lower case with the Turkish rules for I and İ."""
    return F.lower(F.translate(s, "Iİ", "ıi"))


def _strip(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch))


@lru_cache(maxsize=1)
def _single() -> tuple[str, str]:
    """Characters up to U+FFFF that fold to exactly one other character, and what they fold to."""
    src, dst = [], []
    for i in range(0x80, min(sys.maxunicode, 0xFFFF)):
        if 0xD800 <= i < 0xE000 or 0xAC00 <= i < 0xD7A4:
            continue
        f = _strip(chr(i))
        if len(f) == 1 and f != chr(i):
            src.append(chr(i))
            dst.append(f)
    return "".join(src), "".join(dst)


#: What the translate table does not cover: combining marks, and everything outside Latin, Greek and Cyrillic that may fold to
#: several characters.
_BEYOND = r"[^\x{00}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17f}\x{192}\x{1fa}-\x{1ff}\x{218}-\x{21b}\x{391}-\x{3c9}\x{400}-\x{45f}\x{2010}-\x{2016}\x{2018}-\x{2023}\x{20ac}\x{2500}-\x{25ff}]"


@lru_cache(maxsize=1)
def _several() -> dict[str, str]:
    """Characters that fold to none or to several characters, or that lie beyond U+FFFF; Hangul syllables stay composed."""
    single, out = set(_single()[0]), {}
    for i in range(0x80, sys.maxunicode + 1):
        ch = chr(i)
        if ch in single or 0xD800 <= i < 0xE000 or 0xAC00 <= i < 0xD7A4:
            continue
        f = _strip(ch)
        if f != ch:
            out[ch] = f
    return out


@lru_cache(maxsize=1)
def _table() -> tuple[str, str]:
    """Source and target of one translate call for all characters that fold to one character or to none (these come last, without
    a target, which deletes them)."""
    src, dst = _single()
    one = {k: v for k, v in _several().items() if len(v) == 1}
    return src + "".join(one) + "".join(k for k, v in _several().items() if v == ""), dst + "".join(one.values())


@lru_cache(maxsize=1)
def _longer() -> tuple[str, list[str]]:
    """A character class of those that fold to several characters, and what they fold to: "key, value" lists by code point modulo BUCKETS."""
    longer = {k: v for k, v in _several().items() if len(v) > 1}
    runs: list[list[int]] = []
    for i in sorted(map(ord, longer)):
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    lists: list[list[str]] = [[] for _ in range(BUCKETS)]
    for k, v in longer.items():
        lists[ord(k) % BUCKETS].append(f"{k}\x02{v}")
    return f"[{_BEYOND}&&[{''.join(rf'\x{{{a:x}}}-\x{{{b:x}}}' for a, b in runs)}]]", ["\x01".join(x) for x in lists]


def _mapped(s: Column) -> Column:
    """Characters that fold to several by their entries in literal maps that are parsed once per plan; the runs between them stay whole."""
    longer, lists = _longer()
    maps = F.array(*[F.str_to_map(F.lit(x), F.lit("\x01"), F.lit("\x02")) for x in lists])
    lookup = lambda c: F.when(F.length(c) == 1, F.try_element_at(F.get(maps, F.ascii(c) % BUCKETS), c))
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(rf"(?s){longer}|(?:(?!{longer}).)+"), F.lit(0)), lambda c: F.coalesce(lookup(c), c)), "")


def strip_marks(s: Column) -> Column:
    """Compatibility decomposition without combining marks (NFKD); Hangul syllables stay composed. Plain ASCII passes by the tables."""
    src, dst = _table()
    return F.when(F.octet_length(s) == F.length(s), s).otherwise(F.translate(F.when(s.rlike(_longer()[0]), _mapped(s)).otherwise(s), src, dst))


def _dots(s: Column) -> Column:
    """The ellipsis, which stands in every other snippet, as it folds: most texts are ASCII then."""
    return F.replace(s, F.lit("…"), F.lit("..."))


def _lower_ascii(s: Column) -> Column:
    """tr_lower and the Turkish letters to ASCII, in one pass."""
    return F.lower(F.translate(s, TURKISH, ASCII.lower()))


def fold(s: Column) -> Column:
    """Turkish lower case, then plain ASCII letters: the form in which texts are matched. Null stays null."""
    return strip_marks(_lower_ascii(_dots(s)))


def fold_latin(s: Column) -> Column:
    """fold for text whose characters all fold to one character (names, keys): no Python at all."""
    src, dst = _single()
    return F.translate(_lower_ascii(s), src, dst)


def ascii_translit(s: Column) -> Column:
    """ASCII letters with the case kept."""
    return strip_marks(F.translate(_dots(s), TURKISH, ASCII))


def fold_case_kept(s: Column) -> Column:
    """ascii_translit for text whose characters all fold to one character."""
    src, dst = _single()
    return F.translate(F.translate(s, TURKISH, ASCII), src, dst)


def collapse_ws(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), r"^ | $", "")


def spelling_forms(s: Column) -> Column:
    """The trimmed text and its ASCII spelling, without repeats and blanks."""
    t = collapse_edges(s)
    return F.array_distinct(F.filter(F.array(t, ascii_translit(t)), lambda x: x.isNotNull() & (x != "")))


def collapse_edges(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def _phrase_body(phrase: Column) -> Column:
    words = F.filter(F.split(fold_latin(phrase), r"(?U)\s+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.regexp_replace(w, r"([\\\[\](){}.*+?^$|])", r"\\$1"), F.when(w.endswith("."), r"\s*").otherwise(r"[\s\-_]+")))
    body = F.regexp_replace(F.array_join(quoted, ""), r"(\\s\*|\[\\s\\-_\]\+)$", "")
    return F.when(F.size(words) > 0, body)


def phrase_pattern(phrase: Column) -> Column:
    """Regular expression that finds a phrase in folded text: words apart by white space, hyphens or underscores (or nothing
    after an initial), not inside other words. Null for a blank phrase."""
    return F.concat(F.lit(r"(?U)(?<!\w)"), _phrase_body(phrase), F.lit(r"(?!\w)"))


def any_phrase_pattern(phrases: Column) -> Column:
    """Regular expression that matches where one of the phrases (an array) does. Null where all are blank or there is none."""
    bodies = F.filter(F.transform(phrases, _phrase_body), lambda b: b.isNotNull())
    return F.element_at(F.transform(F.array(bodies), lambda bs: F.when(F.size(bs) > 0, F.concat(F.lit(r"(?U)(?<!\w)(?:"), F.array_join(bs, "|"), F.lit(r")(?!\w)")))), 1)


def contains_phrase(folded: Column, phrase: Column) -> Column:
    """False for a blank phrase."""
    return F.coalesce(F.call_function("rlike", folded, phrase_pattern(phrase)), F.lit(False))


def match_spans(s: Column, pattern: Column | str) -> Column:
    """array<struct<s,e>> of all matches: the pieces between matches and the matches, with running lengths."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(s, p, F.lit(0))
    pieces = F.slice(F.call_function("split", s, p, F.lit(-1)), F.lit(1), F.size(found))
    zipped = F.arrays_zip(pieces.alias("p"), found.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["p"])
        b = a + F.length(x["m"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("s"), b.alias("e")))).alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def merge_spans(spans: Column) -> Column:
    """Overlapping spans joined; touching ones stay apart."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] < last["e"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, step)


def find_spans(folded: Column, phrases: Column) -> Column:
    """Merged spans of all phrases (an array of phrases) in folded text."""
    return pattern_spans(folded, F.transform(F.filter(phrases, lambda p: p.isNotNull() & (F.trim(p) != "")), phrase_pattern))


def pattern_spans(folded: Column, patterns: Column) -> Column:
    """Merged spans of all patterns (an array) in folded text."""
    return merge_spans(F.flatten(F.transform(patterns, lambda p: match_spans(folded, p))))


def contexts(folded: Column, spans: Column, n: int = 5, width: int = 80) -> Column:
    """The first n spans with width characters around each."""
    return F.transform(F.slice(spans, 1, n), lambda x: collapse_ws(F.substring(folded, F.greatest(x["s"] - width, F.lit(0)) + 1, x["e"] + width - F.greatest(x["s"] - width, F.lit(0)))))


def slug_text(path_and_query: Column) -> Column:
    """Words of a URL's path and query."""
    return F.regexp_replace(F.coalesce(F.try_url_decode(path_and_query), path_and_query), r"[/_\-+.=&?]+", " ")


def md_escape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
