"""Text decoded with the wrong character encoding: find it, learn the transformations, restore the original.

1. twins     texts that are equal once non-ASCII characters are stripped are near-twins; of each set, the one with the fewest
             non-ASCII characters (then the most frequent) is taken as clean.
2. align     between twins the ASCII parts match, so their non-ASCII runs pair up; each pair votes for the transformations (wrong
             decoder, single-character substitution, or, where no known decoder explains it, mapping of a garbled sequence) that
             turn the clean run into the garbled one.
3. apply     transformations with enough votes repair all records, run by run, once and then again for text damaged twice.
             Substitutions that are also letters of correct foreign text apply to a word only if the word they give is known
             from clean text, or if the field holds other such words.
A field in which a damaged character cannot be restored (a replacement character, a torn sequence) is damaged and lost.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The decoders that are tried as wrong ones for UTF-8 bytes, and the repertoire of originals.
WRONG = ("cp1252", "latin-1", "cp1254", "mac_roman", "cp850", "cp437", "cp1250", "cp857", "mac_turkish", "iso8859-9", "iso8859-15", "cp1251")
_REPERTOIRE = [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2010, 0x2050), 0x20AC, 0x20BA, 0x2116, 0x2122, 0x2190, 0x2192, 0x2212, 0x2026, 0x20BD, *range(0x370, 0x500)]
LEAST_VOTES = 2
_CORRECT = frozenset("ýþðÝÞÐçöüğışâîûÇÖÜĞİŞ")  # a sequence of letters that begins with one of these is read as correct text
LOST = "�"
_TURKISH = frozenset("çğıöşüâîûÇĞİÖŞÜÂÎÛ")
# Turkish letters whose byte is another letter in Western Latin.
TURKISH_BYTES = {"ý": "ı", "þ": "ş", "ð": "ğ", "Ý": "İ", "Þ": "Ş", "Ð": "Ğ"}


@lru_cache(maxsize=None)
def _bytes_as(codec: str) -> list[str]:
    """The character of each byte; undefined bytes pass through as control characters, as lenient decoders do."""
    out = []
    for i in range(256):
        try:
            out.append(bytes([i]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(i))
    return out


@lru_cache(maxsize=None)
def sequences(codec: str) -> dict[str, str]:
    """Garbled sequence -> original character, for UTF-8 read as codec."""
    table = _bytes_as(codec)
    twice = [ord(ch) for name in WRONG for ch in _bytes_as(name)[0x80:]]  # what a first damage leaves for a second
    found = {"".join(table[b] for b in chr(c).encode()): chr(c) for c in {*_REPERTOIRE, *twice}}
    return {g: c for g, c in found.items() if not (g[0] in _CORRECT and g.isalpha())}


@lru_cache(maxsize=None)
def controls() -> dict[str, str]:
    """Windows punctuation read as Latin-1 control characters."""
    table = _bytes_as("cp1252")
    return {chr(i): table[i] for i in range(0x80, 0xA0) if table[i] != chr(i)}


Learned = tuple[tuple[str, str], ...]  # garbled sequence, original character: of decoders that WRONG does not name


@lru_cache(maxsize=64)
def _merged(codecs: tuple[str, ...], with_controls: bool, learned: Learned = ()) -> tuple[dict[str, str], int, str, str]:
    """All sequences of the codecs, the first codec winning; the longest length; openers; what can be a torn rest."""
    table: dict[str, str] = {}
    for c in reversed(codecs):
        table.update(sequences(c))
    if with_controls:
        table = controls() | table
    table = dict(learned) | table
    opened = {g[0] for c in codecs for g in sequences(c) if len(g) > 1}
    return table, max([1, *map(len, table)]), "".join(sorted({g[0] for g in table})), "".join(sorted(opened))


@lru_cache(maxsize=64)
def damage_pattern(codecs: tuple[str, ...], with_controls: bool, learned: Learned = ()) -> str:
    """Regular expression (Java and Python alike) without which a text holds nothing to repair: for each codec, a character of a
    first byte before one of a second byte; control characters; the replacement character."""
    chars = lambda cs: "[" + "".join(f"\\u{ord(c):04x}" for c in sorted(set(cs))) + "]"
    parts = []
    for c in codecs:
        two = [g for g in sequences(c) if len(g) > 1]
        parts.append(chars(g[0] for g in two) + chars(g[1] for g in two))
    if learned:
        parts.append(chars(g[0] for g, _ in learned) + chars(g[1] for g, _ in learned))
    # The look-ahead turns ASCII characters away with one test.
    return r"(?=[^\x00-\x7f])(?:" + "|".join([*parts, *([chars(controls())] if with_controls else []), LOST]) + ")"


@lru_cache(maxsize=64)
def _damage(codecs: tuple[str, ...], with_controls: bool, learned: Learned = ()) -> re.Pattern[str]:
    return re.compile(damage_pattern(codecs, with_controls, learned))


_RUN = re.compile(r"[^\x00-\x7f]+")
_RUN_OR_QUERY = re.compile(r"[^\x00-\x7f]+|\?+")
#: Question marks where letters belong: inside a word, at its start, or between full stops; not in addresses and formulas.
QUERY_LOSS = r"(?:^|[\s(\[«\"'|,;:-])[^\s/=&.@<>?\"]*(?:\p{L}\?+\p{L}|(?<![\p{L}\p{N}/=&.@?])\?+\p{L}\p{L})|\p{L}\.\?\.|\p{L}\?['’]\p{L}"


def _pass(text: str, codecs: tuple[str, ...], with_controls: bool, learned: Learned = ()) -> tuple[str, int]:
    table, longest, _, _ = _merged(codecs, with_controls, learned)
    fixed = 0

    def run(m: re.Match[str]) -> str:
        nonlocal fixed
        s, i, out = m[0], 0, []
        while i < len(s):
            for n in range(min(longest, len(s) - i), 0, -1):
                hit = table.get(s[i : i + n])
                if hit is not None:
                    out.append(hit)
                    fixed += 1
                    i += n
                    break
            else:
                out.append(s[i])
                i += 1
        return "".join(out)

    return _RUN.sub(run, text), fixed


def _codec_order(text: str, codecs: tuple[str, ...]) -> tuple[str, ...]:
    """The codecs whose sequences cover most of this text's non-ASCII characters first: a text has one history as a rule."""
    runs = Counter(_RUN.findall(text))
    best = {}
    for c in codecs:
        table = sequences(c)
        covered = 0
        for s, times in runs.items():
            i = 0
            while i < len(s):
                for n in (3, 2):
                    if s[i : i + n] in table and len(s[i : i + n]) == n:
                        covered += n * times
                        i += n
                        break
                else:
                    i += 1
        best[c] = covered
    return tuple(sorted(codecs, key=lambda c: (-best[c], codecs.index(c))))


def repair(text: str, codecs: tuple[str, ...] = WRONG[:6], with_controls: bool = True, passes: int = 2, learned: Learned = ()) -> tuple[str, bool, bool]:
    """(text, damaged, lost) after undoing wrong decodings of UTF-8, at most `passes` times over."""
    if text.isascii():
        return text, False, False
    damaged = False
    for _ in range(passes):
        if not _damage(codecs, with_controls, learned).search(text):
            break
        order = _codec_order(text, codecs)
        text, n = _pass(text, order, with_controls, learned)
        damaged |= n > 0
        if not n:
            break
    lost = LOST in text
    if damaged and not lost:
        lost = any(0x80 <= ord(ch) < 0xA0 for ch in text)
    return text, damaged or lost, lost


@lru_cache(maxsize=20_000)
def plain_repair(text: str) -> str:
    return text if text.isascii() else repair(text)[0]


@lru_cache(maxsize=64)
def _suspect_words(letters: str) -> tuple[re.Pattern[str], re.Pattern[str]]:
    """Words with one of these letters (signs count as letters too); words with no letters but these and Turkish ones."""
    return re.compile(rf"(?:[^\W\d_]|[{letters}])*[{letters}](?:[^\W\d_]|[{letters}])*"), re.compile(rf"[A-Za-zçöüÇÖÜâîûÂÎÛ{letters}]+")


_FOREIGN = re.compile(r"[áàãåæéèêëíìïñóòôõøúùßđčćšžłńśźżāēīūģķļņ]", re.I)  # letters that the neighbours of a foreign name hold


def suspects(text: str, swaps: dict[str, str] = TURKISH_BYTES) -> list[str]:
    """Words that the substitutions, such as Turkish bytes read as Western Latin, may have given (no other foreign letter in them)."""
    word, plain = _suspect_words("".join(swaps))
    return [w for w in word.findall(text) if plain.fullmatch(w)]


def substitute(text: str, known: frozenset[str], foreign: frozenset[str] = frozenset(), swaps: dict[str, str] = TURKISH_BYTES) -> tuple[str, bool]:
    """Undo the substitutions in words whose clean form is known; if there are any, in the other suspects as well."""
    word, plain = _suspect_words("".join(swaps))
    table = str.maketrans(swaps)
    good = {w for w in suspects(text, swaps) if w.translate(table) in known and w not in foreign}
    if not good:
        return text, False

    def swap(m: re.Match[str]) -> str:
        w = m[0]
        if w in good:
            return w.translate(table)
        near = text[max(0, m.start() - 24) : m.start()].split(" ")[-2:-1] + text[m.end() : m.end() + 24].split(" ")[1:2]
        if w in foreign or not plain.fullmatch(w) or any(_FOREIGN.search(x.translate(table)) for x in near):
            return w
        return w.translate(table)

    return word.sub(swap, text), True


def explain(garbled: str, clean: str) -> list[str]:
    """The transformations that turn clean into garbled: names of wrong decoders, '2:' before those applied twice, 'c1' for
    control characters, '1:xy' for the substitution of one letter, 'm:' with a garbled sequence and the letter it stands for where
    no named decoder fits, 'lost:' and the character that stands for lost ones."""
    out = []
    if set(garbled) <= {"?", LOST} and not clean.isascii():
        return ["lost:" + garbled[0]]
    for codec in WRONG:
        table = _bytes_as(codec)
        once = "".join(table[b] for b in clean.encode("utf-8", "surrogatepass"))
        if once == garbled:
            out.append(codec)
        elif len(garbled) > 3 and "".join(table[b] for b in once.encode("utf-8", "surrogatepass")) == garbled:
            out.append("2:" + codec)
    if not out and len(garbled) == len(clean):
        for g, c in zip(garbled, clean):
            if g != c:
                out.append("c1" if controls().get(g) == c else f"1:{g}{c}")
    each = len(garbled) // max(len(clean), 1)
    if not out and each in (2, 3) and len(garbled) == each * len(clean):
        out = [f"m:{garbled[i * each : (i + 1) * each]}{c}" for i, c in enumerate(clean)]
    return out


def sequences_learned(votes: dict[str, int], least: int = LEAST_VOTES) -> Learned:
    """Garbled sequences that no named decoder explains, with the letter most twins gave them. Letters of correct text are none."""
    count: dict[str, tuple[int, str]] = {}
    for name, n in votes.items():
        g, c = name[2:-1], name[-1:]
        if name.startswith("m:") and len(g) > 1 and n >= least and not (g[0] in _CORRECT and g.isalpha()) and c not in g and LOST not in g:
            count[g] = max(count.get(g, (0, "")), (n, c))
    return tuple(sorted((g, c) for g, (_, c) in count.items()))


def skeleton(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7f]+|\?+", "")


def query_loss(text: Column, html: bool = False) -> Column:
    """Letters were replaced by question marks. In html only the text between tags counts."""
    if not html:
        return text.contains("?") & text.rlike(QUERY_LOSS)
    bare = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    # The first test starts at question marks and wants a tag to open next, not to close: few pages come to the second.
    return text.rlike(r"(?<=[\p{L}\s(>.])\?+[\p{L}.'’][^<>]*(?:<|\z)") & bare.rlike(QUERY_LOSS)


def learn(texts: DataFrame, least: int = LEAST_VOTES) -> dict[str, int]:
    """Votes per transformation. texts: one string column `text` (null, blank and ASCII-only texts are of no use here).

    The twins join is between distinct texts and one clean text per skeleton, so it stays linear in them; a text that makes up a
    third of all rows is one row after map-side aggregation. What comes to the driver is one row per transformation.
    """
    rows = texts.where((F.col("text").rlike(r"[^\x00-\x7f]") | query_loss(F.col("text"))) & F.col("text").rlike(r"[A-Za-z]{2}"))
    rows = rows.groupBy("text").agg(F.count("*").alias("n"))
    sk = skeleton(F.col("text"))
    rows = rows.select("text", "n", F.xxhash64(sk).alias("sk"), (F.length("text") - F.length(sk)).alias("extra"))
    rows = rows.withColumn("extra", F.col("extra") + F.when(F.col("text").contains(LOST) | query_loss(F.col("text")), 1_000_000).otherwise(0))
    clean = rows.groupBy("sk").agg(F.min_by(F.struct("text", "n"), F.struct("extra", -F.col("n"), F.length(F.regexp_replace("text", "[" + "".join(TURKISH_BYTES) + "]", "")).alias("plain") * -1, "text")).alias("c"), F.count("*").alias("k")).where("k > 1")
    pairs = rows.join(clean, "sk").where("text != c.text").select(F.col("text").alias("g"), F.col("c.text").alias("c"))

    @F.pandas_udf("array<string>")
    def votes(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for g, c in it:
            out = []
            for a, b in zip(g, c):
                names: list[str] = []
                if _RUN_OR_QUERY.sub("\0", a) == _RUN_OR_QUERY.sub("\0", b):
                    for x, y in set(zip(_RUN_OR_QUERY.findall(a), _RUN_OR_QUERY.findall(b))):
                        if x != y:
                            names += explain(x, y)
                out.append(sorted(set(names)))
            yield pd.Series(out)

    counted = pairs.select(F.explode(votes("g", "c")).alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    got = counted.limit(100_001).collect()
    if len(got) > 100_000:
        raise ValueError("twins vote for over 100,000 transformations: these are not differences of encoding")
    return {r["t"]: r["n"] for r in got}


def substitutions(votes: dict[str, int], least: int = LEAST_VOTES) -> dict[str, str]:
    """Letter -> original, from the votes '1:xy'. The six Turkish bytes go together, with any vote.

    Of two twins with as many letters the clean one is a guess, so a vote that turns a Turkish letter into another one counts the
    other way round. Turkish letters themselves, as ö and ü in two correct words, are no damage.
    """
    count: dict[tuple[str, str], int] = {}
    for name, n in votes.items():
        if name.startswith("1:") and len(name) == 4:
            g, c = name[2:]
            g, c = (c, g) if g in _TURKISH and c not in _TURKISH else (g, c)
            if c in _TURKISH and g not in _TURKISH and not g.isascii() and g != LOST:
                count[g, c] = count.get((g, c), 0) + n
    out: dict[str, str] = {}
    for (g, c), n in sorted(count.items(), key=lambda x: (-x[1], x[0])):
        if n >= least:
            out.setdefault(g, c)
    return out | (TURKISH_BYTES if any(votes.get(f"1:{g}{c}", 0) for g, c in TURKISH_BYTES.items()) else {})


def chosen(votes: dict[str, int]) -> tuple[tuple[str, ...], bool, dict[str, str]]:
    """(wrong decoders, control characters, substitutions) that the votes support, most votes first."""
    codecs = [c for c in WRONG if votes.get(c, 0) + votes.get("2:" + c, 0) > 0]
    codecs.sort(key=lambda c: (-(votes.get(c, 0) + votes.get("2:" + c, 0)), WRONG.index(c)))
    return tuple(codecs), votes.get("c1", 0) > 0, substitutions(votes)


def segments(html: Column) -> Column:
    """Text between tags, as an array."""
    return F.filter(F.split(html, r"<[^>]*>"), lambda x: F.length(F.trim(x)) > 0)


def restore(df: DataFrame, keys: list[str], text: str, votes: dict[str, int], vocabulary: DataFrame | None = None, html: bool = False) -> DataFrame:
    """keys, fixed, lost: one row per row of df whose text is damaged; fixed is the whole restored text, null if lost.

    Null, empty, ASCII-only and correct texts give no row; repeated rows come out as often as they are; very long texts are read
    whole. vocabulary (column `word`) holds clean words; it decides the substitutions that correct foreign text also has.
    """
    codecs, c1, swaps = chosen(votes)
    learned = sequences_learned(votes)
    marks = damage_pattern(codecs, c1, learned) + ("|[" + "".join(swaps) + "]" if swaps else "")
    queries = query_loss(F.col("t"), html) if votes.get("lost:?") else F.lit(False)
    rows = df.select(*keys, F.col(text).alias("t")).withColumn("q", queries).where(F.col("q") | F.col("t").rlike(marks))

    @F.pandas_udf("struct<fixed:string,damaged:boolean,lost:boolean,words:array<string>>")
    def fix(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            got = [repair(x, codecs, c1, learned=learned) for x in s]
            yield pd.DataFrame({"fixed": [g[0] for g in got], "damaged": [g[1] for g in got], "lost": [g[2] for g in got], "words": [sorted(set(suspects(g[0], swaps))) if swaps else [] for g in got]})

    fix = fix.asNondeterministic()  # else the filter below is evaluated with the UDF over all rows
    rows = rows.select(*keys, "q", fix("t").alias("f")).select(*keys, "f.fixed", (F.col("f.damaged") | F.col("q")).alias("damaged"), (F.col("f.lost") | F.col("q")).alias("lost"), "f.words")
    if swaps and vocabulary is not None:
        rows = _with_substitutions(rows, keys, vocabulary, swaps)
    return rows.where("damaged").select(*keys, F.when(~F.col("lost"), F.col("fixed")).alias("fixed"), "lost")


def _with_substitutions(rows: DataFrame, keys: list[str], vocabulary: DataFrame, swaps: dict[str, str]) -> DataFrame:
    from veyra.session import cut

    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()), "repaired")
    asked = rows.where(F.size("words") > 0).select("rid", F.explode("words").alias("w"))
    asked = asked.select("rid", "w", F.translate("w", "".join(swaps), "".join(swaps.values())).alias("word"))
    hits = asked.select("word").distinct().join(vocabulary, "word", "left_semi")
    known = asked.join(hits, "word", "left_semi").groupBy("rid").agg(F.collect_set("word").alias("known"))  # words of one text only

    @F.pandas_udf("struct<fixed:string,changed:boolean>")
    def swap(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for t, k in it:
            got = [substitute(x, frozenset(y), swaps=swaps) for x, y in zip(t, k)]
            yield pd.DataFrame({"fixed": [g[0] for g in got], "changed": [g[1] for g in got]})

    changed = rows.join(known, "rid").select("rid", swap("fixed", "known").alias("s"))
    out = rows.join(changed, "rid", "left")
    return out.select(*keys, F.coalesce("s.fixed", "fixed").alias("fixed"), (F.col("damaged") | F.coalesce("s.changed", F.lit(False))).alias("damaged"), "lost")


def clean_words(texts: DataFrame) -> DataFrame:
    """Distinct words with a letter that only Turkish has, from texts without marks of damage."""
    ok = texts.where(F.col("text").rlike("[ışğİŞĞ]"))
    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w.rlike("[ışğİŞĞ]"))
    return ok.select(F.explode(F.array_distinct(words)).alias("word")).distinct()
