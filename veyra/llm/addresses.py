"""Postal addresses of one building written in many ways.

1. parse    each text gives components: street, street type, door number, neighbourhood, postcode, places; flat, floor and unit go.
2. respell  a rare phrase, else a rare word, of a street, neighbourhood or place that is one edit away from a far more frequent
            one of the same field becomes that one (deletion-variant join: nothing is compared without a shared variant).
3. block    distinct component tuples meet on (street sound, number, district), on (street sound, number) where a district
            is missing, and on (postcode, number).
4. compare  agreement, disagreement or a missing value per component, and near agreement of streets; expectation-maximisation
            over the counts of comparison patterns gives Fellegi-Sunter weights, the missing level included. They decide.
5. pair     linked tuples expand to pairs of records. A tuple with many records is salted on both sides.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veyra.session import cut

# Street types and markers after folding to lower-case ASCII.
STREET_TYPES = {
    "sokak": "sokak", "sokagi": "sokak", "sok": "sokak", "sk": "sokak", "cadde": "cadde", "caddesi": "cadde", "cad": "cadde", "cd": "cadde",
    "bulvar": "bulvar", "bulvari": "bulvar", "bulv": "bulvar", "blv": "bulvar", "meydan": "meydan", "meydani": "meydan", "yol": "yol", "yolu": "yol",
}
WESTERN_TYPES = {
    "st": "street", "str": "street", "street": "street", "ave": "avenue", "av": "avenue", "avenue": "avenue", "rd": "road", "road": "road", "ln": "lane", "lane": "lane",
    "dr": "drive", "drive": "drive", "blvd": "boulevard", "boulevard": "boulevard", "ct": "court", "court": "court", "pl": "place", "place": "place", "way": "way", "sq": "square", "square": "square", "close": "close",
}
_TR = str.maketrans({"ı": "i", "İ": "i", "I": "i", "â": "a", "î": "i", "û": "u"})
_type = re.compile(r"\b(%s)\b\.?" % "|".join(sorted(STREET_TYPES, key=len, reverse=True)))
_western = re.compile(r"(?:^|[,\s])(\d+[a-z]?)\s+((?:[a-z'’]+\s+)+?)(%s)\b\.?" % "|".join(sorted(WESTERN_TYPES, key=len, reverse=True)))
_unit = re.compile(r"\b(?:flat|apt|apartment|unit|suite|floor|room)\s*\.?\s*#?\d+[a-z]?\b,?")
_british = re.compile(r"\b([a-z]{1,2}\d[a-z\d]?)\s*(\d[a-z]{2})\b")
_number = re.compile(r"^\s*[.,:]?\s*(?:(?:no|numara|nr|n|kapi no)\s*[.:]*\s*)?(\d+[a-z]?)\b(?:\s*/\s*\d+[a-z]?)?")
_any_number = re.compile(r"\b(?:no|numara|nr|n)\s*[.:]*\s*(\d+[a-z]?)\b(?:\s*/\s*\d+)?")
_flat = re.compile(r"\b(?:kat|k|daire|d|blok|ic kapi(?: no)?)\s*[.:]+\s*\w+|\b(?:kat|daire)\s+\d+")
_hood = re.compile(r"([a-z][a-z' ]*?)\s*\b(?:mahallesi|mahalle|mah|mh)\b\.?")
_post = re.compile(r"(?<!\d)\d{5}(?!\d)")


def fold(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", s.translate(_TR).lower()) if not unicodedata.combining(ch))


class Address(NamedTuple):
    street: str
    stype: str
    number: str
    hood: str
    postcode: str
    places: list[str]  # smallest first


def parse(text: str | None) -> Address | None:
    """Components of one address text; '' where one is missing; None for null, blank or a text without street or number."""
    if not text or not text.strip():
        return None
    s = re.sub(r"\s+", " ", fold(text)).strip()
    w = _western.search(_unit.sub(" ", s))
    if w and not _type.search(s):
        rest = _unit.sub(" ", s)
        code = _british.search(rest)
        rest = rest[: w.start()] + " , " + rest[w.end() :]
        rest = _british.sub(" ", rest)
        places = [re.sub(r"[^a-z ]", "", p).strip() for p in re.split(r"[,/]| - ", rest)]
        return Address(w[2].strip(), WESTERN_TYPES[w[3]], w[1].lstrip("0") or "0", "", code[1] + code[2] if code else "", [re.sub(r" +", " ", p) for p in places if p])
    m = None
    for m in _type.finditer(s):
        if m.start() > 0 and re.search(r"[a-z]", s[: m.start()]):
            break
    if m is None:
        return None
    postcode = _post.search(s)
    before, after = s[: m.start()], s[m.end() :]
    number = _number.match(after) or _any_number.search(after)
    if number is None:
        return None
    pieces = [p.strip() for p in re.split(r"[,/]| - ", before)]
    street = pieces.pop()
    hood = ""
    h = _hood.search(street)
    if h:
        hood, street = h[1].strip(), street[h.end() :].strip()
    rest = pieces + [p for p in re.split(r"[,/]| - ", _flat.sub(" ", after[: number.start()] + " , " + after[number.end() :]))]
    places: list[str] = []
    for p in rest:
        h = _hood.search(p)
        if h:
            hood = hood or h[1].strip()
            p = p[: h.start()] + " " + p[h.end() :]
        p = re.sub(r"[^a-z ]", " ", _post.sub(" ", p)).strip()
        places += p.split()
    if " - " in s or (pieces and len(places) > 1 and " - " in before):
        places = places[::-1]
    street = re.sub(r"[^a-z0-9 ]", "", street).strip()
    return Address(re.sub(r" +", " ", street), STREET_TYPES[m[1]], number[1].lstrip("0") or "0", re.sub(r" +", " ", hood), postcode[0] if postcode else "", places) if street else None


def parsed(records: DataFrame, text: str = "address_text", key: str = "addr_id") -> DataFrame:
    """key, street, stype, number, hood, postcode, places of the records that hold an address."""
    schema = "struct<street:string,stype:string,number:string,hood:string,postcode:string,places:array<string>>"

    @F.pandas_udf(schema)
    def of(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in it:
            got = [parse(x) for x in batch]
            yield pd.DataFrame([tuple(g) if g else (None, None, None, None, None, None) for g in got], columns=["street", "stype", "number", "hood", "postcode", "places"])

    of = of.asNondeterministic()  # once, although its result is filtered on
    return records.select(F.col(key).alias("id"), F.col(text).alias("t")).where("t is not null").select("id", of("t").alias("a")).where("a.street is not null").select("id", "a.*")


RARE = 0.2  # a misspelt word is at most this often as the word it stands for
FREQUENT = 5  # a word that others are respelt to stands in at least so many records
LEAST = 4  # characters a word needs to be respelt


def respellings(words: DataFrame) -> DataFrame:
    """(field, word, right): rare words one edit (insertion, deletion, substitution, swap) from a frequent word of their field.
    words: field, word, n. Words meet on shared deletion variants only."""
    w = words.where(F.length("word") >= LEAST)
    variants = w.select("field", "word", "n", F.explode(F.array_union(F.array("word"), F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word")))))).alias("v"))
    rare = variants.select("field", "v", F.col("word").alias("word"), F.col("n").alias("m"))
    good = variants.where(F.col("n") >= FREQUENT).select("field", "v", F.col("word").alias("right"), "n")
    near = rare.join(good, ["field", "v"]).where((F.col("word") != F.col("right")) & (F.col("m") <= RARE * F.col("n")))
    swap = (F.length("word") == F.length("right")) & (F.levenshtein("word", "right") == 2) & (F.array_sort(F.split("word", "")) == F.array_sort(F.split("right", "")))
    near = near.where((F.levenshtein("word", "right") <= 1) | swap).select("field", "word", "right", "n").distinct()
    return near.groupBy("field", "word").agg(F.max_by("right", F.struct("n", "right")).alias("right"))


def _said(rows: DataFrame) -> DataFrame:
    """(tid, n, field, i, p): the phrases of each tuple."""
    one = lambda field, c: F.array(F.struct(F.lit(field).alias("field"), F.lit(0).alias("i"), F.col(c).alias("p")))
    places = F.transform("places", lambda x, i: F.struct(F.lit("place").alias("field"), i.alias("i"), x.alias("p")))
    return rows.select("tid", "n", F.inline(F.concat(one("street", "street"), one("hood", "hood"), places))).where("p != ''")


def respell(rows: DataFrame) -> DataFrame:
    """rows (tid, n, street, stype, number, hood, postcode, places) with the phrases of street, hood and places respelt."""
    said = _said(rows)
    phrases = cut(said.groupBy("field", "p").agg(F.sum("n").alias("n")), "address-phrases")
    words = phrases.select("field", "p", "n", F.posexplode(F.split("p", " ")).alias("i", "word")).where("word != ''")
    right = respellings(words.groupBy("field", "word").agg(F.sum("n").alias("n")))
    # A phrase one edit from a frequent phrase becomes that; only then are its words looked at one by one.
    whole = respellings(phrases.select("field", F.col("p").alias("word"), "n")).select("field", F.col("word").alias("p"), F.col("right").alias("whole"))
    by_word = words.join(right, ["field", "word"], "left").groupBy("field", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("right", "word").alias("w")))), lambda x: x["w"]), " ").alias("q"))
    fixed = cut(by_word.join(whole, ["field", "p"], "left").select("field", "p", F.coalesce("whole", "q").alias("q")).where("p != q"), "address-respelt")
    got = said.join(fixed, ["field", "p"], "left").select("tid", F.struct("field", "i", F.coalesce("q", "p").alias("p")).alias("x"))
    got = got.groupBy("tid").agg(F.array_sort(F.collect_list("x")).alias("x"))  # the phrases of one address
    of = lambda field: F.transform(F.filter("x", lambda x: x["field"] == field), lambda x: x["p"])
    got = got.select("tid", F.coalesce(F.get(of("street"), F.lit(0)), F.lit("")).alias("street"), F.coalesce(F.get(of("hood"), F.lit(0)), F.lit("")).alias("hood"), of("place").alias("places"))
    return rows.select("tid", "stype", "number", "postcode").join(got, "tid")


def placed(rows: DataFrame) -> DataFrame:
    """District and province out of all places: in texts with several the district comes first as a rule; a place is a province
    if it mostly stands after another one."""
    seen = rows.where(F.size("places") > 1).select(F.posexplode("places").alias("i", "p"))
    big = seen.groupBy("p").agg(F.avg((F.col("i") == 0).cast("int")).alias("share")).where("share < 0.5").select("p", F.lit(True).alias("big"))
    each = rows.select("tid", F.posexplode("places").alias("i", "p")).join(big, "p", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    first = lambda cond: F.min_by(F.when(cond, F.col("p")), F.when(cond, F.col("i")))
    both = each.groupBy("tid").agg(first(~F.col("big")).alias("district"), first(F.col("big")).alias("province"))
    out = rows.drop("places").join(both, "tid", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("district", "province")})


COMPARED = ("district", "stype", "hood", "postcode", "province", "street")


# How often a component is believed to differ in matches and in other pairs, where both have it, before anything is learned. A
# missing value is believed to say nothing; of streets, 0.15 of either are near.
DIFFERS = {"district": 0.005, "stype": 0.005, "street": 0.005}
USUAL, OTHERS, NEAR_SHARE = 0.06, 0.75, 0.15
PULL = 0.4  # weight of that beside what is learned, as a share of all pairs


def estimate(patterns: dict[tuple[int, ...], int], steps: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """EM for the two-class model with three levels (0 differs, 1 agrees, 2 missing; of streets 2 is near) per component: share of
    matches, m, u. A pair that met in a block is at most as likely as not to match before its components are compared."""
    k = len(COMPARED)
    keys = sorted(patterns)
    x, w = np.array(keys, dtype=int).reshape(len(keys), k), np.array([patterns[p] for p in keys], dtype=float)
    cast, share = np.stack([x == level for level in range(3)], axis=2).astype(float), 0.3
    third = np.clip((cast[:, :, 2] * w[:, None]).sum(0) / max(w.sum(), 1.0), 0.01, 0.98)
    third[COMPARED.index("street")] = NEAR_SHARE
    believed = lambda differs: np.stack([(1 - third) * differs, (1 - third) * (1 - differs), third], axis=1)
    m, u = believed(np.array([DIFFERS.get(c, USUAL) for c in COMPARED])), believed(np.full(k, OTHERS))
    start, pull = (m, u), PULL * w.sum()
    for _ in range(steps if len(keys) else 0):
        q = match_probability(x, share, m, u)
        share = float(np.clip((q * w).sum() / w.sum(), 0.01, 0.5))
        m, u = ((cast * (r * w)[:, None, None]).sum(0) + pull * s for r, s in ((q, start[0]), (1 - q, start[1])))
        m, u = (np.clip(t / t.sum(1, keepdims=True), 1e-4, 1.0) for t in (m, u))
    return share, m, u


def match_probability(x: np.ndarray, share: float, m: np.ndarray, u: np.ndarray) -> np.ndarray:
    log = np.log(share / (1 - share)) + sum(np.log(m[j, x[:, j]] / u[j, x[:, j]]) for j in range(x.shape[1]))
    return 1 / (1 + np.exp(-np.clip(log, -50, 50)))


SOUND = r"[aeiou ]+"


NEAR = 2  # edits between streets that count as near
MATCH = 0.5


def linked(tuples: DataFrame, least: float = MATCH) -> DataFrame:
    """(a, b): ids of distinct tuples that denote one building, a < b: those that meet in a block and whose weights give a
    probability of at least `least`. tuples: tid, street, stype, number, district, hood, postcode, province."""
    t = tuples.withColumn("sound", F.regexp_replace("street", SOUND, ""))
    lacking, has_code = F.col("district") == "", F.col("postcode") != ""
    key = lambda kind, cond, *cs: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), *cs).alias("key")))
    exact, code = key("d", ~lacking, "sound", "number", "district"), key("p", has_code, "postcode", "number")
    cols = ["tid", "sound", "street", "stype", "number", "district", "hood", "postcode", "province"]
    side = lambda s, *keys: t.select(F.inline(F.array_compact(F.array(*keys))), *[F.col(c).alias(f"{s}_{c}") for c in cols])
    a = side("a", exact, code, key("n", lacking, "sound", "number"))
    b = side("b", exact, code, key("n", F.lit(True), "sound", "number")).drop("kind")
    met = a.join(b, "key").where((F.col("a_tid") < F.col("b_tid")) | (F.col("kind") == "n") & (F.col("a_tid") != F.col("b_tid")))
    met = met.where((F.col("a_number") == F.col("b_number")))
    level = lambda k: (F.when((F.col("a_" + k) == "") | (F.col("b_" + k) == ""), 2).when(F.col("a_" + k) == F.col("b_" + k), 1).otherwise(0)).alias("l_" + k)
    street = F.when(F.col("a_street") == F.col("b_street"), 1).when(F.levenshtein("a_street", "b_street") <= NEAR, 2).otherwise(0).alias("l_street")
    low, high = F.least("a_tid", "b_tid"), F.greatest("a_tid", "b_tid")
    pairs = cut(met.select(low.alias("a"), high.alias("b"), *[level(k) for k in COMPARED[:-1]], street).distinct(), "address-pairs")
    names = ["l_" + k for k in COMPARED]
    counts = {tuple(r[n] for n in names): r["n"] for r in pairs.groupBy(*names).agg(F.count("*").alias("n")).collect()}  # at most 3^6
    share, m, u = estimate(counts)
    keys = sorted(counts)
    p = match_probability(np.array(keys, dtype=int).reshape(len(keys), len(names)), share, m, u) if keys else []
    weights = pairs.sparkSession.createDataFrame([(*map(int, k), float(v)) for k, v in zip(keys, p)], ", ".join(f"{n} int" for n in names) + ", p double")
    return pairs.join(F.broadcast(weights), names).where(F.col("p") >= least).select("a", "b")


SALT_ROWS = 2_000


def same_building(records: DataFrame, text: str = "address_text", key: str = "addr_id", least: float = MATCH) -> DataFrame:
    """(addr_a, addr_b): all pairs of records of one building, addr_a < addr_b.

    Null, blank and unreadable addresses pair only with records written exactly alike (blank ones with none). Repeated rows are
    records of their own. An empty table gives no pairs.
    """
    read = parsed(records, text, key).withColumn("wid", F.xxhash64("street", "stype", "number", "hood", "postcode", F.array_join("places", "/")))
    read = cut(read, "addresses")
    written = read.groupBy("wid").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("street", "stype", "number", "hood", "postcode", "places")])
    parts = ["street", "stype", "number", "hood", "postcode", "district", "province"]
    spelt = cut(placed(respell(written.withColumnRenamed("wid", "tid"))).select(F.col("tid").alias("wid"), F.xxhash64(*parts).alias("tid"), *parts), "components")
    rows = read.select("id", "wid").join(spelt.select("wid", "tid"), "wid")
    links = linked(spelt.select("tid", *parts).distinct(), least)
    known = rows.select("id", "tid")
    plain = records.select(F.col(key).alias("id"), F.trim(text).alias("t")).where("t != ''").join(known.select("id"), "id", "left_anti").select("id", F.xxhash64("t", F.lit("as written")).alias("tid"))
    members = known.unionByName(plain)
    sizes = members.groupBy("tid").agg(F.count("*").alias("n"))
    within = sizes.where("n > 1").select(F.col("tid").alias("a"), F.col("tid").alias("b"))
    edges = within.unionByName(links).join(sizes.select(F.col("tid").alias("a"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("s")), "a")
    left = members.select(F.col("tid").alias("a"), F.col("id").alias("i"))
    left = edges.join(left, "a").select("b", "a", "i", F.pmod(F.xxhash64("i"), F.col("s")).cast("int").alias("part"))
    spread = sizes.select(F.col("tid").alias("b")).join(edges, "b").groupBy("b").agg(F.max("s").alias("s"))
    right = members.select(F.col("tid").alias("b"), F.col("id").alias("j")).join(spread, "b").select("b", "j", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("part"))
    pairs = left.join(right, ["b", "part"]).where((F.col("a") != F.col("b")) | (F.col("i") < F.col("j")))
    return pairs.select(F.least("i", "j").alias("addr_a"), F.greatest("i", "j").alias("addr_b")).where("addr_a < addr_b").distinct()
