import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veyra.functions import text


def one(spark, expr, schema="s string", *row):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()["x"]


def python_fold(s):
    s = s.replace("I", "ı").replace("İ", "i").lower().translate(str.maketrans(text.TURKISH, text.ASCII))
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@pytest.mark.parametrize("s", ["AHMET YILMAZ", "Ahmet Yılmaz", "ahmet yilmaz"])
def test_fold_spellings(spark, s):
    assert one(spark, text.fold(F.col("s")), "s string", s) == "ahmet yilmaz"


def test_fold_other_letters(spark):
    rows = ["ŞÇĞÜÖ", "İSTANBUL", "ﬁn ½ ①", "Ångström", "naïve", "", None, "ÀÉ日本", "é", "…™", "한글"]
    got = [r["x"] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(text.fold(F.col("s")).alias("x")).collect()]
    assert got == [None if x is None else python_fold(x) for x in rows]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=30, max_size=60))
def test_fold_equals_unicodedata(spark, texts):
    texts = [t for t in texts if "\x00" not in t and not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(text.ascii_translit(F.col("s")).alias("x")).collect()]
    want = ["".join(c for c in unicodedata.normalize("NFKD", t.translate(str.maketrans(text.TURKISH, text.ASCII))) if not unicodedata.combining(c)) for t in texts]
    assert got == want


def test_fold_of_odd_characters_is_quick(spark):
    def seconds(word):
        df = spark.range(4000).coalesce(1).select(F.concat_ws(" ", F.col("id").cast("string"), F.lit(word * 50)).alias("s"))
        began = time.time()
        assert df.select(F.sum(F.length(text.fold(F.col("s"))))).first()[0] > 0
        return time.time() - began

    seconds("ab…½")  # compiles
    assert seconds("ab…½") < 10 * seconds("abcd") + 10  # over a map of all characters: a thousand times


def test_any_phrase_pattern(spark):
    rows = [("ada  yilmaz", True), ("a.yilmaz", True), ("adayilmaz", False), ("ada yilmazer", False), ("x c++ y", True)]
    df = spark.createDataFrame(rows, "s string, w boolean").withColumn("p", text.any_phrase_pattern(F.array(F.lit("Ada Yılmaz"), F.lit(" "), F.lit(None), F.lit("A. Yılmaz"), F.lit("C++"))))
    assert [r["x"] for r in df.select(F.call_function("rlike", "s", F.col("p")).alias("x")).collect()] == [w for _, w in rows]
    assert one(spark, text.any_phrase_pattern(F.array(F.col("s"))), "s string", " ") is None


def test_translit_and_forms(spark):
    assert one(spark, text.ascii_translit(F.col("s")), "s string", "İstanbul Şişli Çağlayan Göğüş Ünlü") == "Istanbul Sisli Caglayan Gogus Unlu"
    assert one(spark, text.spelling_forms(F.col("s")), "s string", " Şule ") == ["Şule", "Sule"]
    assert one(spark, text.spelling_forms(F.col("s")), "s string", "Anna") == ["Anna"]


def spans(spark, s, phrases):
    df = spark.createDataFrame([(s, phrases)], "s string, p array<string>").select(text.fold(F.col("s")).alias("t"), "p")
    x = df.select(text.find_spans(F.col("t"), F.col("p")).alias("x")).first()["x"]
    return [(a["s"], a["e"]) for a in x]


def test_mentions(spark):
    s = "Ahmet Yılmaz, AHMET YILMAZ ve ahmet-yilmaz; Mehmet Yılmaz, Ahmetyılmaz"
    assert len(spans(spark, s, ["Ahmet Yılmaz"])) == 3
    assert len(spans(spark, s, ["Ahmet Yılmaz", "Yılmaz", " ", None])) == 4
    assert spans(spark, "", ["x"]) == []


def test_touching_spans_stay_apart(spark):
    x = one(spark, text.merge_spans(F.col("a")), "a array<struct<s:int,e:int>>", [(8, 9), (0, 5), (3, 8)])
    assert [(a["s"], a["e"]) for a in x] == [(0, 8), (8, 9)]


def test_initials_and_blank_phrase(spark):
    assert len(spans(spark, "A.Yılmaz ve A. Yılmaz", ["A. Yılmaz"])) == 2
    assert one(spark, text.contains_phrase(F.col("s"), F.lit("  ")), "s string", "x") is False


def test_contexts_and_slug(spark):
    sp = text.find_spans(F.col("s"), F.array(F.lit("ada")))
    assert one(spark, text.contexts(F.col("s"), sp, 1, 4), "s string", "bir  ada  var") == ["ir ada va"]
    assert one(spark, text.slug_text(F.col("s")), "s string", "/u/ada_ok?x=%C3%BC&y=%zz") == " u ada ok x %C3%BC y %zz"


def test_folding_takes_no_python(spark):
    rows = ["ﬁne ½ … é İIıi ＡＢ 𝐀x ㎏ ǆ", "plain", "Şükrü ÇAĞ", None, "", "ö" * 30_000 + "\u0301"]
    df = spark.createDataFrame([(x,) for x in rows], "t string").select("t", text.fold(F.col("t")).alias("f"))
    low = lambda x: text._strip(x.translate(str.maketrans("Iİ", "ıi")).lower().translate(str.maketrans(text.TURKISH, text.ASCII)))
    assert {r["t"]: r["f"] for r in df.collect()} == {x: None if x is None else low(x) for x in rows}
    assert "Python" not in df._jdf.queryExecution().toString()
