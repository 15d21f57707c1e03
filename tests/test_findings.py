import datetime as dt

import pytest
from pyspark.sql import functions as F

from veyra.functions.domains import registered_domain
from veyra.operators import findings, pages

SUBJECT = "case_id string, full_name string, name_variants array<string>, dob date, cities array<string>, addresses array<string>, phones array<string>, emails array<string>, usernames array<string>, employers array<string>, schools array<string>, relatives array<string>"


@pytest.fixture(scope="module")
def subjects(spark):
    return spark.createDataFrame([("C1", "Ada Yılmaz", None, dt.date(1985, 3, 15), ["İzmir"], None, ["0532 123 45 67"], None, ["@adayilmaz34"], None, None, None)], SUBJECT)


@pytest.mark.parametrize(
    "host,want",
    [("tr.linkedin.com", "linkedin.com"), ("www.hurriyet.com.tr", "hurriyet.com.tr"), ("a.foo.blogspot.com", "foo.blogspot.com"), ("foo.blogspot.com", "foo.blogspot.com"), ("com.tr", "com.tr"), ("localhost", "localhost"), ("10.0.0.1", "10.0.0.1"), ("", ""), (None, None)],
)
def test_registered_domain(spark, host, want):
    assert spark.createDataFrame([(host,)], "h string").select(registered_domain(F.col("h")).alias("x")).first()["x"] == want


def test_photo_contexts():
    assert findings.photo_contexts(None) == findings.photo_contexts("<p>x") == []
    html = '<body><div><p>Ada <b>Yılmaz</b><img src=a.jpg></p></div><img src="logo.png" alt="Ada"><img width=20 alt="Ada"><script>"<img>"</script><img alt="Ece &amp; Ada" title=t></body>'
    got = findings.photo_contexts(html)
    assert len(got) == 2 and "Ada Yılmaz" in got[0] and got[1].startswith("Ece & Ada t")
    assert "Ada" not in findings.photo_contexts("<body><div>Ada " + "x " * 400 + "<img src=a.jpg></div></body>")[0]


def test_photos(spark, subjects):
    f = spark.createDataFrame([(1, "C1", "<p>ADA YILMAZ<img src=a.jpg></p>"), (2, "C1", "<p>Ece<img src=a.jpg></p>"), (3, "C1", None), (4, "C9", "<img alt='Ada Yılmaz'>")], "fetch_id long, case_id string, html string")
    assert {r["fetch_id"]: r["photo"] for r in findings.photos(f, subjects).collect()} == {1: True, 2: False, 3: False}
    assert findings.photos(f.limit(0), subjects).count() == 0


def test_imprint_links(spark):
    html = '<a href="/kunye">Künye</a><a href="https://other.example/about">about</a><a href="/about">About</a><a href="/kunye">again</a><a href="/x">x</a><a href="/legal">l</a><a href="/imprint">l</a>'
    f = spark.createDataFrame([(1, "https://e.example/p", html), (2, "https://e.example/p", "")], "fetch_id long, url string, html string").withColumn("s", pages.sections_of("html"))
    assert [tuple(r) for r in findings.imprint_links(f).collect()] == [(1, ["https://e.example/kunye", "https://e.example/about", "https://e.example/legal"])]


def test_snippet_analysis(spark, subjects):
    r = spark.createDataFrame([(1, "C1", "https://e.example/ada-yilmaz", "Ada Yılmaz", "adayilmaz34 İzmir"), (2, "C1", "https://e.example/x", None, None)], "result_id long, case_id string, url string, title string, snippet string")
    got = {x["result_id"]: x for x in findings.snippet_analysis(r, subjects).collect()}
    assert got[1]["mentions"] == 0 and got[1]["places"] == ["Search snippet", "URL slug"] and set(got[1]["data_types"]) == {"Full name", "City", "Username"}
    assert got[2]["places"] == [] and got[2]["data_types"] == []


def test_blank_name_hides_no_mention(spark, subjects):
    r = spark.createDataFrame([(1, "C1", "https://e.example/x", "Ada Yılmaz", "… ada-yılmaz ½ İzmir 0532 123 45 67")], "result_id long, case_id string, url string, title string, snippet string")
    x = findings.snippet_analysis(r, subjects.withColumn("name_variants", F.array(F.lit("\u00a0"), F.lit(None), F.lit("A. Yılmaz")))).first()
    assert x["data_types"] == ["Full name", "Phone", "City"] and len(x["contexts"]) == 2 and x["matched"] == {"phone": ["0532 123 45 67"], "city": ["İzmir"]}


def test_source(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, False)], "o boolean, h boolean")
    assert [r["x"] for r in df.select(findings.source_of(F.col("o"), F.col("h")).alias("x")).collect()] == ["page", "snippet", None]


def test_known_birth_date(spark, subjects):
    written = ["05.01.1980", "5.1.1980", "05/01/1980", "5/1/1980", "05-01-1980", "5-1-1980", "1980-01-05", "5 Ocak 1980", "5 January 1980", "6 Ocak 1980"]
    known = subjects.withColumn("dob", F.lit(dt.date(1980, 1, 5)))
    r = spark.createDataFrame([(i, "C1", "https://e.example/x", "", f"since {w}") for i, w in enumerate(written)], "result_id long, case_id string, url string, title string, snippet string").coalesce(1)
    assert {x["result_id"] for x in findings.snippet_analysis(r, known).where("array_contains(data_types, 'Date of birth')").collect()} == set(range(9))


def test_photo_is_a_data_type(spark, tmp_path):
    from veyra.plans import reference

    html = ["<p>Ada Yılmaz<img src=a.jpg></p>", "<p>Ada Yılmaz</p>"]
    f = [(i, "C1", "https://e.example/x", 200, h) for i, h in enumerate(html)]
    spark.createDataFrame(f, "fetch_id long, case_id string, url string, status int, html string").write.parquet(f"{tmp_path}/fetches.parquet")
    who = ("C1", "Ada Yılmaz", None, None, None, None, None, None, None, None, None, None, True)
    spark.createDataFrame([who], SUBJECT + ", authorized boolean").write.parquet(f"{tmp_path}/subjects.parquet")
    got = {r["fetch_id"]: r["data_types"] for r in reference.page_analysis(spark, str(tmp_path)).collect()}
    assert got == {0: ["Full name", "Photo"], 1: ["Full name"]}
