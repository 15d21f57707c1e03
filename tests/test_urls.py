import pytest
from pyspark.sql import functions as F

from veyra.functions import urls
from veyra.operators import classify


def norm(spark, url, f=urls.normalize_url):
    return spark.createDataFrame([(url,)], "u string").select(f(F.col("u")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTPS://www.Example.com:443/Profile/ahmet/?utm_source=x&b=2&a=1&fbclid=9#top", "https://www.example.com/Profile/ahmet?a=1&b=2"),
        ("http://example.com/", "http://example.com"), ("http://example.com:8080/a//", "http://example.com:8080/a"), ("http://u:p@example.com./x?c=&d", "http://example.com/x?c=&d="),
        ("https://e.com/?q=a+b%26", "https://e.com?q=a+b%26"), (None, None), ("example.com/a", "https://example.com/a"), ("https://e.com/%zz?x=%zz", "https://e.com/%zz?x=%25zz"),
    ],
)
def test_normalize(spark, url, want):
    assert norm(spark, url) == want


def test_key(spark):
    assert norm(spark, "http://www.example.com/a/?gclid=1", urls.url_key) == norm(spark, "https://example.com/a", urls.url_key) == "example.com/a"


def test_host_parts(spark):
    assert norm(spark, "a.b.co.uk", urls.host_suffixes) == ["a.b.co.uk", "b.co.uk", "co.uk", "uk"]
    assert norm(spark, "a.co.uk", urls.cctld) == "GB" and norm(spark, "a.com", urls.cctld) == "" and norm(spark, "x.de", urls.cctld) == "DE"


def test_suffix_match(spark):
    hosts = spark.createDataFrame([("m.a.com",), ("ba.com",), (None,), ("a.com",)], "host string")
    rules = spark.createDataFrame([("www.a.com", 2, "two"), ("a.com", 1, "one"), ("m.a.com", 3, "three")], "domain string, ord int, value string")
    got = {r["host"]: r["value"] for r in classify.suffix_match(hosts, rules).collect()}
    assert got == {"m.a.com": "one", "a.com": "one", "ba.com": None, None: None}


def test_classification_texts(spark):
    df = spark.createDataFrame([("TR", "", "TR"), ("", "DE", "TR"), ("US", "", ""), ("", "", "")], "o string, r string, h string")
    assert [r["x"] for r in df.select(classify.jurisdiction(F.col("o"), F.col("r"), F.col("h")).alias("x")).collect()] == ["Turkey", "Germany (registrant); Turkey (hosting)", "USA (operator)", ""]
    df = spark.createDataFrame([("/a.PDF", "", "Other"), ("/watch", "text/html", "Other"), ("/u", "", "Social media"), ("/u", None, "Other"), ("/i", "image/png", "Other")], "p string, m string, c string")
    assert [r["x"] for r in df.select(classify.content_type(F.col("p"), F.col("m"), F.col("c")).alias("x")).collect()] == ["PDF / document", "Video", "Profile page", "Text", "Image"]
    df = spark.createDataFrame([("https://X.com/Ada", ["https://www.x.com/ada/"]), ("https://x.com/b", ["", None]), ("https://x.com/b", None)], "u string, k array<string>")
    assert [r["x"] for r in df.select(classify.keeps(F.col("u"), F.col("k")).alias("x")).collect()] == [True, False, False]
