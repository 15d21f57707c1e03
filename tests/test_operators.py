import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from veyra.operators import matrix, pages, report, results, tracker
from veyra.operators.pageblocks import blocks, visible_text
from veyra.sources import dictionaries, enrich, providers, sinks

SUBJECT = "case_id string, full_name string, name_variants array<string>, dob date, cities array<string>, addresses array<string>, phones array<string>, emails array<string>, usernames array<string>, employers array<string>, schools array<string>, relatives array<string>, keep_accounts array<string>, authorized boolean, source string"


def subject(spark, **kw):
    row = dict(case_id="C1", full_name="Ada Yılmaz", name_variants=["ADA YILMAZ", "A. Yılmaz"], dob=dt.date(1985, 3, 15), cities=["İzmir"], addresses=["Gül Sokak No: 4 Kadıköy"], phones=["0532 123 45 67"], emails=["ada@e.example"], usernames=["@ada"], employers=["Acme"], schools=None, relatives=["Ali Yılmaz"], keep_accounts=[], authorized=True, source="")
    return spark.createDataFrame([tuple({**row, **kw}.values())], SUBJECT)


def test_matrix(spark):
    sites = spark.createDataFrame([("site_broker", i, f"b{i}.example") for i in range(9)] + [("site_broker", 20, "b0.example")], "kind string, ord int, domain string")
    q = matrix.dedupe(matrix.raw_queries(subject(spark), sites)).orderBy("place").collect()
    assert (q[0]["text"], q[0]["kind"]) == ('"Ada Yılmaz"', "name_main")
    texts = [r["text"] for r in q]
    assert len(set(t.lower() for t in texts)) == len(texts)
    assert [r["priority"] for r in q] == sorted(r["priority"] for r in q)
    assert sum(r["kind"] == "name_main" for r in q) == 1 and '"Ada Yilmaz"' in texts and '"5321234567"' not in texts
    groups = [r["text"] for r in q if r["kind"] == "site_broker"]
    assert any("(site:b0.example OR site:b1.example" in t for t in groups) and any(t.endswith(" site:b8.example") for t in groups)


def test_dedupe_keeps_place_and_better_kind(spark):
    q = spark.createDataFrame([("C", '"a  B"', "username", [1]), ("C", '"A b"', "email", [2]), ("C", '"c"', "email", [3])], "case_id string, text string, kind string, ord array<int>")
    assert [(r["kind"], r["place"]) for r in matrix.dedupe(q).orderBy("place").collect()] == [("email", 1), ("email", 2)]


RESULTS = "case_id string, seq long, query_text string, query_kind string, provider string, result_pos int, url string, title string, snippet string"


def test_merge(spark):
    rows = [
        ("C", 1, "q1", "name_main", "brave", 7, "http://www.e.com/a/", "T", ""), ("C", 2, "q2", "name", "brave", 1, "https://e.com/a?utm_x=1", "", "snip"),
        ("C", 3, "q1", "name_main", "serpapi", 3, "https://e.com/a", "T3", "s3"), ("C", 4, "q1", "name_main", "brave", None, "https://e.com/b", None, None), ("C", 5, None, None, None, None, None, None, None),
    ]
    h = {r["key"]: r for r in results.merge_hits(spark.createDataFrame(rows, RESULTS)).collect()}
    a = h["e.com/a"]
    assert (a["title"], a["snippet"], a["queries"], a["providers"], a["found_by_google"], a["best_rank"], a["rank_provider"]) == ("T", "snip", ["q1", "q2"], ["brave", "serpapi"], True, 3, "serpapi")
    assert h["e.com/b"]["best_rank"] is None and len(h) == 2
    assert results.merge_hits(spark.createDataFrame([], RESULTS)).count() == 0


def test_pages_budget_cap(spark):
    df = spark.createDataFrame([("C", i, "q", "name", "p", i, f"http://e.com/{i % 3}", "", "") for i in range(9)] + [("C", 99, "q", "name", "p", 1, "ftp://e.com", "", "")], RESULTS)
    assert sorted((r["url"], r["position"]) for r in results.absolute_positions(df, 2).collect()) == [("http://e.com/0", 1), ("http://e.com/1", 2)]
    c = spark.createDataFrame([("C", 1, False), ("C", 2, True), ("C", 3, False)], "case_id string, ord int, cached boolean")
    assert [r["status"] for r in results.within_budget(c, 1).orderBy("ord").collect()] == ["called", "cached", "skipped"]


TRACKER = "case_id string, row_no int, site_link string, url_key string, status string, match_confidence string, severity string, site_category string, data_types_exposed string, mentioned_places string, mentions int, name_rank int, indexed string, evidence string, notes string, date_found timestamp, last_checked timestamp"


def trow(n, link, **kw):
    row = dict(case_id="C", row_no=n, site_link=link, url_key="", status="Sent", match_confidence="Likely", severity="High", site_category="", data_types_exposed="", mentioned_places="", mentions=None, name_rank=None, indexed=None, evidence="", notes=None, date_found=None, last_checked=None)
    return tuple({**row, **kw}.values())


def test_tracker(spark):
    t = spark.createDataFrame([trow(2, "http://e.com/a", name_rank=4, notes="mine "), trow(3, "https://www.e.com/a/"), trow(4, " "), trow(5, "https://e.com/z", mentions=2)], TRACKER)
    seen = spark.createDataFrame([("C", "e.com/a", "2025-01-02", True, 0, "Phone", 9, False, True, True, "shot.png")], "case_id string, key string, checked string, page_ok boolean, seen_mentions int, seen_types string, best_rank int, rank_google boolean, main_ran boolean, found_by_google boolean, screenshot string")
    after = {r["row_no"]: r for r in tracker.applied(t, tracker.plan(t, seen)).collect()}
    a = after[2]
    assert (a["mentions"], a["name_rank"], a["indexed"], a["evidence"], a["notes"], a["status"]) == (0, 9, "Yes", "shot.png", "mine\n" + tracker.RANK_NOTE, "Sent")
    assert after[5]["mentions"] == 2 and after[5]["last_checked"] is None and len(after) == 4
    again = tracker.plan(spark.createDataFrame([trow(2, "http://e.com/a", notes=tracker.RANK_NOTE.upper(), name_rank=4)], TRACKER), seen.withColumn("best_rank", F.lit(None).cast("int")))
    assert [(r["value"], r["is_clear"]) for r in again.where("field = 'name_rank'").collect()] == [(None, True)] and again.where("field = 'notes'").count() == 0
    hits = spark.createDataFrame([("C", "e.com/a", 1), ("C", "e.com/n", 2)], "case_id string, key string, place int")
    assert [r["key"] for r in tracker.new_hits(hits, t).collect()] == ["e.com/n"]
    assert [r["row_no"] for r in tracker.known_hits(hits, t).collect()] == [3]
    assert [r["row_no"] for r in tracker.allocate(tracker.new_hits(hits, t), t).collect()] == [6]


def test_tracker_observations(spark):
    t = spark.createDataFrame([trow(2, "http://e.com/a", name_rank=4), trow(3, "http://e.com/gone", name_rank=7, evidence="old.png"), trow(4, "http://e.com/n", name_rank=1)], TRACKER)
    found = spark.createDataFrame([("C", 1, "q", "name_main", "brave", 3, "http://e.com/n", "t", "s")], RESULTS)
    f = spark.createDataFrame([
        (1, "C", "http://e.com/a", 200, "<p>x", "first.png", "2025-01-01"), (2, "C", "https://www.e.com/a/", 200, "<p>x", "last.png", "2025-01-02"), (3, "C", "http://e.com/gone", 404, None, "new.png", "2025-01-01"), (4, "C", "http://e.com/n", 200, "<p>x", None, "2025-01-01"),
    ], "fetch_id long, case_id string, url string, status int, html string, screenshot string, fetched_at string")
    a = spark.createDataFrame([(1, 1, 9, ["City"], "page", "1"), (2, 2, 0, ["Phone", "Email"], "page", "1"), (3, 3, 5, ["Phone"], "page", "1"), (4, 4, 5, ["Phone"], "snippet", "1")], "analysis_id long, fetch_id long, mentions int, data_types array<string>, source string, analysed_at string")
    seen = tracker.observations(t, results.merge_hits(found), tracker.latest_pages(f, a), found, "2025-01-02")
    got = {(r["row_no"], r["field"]): (r["value"], r["is_clear"]) for r in tracker.plan(t, seen).collect()}
    checked = {(n, "last_checked"): ("2025-01-02", False) for n in (2, 3, 4)}
    read = {(2, "mentions"): ("0", False), (2, "data_types_exposed"): ("Phone, Email", False), (2, "evidence"): ("last.png", False)}
    assert got == checked | read | {(2, "name_rank"): (None, True), (3, "name_rank"): (None, True), (4, "name_rank"): ("3", False), (4, "notes"): (tracker.RANK_NOTE, False)}
    unsearched = tracker.observations(t, results.merge_hits(found.limit(0)), tracker.latest_pages(f, a), found.limit(0), "2025-01-02")
    assert tracker.plan(t, unsearched).where("field = 'name_rank'").count() == 0


PAGE = """<html><head><title>Ada  Yılmaz &amp; co</title><meta name="description" content="Ada Yılmaz hakkında"><script>"Ada Yılmaz"</script></head><body><!-- Ada Yılmaz -->
<nav><a href="#x">skip</a><a href="/privacy">Privacy</a><a href="/kaldirma">İçerik kaldırma</a><a href="/kaldirma">again</a></nav><h1>Ada Yılmaz</h1><p>ADA YILMAZ yazdı: 0532 123 45 67, T.C. 10000000146</p>
<img src=a.jpg alt="Ada Yılmaz"><div class="comment">ada yılmaz yorum</div><footer>© 2020 Acme Medya Ltd. Şti.</footer></body></html>"""


def test_page_analysis(spark):
    f = spark.createDataFrame([(1, "C1", "https://e.com/ada-yilmaz/p", PAGE), (2, "C1", "https://e.com/x", ""), (3, "C1", "https://e.com/y", None)], "fetch_id long, case_id string, url string, html string")
    x = f.withColumn("s", pages.sections_of("html")).join(subject(spark), "case_id")
    got = {r["fetch_id"]: r for r in pages.analysis(x).collect()}
    assert got[1]["mentions"] == 5 and got[2]["mentions"] == 0
    assert got[1]["places"] == ["Title", "Meta description", "Headings", "Body", "Image alt/captions", "Comments section", "URL slug"]
    assert set(got[1]["data_types"]) == {"Full name", "Phone", "TC Kimlik No", "Employer", "Username"} and got[1]["s"]["owner"] == "Acme Medya Ltd. Şti"
    assert got[1]["matched"].keys() >= {"employer", "username"} and got[2]["matched"] == {}
    links = pages.ranked_links(f.withColumn("s", pages.sections_of("html")).where("html is not null")).orderBy("place").collect()
    assert [(r["href"], r["score"]) for r in links] == [("https://e.com/kaldirma", 9), ("https://e.com/privacy", 5)]


@pytest.mark.parametrize("text,owner", [("© 2019-2024 Mavi Pusula A.Ş. Tüm hakları saklıdır", "Mavi Pusula A.Ş"), ("Copyright 2020 all rights reserved. Acme GmbH", "Acme GmbH"), ("(c) Ada Ak", ""), ("© 2020 Deniz Ltd. Şti. | Künye", "Deniz Ltd. Şti"), ("Ltd. © ", "")])
def test_owner(text, owner):
    assert pages.owner_hint(text) == owner


def test_captions_count_once_and_hints_read_the_link_as_written(spark):
    html = "<body><p>x</p><figure><img alt=y><figcaption>Ada Yılmaz</figcaption></figure><iframe>Ada Yılmaz</iframe><div id=box class=comments>Ada Yılmaz</div><a href='/a'>more</a><a href='/gizlilik'>x</a></body>"
    f = spark.createDataFrame([(1, "C1", "https://contact-x.example/", html)], "fetch_id long, case_id string, url string, html string").withColumn("s", pages.sections_of("html"))
    r = pages.analysis(f.join(subject(spark), "case_id")).first()
    assert r["mentions"] == 2 and "Comments section" in r["places"] and "Image alt/captions" in r["places"]
    assert [x["href"] for x in pages.ranked_links(f).collect()] == ["https://contact-x.example/gizlilik"]


def test_short_known_addresses_match_as_a_whole(spark):
    s = subject(spark).withColumn("addresses", F.array(F.lit("Gül 4"), F.lit("Moda, Uzun Yol 12, X")))
    f = spark.createDataFrame([(1, "C1", "https://e.com/", "<p>Gül 4 ve Uzun Yol 12 burada"), (2, "C1", "https://e.com/", "<p>Moda")], "fetch_id long, case_id string, url string, html string").withColumn("s", pages.sections_of("html"))
    got = {r["fetch_id"]: r["matched"].get("address") for r in pages.analysis(f.join(s, "case_id")).collect()}
    assert got == {1: ["Gül 4", "Moda, Uzun Yol 12, X"], 2: None}


def test_site_category(spark):
    from veyra.operators import classify

    rows = spark.createDataFrame([(1, "a.spokeo.test", "/"), (2, "x.social.test", "/haber/1"), (3, "city.gov.tr", "/"), (4, "e.test", "/Haber/2"), (5, "e.test", "/q"), (6, None, None), (7, "social.test", "/")], "id long, host string, path string")
    brokers = spark.createDataFrame([("spokeo.test", 1)], "domain string, ord int")
    domains = spark.createDataFrame([("social.test", 2, "Social media"), ("x.social.test", 1, "Blog")], "domain string, ord int, value string")
    got = {r["id"]: r["category"] for r in classify.site_category(rows, brokers, domains, [("Government", [".gov.tr"])], [("News", ["haber"]), ("Odd", ["a+b", "["])]).collect()}
    assert got == {1: "Data broker", 2: "Blog", 3: "Government", 4: "News", 5: "Other", 6: "Other", 7: "Social media"}


def test_content_types(spark):
    from veyra.operators import classify

    rows = [("/a", "text/html", "Other", ["Comments section"], "Comment"), ("/a", "text/html", "Other", ["Title", "Comments section"], "Text"), ("/a.pdf", None, "Other", None, "PDF / document"), ("/a", "", "Social media", ["Comments section"], "Profile page")]
    df = spark.createDataFrame(rows, "p string, m string, c string, places array<string>, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", classify.content_type(F.col("p"), F.col("m"), F.col("c"), F.col("places"))).collect())


def test_fetch_decisions(spark):
    from veyra.operators import fetching

    df = spark.createDataFrame([(None,), (200,), (301,), (401,), (403,), (404,), (500,)], "status int")
    assert [r[0] for r in df.select(fetching.robots(F.col("status"))).collect()] == ["deny", "parse", "parse", "deny", "deny", "allow", "deny"]
    pages_ = spark.createDataFrame([(200, "text/html; charset=utf-8", 10), (200, "text/html", 400), (200, None, 0), (404, "text/html", 0), (200, "Application/XHTML+xml", None)], "s int, t string, n int")
    assert [r[0] for r in pages_.select(fetching.needs_rendering(F.col("s"), F.col("t"), F.col("n"))).collect()] == [True, False, False, False, True]
    reqs = spark.createDataFrame([("a", i, 402 if i == 3 else 200) for i in range(1, 6)] + [("b", i, None) for i in range(1, 6)], "case_id string, ord int, status int")
    sent = {(r["case_id"], r["ord"]) for r in fetching.within_credits(reqs, 20).where("sent").collect()}
    assert sent == {("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3), ("b", 4)} and fetching.within_credits(reqs.limit(0), 20).count() == 0


def test_validated(spark):
    from veyra.sources import dictionaries

    rows = [("C1", "Ada Ak", ["0532 1234567", "12", None], ["a@b.test", "a@b"]), ("", "Ada", None, None), ("C3", "xx", [], None), ("C4", None, None, None)]
    got = {r["case_id"]: r for r in dictionaries.validated(spark.createDataFrame(rows, "case_id string, full_name string, phones array<string>, emails array<string>")).collect()}
    assert got["C1"]["rejected"] is None and got["C1"]["dropped"] == 2 and got["C1"]["phones"] == ["0532 1234567"] and got["C1"]["emails"] == ["a@b.test"]
    assert got[""]["rejected"] and got["C3"]["rejected"] and got["C4"]["rejected"] and got[""]["phones"] is None


def test_dictionaries(spark):
    from veyra.sources import dictionaries

    data = {"categories": {"B": ["X.test", None], "A": ["y.test"]}, "keyword_rules": {"N": ["Haber"]}, "site_queries": {"social": ["s.test"], "professional": None}}
    assert [tuple(r) for r in dictionaries.category_domains(spark, data).collect()] == [("x.test", 0, "B"), ("y.test", 1, "A")]
    assert dictionaries.category_rules(data, "keyword_rules") == [("N", ["haber"])] and dictionaries.category_rules(data, "none") == []
    b = spark.createDataFrame([(1, "b.test")], "ord int, domain string")
    assert {(r["kind"], r["domain"]) for r in dictionaries.site_domains(spark, data, b).collect()} == {("site_broker", "b.test"), ("site_social", "s.test")}


def test_enriched_rows_stay(spark):
    rows = spark.createDataFrame([("u1", "a"), ("u2", "b"), (None, None)], "url string, domain string")
    got = enrich.with_facts(rows, spark.createDataFrame([("a", "TR")], "domain string, country string"), spark.createDataFrame([("u2", 3)], "url string, copies int")).collect()
    assert {(r["url"], r["country"], r["copies"]) for r in got} == {("u1", "TR", None), ("u2", None, 3), (None, None, None)}


def test_blocks():
    html = "<body>a<b>b</b> c<br>d<p>e<p>f&nbsp;g<table><tr><td>h<td>i</table><ul><li>j<li>k</ul><noscript>no</noscript><svg>no</svg>&lt;l&gt;"
    assert [b.text for b in blocks(html)] == ["ab c", "d", "e", "f g", "h", "i", "j", "k", "<l>"]
    assert [b.path[-1] for b in blocks(html)][2:8] == ["p", "p", "td", "td", "li", "li"]
    assert visible_text("<script>var a='<p>x</p>'</script><p>y") == "y" and blocks(None) == blocks("") == [] and visible_text("<p>" * 20_000 + "z") == "z"


def test_providers(spark):
    bodies = [
        ("serpapi", "q", 0, json.dumps({"organic_results": [{"position": 1, "link": "http://a", "title": "t"}], "serpapi_pagination": {"next": "x"}})), ("serpapi", "q", 1, "not json"), ("brave", "q", 0, json.dumps({"web": {"results": [{"url": "http://b", "title": "<b>t</b>", "description": "d"}]}, "query": {"more_results_available": False}})),
    ]
    got = providers.results(spark.createDataFrame(bodies, "provider string, query_text string, page int, body string"), ["serpapi", "brave"]).collect()
    assert sorted((r["url"], r["title"], r["more"]) for r in got) == [("http://a", "t", True), ("http://b", "t", False)]
    with pytest.raises(KeyError):
        providers.page_size("none")
    k = spark.createDataFrame([({"q": "x", "api_key": "1"}, {"api_key": "2", "q": "x"})], "a map<string,string>, b map<string,string>")
    r = k.select(providers.cache_key(F.lit("p"), F.lit("u"), F.col("a")).alias("a"), providers.cache_key(F.lit("p"), F.lit("u"), F.col("b")).alias("b")).first()
    assert r["a"] == r["b"]


def test_enrich(spark):
    body = json.dumps({"entities": [{"roles": ["abuse"], "entities": [{"roles": ["registrant"], "vcardArray": ["vcard", [["fn", {}, "text", "Ada"], ["org", {}, "text", "Redacted for privacy"], ["adr", {}, "text", ["", "Turkey"]]]]}]}]})
    df = spark.createDataFrame([(body,), ("{",), (None,)], "b string").select(enrich.rdap_domain(F.col("b")).alias("r"))
    assert [(r["o"], r["c"]) for r in df.select(enrich.registrant(F.col("r")).alias("o"), enrich.country_code(F.col("r.country")).alias("c")).collect()] == [("Ada", "TR"), ("", ""), ("", "")]
    a = spark.createDataFrame([('{"archived_snapshots":{"closest":{"available":true}}}', True), ('{"archived_snapshots":{}}', True), (None, True), ("{}", False)], "b string, q boolean")
    assert [r["x"] for r in a.select(enrich.archived(F.col("b"), F.col("q")).alias("x")).collect()] == ["Yes", "No", "Unknown", "Unknown"]


def test_gate_and_dictionaries(spark):
    s = subject(spark).unionByName(subject(spark, case_id="C2", authorized=False))
    rows = spark.createDataFrame([("C1",), ("C2",), ("C3",)], "case_id string")
    assert [r["case_id"] for r in dictionaries.gate(rows, s).collect()] == ["C1"]
    assert dictionaries.gate(rows, s, override=True).count() == 2
    assert [r["domain"] for r in dictionaries.brokers(spark, {"brokers": ["A.com", {"name": "x"}, {"domain": "b.com"}]}).collect()] == ["a.com", "b.com"]
    with pytest.warns(UserWarning):
        assert dictionaries.overlay(dictionaries.Settings(), {"max_pages": 3, "nope": 1}).max_pages == 3
    sheet = spark.createDataFrame([("C", 1, "Full Legal Name (as on ID)", "Ada"), ("C", 2, "FULL LEGAL NAME", "no"), ("C", 3, "else", "x")], "case_id string, row int, label string, value string")
    assert [tuple(r) for r in dictionaries.profile_fields(sheet).collect()] == [("C", "full_name", "Ada")]


def test_report_and_sinks(spark, tmp_path):
    t = spark.createDataFrame([trow(2, "x"), trow(3, "y", match_confidence="Namesake (not client)"), trow(4, "z", match_confidence="Unverified", severity=None, site_category="Blog")], TRACKER)
    assert [r["row_no"] for r in report.items(t).collect()] == [2] and "notes" not in report.items(t).columns
    assert {tuple(r) for r in report.counts(report.items(t, True)).collect()} == {("severity", "High", 1), ("category", "Other", 1), ("category", "Blog", 1)}
    assert spark.range(1).select(report.localised(F.lit("Phone, City,x")).alias("x")).first()["x"] == "Telefon, Şehir, x"
    assert sinks.timestamped_name("a_2024-01-02_0304", dt.datetime(2025, 1, 2, 3, 4, 5)) == "a_2025-01-02_030405"
    out = str(tmp_path / "t")
    sinks.save_as_new(t, out)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.save_as_new(t, out)
    with pytest.raises(ValueError):
        sinks.purge(spark, out, "../t")
    assert sinks.purge(spark, out, "nobody") == 0 and sinks.purge(spark, out, "C") > 0
    f = spark.createDataFrame([(1, "abc")], "fetch_id long, html string")
    assert json.loads(sinks.raw_lines(f).first()["value"]) == {"fetch_id": 1, "html_chars": 3}
    assert sinks.report_lines("T|x", spark.createDataFrame([("a|b", 1)], "k string, n int"), "k", "n").splitlines()[-1] == "| a\\|b | 1 |"


def test_stream(spark, tmp_path):
    from veyra.streaming.diff import changes

    src, schema = str(tmp_path / "in"), "case_id string, key string, seen_at timestamp, mentions int"
    rows = [("C", "k", dt.datetime(2025, 1, 1), 1), ("C", "k", dt.datetime(2025, 1, 2), 1), ("C", "k", dt.datetime(2025, 1, 3), None), ("C", None, dt.datetime(2025, 1, 1), 5)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    q = changes(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("diffs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["change"], r["mentions"], r["previous"]) for r in spark.table("diffs").orderBy("seen_at").collect()] == [("new", 1, None), ("changed", None, 1)]
