"""Queries of categories, validation, decisions about fetches, facts joined to results, and run counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veyra.functions import domains, urls
from veyra.operators import classify, fetching, report, results, tracker
from veyra.plans import findings, reference
from veyra.plans.reference import _RESULTS, fold_sql, host_and_path, rules_sql
from veyra.sources import dictionaries, enrich
from veyra.sources.tables import table

# Domain lists of the categories that these queries use.
CATEGORIES = {"categories": {"Social media": ["kisibulucu.example", "lark-copper1.com.example"], "News / media": ["kumsal-harman2.test", "harbor-lark6.test"], "Forum / community": ["defter-defter4.test"], "Archive / cache": ["quarry-ledger8.test"]}}
ENDINGS = [*dictionaries.ENDINGS, ("Blog", [".com.example"])]


def site_categories(spark, d):
    """The whole chain: brokers, domain lists, endings, keywords, Other."""
    host, path = host_and_path("url")
    r = table(spark, d, "search_results").where("url is not null").select("result_id", host.alias("host"), path.alias("path"))
    return classify.site_category(r, table(spark, d, "brokers"), dictionaries.category_domains(spark, CATEGORIES), ENDINGS, dictionaries.KEYWORDS).select("result_id", "category")


_BROKER = "(SELECT 1 FROM brokers b WHERE r.host = lower(b.domain) OR ends_with(r.host, '.' || lower(b.domain)))"
_LISTED = rules_sql(list(CATEGORIES["categories"].items()), "host = {0} OR ends_with(host, '.' || {0})")
_ENDING = rules_sql(ENDINGS, "ends_with(host, {0}) OR host = ltrim({0}, '.')")


def content_kinds(spark, d):
    """Kind of each fetched page, with what its latest analysis says of its places."""
    f = table(spark, d, "fetches").where("url is not null")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"\s+", ""), r"^[^:]*://[^/]*", ""), r"[?#].*$", "")
    a = table(spark, d, "analyses").groupBy("fetch_id").agg(F.max_by("places", "analysis_id").alias("places"))
    return f.select("fetch_id", "content_type", path.alias("path")).join(a, "fetch_id", "left").select("fetch_id", classify.content_type(F.col("path"), F.col("content_type"), F.lit("Other"), F.col("places")).alias("kind"))


def valid_subjects(spark, d):
    s = dictionaries.validated(table(spark, d, "subjects"))
    return s.select("case_id", "rejected", "dropped", *[F.size(c).alias("n_" + c) for c in ("phones", "emails", "cities")])


_PLACEHOLDER = r"(?i)\dx|x\d|\bx{2,}\b|\.\.\.|<[^>]+>|^tbd$|^n/?a$|^-$"
_OK = f"(v IS NOT NULL AND trim(v, ' ') <> '' AND NOT regexp_matches(trim(v, ' '), '{_PLACEHOLDER}'))"
_CHECK = {"phones": f"{_OK} AND length(regexp_replace(v, '\\D', '', 'g')) >= 7", "emails": f"{_OK} AND contains(v, '@') AND contains(split_part(v, '@', -1), '.')"}
_KEPT = {c: f"list_filter({c}, lambda v: {_CHECK.get(c, _OK)})" for c in dictionaries.LIST_FIELDS}
_DROPPED = " + ".join(f"coalesce(len(list_filter({c}, lambda v: v IS NOT NULL)) - len({k}), 0)" for c, k in _KEPT.items())


def fetch_decisions(spark, d):
    """What robots.txt would allow (its status here is the page's), and whether a page needs rendering."""
    f = table(spark, d, "fetches")
    words = F.length(F.regexp_replace("html", r"(?s)<[^>]*>|\s+", "")).alias("words")
    f = f.select("fetch_id", "status", "content_type", words)
    return f.select("fetch_id", fetching.robots(F.col("status")).alias("robots"), fetching.needs_rendering(F.col("status"), F.col("content_type"), F.col("words")).alias("rendering"))


def render_budget(spark, d):
    f = table(spark, d, "fetches").select("case_id", F.col("fetch_id").alias("ord"), F.when(F.col("status") == 403, 402).otherwise(F.col("status")).alias("status"))
    return fetching.within_credits(f, 1000).select("case_id", F.col("ord").alias("fetch_id"), "sent")


def enriched_results(spark, d):
    """Results with the facts of their registered domain (here: brokers) and the number of archived copies (here: fetches)."""
    r = results.keyed(table(spark, d, "search_results")).select("result_id", "key", domains.registered_domain(urls.hostname(F.col("url_norm")), ("com.example",)).alias("domain"))
    facts = table(spark, d, "brokers").groupBy(F.lower("domain").alias("domain")).agg(F.min_by("country", "ord").alias("country"))
    copies = results.keyed(table(spark, d, "fetches")).groupBy("key").agg(F.count("*").alias("copies"))
    return enrich.with_facts(r, facts, copies, url="key").select("result_id", "country", "copies")


def run_counts(spark, d):
    h = reference.merged_hits(spark, d)
    return report.run_counts(reference.budgeted_calls(spark, d), h, tracker.known_hits(h, table(spark, d, "tracker")), reference.tracker_diff(spark, d))


QUERIES = {f.__name__: f for f in (site_categories, content_kinds, valid_subjects, fetch_decisions, render_budget, enriched_results, run_counts)}
_DOMAIN = findings.ORACLES["registered_domains"]
ORACLES = {
    "site_categories": f"""SELECT result_id, coalesce(CASE WHEN EXISTS {_BROKER} THEN 'Data broker' END, {_LISTED}, {_ENDING}, {reference._KEYWORD}, 'Other') AS category FROM (SELECT result_id, host, path, {fold_sql("host || ' ' || path")} AS f FROM {_RESULTS}) r""",
    "content_kinds": r"""SELECT fetch_id, CASE WHEN m LIKE '%pdf%' OR regexp_matches(p, '\.(pdf|docx?|xlsx?|pptx?|odt)$') THEN 'PDF / document' WHEN m LIKE 'image/%' OR regexp_matches(p, '\.(jpe?g|png|gif|webp)$') THEN 'Image'
 WHEN m LIKE 'video/%' OR regexp_matches(p, '/(watch|video|videos|shorts|reel)s?\b') THEN 'Video' WHEN places = ['Comments section'] THEN 'Comment' ELSE 'Text' END AS kind
 FROM (SELECT f.fetch_id, places, lower(coalesce(content_type, '')) AS m, lower(regexp_replace(regexp_replace(regexp_replace(url, '\s+', '', 'g'), '^[^:]*://[^/]*', ''), '[?#].*$', '')) AS p
 FROM fetches f LEFT JOIN (SELECT fetch_id, arg_max(places, analysis_id) AS places FROM analyses GROUP BY fetch_id) a ON f.fetch_id = a.fetch_id WHERE url IS NOT NULL)""",
    "valid_subjects": f"""SELECT case_id, CASE WHEN trim(coalesce(case_id, ''), ' ') = '' THEN 'case id is missing' WHEN trim(coalesce(full_name, ''), ' ') = '' OR regexp_matches(trim(full_name, ' '), '{_PLACEHOLDER}') THEN 'full name is missing' END AS rejected,
 CAST({_DROPPED} AS INT) AS dropped, {", ".join(f"CAST(len({_KEPT[c]}) AS INT) AS n_{c}" for c in ("phones", "emails", "cities"))} FROM subjects""",
    "fetch_decisions": r"""SELECT fetch_id, CASE WHEN status IS NULL OR status IN (401, 403) OR status >= 500 THEN 'deny' WHEN status BETWEEN 400 AND 499 THEN 'allow' ELSE 'parse' END AS robots,
 coalesce(status = 200, false) AND coalesce(lower(trim(split_part(content_type, ';', 1), ' ')) IN ('text/html', 'application/xhtml+xml'), false) AND coalesce(length(regexp_replace(html, '<[^>]*>|\s+', '', 'g')), 0) < 400 AS rendering FROM fetches""",
    "render_budget": """SELECT case_id, fetch_id, 5 * row_number() OVER (PARTITION BY case_id ORDER BY fetch_id) <= 1000 AND NOT coalesce(bool_or(coalesce(status IN (401, 403), false)) OVER (PARTITION BY case_id ORDER BY fetch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS sent FROM fetches""",
    "enriched_results": f"""SELECT r.result_id, b.country, c.copies FROM (SELECT *, CASE WHEN regexp_matches(h, '^[0-9.]+$|:') THEN h ELSE coalesce(array_to_string(list_slice(l, greatest(k, 1), len(l)), '.'), h) END AS domain FROM (
 SELECT *, coalesce(list_min(list_filter(range(1, len(l) + 1), lambda i: array_to_string(list_slice(l, i, len(l)), '.') IN ({findings._SUFFIX}))), len(l)) - 1 AS k FROM (SELECT result_id, key, regexp_replace(host, '^www\\.', '') AS h, string_split(regexp_replace(host, '^www\\.', ''), '.') AS l FROM {_RESULTS}))) r
 LEFT JOIN (SELECT lower(domain) AS domain, arg_min(country, ord) AS country FROM brokers GROUP BY 1) b ON r.domain = b.domain
 LEFT JOIN (SELECT key, count(*) AS copies FROM {reference.keyed_sql('fetches', 'url')} GROUP BY 1) c ON r.key = c.key""",
    "run_counts": f"""WITH c AS ({reference.ORACLES["budgeted_calls"]}) SELECT 'searches ' || status AS item, count(*) AS n FROM c GROUP BY status UNION ALL SELECT 'queries', count(DISTINCT (case_id, query_text)) FROM c WHERE case_id IS NOT NULL AND query_text IS NOT NULL
 UNION ALL SELECT 'unique pages', count(*) FROM {reference._HITS} UNION ALL SELECT 'already tracked', count(*) FROM ({reference.ORACLES["tracked_hits"]}) UNION ALL SELECT 'new rows', (SELECT count(*) FROM {reference._HITS}) - (SELECT count(*) FROM ({reference.ORACLES["tracked_hits"]}))
 UNION ALL SELECT 'rows checked again', count(DISTINCT (case_id, row_no)) FROM {reference._DIFF}""",
}
