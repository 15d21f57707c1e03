"""Queries of domains, photos, imprints and snippet analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from veyra.functions import domains, urls
from veyra.operators import findings, pages, results
from veyra.plans.reference import _RESULTS, keyed_sql
from veyra.sources import dictionaries
from veyra.sources.tables import table


def registered_domains(spark, d):
    h = results.keyed(table(spark, d, "search_results")).select(urls.hostname(F.col("url_norm")).alias("host"))
    return h.groupBy(domains.registered_domain(F.col("host"), ("com.example",)).alias("domain")).agg(F.count("*").alias("n_results"))


def photo_flags(spark, d):
    return findings.photos(table(spark, d, "fetches"), dictionaries.authorized(table(spark, d, "subjects")))


def imprints(spark, d):
    f = table(spark, d, "fetches").where("html is not null").select("fetch_id", F.coalesce("final_url", "url").alias("url"), pages.sections_of("html").alias("s"))
    return findings.imprint_links(f)


def snippet_analyses(spark, d):
    s = dictionaries.authorized(table(spark, d, "subjects"))
    return findings.snippet_analysis(table(spark, d, "search_results").where("url is not null"), s)


def finding_sources(spark, d):
    """Per fetch: whether its page, or a merged search hit of its address, is what an analysis can rest on."""
    f = results.keyed(table(spark, d, "fetches")).select("fetch_id", "case_id", "key", ((F.col("status") == 200) & (F.trim(F.coalesce("html", F.lit(""))) != "")).alias("ok"))
    hits = results.keyed(table(spark, d, "search_results")).select("case_id", "key", F.lit(True).alias("hit")).distinct()
    return f.join(hits, ["case_id", "key"], "left").select("fetch_id", findings.source_of(F.coalesce("ok", F.lit(False)), F.coalesce("hit", F.lit(False))).alias("source"))


QUERIES = {f.__name__: f for f in (registered_domains, photo_flags, imprints, snippet_analyses, finding_sources)}

_SUFFIX = ", ".join(f"'{s}'" for s in (*domains.SUFFIXES, "com.example"))
_FETCHED = keyed_sql("fetches", "url")
ORACLES = {
    "finding_sources": f"""SELECT f.fetch_id, CASE WHEN f.status = 200 AND trim(coalesce(f.html, ''), ' ') <> '' THEN 'page' WHEN h.key IS NOT NULL THEN 'snippet' END AS source FROM {_FETCHED} f
 LEFT JOIN (SELECT DISTINCT case_id, key FROM {_RESULTS}) h ON f.case_id = h.case_id AND f.key = h.key""",
    "registered_domains": f"""SELECT domain, count(*) AS n_results FROM (SELECT CASE WHEN regexp_matches(h, '^[0-9.]+$|:') THEN h ELSE coalesce(array_to_string(list_slice(l, greatest(k, 1), len(l)), '.'), h) END AS domain FROM (
 SELECT h, l, coalesce(list_min(list_filter(range(1, len(l) + 1), lambda i: array_to_string(list_slice(l, i, len(l)), '.') IN ({_SUFFIX}))), len(l)) - 1 AS k FROM (SELECT regexp_replace(host, '^www\\.', '') AS h, string_split(regexp_replace(host, '^www\\.', ''), '.') AS l FROM {_RESULTS}))) GROUP BY domain""",
}
