"""Search results: pagination, budgets, merging into hits, ranks, order, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veyra.functions.urls import normalize_url, url_key

# Providers that query the Google index.
GOOGLE = ("serpapi", "google", "searchapi", "serper")
MAIN_KIND = "name_main"


def keyed(results: DataFrame, url: str = "url") -> DataFrame:
    """results plus url_norm and key; rows without a url are left out."""
    return results.where(F.col(url).isNotNull()).withColumns({"url_norm": normalize_url(F.col(url)), "key": url_key(F.col(url))})


def absolute_positions(results: DataFrame, max_results: int) -> DataFrame:
    """Per query and provider: http(s) results only, a url counts once, positions run on over the pages, cut at max_results (the
    cap is the feature)."""
    query = ["case_id", "query_text", "provider"]
    ok = results.where(F.lower(F.trim("url")).rlike("^https?://"))
    once = ok.groupBy(*query, "url").agg(F.min("seq").alias("seq"), F.min_by(F.struct("title", "snippet", "query_kind"), "seq").alias("r"))
    place = F.row_number().over(Window.partitionBy(*query).orderBy("seq"))
    return once.withColumn("position", place).where(F.col("position") <= max_results).select(*query, "url", "seq", "position", "r.*")


def within_budget(calls: DataFrame, budget: int, by: str = "case_id", order: str = "ord", cached: str = "cached") -> DataFrame:
    """calls plus spent and status: a running sum of uncached calls in order; those over the budget are skipped, cached are free."""
    spent = F.sum(F.when(F.col(cached), 0).otherwise(1)).over(Window.partitionBy(by).orderBy(order))
    return calls.withColumn("spent", spent).withColumn("status", F.when(F.col(cached), "cached").when(F.col("spent") <= budget, "called").otherwise("skipped"))


def merge_hits(results: DataFrame, google: tuple[str, ...] = GOOGLE) -> DataFrame:
    """One row per case and page: url, title and snippet of the first result (a later snippet fills an empty one and brings its
    title if it has one), queries and providers in first-seen order, best rank.

    Only results of the main query give ranks; ranks of Google-backed providers come before others, then the lower rank, then the
    first seen. A page that makes up a third of all rows is combined map-side; only distinct queries are collected per page.
    """
    r = keyed(results).withColumn("filled", F.coalesce(F.trim("snippet"), F.lit("")) != "")
    titled = F.coalesce(F.trim("title"), F.lit("")) != ""
    is_google = F.col("provider").isin(*google)
    ranked = (F.col("query_kind") == MAIN_KIND) & F.col("result_pos").isNotNull()
    queries = r.where("query_text is not null").groupBy("case_id", "key", "query_text").agg(F.min("seq").alias("s")).groupBy("case_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "query_text"))), lambda x: x["query_text"]).alias("queries"))
    one = r.groupBy("case_id", "key").agg(
        F.min("seq").alias("first_seq"),
        F.min_by(F.struct("url_norm", "title", "snippet", "filled"), "seq").alias("first"),
        F.min_by(F.when(F.col("filled"), F.struct("title", "snippet", titled.alias("titled"))), F.when(F.col("filled"), F.col("seq"))).alias("fill"),
        F.array_sort(F.collect_set("provider")).alias("providers"),
        F.coalesce(F.max(is_google), F.lit(False)).alias("found_by_google"),
        F.min_by(F.when(ranked, F.struct("result_pos", "provider")), F.when(ranked, F.struct((~is_google).alias("g"), F.col("result_pos").alias("p"), F.col("seq").alias("s")))).alias("rank"),
    )
    late = ~F.col("first.filled") & F.col("fill").isNotNull()
    return one.join(queries, ["case_id", "key"], "left").select(
        "case_id", "key", F.col("first.url_norm").alias("url"),
        F.when(late & F.col("fill.titled"), F.col("fill.title")).otherwise(F.col("first.title")).alias("title"),
        F.when(late, F.col("fill.snippet")).otherwise(F.col("first.snippet")).alias("snippet"),
        F.coalesce("queries", F.array().cast("array<string>")).alias("queries"), "providers", "found_by_google",
        F.col("rank.result_pos").alias("best_rank"), F.col("rank.provider").alias("rank_provider"), "first_seq",
    )


def ordered_hits(hits: DataFrame) -> DataFrame:
    """hits plus place within the case: best rank, then most queries, then first seen."""
    order = Window.partitionBy("case_id").orderBy(F.coalesce("best_rank", F.lit(10_000)), F.size("queries").desc(), "first_seq")
    return hits.withColumn("place", F.row_number().over(order))


def page_cap(targets: DataFrame, cap: int, by: str = "case_id", order: str = "place") -> DataFrame:
    """The first cap targets of each case (the cap is the feature)."""
    return targets.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= cap).drop("_n")


def counts(results: DataFrame) -> DataFrame:
    return results.groupBy("query_kind", "provider").agg(F.count("*").alias("n_results"), F.count_distinct("query_text").alias("n_queries"))
