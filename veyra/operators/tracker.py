"""Findings tracker: what is new, what is known, the differences a new observation makes, and a tracker with them applied.

Left out on purpose: status transitions and other workflow rules. Columns that people own are never written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veyra.functions.urls import url_key
from veyra.operators import results

RANK_NOTE = "Rank is not from Google"


def rows(tracker: DataFrame) -> DataFrame:
    """Tracker rows with a link, and their key recomputed from it."""
    return tracker.where(F.coalesce(F.trim("site_link"), F.lit("")) != "").withColumn("key", url_key(F.col("site_link")))


def last_rows(tracker: DataFrame) -> DataFrame:
    """One row per case and key: where a key stands twice, the last row."""
    t = rows(tracker)
    return t.groupBy("case_id", "key").agg(F.max("row_no").alias("row_no"))


def new_hits(hits: DataFrame, tracker: DataFrame) -> DataFrame:
    return hits.join(rows(tracker).select("case_id", "key"), ["case_id", "key"], "left_anti")


def known_hits(hits: DataFrame, tracker: DataFrame) -> DataFrame:
    return hits.join(last_rows(tracker), ["case_id", "key"])


def allocate(new: DataFrame, tracker: DataFrame, order: str = "place") -> DataFrame:
    """new plus row_no: the rows after the last used one of each case."""
    last = tracker.groupBy("case_id").agg(F.max("row_no").alias("last"))
    n = F.row_number().over(Window.partitionBy("case_id").orderBy(order))
    return new.join(last, "case_id", "left").withColumn("row_no", F.coalesce("last", F.lit(1)) + n).drop("last")


def append_note(notes: Column, line: Column) -> Column:
    return F.concat_ws("\n", F.nullif(F.rtrim(notes), F.lit("")), F.nullif(line, F.lit("")))


def latest_pages(fetches: DataFrame, analyses: DataFrame) -> DataFrame:
    """case_id, key, page_ok, seen_mentions, seen_types, screenshot: the last fetch of each page and the last analysis of it. Only a
    fetch that was read and an analysis of the page itself are page_ok."""
    last = F.max_by(F.struct("fetch_id", "status", "html_ok", "screenshot"), F.struct("fetched_at", "fetch_id"))
    f = results.keyed(fetches.withColumn("html_ok", F.trim(F.coalesce("html", F.lit(""))) != "").drop("html"))
    f = f.groupBy("case_id", "key").agg(last.alias("f")).select("case_id", "key", "f.*")
    a = analyses.groupBy("fetch_id").agg(F.max_by(F.struct("mentions", "data_types", "source"), F.struct("analysed_at", "analysis_id")).alias("a"))
    ok = F.coalesce((F.col("status") == 200) & F.col("html_ok") & (F.col("a.source") == "page"), F.lit(False))
    return f.join(a, "fetch_id", "left").select(
        "case_id", "key", ok.alias("page_ok"), F.col("a.mentions").alias("seen_mentions"),
        F.array_join(F.coalesce("a.data_types", F.array().cast("array<string>")), ", ").alias("seen_types"), "screenshot",
    )


def observations(tracker: DataFrame, hits: DataFrame, pages: DataFrame, found: DataFrame, checked: str) -> DataFrame:
    """What a rescan sees of every tracked page, the input of plan: a row for each case and key of the tracker, with its merged hit and
    its page where there are any. pages: latest_pages; found: search results, of which any of the main query says that it ran."""
    h = hits.select("case_id", "key", "best_rank", "rank_provider", "found_by_google")
    ran = found.where(F.col("query_kind") == results.MAIN_KIND).select("case_id", F.lit(True).alias("ran")).distinct()
    seen = rows(tracker).select("case_id", "key").distinct().join(h, ["case_id", "key"], "left").join(pages, ["case_id", "key"], "left").join(ran, "case_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return seen.select(
        "case_id", "key", F.lit(checked).alias("checked"), flag(F.col("page_ok")).alias("page_ok"), "seen_mentions", "seen_types",
        "best_rank", flag(F.col("rank_provider").isin(*results.GOOGLE)).alias("rank_google"), flag(F.col("ran")).alias("main_ran"),
        flag(F.col("found_by_google")).alias("found_by_google"), F.coalesce("screenshot", F.lit("")).alias("screenshot"),
    )


def plan(tracker: DataFrame, seen: DataFrame) -> DataFrame:
    """case_id, row_no, field, value, is_clear: the cells that new observations change, in long form.

    seen: case_id, key, checked (date text), page_ok (a page was read), mentions, data_types, hit (a search found it), best_rank,
    rank_google, main_ran, found_by_google, screenshot. Rows without an observation get nothing. A null value with is_clear
    empties the cell.
    """
    t = rows(tracker).join(seen, ["case_id", "key"])
    cell = lambda field, value, when, clear=False: t.where(when).select("case_id", "row_no", F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(clear).alias("is_clear"))
    c = F.col
    changes = [
        cell("last_checked", c("checked"), F.lit(True)),
        cell("mentions", c("seen_mentions"), c("page_ok")),
        cell("data_types_exposed", c("seen_types"), c("page_ok")),
        cell("name_rank", c("best_rank"), c("best_rank").isNotNull()),
        cell("name_rank", F.lit(None), c("best_rank").isNull() & c("main_ran") & c("name_rank").isNotNull(), True),
        cell("notes", append_note(c("notes"), F.lit(RANK_NOTE)), c("best_rank").isNotNull() & ~c("rank_google") & ~F.lower(F.coalesce("notes", F.lit(""))).contains(RANK_NOTE.lower())),
        cell("indexed", F.lit("Yes"), c("found_by_google")),
        cell("evidence", c("screenshot"), (F.coalesce("evidence", F.lit("")) == "") & (F.coalesce("screenshot", F.lit("")) != "")),
    ]
    return reduce(DataFrame.unionByName, changes)


PLANNED = ("last_checked", "mentions", "data_types_exposed", "name_rank", "notes", "indexed", "evidence")


def applied(tracker: DataFrame, changes: DataFrame) -> DataFrame:
    """The tracker with the changed cells; all other cells and rows as they were."""
    wide = changes.groupBy("case_id", "row_no").agg(*[F.max(F.when(F.col("field") == f, F.struct("value", "is_clear"))).alias("_" + f) for f in PLANNED])
    t = tracker.join(wide, ["case_id", "row_no"], "left")
    types = dict(tracker.dtypes)
    new = {f: F.when(F.col("_" + f).isNull(), F.col(f)).otherwise(F.when(~F.col(f"_{f}.is_clear"), F.col(f"_{f}.value").cast(types[f]))) for f in PLANNED if f in types}
    return t.withColumns(new).select(*tracker.columns)


def outside_vocabulary(tracker: DataFrame, lists: DataFrame, field: str, list_name: str) -> DataFrame:
    """Values of a field that its closed list does not hold."""
    allowed = lists.where(F.col("list_name") == list_name).select(F.col("entry").alias("value"))
    used = tracker.select(F.col(field).alias("value")).where("value is not null and value != ''").groupBy("value").agg(F.count("*").alias("n_rows"))
    return used.join(allowed, "value", "left_anti")
