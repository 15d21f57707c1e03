"""Decisions about fetches as expressions over staged facts: what robots.txt allows, what to render again, what credits allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HTML_TYPES = ("text/html", "application/xhtml+xml")
RENDER_COST = 5
DISABLING = (401, 402)


def robots(status: Column) -> Column:
    """'deny', 'allow' or 'parse' from the status of /robots.txt (null: it could not be fetched)."""
    return F.when(status.isNull() | status.isin(401, 403) | (status >= 500), "deny").when(status.between(400, 499), "allow").otherwise("parse")


def needs_rendering(status: Column, content_type: Column, text_length: Column, threshold: int = 400) -> Column:
    """An HTML page that came well but with no text, or with less than the threshold. Null types are not HTML."""
    html = F.coalesce(F.lower(F.trim(F.substring_index(content_type, ";", 1))).isin(*HTML_TYPES), F.lit(False))
    return F.coalesce(status == 200, F.lit(False)) & html & (F.coalesce(text_length, F.lit(0)) < threshold)


def within_credits(requests: DataFrame, cap: int, by: str = "case_id", order: str = "ord", status: str = "status") -> DataFrame:
    """requests plus `sent`: each request costs RENDER_COST; one that would exceed the cap is not sent, and none after an answer
    that disables the service (its status stands at the request that got it)."""
    before = Window.partitionBy(by).orderBy(order)
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    disabled = F.coalesce(F.max(F.coalesce(F.col(status).isin(*DISABLING), F.lit(False))).over(earlier), F.lit(False))
    return requests.withColumn("sent", (F.row_number().over(before) * RENDER_COST <= cap) & ~disabled)
