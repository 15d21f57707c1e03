"""Customer report tables: selection, order, counts, localisation. Namesakes and internal notes never leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities in order, and Turkish words of values.
SEVERITIES = ("Critical", "High", "Medium", "Low")
TURKISH = {"Critical": "Kritik", "High": "Yüksek", "Medium": "Orta", "Low": "Düşük", "Yes": "Evet", "No": "Hayır", "Unknown": "Bilinmiyor", "Full name": "Ad soyad", "Phone": "Telefon", "Email": "E-posta", "Address": "Adres", "City": "Şehir", "School": "Okul", "Employer": "İşyeri", "Other": "Diğer"}


def items(tracker: DataFrame, include_unverified: bool = False) -> DataFrame:
    """Rows for the customer: confirmed and likely ones, unverified on request; notes are not carried."""
    wanted = ("Confirmed", "Likely", *(("Unverified",) if include_unverified else ()))
    return tracker.where(F.col("match_confidence").isin(*wanted)).drop("notes")


def severity_rank(s: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), s), F.lit(0)).cast("int")


def order_key(by: str) -> list[Column]:
    rank = F.when(severity_rank(F.col("severity")) == 0, 9).otherwise(severity_rank(F.col("severity")))
    return [rank, F.col("row_no")] if by == "severity" else [F.col("row_no")]


def counts(tracker: DataFrame) -> DataFrame:
    """what, label, n: findings by severity and by category in one pass over the items (grouping sets)."""
    t = tracker.select(F.coalesce("severity", F.lit("")).alias("severity"), F.coalesce(F.nullif(F.col("site_category"), F.lit("")), F.lit("Other")).alias("category"))
    g = t.groupingSets([[F.col("severity")], [F.col("category")]], "severity", "category").agg(F.count("*").alias("n"), F.grouping("severity").alias("g"))
    return g.select(F.when(F.col("g") == 0, "severity").otherwise("category").alias("what"), F.coalesce("severity", "category").alias("label"), "n").where("label != ''")


def localised(s: Column) -> Column:
    """Turkish words of a comma list; unknown words stay."""
    words = F.create_map(*[F.lit(x) for kv in TURKISH.items() for x in kv])
    return F.array_join(F.transform(F.split(s, ","), lambda w: F.coalesce(F.try_element_at(words, F.trim(w)), F.trim(w))), ", ")


def written_date(d: Column, lang: str) -> Column:
    return F.date_format(d, "dd.MM.yyyy" if lang == "tr" else "yyyy-MM-dd")


def run_counts(calls: DataFrame, hits: DataFrame, known: DataFrame, planned: DataFrame) -> DataFrame:
    """item, n: the summary of a run. calls: case_id, query_text, status (called, cached, skipped); hits: merged pages; known: hits that
    the tracker already has; planned: cells of a rescan (case_id, row_no, field)."""
    one = lambda item, n: n.select(F.lit(item).alias("item"), F.col("n"))
    rows = lambda df: df.agg(F.count("*").alias("n"))
    status = calls.groupBy("status").agg(F.count("*").alias("n")).select(F.concat(F.lit("searches "), "status").alias("item"), "n")
    found, old = rows(hits), rows(known)
    new = found.crossJoin(old.withColumnRenamed("n", "o")).select((F.col("n") - F.col("o")).alias("n"))  # one row each
    parts = [one("queries", calls.agg(F.countDistinct("case_id", "query_text").alias("n"))), one("unique pages", found), one("already tracked", old), one("new rows", new), one("rows checked again", planned.agg(F.countDistinct("case_id", "row_no").alias("n")))]
    out = status
    for p in parts:
        out = out.unionByName(p)
    return out
