"""Queries of the value splitter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veyra.operators.split_values import split_cells
from veyra.sources.tables import table

MAX_ENTRIES = 10_000


def vocabulary(spark: SparkSession, folder: str) -> list[str]:
    """The entries of lists. The table is a closed vocabulary; more than MAX_ENTRIES rows is an error, not a cut."""
    rows = table(spark, folder, "lists").select("entry").where("entry is not null").distinct().limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"lists has over {MAX_ENTRIES} entries; a closed vocabulary is expected")
    return sorted(r[0] for r in rows)


def _all(spark: SparkSession, folder: str) -> DataFrame:
    words = vocabulary(spark, folder)
    subjects, analyses, tracker = (table(spark, folder, t) for t in ("subjects", "analyses", "tracker"))
    fields = [
        split_cells(subjects, F.lit("name_variants"), "case_id", "name_variants", words),
        split_cells(subjects, F.lit("phones"), "case_id", "phones", words),
        split_cells(analyses, F.lit("data_types"), "analysis_id", "data_types", words),
        split_cells(tracker, F.lit("data_types_exposed"), F.concat_ws("#", "case_id", F.col("row_no").cast("string")), "data_types_exposed", words),
    ]
    return reduce(DataFrame.unionByName, fields)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _all(spark, folder).drop("error")


def p5_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The values that came from malformed quotes, by source."""
    return _all(spark, folder).groupBy("src", "error").agg(F.count("*").alias("n_values"))


QUERIES = {"p5_found": p5_found, "p5_errors": p5_errors}
ORACLES: dict[str, str] = {}
