"""Outputs: JSON lines, report text, dated names, save-as-new, and the removal of one case's data."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAMP = re.compile(r"_\d{4}-\d{2}-\d{2}_\d{4}(?:\d{2})?$")


def timestamped_name(stem: str, when: dt.datetime) -> str:
    """The stem with its old stamp, if any, replaced by a new one."""
    return f"{_STAMP.sub('', stem)}_{when:%Y-%m-%d_%H%M%S}"


def save_as_new(df: DataFrame, path: str) -> str:
    """Partitioned by case; an existing path is an error, so an input is never overwritten."""
    df.write.mode("errorifexists").partitionBy("case_id").parquet(path)
    return path


def raw_lines(fetches: DataFrame) -> DataFrame:
    """One JSON text per fetch, with the number of characters instead of the html."""
    cols = [F.col(c) for c in fetches.columns if c != "html"]
    return fetches.select(F.to_json(F.struct(*cols, F.length("html").alias("html_chars"))).alias("value"))


def report_lines(title: str, counts: DataFrame, label: str, number: str) -> str:
    """Markdown of a small aggregate (as many rows as there are labels)."""
    rows = counts.select(label, number).collect()
    clean = lambda s: str(s).replace("|", "\\|").replace("\n", " ")
    return "\n".join([f"# {clean(title)}", "", f"| {label} | {number} |", "|-|-|", *(f"| {clean(r[0])} | {r[1]} |" for r in rows)])


def purge(spark: SparkSession, root: str, case_id: str) -> int:
    """Deletes exactly the partition of one case under root; returns the number of files. A case id that leaves root is refused."""
    if not re.fullmatch(r"[A-Za-z0-9_.\-]+", case_id) or set(case_id) <= {"."}:
        raise ValueError(f"no usable case id: {case_id!r}")
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = jvm.org.apache.hadoop.fs.Path(base, f"case_id={case_id}")
    if not fs.exists(target):
        return 0
    if not fs.resolvePath(target).toString().startswith(fs.resolvePath(base).toString() + "/"):
        raise ValueError("the case folder lies outside the root")
    n = sum(1 for s in fs.listStatus(target) if s.isFile())
    fs.delete(target, True)
    return n
