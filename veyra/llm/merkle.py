"""Duplicates hidden by formatting: Merkle-style digests of nested records.

A record is a tree. Leaves are normalised (white space, letter case and punctuation go) and digested; a node's digest covers
its tag and its children's digests, in order where order matters and sorted where it does not; records group by the root
digest. The full structural comparison follows: of each group the smallest and the largest canonical structure are kept, and
where they differ - two records with one digest - the group is split by structure. All steps are JVM expressions; the only shuffle is
the grouping, after map-side partial aggregation, so a page that holds a third of all rows arrives as one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veyra.functions import urls
from veyra.session import cut

_US, _RS = "\x1f", "\x1e"  # between children, between parts: neither survives normalisation


def leaf_text(s: Column) -> Column:
    """A leaf without white space, letter case and punctuation; letters, digits and marks stay."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}\p{M}]+|̇", "")


def leaf(tag: str, text: Column) -> Column:
    return F.md5(F.concat(F.lit(tag + _US), text))


def ordered(tag: str, children: Column) -> Column:
    return F.md5(F.concat(F.lit(tag + _RS), F.array_join(children, _US)))


def unordered(tag: str, children: Column) -> Column:
    return F.md5(F.concat(F.lit(tag + _RS), F.array_join(F.array_sort(children), _US)))


def url_record(url: Column) -> Column:
    """struct<host, port, path: array, params: array<struct<k,v>>> with normalised leaves; wrappers around the URL go."""
    u = F.regexp_replace(url, r"[\s\x{a0}\x{200b}\x{2007}\x{202f}\x{feff}]+", "")
    u = F.regexp_replace(F.regexp_replace(u, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}/]+$", "")
    at = lambda i: F.regexp_extract(u, r"^(?i:([a-z][a-z0-9+.\-]*)://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    net = F.regexp_replace(at(2), r"^.*@", "")
    port = F.regexp_extract(net, r":(\d+)$", 1)
    scheme = F.when(at(1) == "", "https").otherwise(F.lower(at(1)))
    default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(net, r":\d*$", "")), r"^www\.", ""), r"[^\p{L}\p{N}]+$", "")
    segments = F.filter(F.transform(F.split(at(3), "/"), lambda x: leaf_text(urls.unquote_plus(x))), lambda x: x != "")
    pairs = F.transform(
        F.filter(F.split(at(4), "&"), lambda x: ~urls.is_tracking(F.substring_index(x, "=", 1))),
        lambda x: F.struct(leaf_text(urls.unquote_plus(F.substring_index(x, "=", 1))).alias("k"), F.when(x.contains("="), leaf_text(urls.unquote_plus(F.substring(x, F.instr(x, "=") + 1, F.length(x))))).otherwise("").alias("v")),
    )
    return F.struct(host.alias("host"), F.when(default, "").otherwise(port).alias("port"), segments.alias("path"), F.array_sort(F.filter(pairs, lambda p: (p["k"] != "") | (p["v"] != ""))).alias("params"))


def url_digest(r: Column) -> Column:
    """Bottom-up digest of a url_record: the path keeps its order, the parameters do not."""
    path = ordered("path", F.transform(r["path"], lambda x: leaf("s", x)))
    query = unordered("params", F.transform(r["params"], lambda p: ordered("p", F.array(leaf("k", p["k"]), leaf("v", p["v"])))))
    return ordered("url", F.array(leaf("host", r["host"]), leaf("port", r["port"]), path, query))


def canonical(r: Column) -> Column:
    """The whole normalised structure as one string, injective because leaves hold no control characters."""
    return F.concat_ws(_RS, r["host"], r["port"], F.array_join(r["path"], _US), F.array_join(F.transform(r["params"], lambda p: F.concat(p["k"], F.lit("="), p["v"])), _US))


def url_pages(df: DataFrame, url: str, row_id: str) -> DataFrame:
    """(root, keep_id, copies): one row per page of df, with its smallest row id and its number of rows.

    A null url is no page and gives no row; '' and urls of punctuation only share the empty record; repeated rows count as
    rows of their own; ties of ids are harmless as only the minimum is kept. Other columns are not read.
    """
    rows = df.select(F.col(row_id).alias("id"), url_record(F.col(url)).alias("r")).where(F.col(url).isNotNull())
    return groups(rows.select("id", url_digest(F.col("r")).alias("root"), canonical(F.col("r")).alias("structure")))


def groups(rows: DataFrame) -> DataFrame:
    """(root, keep_id, copies) of rows (id, root, structure): by digest, and by structure where one digest has several."""
    by_root = rows.groupBy("root").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"), (F.min("structure") != F.max("structure")).alias("clash"))
    by_root = cut(by_root, "digests")
    if by_root.where("clash").isEmpty():
        return by_root.drop("clash")
    torn = rows.join(by_root.where("clash").select("root"), "root", "left_semi")
    split = torn.groupBy("root", "structure").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")).drop("structure")
    return by_root.where("NOT clash").drop("clash").unionByName(split)
