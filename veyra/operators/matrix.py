"""Search-query matrix of each subject: cross products of names with other identifiers, dedup that keeps the first place and the
better kind, order by priority. One row per query; every step joins or explodes within one subject."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veyra.functions import ident, text

# Kinds in the order of their priority.
KINDS = ("name_main", "name", "email", "phone", "username", "name_city", "name_employer", "name_school", "site_broker", "site_social", "site_professional")
GROUP_SIZE = 8
MAX_GROUPS = 10_000  # each name is paired with each group, so their number is checked


def quote(s: Column) -> Column:
    return F.concat(F.lit('"'), F.trim(F.replace(s, F.lit('"'), F.lit(""))), F.lit('"'))


def priority(kind: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind) - 1, F.lit(99)).cast("int")


def name_forms(subjects: DataFrame) -> DataFrame:
    """case_id, n (place), form: each distinct spelling of each distinct name."""
    names = ident.distinct_names(F.col("full_name"), F.col("name_variants"))
    forms = F.array_distinct(F.flatten(F.transform(names, lambda x: F.array(F.trim(x), text.fold_case_kept(F.trim(x))))))
    return subjects.select("case_id", F.posexplode(F.filter(forms, lambda x: x != "")).alias("n", "form"))


def site_groups(sites: DataFrame, size: int = GROUP_SIZE) -> DataFrame:
    """kind, g, filter: domains chunked in order into (site:a OR site:b ...); a chunk of one stands bare. sites: kind, ord, domain,
    a closed dictionary."""
    first = sites.where("domain is not null and domain != ''").groupBy("kind", "domain").agg(F.min("ord").alias("ord"))
    place = first.withColumn("g", F.expr(f"cast((row_number() over (partition by kind order by ord) - 1) div {max(size, 1)} as int)"))
    chunk = place.groupBy("kind", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "domain"))), lambda x: F.concat(F.lit("site:"), x["domain"])), " OR ").alias("f"), F.count("*").alias("k"))
    return chunk.select("kind", "g", F.when(F.col("k") > 1, F.concat(F.lit("("), "f", F.lit(")"))).otherwise(F.col("f")).alias("filter"))


def raw_queries(subjects: DataFrame, sites: DataFrame | None = None, group_size: int = GROUP_SIZE) -> DataFrame:
    """case_id, text, kind, ord (array<int> that sorts as written): the matrix before dedup."""
    names = name_forms(subjects)
    o = lambda *cs: F.array(*[F.lit(c).cast("int") if isinstance(c, int) else c.cast("int") for c in cs]).alias("ord")
    main = subjects.select("case_id", quote(F.col("full_name")).alias("text"), F.lit("name_main").alias("kind"), o(0))
    single = names.select("case_id", quote(F.col("form")).alias("text"), F.lit("name").alias("kind"), o(1, F.col("n")))
    parts = [main, single]
    for block, (kind, field) in enumerate((("name_city", "cities"), ("name_employer", "employers"), ("name_school", "schools"))):
        values = subjects.select("case_id", F.posexplode(field).alias("v", "value")).where("value is not null")
        parts.append(names.join(values, "case_id").select("case_id", F.concat_ws(" ", quote(F.col("form")), quote(F.col("value"))).alias("text"), F.lit(kind).alias("kind"), o(2, F.col("n"), block, F.col("v"))))
    for block, (kind, field) in enumerate((("email", "emails"), ("username", "usernames"))):
        clean = ident.bare_username(F.col("value")) if kind == "username" else F.col("value")
        parts.append(subjects.select("case_id", F.posexplode(field).alias("v", "value")).where("value is not null").select("case_id", quote(clean).alias("text"), F.lit(kind).alias("kind"), o(3 + block, F.col("v"))))
    phones = subjects.select("case_id", F.posexplode("phones").alias("v", "value")).where("value is not null").select("case_id", "v", F.posexplode(ident.phone_formats(F.col("value"))).alias("k", "form"))
    parts.append(phones.select("case_id", quote(F.col("form")).alias("text"), F.lit("phone").alias("kind"), o(5, F.col("v"), F.col("k"))))
    if sites is not None:
        groups = site_groups(sites, group_size)
        if groups.limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
            raise ValueError(f"over {MAX_GROUPS} site groups; a closed dictionary is expected")
        kinds = F.array_position(F.array(*[F.lit(k) for k in KINDS[8:]]), F.col("kind")).cast("int")
        parts.append(names.join(F.broadcast(groups)).select("case_id", F.concat_ws(" ", quote(F.col("form")), F.col("filter")).alias("text"), "kind", o(6, kinds, F.col("g"), F.col("n"))))
    return reduce(DataFrame.unionByName, parts)


def dedupe(queries: DataFrame, by: str = "case_id") -> DataFrame:
    """by, text, kind, priority, ord: equal texts (Turkish lower case, white space collapsed; Turkish and ASCII spellings stay
    apart) become one, at the first place, with the best kind; place is its rank in priority order."""
    q = queries.withColumn("key", text.collapse_ws(text.tr_lower(F.col("text")))).withColumn("priority", priority(F.col("kind")))
    one = q.groupBy(by, "key").agg(F.min("ord").alias("ord"), F.min_by(F.struct("text", "kind", "priority"), F.struct("priority", "ord")).alias("q"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("q.priority", "ord"))
    return one.select(by, "q.text", "q.kind", "q.priority", rank.alias("place"))


def limited(queries: DataFrame, most: int) -> DataFrame:
    """The first `most` queries of each case in priority order; all of them for 0."""
    return queries.where(F.col("place") <= most) if most else queries


def cost(queries: DataFrame, page_size: int, max_results: int, cached: DataFrame | None = None) -> DataFrame:
    """kind, pages, from_cache: calls that a run needs, a page at a time; cached: text, page."""
    pages = queries.select("kind", "text", F.explode(F.sequence(F.lit(0), F.lit(-(-max_results // page_size) - 1))).alias("page"))
    if cached is not None:
        pages = pages.join(cached.select("text", "page", F.lit(1).alias("hit")).distinct(), ["text", "page"], "left")
    else:
        pages = pages.withColumn("hit", F.lit(None).cast("int"))
    return pages.groupBy("kind").agg(F.count("*").alias("pages"), F.count("hit").alias("from_cache"))
