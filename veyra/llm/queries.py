"""Queries and SQL of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veyra.llm import addresses, encoding, mainbody, merkle, mixture, notices, personal, quality, tokens
from veyra.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda name, url, key: merkle.url_pages(table(spark, folder, name), url, key).where("copies >= 2").select(F.lit(name).alias("src"), "keep_id", "copies")
    return one("search_results", "url", "result_id").unionByName(one("hits", "key", "hit_id"))


def p1_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page of both tables, cases or not."""
    one = lambda name, url, key: merkle.url_pages(table(spark, folder, name), url, key).select(F.lit(name).alias("src"), "keep_id", "copies")
    return one("search_results", "url", "result_id").unionByName(one("hits", "key", "hit_id"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = mainbody.walked(table(spark, folder, "fetches"))
    return mainbody.main_blocks(pages, notices.notices_of(pages).where(F.col("p") >= notices.CUT))


def _personal(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    fetches, analyses, subjects = (table(spark, folder, t) for t in ("fetches", "analyses", "subjects"))
    return personal.personal_information(fetches.select("fetch_id", "html"), analyses.select("analysis_id", "data_types", "matched"), subjects)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.values(_personal(spark, folder)[0])


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts with typed placeholders."""
    return personal.redacted(_personal(spark, folder)[0])


def p3_reliabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated accuracy of each labeler."""
    report = _personal(spark, folder)[1]
    rows = [(personal.TYPES[t], name, float(a)) for t, r in report.items() for name, a in zip(personal.LABELERS[t], r.accuracy())]
    return spark.createDataFrame(rows, "pii_type string, labeler string, accuracy double")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and the text between the tags of pages, one column `text`."""
    titles = table(spark, folder, "search_results").select(F.col("title").alias("text"))
    pages = table(spark, folder, "fetches").where("html is not null").select(F.explode(encoding.segments(F.col("html"))).alias("text"))
    return titles.unionByName(pages)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = _texts(spark, folder)
    votes, words = encoding.learn(texts), encoding.clean_words(texts)
    fixed = []
    for name, key, text in (("search_results", "result_id", "title"), ("fetches", "fetch_id", "html")):
        rows = table(spark, folder, name).select(F.lit(name).alias("src"), F.col(key).alias("rec_id"), text)
        fixed.append(encoding.restore(rows, ["src", "rec_id"], text, votes, words, html=text == "html"))
    return fixed[0].unionByName(fixed[1]).select("src", "rec_id", F.when(F.col("lost"), "").otherwise(F.md5("fixed")).alias("fixed_md5"))


def p4_transformations(spark: SparkSession, folder: str) -> DataFrame:
    """What the twins taught: votes per transformation."""
    votes = encoding.learn(_texts(spark, folder))
    return spark.createDataFrame(sorted(votes.items()), "transformation string, votes long")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.same_building(table(spark, folder, "address_records"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return notices.notices(table(spark, folder, "fetches")).where(F.col("p") >= notices.CUT).select("fetch_id")


def p7_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts that the classifier has not seen: agreement with the weak labels, and with what status and length alone suggest."""
    held = notices.notices(table(spark, folder, "fetches")).where("held_out").withColumn("said", (F.col("p") >= notices.CUT).cast("int"))
    held = held.select("said", F.explode(F.create_map(F.lit("weak"), "weak", F.lit("status"), "by_status")).alias("judge", "label")).where("label >= 0")
    return held.groupBy("judge", "label").agg(F.count("*").alias("n_pages"), F.avg((F.col("said") == F.col("label")).cast("double")).alias("agreement"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_column(table(spark, folder, "documents").select("doc_id", "text"), "text", ["doc_id"])


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixed_documents(table(spark, folder, "documents").select("doc_id", "source", "text"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.shares(p9_mix(spark, folder), table(spark, folder, "mix_targets"))


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    """How often the mixture uses each document."""
    return mixture.document_uses(p9_mix(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_types(spark, folder).where("kind != 'prose'").select("doc_id", "kind")


def p10_types(spark: SparkSession, folder: str) -> DataFrame:
    """Posterior shares of the text types of every non-blank document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.text_types(docs, quality.common_words(docs))


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.statistics(docs, quality.common_words(docs))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pages, p2_found, p3_found, p3_redacted, p3_reliabilities, p4_found, p4_transformations, p6_found, p7_found, p7_validation, p8_ids, p9_mix, p9_shares, p9_documents, p10_found, p10_types, p10_statistics)
}
_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
ORACLES: dict[str, str] = {
    "p10_statistics": rf"""
WITH d AS (SELECT doc_id, text AS t, list_filter(string_split_regex(text, '[ \t\n\f\r\x{{a0}}]+'), lambda w: w <> '') AS w,
                  list_filter(string_split_regex(text, '[\n\r]+'), lambda x: regexp_matches(x, '[^ \t\f\x{{a0}}]')) AS l FROM documents),
low AS (SELECT doc_id, list_transform(w, lambda x: regexp_replace(lower(replace(x, 'İ', 'i')), '{_EDGE}', '', 'g')) AS b FROM d),
c AS (SELECT x FROM (SELECT x, count(*) AS n FROM (SELECT unnest(list_distinct(b)) AS x FROM low) WHERE x <> '' AND NOT regexp_matches(x, '[0-9]') GROUP BY x
      ORDER BY n DESC, x LIMIT {quality.COMMON_WORDS})),
k AS (SELECT list(x) AS common FROM c)
SELECT d.doc_id, CAST(length(t) AS BIGINT) AS n_chars, CAST(len(w) AS BIGINT) AS n_words,
       CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) END AS mean_word_length,
       CASE WHEN length(t) > 0 THEN round(length(regexp_replace(t, '[\p{{L}}\p{{N}} \t\n\f\r\x{{a0}}]', '', 'g')) / length(t), 6) END AS symbol_ratio,
       CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(rtrim(x), '[.!?…]$'))) / len(l), 6) END AS line_end_ratio,
       CASE WHEN len(w) > 0 THEN round(len(list_filter(b, lambda x: list_contains(common, x))) / len(w), 6) END AS common_ratio
FROM d JOIN low USING (doc_id), k""",
}
