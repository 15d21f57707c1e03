"""Mixing sources to target weights over fixed-length token blocks.

1. Each source's documents, in a pseudorandom order, are packed end to end into blocks of `block` tokens (a source's last
   block may be shorter; nothing is dropped).
2. The mixture is as large as the targets and the repeat caps allow; a source's quota is its share of that.
3. Every output shard draws its source counts; the draws are multinomial with what is left of the quotas as weights, so shares
   hold exactly over all shards up to one block per source. They go in two steps: the driver draws for at most MAX_GROUPS groups of
   shards, and each group draws for its shards on its own.
4. Slot j of a source maps to block perm(j mod n) of epoch j div n, perm a keyed permutation of the source's block indices per
   epoch: no block comes a second time before every block came once, and none more often than the cap.
5. Slots join blocks by (source, index).

What the driver holds is the plan of the groups: at most MAX_GROUPS x sources rows. The running offsets (sources x buckets, both bounded) are
broadcast between executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veyra.llm import tokens
from veyra.session import cut

BLOCK = 256
SHARD_BLOCKS = 4096
MAX_GROUPS = 1024  # groups of shards that the driver plans; a larger mixture has more shards to a group
BUCKETS, MAX_BUCKETS = 64, 1 << 16
BUCKET_TOKENS = 20_000_000  # tokens of all sources per bucket; buckets grow in number, not in size
MAX_SOURCES = 1000


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1, elementwise: a four-round Feistel network over the next even power of two,
    walked until the value is inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.ones(len(index), dtype=bool)
    key = key.astype(np.uint64)
    while todo.any():
        left, right, k, h, m = x[todo] >> half[todo], x[todo] & mask[todo], key[todo], half[todo], mask[todo]
        for r in range(4):
            f = (right + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ k
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        x[todo] = (left << h) | right
        todo = x >= n.astype(np.uint64)
    return x.astype(np.int64)


def packed_blocks(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(source, index, n_tokens, ids, docs): the token blocks of each source. docs: doc_id, source, ids. The column docs names the
    documents of a block in order, with the tokens each has in it.

    A hot source is spread over buckets by a hash of the document id, as many as the tokens call for; a bucket starts where the
    tokens of the buckets before it end, so no task sees a whole source. A document that crosses a block's end gives its pieces to both blocks.
    """
    d = docs.select("doc_id", "source", "ids", F.size("ids").alias("n")).where("n > 0")
    tokens_in_all = d.agg(F.sum("n")).first()[0] or 0
    buckets = min(max(BUCKETS, -(-tokens_in_all // BUCKET_TOKENS)), MAX_BUCKETS)
    d = d.withColumns({"h": F.xxhash64("doc_id", F.lit(seed))}).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
    sums = d.groupBy("source", "bucket").agg(F.sum("n").alias("t"))
    sources = sums.select("source").distinct().count()
    if sources > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    starts = sums.select("source", "bucket", (F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("base"))
    run = Window.partitionBy("source", "bucket").orderBy("h", "doc_id")
    at = d.withColumn("before", F.sum("n").over(run) - F.col("n")).join(F.broadcast(starts), ["source", "bucket"])
    at = at.select("source", "doc_id", "ids", "n", (F.col("base") + F.col("before")).alias("start"))
    piece = at.select("source", "doc_id", "ids", "n", "start", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + n - 1) div {block}"))).alias("index"))
    lo = F.greatest(F.col("index") * block - F.col("start"), F.lit(0))
    hi = F.least((F.col("index") + 1) * block - F.col("start"), F.col("n"))
    piece = piece.select("source", "doc_id", "index", (F.col("start") + lo).alias("o"), F.slice("ids", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("ids"))
    whole = piece.groupBy("source", "index").agg(F.array_sort(F.collect_list(F.struct("o", "doc_id", "ids"))).alias("p"))  # at most `block` pieces
    docs_of = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), F.size(x["ids"]).alias("n")))
    return whole.select("source", "index", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), docs_of.alias("docs")).withColumn("n_tokens", F.size("ids"))


def quotas(blocks_of: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, int]:
    """Blocks per source: the largest total at which no source exceeds its cap, split by the shares (largest remainders)."""
    live = [(s, w, blocks_of.get(s, 0) * m) for s, w, m in targets if w and w > 0]
    live = [x for x in live if x[2] > 0]
    if not live:
        return {}
    weight = sum(w for _, w, _ in live)
    total = int(min(c / (w / weight) for _, w, c in live))
    exact = {s: total * w / weight for s, w, _ in live}
    q = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (q[s] - exact[s], s))[: total - sum(q.values())]:
        q[s] += 1
    return {s: min(q[s], c) for s, _, c in live}


def shard_counts(q: dict[str, int], shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> list[tuple[int, str, int, int]]:
    """(shard, source, first slot of the source, count): multinomial draws per shard, weighted by what is left of each quota."""
    rng, left, used, out, shard = np.random.default_rng(seed), dict(q), dict.fromkeys(q, 0), [], 0
    names = sorted(q)
    while sum(left.values()):
        total = sum(left.values())
        size, counts = min(shard_blocks, total), {}
        for s in names:  # a multinomial draw as a chain of binomial ones, never more than is left
            rest = total - left[s]
            counts[s] = int(rng.binomial(size, left[s] / total)) if left[s] else 0
            counts[s] = max(min(counts[s], left[s], size), size - rest)
            size, total = size - counts[s], rest
        for s in names:
            if counts[s]:
                out.append((shard, s, used[s], counts[s]))
                used[s] += counts[s]
                left[s] -= counts[s]
        shard += 1
    return out


def mix(docs: DataFrame, targets: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """(shard, slot, source, index, repeat, n_tokens, ids, docs): the mixture, one row per block, slots shuffled within a shard.

    docs: doc_id, source, ids (see tokens.encode_column); targets: source, target_share, max_repeats (at most MAX_SOURCES rows).
    Documents of sources without a target, with null source or without tokens take no part. A target whose source has no
    tokens is left out and the other shares are scaled up to 1. An empty table gives an empty mixture. Repeated documents are
    documents of their own.
    """
    spark = docs.sparkSession
    wanted = [(r[0], float(r[1] or 0), int(r[2] or 0)) for r in targets.select("source", "target_share", "max_repeats").where("source is not null").limit(MAX_SOURCES + 1).collect()]
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    chosen = cut(docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi"), "tokens")  # encoded once, read thrice
    blocks = cut(packed_blocks(chosen, block, seed), "blocks")
    n_of = {r["source"]: r["n"] for r in blocks.groupBy("source").agg((F.max("index") + 1).alias("n")).collect()}
    q = quotas(n_of, wanted)
    per_group = max(1, -(-sum(q.values()) // (shard_blocks * MAX_GROUPS)))  # shards of a group
    plan = [(g, s, first, c, n_of[s]) for g, s, first, c in shard_counts(q, shard_blocks * per_group, seed)]
    slots = _slots(spark, plan, seed, shard_blocks, per_group)
    joined = slots.join(blocks, ["source", "index"])
    return joined.select("shard", F.xxhash64(F.lit(seed), "source", "index", "repeat").alias("slot"), "source", "index", "repeat", "n_tokens", "ids", "docs")


def _slots(spark: SparkSession, plan: list[tuple[int, str, int, int, int]], seed: int, shard_blocks: int, per_group: int) -> DataFrame:
    """One row per slot: its shard, source, block index and how often the block came before."""

    def shards(rows: pd.DataFrame) -> pd.DataFrame:
        group, first, n = int(rows["g"].iloc[0]), dict(zip(rows["source"], rows["first"])), dict(zip(rows["source"], rows["n"]))
        drawn = shard_counts({s: int(c) for s, c in zip(rows["source"], rows["count"])}, shard_blocks, seed + 1 + group)
        return pd.DataFrame([(group * per_group + h, s, int(first[s]) + f, c, int(n[s])) for h, s, f, c in drawn], columns=["shard", "source", "first", "count", "n"])

    frame = spark.createDataFrame(plan or [], "g long, source string, first long, count long, n long")
    frame = frame.groupBy("g").applyInPandas(shards, "shard long, source string, first long, count long, n long")
    # At most shard_blocks slots to a row.
    rows = frame.select("shard", "source", "n", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("j")).withColumn("repeat", F.expr("cast(j div n as int)"))

    @F.pandas_udf("long")
    def block_index(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for i, n, key in it:
            yield pd.Series(permute(i.to_numpy(), n.to_numpy(), key.to_numpy()))

    return rows.withColumn("index", block_index(F.expr("j % n"), F.col("n"), F.xxhash64("source", "repeat", F.lit(seed)))).select("shard", "source", "repeat", "index")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_blocks, n_tokens, actual_share, most_repeats): one row per target."""
    per_block = mixed.groupBy("source", "index").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("t"))
    got = per_block.groupBy("source").agg(F.sum("uses").alias("n_blocks"), F.sum("t").alias("n_tokens"), F.max("uses").alias("most_repeats"))
    total = got.agg(F.sum("n_tokens").alias("total"))
    out = targets.select("source", "target_share", "max_repeats").join(F.broadcast(got), "source", "left").join(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("source", "target_share", "max_repeats", zero("n_blocks"), zero("n_tokens"), (F.coalesce(F.col("n_tokens"), F.lit(0)) / F.col("total")).alias("actual_share"), zero("most_repeats"))


def document_uses(mixed: DataFrame) -> DataFrame:
    """(doc_id, source, used_tokens, most_uses): the documents of a mixture, how many tokens of each it holds, repeats counted, and how
    often the part of it that came most often came."""
    blocks = mixed.groupBy("source", "index").agg(F.count("*").alias("uses"), F.first("docs").alias("docs"))
    each = blocks.select("source", "uses", F.inline("docs"))
    return each.groupBy("doc_id", "source").agg(F.sum(F.col("uses") * F.col("n")).alias("used_tokens"), F.max("uses").alias("most_uses"))


def mixed_documents(docs: DataFrame, targets: DataFrame, text: str = "text", path: str | None = None, **settings) -> DataFrame:
    """mix() from raw documents (doc_id, source, text)."""
    chosen = docs.where(F.col("source").isNotNull() & (F.length(text) > 0))
    return mix(tokens.encode_column(chosen, text, ["doc_id", "source"], path=path), targets, **settings)
