"""Mixing sources to target weights (problem 9).

The mixture's size follows from the scarcest source.  Each source's quota is drawn as whole passes over its documents
plus a part of one more pass, block by block in permuted order; blocks are shared out among the output shards by a
splitting tree of multivariate hypergeometric draws, so each shard is a sample of the mixture; within a shard the
documents are shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowio import cut_lineage, table
from .tokens import count_tokens

#: Documents of a block and of an output shard, on average.
BLOCK_DOCS, SHARD_DOCS = 500, 20_000
SEED = 17
#: Targets that are broadcast; a longer table is joined.
FEW_TARGETS = 10_000
#: Nodes of the splitting tree from which executors draw on.
TOP_NODES = 64
_UNIT = float(1 << 53)


def _halve(lo: int, hi: int, have: np.ndarray, before: np.ndarray, seed: int):
    """The two children of a node: (first shard, end, blocks of each source, blocks of each source left of it)."""
    mid = (lo + hi) // 2
    total = int(have.sum())
    # sizes of shards differ by one at most, wherever the tree cuts
    want = total * (mid - lo) // (hi - lo)
    rng = np.random.default_rng([seed, lo, hi])
    drawn = np.zeros_like(have)
    rest = total
    for s, n in enumerate(have):
        # the marginals of the multivariate draw, one source after the other
        rest -= int(n)
        drawn[s] = rng.hypergeometric(int(n), rest, want) if want and n else 0
        want -= int(drawn[s])
    return (lo, mid, drawn, before), (mid, hi, have - drawn, before + drawn)


def _grow(node, seed: int, most: int | None = None):
    """The nodes under ``node``: its leaves, or the first ``most`` ones of one level and leaves above it."""
    level = [node]
    while any(hi - lo > 1 for lo, hi, _, _ in level) and (most is None or len(level) < most):
        level = [child for n in level for child in (_halve(*n, seed) if n[1] - n[0] > 1 else (n,))]
    return level


def split_quotas(counts: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows): exact column sums, shard sizes equal up to one block.

    A node of the tree holds the counts of its shards; the left half's share is a multivariate hypergeometric draw.
    """
    counts = np.asarray(counts, dtype=np.int64)
    return np.stack([have for _, _, have, _ in _grow((0, shards, counts, np.zeros_like(counts)), seed)])


def shard_ranks(spark: SparkSession, names: list[str], counts: list[int], shards: int, seed: int = SEED) -> DataFrame:
    """(source, rank, shard): the shard of each block of each source by the block's place in the permuted order.

    The driver draws the top of the splitting tree only; every node below is a row from which a task draws its part.
    """
    start = np.array(counts, dtype=np.int64)
    top = _grow((0, shards, start, np.zeros_like(start)), seed, TOP_NODES) if names else []
    nodes = spark.createDataFrame(
        [(lo, hi, have.tolist(), before.tolist()) for lo, hi, have, before in top], "lo long, hi long, have array<long>, before array<long>"
    )

    def leaves(batches):
        for batch in batches:
            for lo, hi, have, before in zip(*(c.to_pylist() for c in batch.columns)):
                for shard, _, n, first in _grow((lo, hi, np.array(have, np.int64), np.array(before, np.int64)), seed):
                    some = np.flatnonzero(n)
                    if len(some):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([names[k] for k in some]), pa.array(first[some]), pa.array(n[some]), pa.array(np.full(len(some), shard))],
                            names=["source", "first", "n", "shard"],
                        )

    spans = nodes.repartition(max(1, min(len(top), TOP_NODES))).mapInArrow(leaves, "source string, first long, n long, shard long")
    return spans.select("source", F.explode(F.sequence("first", F.expr("first + n - 1"))).alias("rank"), F.col("shard").cast("int").alias("shard"))


def running(df: DataFrame, part: str, bucket: str, order: list, value, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same ``part`` that stand before each row.

    Rows are ordered by ``bucket`` and then ``order``.  Two levels: a window within each (part, bucket), and one over
    the buckets' totals, so no task sees all rows of a part.
    """
    totals = df.groupBy(part, bucket).agg(F.sum(value).alias("_sum"))
    above = Window.partitionBy(part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(part, bucket, F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_above"))
    within = Window.partitionBy(part, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(totals, [part, bucket]).withColumn(
        name, F.col("_above") + F.col("_within")
    ).drop("_above", "_within")


def _plan(stats: list[dict], total_tokens: float | None) -> list[dict]:
    """Quota of each target: shares are taken among the sources that have documents."""
    there = [s for s in stats if s["tokens"] and s["share"] > 0 and s["max_repeats"] > 0]
    weight = sum(s["share"] for s in there)
    most = min((s["tokens"] * s["max_repeats"] * weight / s["share"] for s in there), default=0.0)
    size = min(most, total_tokens) if total_tokens else most
    for s in stats:
        s["quota"] = size * s["share"] / weight if s in there else 0.0
        s["passes"] = int(s["quota"] // s["tokens"]) if s["tokens"] else 0
        s["passes"] = min(s["passes"], s["max_repeats"])
        s["part"] = s["quota"] - s["passes"] * s["tokens"] if s["passes"] < s["max_repeats"] else 0.0
    return stats


def mix(
    docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = SEED,
    block_docs: int = BLOCK_DOCS, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """(shard, position, doc_id, source, pass_no, n_tokens) of (doc_id, source, n_tokens) and (source, target_share,
    max_repeats).

    Without ``total_tokens`` the mixture is as large as the scarcest source allows.  Actual shares miss their targets by
    less than one document per source.  Documents without tokens, of no source or of one without target are left out;
    targets without documents get nothing and the other shares grow in proportion.  A repeated row is a document of its
    own.  A source's documents lie in many blocks by hash, and its blocks in as many buckets as a bucket has blocks, so
    a source with a third of all rows makes no large group anywhere.
    """
    spark = docs.sparkSession
    goal = targets.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("max_repeats")).where("source is not null")
    goal = goal.orderBy("source").collect()
    few = F.broadcast if len(goal) <= FEW_TARGETS else lambda df: df
    wanted = few(spark.createDataFrame([(r["source"],) for r in goal], "source string"))
    docs = cut_lineage(docs.where("n_tokens > 0").join(wanted, "source", "left_semi").select("doc_id", "source", "n_tokens"))
    sums = {r["source"]: r for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
    stats = [
        {"source": r["source"], "share": r["share"] or 0.0, "max_repeats": r["max_repeats"] or 0,
         "tokens": sums[r["source"]]["tokens"] if r["source"] in sums else 0, "docs": sums[r["source"]]["docs"] if r["source"] in sums else 0}
        for r in goal
    ]
    stats = _plan(stats, total_tokens)
    # one plan row per source; as many buckets as a bucket has blocks
    blocks_of = {s["source"]: max(1, -(-s["docs"] // block_docs)) for s in stats}
    plan = spark.createDataFrame(
        [(s["source"], s["passes"], float(s["part"]), blocks_of[s["source"]], math.isqrt(blocks_of[s["source"]])) for s in stats],
        "source string, passes int, part double, n_blocks int, n_buckets int",
    )
    unit = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 11) / F.lit(_UNIT)
    # repeated rows of one document differ by their place in the checkpoint, so they spread over the blocks too
    placed = docs.withColumn("row", F.monotonically_increasing_id()).join(few(plan), "source").withColumn("u", unit(F.lit(seed), "source", "doc_id", "row"))
    placed = placed.withColumn("block", F.floor(F.col("u") * F.col("n_blocks")).cast("int"))
    placed = cut_lineage(placed)
    # blocks in permuted order, with the tokens before each
    blocks = placed.groupBy("source", "block", "passes", "part", "n_blocks", "n_buckets").agg(F.sum("n_tokens").alias("tokens"))
    blocks = blocks.withColumn("bucket", F.floor(F.col("block") * F.col("n_buckets") / F.col("n_blocks")).cast("int"))
    blocks = running(blocks, "source", "bucket", ["block"], "tokens", "before")
    # whole passes take every block, the last pass the blocks that begin within its part
    last = F.when(F.col("before") < F.col("part"), 1).otherwise(0)
    copies = blocks.where(F.col("passes") + last > 0).select(
        "source", "block", "part", "passes", "before", "n_buckets", F.explode(F.sequence(F.lit(0), F.col("passes") + last - 1)).alias("pass_no")
    )
    copies = copies.withColumn("h", F.xxhash64(F.lit(seed), F.lit("order"), "source", "pass_no", "block")).withColumn("one", F.lit(1))
    # buckets of equal hash ranges follow one another in the order of the hash
    copies = copies.withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + F.lit(0.5)) * F.col("n_buckets")).cast("int"))
    copies = cut_lineage(running(copies, "source", "bucket", ["h", "pass_no", "block"], "one", "rank").drop("h", "one", "bucket", "n_buckets"))
    counts = {r["source"]: r["count"] for r in copies.groupBy("source").count().collect()}
    names = sorted(counts)
    drawn = sum(sums[n]["docs"] * (s["passes"] + 1) for s in stats for n in [s["source"]] if n in counts)
    n_shards = max(1, min(-(-drawn // shard_docs), sum(counts.values())))
    copies = copies.join(shard_ranks(spark, names, [counts[n] for n in names], n_shards, seed), ["source", "rank"]).drop("rank")
    # a block that the part ends in gives the documents before that point
    inside = Window.partitionBy("source", "block", "pass_no").orderBy("u", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    used = (
        placed.select("source", "block", "doc_id", "n_tokens", "u", "row").join(copies, ["source", "block"])
        .withColumn("done", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .where((F.col("pass_no") < F.col("passes")) | (F.col("done") + F.col("n_tokens") / 2 <= F.col("part")))
    )
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "doc_id", "pass_no"), "doc_id", "pass_no", "row")
    return used.withColumn("position", F.row_number().over(local) - 1).select("shard", "position", "doc_id", "source", "pass_no", "n_tokens")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, ["doc_id", "source"], "text"), table(spark, sf_dir, "source_targets")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(*_inputs(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of the tokens of each target source, and the most often that a document is used."""
    docs, targets = _inputs(spark, sf_dir)
    mixed = mix(docs, targets)
    uses = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    got = uses.groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("n").alias("most_uses"))
    total = got.agg(F.sum("tokens").alias("all_tokens"))
    return targets.join(got, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.coalesce(F.round(F.col("tokens") / F.col("all_tokens"), 6), F.lit(0.0)).alias("actual_share"),
    )
