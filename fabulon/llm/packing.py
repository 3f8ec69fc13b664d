"""Filling fixed-capacity containers with items (problem 8).

Documents are routed to the tier of the smallest capacity that holds them; what exceeds the largest capacity is split.
Each shard packs its long tiers first (best fit, longest first), fills the gaps of their containers from the shorter
tiers, and packs what is left of those.  Containers of equal cost are then dealt to step groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowio import cut_lineage, table
from .tokens import count_tokens

#: Items that one task packs; more documents mean more shards, never larger ones.
SHARD_ITEMS = 50_000
#: Containers of a step group.
GROUP = 8


def pack_shard(sizes: np.ndarray, capacities: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(item, piece, token_start, tokens, tier, container) for items of the given sizes; empty items get none.

    Containers are numbered within their tier.  ``capacities`` ascend.
    """
    top = len(capacities) - 1
    out: list[tuple[int, int, int, int, int, int]] = []
    number = [0] * len(capacities)
    tiers: list[list[tuple[int, int, int, int]]] = [[] for _ in capacities]  # (size, item, piece, start)
    for item, size in enumerate(sizes.tolist()):
        piece, start = 0, 0
        while size > capacities[top]:
            out.append((item, piece, start, capacities[top], top, number[top]))
            number[top] += 1
            size, piece, start = size - capacities[top], piece + 1, start + capacities[top]
        if size > 0:
            tiers[next(t for t, c in enumerate(capacities) if size <= c)].append((size, item, piece, start))
    for t in range(top, -1, -1):
        gaps: list[int] = []  # distinct gaps, ascending
        open_: dict[int, list[int]] = {}

        def put(size, item, piece, start, t=t, gaps=gaps, open_=open_):
            k = bisect_left(gaps, size)
            if k < len(gaps):
                gap = gaps[k]
                box = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[k]
            else:
                gap, box = capacities[t], number[t]
                number[t] += 1
            out.append((item, piece, start, size, t, box))
            if gap > size:
                if gap - size not in open_:
                    insort(gaps, gap - size)
                    open_[gap - size] = []
                open_[gap - size].append(box)

        for x in sorted(tiers[t], reverse=True):
            put(*x)
        # gaps take the longest shorter items that fit
        for lower in range(t - 1, -1, -1):
            kept = []
            for x in sorted(tiers[lower], reverse=True):
                if gaps and gaps[-1] >= x[0]:
                    put(*x)
                else:
                    kept.append(x)
            tiers[lower] = kept
    return out


def pack(items: DataFrame, key: str, capacities: list[tuple[str, int]], shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(key, piece_no, token_start, n_tokens, tier, capacity, container_id, position, step_group) of every token of
    ``items`` (key, n_tokens).

    Every document lies in one container unless it exceeds the largest capacity.  Documents without tokens (null,
    empty) need no space and get no row; repeated rows are packed each.  Shards are drawn by the hash of the key and of
    the row's place in the checkpoint, so neither the number of documents nor one key's repeated rows make a group of
    more than about ``shard_items`` items.
    """
    capacities = sorted(capacities, key=lambda c: (c[1], c[0]))
    names, sizes = [c[0] for c in capacities], [c[1] for c in capacities]
    items = cut_lineage(items.select(items[key].alias("k"), items["n_tokens"].alias("n")))
    shards = max(1, -(-items.count() // shard_items))
    kind = items.schema["k"].dataType.simpleString()

    def one(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "k"], ascending=False, ignore_index=True)
        rows = pack_shard(pdf["n"].fillna(0).to_numpy(dtype=np.int64), sizes)
        got = pd.DataFrame(rows, columns=["item", "piece_no", "token_start", "n_tokens", "t", "box"])
        got[key] = pdf["k"].to_numpy()[got["item"]] if len(got) else pdf["k"].iloc[:0]
        got["tier"] = np.array(names, dtype=object)[got["t"]] if len(got) else pd.Series(dtype=object)
        got["capacity"] = np.array(sizes)[got["t"]] if len(got) else pd.Series(dtype=np.int64)
        # shard and tier above, the number within them in the lower 32 bits
        base = (np.int64(group[0]) * len(sizes) + got["t"].astype(np.int64)) << np.int64(32)
        got["container_id"] = base + got["box"].astype(np.int64)
        got["position"] = got.groupby(["t", "box"]).cumcount()
        # attention costs the squares of the pieces: deal containers to groups in a snake by falling cost
        cost = got.assign(c=got["n_tokens"].astype(float) ** 2).groupby(["t", "box"])["c"].sum().sort_values(ascending=False)
        order = cost.reset_index()
        order["rank"] = order.groupby("t").cumcount()
        count = order.groupby("t")["rank"].transform("size")
        groups = -(-count // GROUP)
        turn, place = order["rank"] // groups, order["rank"] % groups
        order["g"] = np.where(turn % 2 == 0, place, groups - 1 - place)
        got = got.merge(order[["t", "box", "g"]], on=["t", "box"], how="left")
        base = (np.int64(group[0]) * len(sizes) + got["t"].astype(np.int64)) << np.int64(32)
        got["step_group"] = base + got["g"].fillna(0).astype(np.int64)
        return got[[key, "piece_no", "token_start", "n_tokens", "tier", "capacity", "container_id", "position", "step_group"]]

    return (
        items.withColumn("shard", F.pmod(F.xxhash64("k", F.monotonically_increasing_id()), F.lit(shards)).cast("int")).groupBy("shard")
        .applyInPandas(one, f"{key} {kind}, piece_no int, token_start long, n_tokens int, tier string, capacity int, container_id long, position int, step_group long")
    )


def pack_limits(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    rows = table(spark, sf_dir, "size_limits").where("unit = 'tokens' and limit_name like 'pack%'").collect()
    return [(r["limit_name"], r["max_size"]) for r in rows]


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, assigned to containers of the pack* capacities."""
    sizes = count_tokens(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return pack(sizes, "doc_id", pack_limits(spark, sf_dir))


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of used space of each tier."""
    boxes = p8_packed(spark, sf_dir).groupBy("tier", "capacity", "container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return boxes.groupBy("tier", "capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum("pieces").alias("pieces"),
        F.round(F.sum("used") / F.sum(F.col("capacity")), 6).alias("used_share"),
    )
