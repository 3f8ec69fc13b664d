"""Pairwise comparison of arcs: one shuffle brings the versions of a run together, all metrics are narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..settings import METRICS, PAIRS, RESAMPLE_POINTS
from . import arcs as A


def by_role(arcs: DataFrame, keys: list[str] = A.KEY, complete: bool = True) -> DataFrame:
    """(keys, original, human, llm and their versions): the arcs of each role; of several variants the first by name.

    ``complete`` keeps only keys with all three roles.  The aggregation combines before the shuffle.
    """
    aggs = []
    for role in ("original", "human", "llm"):
        own = F.when(F.col("role") == role, F.col("version"))
        aggs += [F.min_by("scores", own).alias(role), F.min(own).alias(f"{role}_version")]
    out = arcs.groupBy(*keys).agg(*aggs)
    return out.where("original is not null and human is not null and llm is not null") if complete else out


def _aligned(a: Column, b: Column) -> Column:
    """Points at which both arcs have a value, with their positions, over the shorter one's length."""
    n = F.least(F.size(a), F.size(b))
    zipped = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    zipped = F.transform(zipped, lambda p, i: F.struct(i.alias("i"), p["a"].alias("a"), p["b"].alias("b")))
    sound = lambda v: v.isNotNull() & ~F.isnan(v)
    return F.filter(zipped, lambda p: sound(p["a"]) & sound(p["b"]))


def pairs(roles: DataFrame, keys: list[str] = A.KEY, n_points: int = RESAMPLE_POINTS) -> DataFrame:
    """(keys, pair, normalization, version_a, version_b, a, b, n, at, length): raw arcs cut to the shorter one
    ('chapter'), and arcs resampled from their full length ('pct_normalized'), without the points that either side lacks;
    ``at`` holds the positions of the n points among ``length``.  Pairs with a missing side are left out."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("pair"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(f"{x}_version").alias("version_a"), F.col(f"{y}_version").alias("version_b"))
        for name, x, y in PAIRS
    ])
    long = roles.select(*keys, F.explode(rows).alias("r")).where("r.x is not null and r.y is not null")
    forms = F.array(
        F.struct(
            F.lit("chapter").alias("normalization"), _aligned(F.col("r.x"), F.col("r.y")).alias("ab"),
            F.least(F.size("r.x"), F.size("r.y")).alias("length"),
        ),
        F.struct(
            F.lit("pct_normalized").alias("normalization"),
            _aligned(A.resample(F.col("r.x"), n_points), A.resample(F.col("r.y"), n_points)).alias("ab"), F.lit(n_points).alias("length"),
        ),
    )
    return long.select(*keys, "r.pair", "r.version_a", "r.version_b", F.explode(forms).alias("f")).select(
        *keys, "pair", "f.normalization", "version_a", "version_b",
        F.transform("f.ab", lambda p: p["a"]).alias("a"), F.transform("f.ab", lambda p: p["b"]).alias("b"), F.size("f.ab").alias("n"),
        F.transform("f.ab", lambda p: p["i"]).alias("at"), "f.length",
    ).where("n > 0")


def alignment(sign: int) -> Column:
    """Mean distance of the peaks (sign 1) or troughs (-1) of smoothed a to the nearest ones of smoothed b."""
    # rounded, so that noise in the last digits makes no peaks
    find = lambda c: A.extrema(F.transform(A.smooth(F.col(c)), lambda x: F.round(x, 9)), sign=sign)
    return A.nearest_distance(find("a"), find("b"), F.col("n"))


def compare(pairs_: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """``pairs_`` with one column per metric instead of the arrays.  Undefined values are null."""
    a, b = F.col("a"), F.col("b")
    out = pairs_
    if {"pearson_r", "pearson_p"} & set(metrics):
        out = out.withColumn("pearson_r", stats.pearson(a, b))
    if {"spearman_rho", "spearman_p"} & set(metrics):
        out = out.withColumn("ra", stats.ranks(a)).withColumn("rb", stats.ranks(b))
        out = out.withColumn("spearman_rho", stats.pearson(F.col("ra"), F.col("rb")))
    made = {
        "pearson_p": lambda: stats.nan_to_null(stats.p_value("pearson_r", "n")),
        "spearman_p": lambda: stats.nan_to_null(F.when(F.col("n") > 2, stats.p_value("spearman_rho", "n"))),
        "dtw_distance": lambda: stats.nan_to_null(stats.dtw("a", "b")), "rmse": lambda: stats.rmse(a, b),
        "mean_abs_diff": lambda: stats.mean_abs_diff(a, b), "cosine_similarity": lambda: stats.cosine(a, b),
        "peak_alignment": lambda: alignment(1), "trough_alignment": lambda: alignment(-1),
    }
    for m in metrics:
        if m in made:
            out = out.withColumn(m, made[m]())
    kept = [c for c in pairs_.columns if c not in ("a", "b", "at", "length")]
    return out.select(*kept, *metrics)


def safe_pearson(a: Column, b: Column) -> Column:
    """Correlation for selection: 0 if the lengths differ, for fewer than two points or without variance."""
    return F.when(F.size(a) == F.size(b), F.coalesce(stats.pearson(a, b), F.lit(0.0))).otherwise(0.0)


def results(score_docs: DataFrame) -> DataFrame:
    """The full table of metrics of all books (keys, pair, normalization and ten metrics)."""
    return compare(pairs(by_role(A.from_score_docs(score_docs, distinct=False))))
