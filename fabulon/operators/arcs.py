"""Arcs: score series as arrays, one row per (book, run, version, method).  All operators here are narrow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import let
from ..functions.text import role_of
from ..settings import PEAK_TOP, RESAMPLE_POINTS, SMOOTH_ORDER, SMOOTH_WINDOW

KEY = ["slug", "run_id", "method"]


def from_score_docs(docs: DataFrame, distinct: bool = True) -> DataFrame:
    """(slug, run_id, method, version, role, scores) without exact repetitions; rows of unknown role are dropped.

    ``distinct`` costs a shuffle; comparisons do without, as repetitions don't change which arc a role has.
    """
    arcs = docs.select("slug", "run_id", "method", "version", role_of(F.col("version")).alias("role"), "scores")
    arcs = arcs.where("role is not null and scores is not null")
    return arcs.distinct() if distinct else arcs


def from_points(points: DataFrame, keys: list[str], pos: str = "pos", score: str = "score") -> DataFrame:
    """Arrays from long rows (keys, pos, score): one arc per key, as long as a text has chapters or windows."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(score).alias("s"))))
    return points.groupBy(*keys).agg(F.transform(pairs, lambda x: x["s"]).alias("scores"))


def points(arcs: DataFrame, column: str = "scores") -> DataFrame:
    """Long form: a row (.., pos, score) per point, positions from 0."""
    return arcs.select(*[c for c in arcs.columns if c != column], F.posexplode(column).alias("pos", "score"))


def resample(scores: Column, n: int = RESAMPLE_POINTS) -> Column:
    """Linear interpolation on n even positions.  One point is repeated; empty gives empty; length n is unchanged."""
    size = F.size(scores)

    def at(i: Column) -> Column:
        p = i * (size - 1) / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)
        lo = F.floor(p).cast("int")
        hi = F.least(lo + 1, size - 1)
        a, b = F.get(scores, lo), F.get(scores, hi)
        return a + (p - lo) * (b - a)

    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)
    return F.when(size == n, scores).when(size > 0, grid).otherwise(F.array().cast("array<double>"))


def smoothing_matrix(window: int, order: int) -> list[list[float]]:
    """Savitzky-Golay weights: row k gives the fitted value at place k of a window (rows before and after the middle
    serve the edges)."""
    if window <= order:
        raise ValueError("the window must be longer than the order of the polynomial")
    x = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return (x @ np.linalg.pinv(x)).tolist()


def _fit(scores: Column, window: int, order: int) -> Column:
    size = F.size(scores)
    rows = F.array(*[F.array(*[F.lit(v) for v in row]) for row in smoothing_matrix(window, order)])  # folded to a literal

    def at(i: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(i - window // 2, size - window))
        weights = F.get(rows, (i - start).cast("int"))
        return F.aggregate(
            F.zip_with(weights, F.slice(scores, (start + 1).cast("int"), window), lambda w, y: w * y), F.lit(0.0), lambda s, x: s + x
        )

    return F.transform(F.sequence(F.lit(0), size - 1), at)


def smooth(scores: Column, window: int = SMOOTH_WINDOW, order: int = SMOOTH_ORDER) -> Column:
    """Savitzky-Golay filter.  The window shrinks by 2 while it is longer than the arc; arcs of fewer than order + 2
    points stay as they are."""
    size = F.size(scores)
    out = scores
    for w in range(order + 2 - (order + 1) % 2, window + 1, 2):
        fits = (size >= w) & ((size < w + 2) if w < window else F.lit(True))
        out = F.when(fits & (size >= order + 2), _fit(scores, w, order)).otherwise(out)
    return out


def smooth_for_plots(scores: Column, window: int = SMOOTH_WINDOW, order: int = SMOOTH_ORDER) -> Column:
    """The plotting variant: short arcs use the longest odd window and a lower order instead of none."""
    size = F.size(scores)
    out = scores
    for w in range(3, window + 1, 2):
        fits = (size >= w) & ((size < w + 2) if w < window else F.lit(True))
        out = F.when(fits, _fit(scores, w, min(order, w - 1))).otherwise(out)
    return out


def extrema(scores: Column, top: int = PEAK_TOP, sign: int = 1) -> Column:
    """Positions of the ``top`` highest strict local maxima (minima for sign -1), highest first, ties by position.

    End points and plateaus never qualify.
    """

    def of(y: Column) -> Column:
        size = F.size(y)
        inner = F.when(size > 2, F.sequence(F.lit(1), size - 2)).otherwise(F.array().cast("array<int>"))
        at = lambda i: F.get(y, i.cast("int"))
        found = F.filter(inner, lambda i: (at(i) > at(i - 1)) & (at(i) > at(i + 1)))
        ordered = F.array_sort(F.transform(found, lambda i: F.struct((-at(i)).alias("v"), i.alias("i"))))
        return F.transform(F.slice(ordered, 1, top), lambda x: x["i"])

    return let(scores if sign > 0 else F.transform(scores, lambda x: -x), of)


def nearest_distance(a: Column, b: Column, n: Column) -> Column:
    """Mean over the positions of ``a`` of the distance to the nearest one of ``b``, relative to ``n``; null if either
    is empty."""

    def of(p: Column, q: Column) -> Column:
        each = F.transform(p, lambda x: F.array_min(F.transform(q, lambda y: F.abs(x - y))) / n.cast("double"))
        mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(p).cast("double")
        return F.when((F.size(p) > 0) & (F.size(q) > 0), mean)

    return let(a, lambda p: let(b, lambda q: of(p, q)))
