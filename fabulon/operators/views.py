"""Data behind the figures, as tables (rendering is left to the caller)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import let, mean
from ..settings import BEST_OF
from . import arcs as A
from .metrics import by_role


def overlay(arcs: DataFrame) -> DataFrame:
    """(keys, role, pos, x, raw, smoothed): each arc over 0..100 with its smoothed form."""
    both = arcs.select(*A.KEY, "role", "version", F.col("scores").alias("s"), A.smooth_for_plots(F.col("scores")).alias("m"), F.size("scores").alias("n"))
    rows = both.select(*A.KEY, "role", "version", "n", F.posexplode(F.arrays_zip("s", "m")).alias("pos", "p"))
    return rows.select(
        *A.KEY, "role", "version", "pos", F.coalesce(F.try_divide(F.col("pos") * 100.0, F.col("n") - 1.0), F.lit(0.0)).alias("x"),
        F.col("p.s").alias("raw"), F.col("p.m").alias("smoothed"),
    )


def drift(arcs: DataFrame) -> DataFrame:
    """(keys, pos, human_drift, llm_drift): differences from the original over the shortest of the three arcs."""
    r = by_role(arcs)
    n = F.least(F.size("original"), F.size("human"), F.size("llm"))
    cut = r.select(*A.KEY, *[F.slice(c, 1, n).alias(c[0]) for c in ("original", "human", "llm")])
    rows = cut.select(*A.KEY, F.posexplode(F.arrays_zip("o", "h", "l")).alias("pos", "p"))
    return rows.select(
        *A.KEY, "pos", (F.col("p.h") - F.col("p.o")).alias("human_drift"), (F.col("p.l") - F.col("p.o")).alias("llm_drift")
    )


def heatmap(results: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(keys, metric, orig_human, orig_llm) of chapter arcs; distances are negated, so more is better everywhere."""
    inverted = {"dtw_distance", "rmse", "mean_abs_diff"}
    cells = F.array(*[
        F.struct(F.lit(m).alias("metric"), (-F.col(m) if m in inverted else F.col(m)).alias("value")) for m in sorted(metrics)
    ])
    rows = results.where("normalization = 'chapter' and pair in ('original_vs_human', 'original_vs_llm')").select(*A.KEY, "pair", F.explode(cells).alias("c"))
    pick = lambda p: F.max(F.when(F.col("pair") == p, F.col("c.value")))
    return rows.groupBy(*A.KEY, F.col("c.metric").alias("metric")).agg(
        pick("original_vs_human").alias("orig_human"), pick("original_vs_llm").alias("orig_llm")
    )


def fidelity(results: DataFrame) -> DataFrame:
    """(keys, r_orig_human, r_orig_llm) where both are defined."""
    pick = lambda p: F.max(F.when(F.col("pair") == p, F.col("pearson_r")))
    return (
        results.where("normalization = 'chapter'").groupBy(*A.KEY)
        .agg(pick("original_vs_human").alias("r_orig_human"), pick("original_vs_llm").alias("r_orig_llm"))
        .where("r_orig_human is not null and r_orig_llm is not null")
    )


def strategy_comparison(arcs: DataFrame, points: int = A.RESAMPLE_POINTS) -> DataFrame:
    """(slug, run_id, method, version, mean_gap): mean distance of each llm variant's smoothed arc from the original's,
    both on one grid.  Points whose smoothing or interpolation touches a missing one are left out; null if all are."""
    llm = arcs.where("role = 'llm'").select(*A.KEY, "version", "scores")
    original = arcs.where("role = 'original'").select(*A.KEY, F.col("scores").alias("o"))
    grid = lambda c: let(A.smooth_for_plots(F.col(c)), lambda s: A.resample(s, points))
    gap = F.filter(F.zip_with(grid("scores"), grid("o"), lambda a, b: F.abs(a - b)), lambda x: x.isNotNull() & ~F.isnan(x))
    return llm.join(original, A.KEY).select(
        *A.KEY, "version", let(gap, mean).alias("mean_gap")
    )


def best_of_n_comparison(arcs: DataFrame, n_values: tuple[int, ...] = BEST_OF) -> DataFrame:
    """(keys, n_candidates, version, pos, x, original, llm, abs_diff): smoothed arcs of the best-of-n variants and of the
    original on the grid of the shorter one, over 0..100.  Without a variant of 1 the plain llm version stands for it."""
    plain = F.col("version").rlike("^[a-z]{2}_llm$")
    n = F.when(plain, 1).otherwise(F.regexp_extract("version", r"^[a-z]{2}_llm_bon(\d+)$", 1).try_cast("int"))
    llm = arcs.where("role = 'llm'").select(*A.KEY, "version", A.smooth_for_plots(F.col("scores")).alias("l"), n.alias("n_candidates"), plain.alias("plain"))
    llm = llm.where(F.col("n_candidates").isin(list(n_values)))
    chosen = llm.groupBy(*A.KEY, "n_candidates").agg(F.min_by(F.struct("version", "l"), F.struct("plain", "version")).alias("c"))
    original = arcs.where("role = 'original'").groupBy(*A.KEY).agg(F.min_by("scores", "version").alias("o"))
    both = chosen.join(original, A.KEY).select(*A.KEY, "n_candidates", "c.version", "c.l", A.smooth_for_plots(F.col("o")).alias("o"))
    size = F.least(F.size("o"), F.size("l"))

    def grid(c: str):
        def at(i):
            p = F.coalesce(F.try_divide(i * (F.size(c) - 1.0), size - 1.0), F.lit(0.0))
            lo = F.floor(p).cast("int")
            a, b = F.get(c, lo), F.get(c, F.least(lo + 1, F.size(c) - 1))
            return F.when(F.size(c) == size, F.get(c, i)).when(p == lo, a).otherwise(a + (p - lo) * (b - a))

        return F.transform(F.sequence(F.lit(0), size - 1), at)

    rows = both.where(size > 0).select(*A.KEY, "n_candidates", "version", size.alias("n"), F.posexplode(F.arrays_zip(grid("o").alias("o"), grid("l").alias("l"))).alias("pos", "p"))
    return rows.select(
        *A.KEY, "n_candidates", "version", "pos", F.coalesce(F.try_divide(F.col("pos") * 100.0, F.col("n") - 1.0), F.lit(0.0)).alias("x"),
        F.col("p.o").alias("original"), F.col("p.l").alias("llm"), F.abs(F.col("p.l") - F.col("p.o")).alias("abs_diff"),
    )


def best_of_n_fidelity(docs: DataFrame, n_values: tuple[int, ...] = BEST_OF) -> DataFrame:
    """(slug, n_candidates, chapters, mean_correlation, mean_diff) from the selection data of chapter documents; of 1 the
    version llm_n1 goes before llm_bon1."""
    n = F.regexp_extract("version", r"llm_(?:bon(\d+)|n1)$", 1)
    own = docs.withColumn("n_candidates", F.when(F.col("version").rlike("llm_n1$"), 1).otherwise(n.try_cast("int")))
    per = own.where(F.col("n_candidates").isin(list(n_values)) & F.col("bon_metadata").isNotNull()).groupBy("slug", "n_candidates", "version").agg(
        F.count(F.lit(1)).alias("chapters"), F.avg("bon_metadata.selected_correlation").alias("mean_correlation"), F.avg("bon_metadata.selection_diff").alias("mean_diff")
    )
    best = per.groupBy("slug", "n_candidates").agg(F.max_by(F.struct("chapters", "mean_correlation", "mean_diff"), "version").alias("x"))
    return best.select("slug", "n_candidates", "x.*")


def best_of_n_summary(chosen: DataFrame, by: str = "n_candidates") -> DataFrame:
    """(n, chapters, mean_correlation): mean selected correlation by number of candidates."""
    return chosen.groupBy(by).agg(F.count(F.lit(1)).alias("chapters"), F.avg("selected_correlation").alias("mean_correlation"))
