"""Choice among candidate texts, calibration, open work and accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import by_role, safe_pearson


def best_of_n(candidates: DataFrame, keys: list[str], correlation: str = "correlation") -> DataFrame:
    """(keys, n_candidates, selected_index, selected_correlation, input_tokens, output_tokens): the candidate of highest
    correlation, the first of equals; failed candidates (null) only count.  Keys without any are left out."""
    sound = F.col(correlation).isNotNull() & ~F.isnan(correlation)
    order = F.when(sound, F.struct((-F.col(correlation)).alias("c"), F.col("cand_idx").alias("i")))
    got = candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.min_by(F.struct("cand_idx", correlation), order).alias("b"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )
    return got.where("b is not null").select(
        *keys, "n_candidates", F.col("b.cand_idx").alias("selected_index"), F.col(f"b.{correlation}").alias("selected_correlation"),
        "input_tokens", "output_tokens",
    )


def score_candidates(candidate_arcs: DataFrame, original_arcs: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of each candidate's mini arc with its original's, over the shorter one: (keys, cand_idx, correlation)."""
    joined = candidate_arcs.join(original_arcs.select(*keys, F.col("scores").alias("original")), keys)
    n = F.least(F.size("scores"), F.size("original"))
    return joined.withColumn("correlation", safe_pearson(F.slice("scores", 1, n), F.slice("original", 1, n))).drop("scores", "original")


def temperature_sweep(scored: DataFrame, keys: list[str], offset: float = 0.0) -> DataFrame:
    """(keys, original_score, adjusted_target, selected_temperature, selected_score, selected_delta, candidate_scores) of
    (keys, temperature, cand_idx, score, original_score): the candidate nearest to the original's score plus ``offset``;
    the first temperature wins ties."""
    target = F.col("original_score") + F.lit(float(offset))
    delta = F.abs(F.col("score") - target)
    order = F.struct(F.round(delta, 12).alias("d"), F.col("temperature").alias("t"), F.col("cand_idx").alias("i"))
    return scored.where("score is not null").groupBy(*keys).agg(
        F.first("original_score").alias("original_score"), F.first(target).alias("adjusted_target"),
        F.min_by(F.struct("temperature", "score", delta.alias("delta")), order).alias("b"),
        F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("cand_idx").cast("string"), F.round("score", 6))))).alias("candidate_scores"),
    ).select(*keys, "original_score", "adjusted_target", F.col("b.temperature").alias("selected_temperature"), F.col("b.score").alias("selected_score"),
             F.col("b.delta").alias("selected_delta"), "candidate_scores")


def calibration_offset(arcs: DataFrame, keys: list[str] | None = None, exclude: str | None = None) -> DataFrame:
    """(direction, offset, n_points): mean difference human - original over all points of all books of a direction.

    A book gives the differences of its chapter arcs where both have as many chapters, else those of its window arcs
    over the shorter one.  ``exclude`` leaves out one slug.
    """
    keys = keys or ["slug", "run_id"]
    arcs = arcs.where(F.col("role").isin("original", "human"))
    if exclude is not None:
        arcs = arcs.where(F.col("slug") != exclude)
    both = by_role(arcs.where(F.col("method").isin("xlm_roberta", "sw_xlm_roberta")), [*keys, "method"], complete=False)
    both = both.where("original is not null and human is not null")
    equal = F.size("original") == F.size("human")
    n = F.least(F.size("original"), F.size("human"))
    diffs = F.zip_with(F.slice("original", 1, n), F.slice("human", 1, n), lambda o, h: h - o)
    usable = both.where((F.col("method") == "sw_xlm_roberta") | equal).select(
        *keys, F.substring("original_version", 1, 2).alias("lang"), diffs.alias("d"), F.when(F.col("method") == "xlm_roberta", 0).otherwise(1).alias("p")
    )
    chosen = usable.groupBy(*keys, "lang").agg(F.min_by("d", "p").alias("d"))
    points = chosen.select(F.when(F.col("lang") == "en", "en_to_fr").otherwise("fr_to_en").alias("direction"), F.explode("d").alias("x"))
    return points.where("x is not null").groupBy("direction").agg(F.avg("x").alias("offset"), F.count(F.lit(1)).alias("n_points"))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``work`` whose keys aren't done: what a resumed run still has to do."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def dry_run(work: DataFrame, done: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, total, finished, remaining, remaining_chars, status): what a run would do; status SKIP (nothing to do),
    COMPLETE (would finish a started one) or WOULD TRANSLATE."""
    marked = work.join(done.select(*keys).distinct().withColumn("there", F.lit(1)), keys, "left")
    out = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count("there").alias("finished"),
        F.coalesce(F.sum(F.when(F.col("there").isNull(), F.char_length("text"))), F.lit(0)).alias("remaining_chars"),
    )
    status = F.when(F.col("finished") == F.col("total"), "SKIP").when(F.col("finished") > 0, "COMPLETE").otherwise("WOULD TRANSLATE")
    return out.select(*by, "total", "finished", (F.col("total") - F.col("finished")).alias("remaining"), "remaining_chars", status.alias("status"))


def token_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )


def strategy(best_of: int = 0, parallel: bool = False, explicit: str | None = None, default_n: int = 5) -> tuple[str, int]:
    """(strategy, n): an explicit one first, then best-of-n for n > 1, parallel, sequential."""
    name = explicit or ("best_of_n" if best_of > 1 else "parallel" if parallel else "sequential")
    return name, (best_of if best_of > 1 else default_n) if name == "best_of_n" else 1


