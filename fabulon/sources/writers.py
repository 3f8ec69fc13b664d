"""Sinks: result tables as CSV and nested JSON, score and chapter documents, Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import METRICS


def results_csv(results: DataFrame, path: str) -> None:
    """book, method, pair, normalization and the metrics in fixed order; undefined values are written as nan."""
    results.select(F.col("slug").alias("book"), "method", "pair", "normalization", *METRICS).write.mode("overwrite").csv(
        path, header=True, nullValue="nan"
    )


def nested(results: DataFrame, keys: tuple[str, ...] = ("slug", "method", "pair", "normalization")) -> DataFrame:
    """(slug, results): per book a JSON object method > pair > normalization > metric, null where undefined."""
    values = F.to_json(F.struct(*METRICS), {"ignoreNullFields": "false"})
    tree = results.select(*keys, values.alias("v"))
    for depth in (3, 2, 1):
        own = keys[:depth]
        # the key as a JSON string without the array's brackets
        entry = F.concat(F.expr(f"substring(to_json(array({keys[depth]})), 2, length(to_json(array({keys[depth]}))) - 2)"), F.lit(": "), F.col("v"))
        parts = F.array_join(F.array_sort(F.collect_list(entry)), ", ")
        tree = tree.groupBy(*own).agg(F.concat(F.lit("{"), parts, F.lit("}")).alias("v"))
    return tree.select(keys[0], F.col("v").alias("results"))


def results_json(results: DataFrame, path: str) -> None:
    nested(results).select(F.to_json(F.struct("slug", "results"))).write.mode("overwrite").text(path)


def score_documents(arcs: DataFrame, path: str) -> None:
    arcs.write.mode("overwrite").partitionBy("method").json(path)


def chapter_documents(chapters: DataFrame, path: str) -> None:
    chapters.write.mode("overwrite").partitionBy("slug", "lang").parquet(path)


def json_reports(reports: DataFrame, path: str, key: str = "slug") -> None:
    reports.select(key, "report").write.mode("overwrite").partitionBy(key).text(path)


def markdown_reports(reports: DataFrame, path: str, key: str = "slug") -> None:
    reports.select(key, "report").write.mode("overwrite").partitionBy(key).text(path)
