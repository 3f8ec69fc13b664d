"""The phases as one composition of lazy plans, and a command line.

    python -m fabulon.plans.pipeline --raw 'raw/*.txt' --books books.parquet --scores 'scores/*.json' --out results --phase metrics

Texts and scores are folders of documents; translations and neural scores come from outside (plug a translator or a
scorer in).  A phase that fails is reported and the later ones still run.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arcs as A
from ..operators import divergence as D
from ..operators import metrics as M
from ..operators import scoring as S
from ..operators import segmentation as G
from ..operators import selection as L
from ..operators import views as V
from ..settings import METRICS, PARALLEL_CALLS, WINDOW_METHODS, WINDOW_WORDS
from ..sources import readers as R
from ..sources import writers as W

log = logging.getLogger(__name__)
PHASES = ("split", "sentiment", "metrics", "qualitative", "visualize")


def _versioned(books: DataFrame, texts: DataFrame) -> DataFrame:
    """``texts`` (slug, lang, ..) with their version: the language a book is translated from is its original."""
    source = F.when(F.col("direction") == "en_to_fr", "en").otherwise("fr")
    role = F.when(F.col("lang") == source, "original").otherwise("human")
    return texts.join(F.broadcast(books.select("slug", "direction")), "slug").withColumn("version", F.concat_ws("_", "lang", role)).drop("direction")


def split_phase(spark: SparkSession, books: DataFrame, raw: str) -> DataFrame:
    """Chapters of all books of the registry from raw files."""
    return _versioned(books, G.segment(R.book_texts(books, R.raw_texts(spark, raw)), ["slug"]))


def translations(spark: SparkSession, books: DataFrame, path: str) -> DataFrame:
    """Chapters of the llm versions among chapter documents, in the language that the book is translated into."""
    target = F.when(F.col("direction") == "en_to_fr", "fr").otherwise("en")
    docs = R.chapter_docs(spark, path).where("version rlike '(^|_)llm'").withColumn("number", F.col("position"))
    docs = docs.join(F.broadcast(books.select("slug", "direction")), "slug").withColumn("lang", target).drop("direction")
    return docs.withColumn("version", F.concat_ws("_", "lang", F.regexp_extract("version", r"(llm\w*)$", 1)))


def whole_texts(spark: SparkSession, books: DataFrame, raw: str | None, done: DataFrame | None) -> DataFrame | None:
    """(slug, version, lang, full_text): raw files of originals and human translations, joined chapters of llm versions."""
    parts = []
    if raw:
        own = _versioned(books, R.book_texts(books, R.raw_texts(spark, raw)))
        parts.append(own.select("slug", "version", "lang", F.col("text").alias("full_text")))
    if done is not None:
        parts.append(R.full_texts(done.withColumn("chapter_id", F.lit(0)), ["slug", "version", "lang"]))
    return reduce(DataFrame.unionByName, parts) if parts else None


def translate_phase(chapters: DataFrame, done: DataFrame, translate: Callable, schema: str, workers: int = PARALLEL_CALLS) -> DataFrame:
    """Chapters that aren't done, through ``translate`` (an iterator of pandas frames to one), at most ``workers`` at a time."""
    return L.pending(chapters, done, ["slug", "number"]).repartition(workers).mapInPandas(translate, schema)


def sentiment_phase(chapters: DataFrame, methods: list[str], texts: DataFrame | None = None) -> DataFrame:
    """Chapter arcs of all texts by each method that supports their language and has a scorer, and sliding-window arcs
    of the full ``texts`` (slug, version, lang, full_text) by those of ``WINDOW_METHODS``; if none is asked for, by those
    of them that have a scorer."""
    parts = []
    for method in methods:
        gated = S.language_gate(chapters, [method])
        parts.append(S.score_texts(gated, method).select("slug", "version", "method", F.col("number").alias("pos"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    keys, none = ["slug", "version", "method"], F.lit(None).cast("int")
    arcs = A.from_points(out, keys).select(
        *keys, "scores", F.size("scores").alias("n_chapters"), none.alias("n_windows"), none.alias("window_words"), none.alias("total_words")
    )
    if texts is None:
        return arcs
    for method in [m for m in methods if m in WINDOW_METHODS] or [m for m in WINDOW_METHODS if S.has_scorer(m)]:
        made = S.scorer_windows(S.language_gate(texts, [f"sw_{method}"]), method, keys)
        n = F.size("scores")
        arcs = arcs.unionByName(made.select(*keys, "scores", n.alias("n_chapters"), n.alias("n_windows"), F.lit(WINDOW_WORDS).alias("window_words"), "total_words"))
    return arcs


def score_arcs(spark: SparkSession, scores: str) -> DataFrame:
    """Score documents as arcs; they have no runs, so all are of run 0."""
    return A.from_score_docs(R.score_docs(spark, scores).withColumn("run_id", F.lit(0).cast("long")))


def metrics_phase(arcs: DataFrame) -> DataFrame:
    return M.compare(M.pairs(M.by_role(arcs)))


def window_data(spark: SparkSession, scores: str) -> DataFrame:
    """(slug, version, method, window_words, n_windows) of the score documents of sliding windows."""
    docs = R.score_docs(spark, scores).where("total_words is not null")
    return docs.groupBy("slug", "version", "method").agg(F.coalesce(F.max("window_words"), F.lit(WINDOW_WORDS)).alias("window_words"), F.max("n_windows").alias("n_windows"))


def qualitative_phase(arcs: DataFrame, texts: DataFrame | None, windows: DataFrame | None = None) -> DataFrame:
    """Divergences with passages of ``texts`` (slug, version, full_text), taken from the windows of ``windows`` or, for
    arcs of chapters, at the same relative place; empty passages without texts."""
    found = D.top_divergences(M.pairs(M.by_role(arcs, complete=False)))
    if texts is None:
        return found.withColumn("excerpt_a", F.lit("")).withColumn("excerpt_b", F.lit(""))
    return D.with_passages(found, texts, ("slug",), windows)


def run(spark: SparkSession, a: argparse.Namespace) -> dict[str, str]:
    """Outcome of each phase: 'done' or the error."""
    outcome = {}
    books = spark.read.parquet(a.books) if a.books else None
    if books is not None and a.works:
        books = R.work_filter(books, a.works)
        if books.isEmpty():
            raise SystemExit("none of the works is known")

    def keep(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(books.select("slug")), "slug", "left_semi") if books is not None and a.works else df

    arcs = keep(score_arcs(spark, a.scores)) if a.scores else None
    done = translations(spark, books, a.translations) if books is not None and a.translations else None
    texts = whole_texts(spark, books, a.raw, done) if books is not None else None
    windows = window_data(spark, a.scores) if a.scores else None

    def chapters() -> DataFrame:
        cols = ["slug", "version", "lang", "number", "text"]
        own = spark.read.parquet(f"{a.out}/chapters").select(*cols)
        return own if done is None else own.unionByName(done.select(*cols))

    def measured() -> DataFrame:
        """The saved metrics; they are computed once, by whichever phase needs them first."""
        path = f"{a.out}/metrics"
        if not fresh:
            metrics_phase(arcs).write.mode("overwrite").parquet(path)
            fresh.append(path)
        return spark.read.parquet(path)

    def report() -> None:
        found = qualitative_phase(arcs, texts, windows)
        title = F.col("slug")
        if books is not None:
            found = found.join(books.select("slug", F.col("title").alias("book_title")), "slug", "left")
            title = F.coalesce("book_title", "slug")
        W.markdown_reports(D.markdown(found, ["slug", "method"], F.concat(title, F.lit(" ("), "method", F.lit(")"))), f"{a.out}/reports")
        W.json_reports(D.nested_json(found, ["slug", "method"], title), f"{a.out}/reports_json")

    fresh: list[str] = []
    steps = {
        "split": lambda: split_phase(spark, books, a.raw).write.mode("overwrite").partitionBy("lang").parquet(f"{a.out}/chapters"),
        "sentiment": lambda: W.score_documents(sentiment_phase(chapters(), a.methods, texts if a.sliding_window else None), f"{a.out}/scores"),
        "metrics": lambda: (W.results_csv(measured(), f"{a.out}/results_csv"), W.results_json(measured(), f"{a.out}/results_json")),
        "qualitative": report,
        "visualize": lambda: [
            V.overlay(arcs).write.mode("overwrite").parquet(f"{a.out}/overlay"),
            V.drift(arcs).write.mode("overwrite").parquet(f"{a.out}/drift"),
            V.heatmap(measured(), METRICS).write.mode("overwrite").parquet(f"{a.out}/heatmap"),
            V.fidelity(measured()).write.mode("overwrite").parquet(f"{a.out}/fidelity"),
            V.best_of_n_comparison(arcs).write.mode("overwrite").parquet(f"{a.out}/best_of_n_comparison"),
            done is not None and V.best_of_n_fidelity(done).write.mode("overwrite").parquet(f"{a.out}/best_of_n_fidelity"),
        ],
    }
    for name in PHASES if a.phase == "all" else [a.phase]:
        try:
            steps[name]()
            outcome[name] = "done"
        except Exception as e:  # noqa: BLE001 - a failed phase must not stop the later ones
            log.exception("phase %s failed", name)
            outcome[name] = f"{type(e).__name__}: {e}"[:300]
    return outcome


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fabulon")
    p.add_argument("--phase", choices=("all", *PHASES), default="all")
    p.add_argument("--works", nargs="*", help="titles or slugs; all books where left out")
    p.add_argument("--methods", nargs="*", default=["labmt"])
    p.add_argument("--books", help="registry of books (parquet)")
    p.add_argument("--raw", help="raw text files")
    p.add_argument("--scores", help="score documents (JSON)")
    p.add_argument("--translations", help="chapter documents (JSON) of llm versions")
    p.add_argument("--no-sliding-window", dest="sliding_window", action="store_false", help="chapter arcs only")
    p.add_argument("--out", default="out")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("fabulon").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    for phase, said in run(spark, a).items():
        print(f"{phase}: {said}")


if __name__ == "__main__":
    main()
