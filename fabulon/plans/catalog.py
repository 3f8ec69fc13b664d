"""Queries over the engine's tables: each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import arcs as A
from ..operators import divergence as D
from ..operators import metrics as M
from ..operators import scoring as S
from ..operators import segmentation as G
from ..operators import selection as L
from ..operators import views as V
from ..settings import METRICS
from ..sources import readers as R
from ..sources import writers as W

#: Window of the scaled-down sliding arcs (the texts are shorter than books).
WINDOW, POINTS = 200, 100


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: Column | str, n: int = 6) -> Column:
    """Rounded, with negative zero as zero."""
    return F.round(c, n) + F.lit(0.0)


def _arcs(spark: SparkSession, d: str) -> DataFrame:
    return A.from_score_docs(table(spark, d, "score_docs"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.pairs(M.by_role(A.from_score_docs(table(spark, d, "score_docs"), distinct=False), complete=False))


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """A word list with a repeatable score: the single words of both languages of the glossary (a fixed table)."""
    g = table(spark, d, "glossary")
    both = g.select(F.col("term_id").alias("ord"), F.explode(F.array("en", "fr")).alias("word")).where("word rlike '^[A-Za-zÀ-ÿ]+$'")
    score = F.lit(1.0) + F.lit(8.0) * F.pmod(F.conv(F.substring(F.md5(F.lower("word")), 1, 6), 16, 10).cast("long"), F.lit(1000)) / F.lit(999.0)
    return S.clean_lexicon(both.withColumn("happs", score))


PAIR_KEY = [*A.KEY, "pair", "normalization"]


def version_triples(spark, d):
    b = table(spark, d, "books")
    src = F.when(F.col("direction") == "en_to_fr", "en").otherwise("fr")
    dst = F.when(F.col("direction") == "en_to_fr", "fr").otherwise("en")
    rows = F.array(*[F.struct(F.lit(r).alias("role"), lang.alias("lang")) for r, lang in (("original", src), ("human", dst), ("llm", dst))])
    return b.select("slug", F.explode(rows).alias("r")).select("slug", "r.role", "r.lang", F.concat_ws("_", "r.lang", "r.role").alias("version"))


def wanted_texts(spark, d):
    return R.wanted_texts(table(spark, d, "books")).select("slug", F.col("gutenberg_id").cast("long").alias("gutenberg_id"), "lang")


def missing_texts(spark, d):
    cached = table(spark, d, "chapters").where("gutenberg_id is not null").select("gutenberg_id")
    return R.missing_texts(table(spark, d, "books"), cached).select("slug", F.col("gutenberg_id").cast("long").alias("gutenberg_id"), "lang")


def work_filter(spark, d):
    return R.work_filter(table(spark, d, "books"), [" THE BORROWED BOAT ", "the_empty_book", "unknown"]).select("slug", "title", "author")


def language_gate(spark, d):
    texts = table(spark, d, "chapters").select("chapter_id", "lang")
    return S.language_gate(texts).groupBy("method", "lang").agg(F.count(F.lit(1)).alias("n"))


def method_discovery(spark, d):
    return R.methods(table(spark, d, "score_docs"))


def full_texts(spark, d):
    t = R.full_texts(table(spark, d, "chapters").where("text is not null"), ["run_id", "version"])
    return t.select("run_id", "version", F.char_length("full_text").cast("long").alias("chars"), F.md5("full_text").alias("digest"))


def tokenize_words(spark, d):
    c = table(spark, d, "chapters").where("text is not null")
    return c.select("chapter_id", F.char_length("text").cast("long").alias("chars"), T.word_count(F.col("text")).cast("long").alias("words"))


def lexicon_tokens(spark, d):
    c = table(spark, d, "documents").where("text is not null")
    tokens = T.lexicon_tokens(F.col("text"))
    return c.select("doc_id", F.size(tokens).cast("long").alias("n"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"))


def lexicon_table(spark, d):
    return lexicon(spark, d).select("word", _r("happs").alias("happs"))


def labmt_score(spark, d):
    s = S.lexicon_score(table(spark, d, "chapters").select("chapter_id", "text"), lexicon(spark, d), ["chapter_id"])
    return s.select("chapter_id", _r("score").alias("score"))


def chunk_weighted_score(spark, d):
    parts = S.chunks(table(spark, d, "chapters").select("chapter_id", "text"), ["chapter_id"])
    scored = S.lexicon_score(parts, lexicon(spark, d), ["chapter_id", "chunk_no", "n_words"])
    return S.weighted_mean(scored, ["chapter_id"]).select("chapter_id", _r("score").alias("score"))


def sliding_window_arc(spark, d):
    t = R.full_texts(table(spark, d, "chapters").where("text is not null"), ["run_id", "version"])
    w = S.lexicon_windows(t, lexicon(spark, d), ["run_id", "version"], "full_text", WINDOW, POINTS)
    return A.points(w).select("run_id", "version", F.col("total_words").cast("long").alias("total_words"), F.col("pos").cast("long").alias("pos"), _r("score").alias("score"))


def mini_arc(spark, d):
    c = table(spark, d, "candidates").select("cand_id", F.col("translated_text").alias("text"))
    w = S.lexicon_windows(c, lexicon(spark, d), ["cand_id"], points=10, mini=True)
    return A.points(w).select("cand_id", F.col("pos").cast("long").alias("pos"), _r("score").alias("score"))


def arc_build(spark, d):
    return A.points(_arcs(spark, d)).select("slug", "run_id", "method", "role", "version", F.col("pos").cast("long").alias("pos"), _r("score").alias("score"))


def _open_arcs(spark, d):
    """All arcs; points that are no numbers are missing ones, and what a missing point touches is missing too."""
    return _arcs(spark, d).withColumn("scores", F.transform("scores", lambda x: F.when(~F.isnan(x), x)))


def _long(spark, d, column):
    arcs = _open_arcs(spark, d)
    return A.points(arcs.withColumn("scores", column(F.col("scores")))).select(
        "slug", "run_id", "method", "version", F.col("pos").cast("long").alias("pos"), _r("score").alias("score")
    )


def arc_resample(spark, d):
    return _long(spark, d, A.resample)


def arc_smooth(spark, d):
    return _long(spark, d, A.smooth)


def arc_smooth_plots(spark, d):
    return _long(spark, d, A.smooth_for_plots)


def _extrema(spark, d, sign):
    arcs = _open_arcs(spark, d)
    found = A.extrema(F.transform(A.smooth(F.col("scores")), lambda x: F.round(x, 9)), sign=sign)
    rows = arcs.select("slug", "run_id", "method", "version", F.posexplode(found).alias("k", "pos"))
    return rows.select("slug", "run_id", "method", "version", (F.col("k") + 1).cast("long").alias("rank_no"), F.col("pos").cast("long").alias("pos"))


def arc_peaks(spark, d):
    return _extrema(spark, d, 1)


def arc_troughs(spark, d):
    return _extrema(spark, d, -1)


def arc_pairs(spark, d):
    return _pairs(spark, d).select(*PAIR_KEY, "version_a", "version_b", F.col("n").cast("long").alias("n"))


def arc_completeness(spark, d):
    return M.by_role(_arcs(spark, d)).select(*A.KEY, *[F.size(r).cast("long").alias(f"n_{r}") for r in ("original", "human", "llm")])


def _metric(names):
    def run(spark, d):
        got = M.compare(_pairs(spark, d), names)
        return got.select(*PAIR_KEY, *[_r(m).alias(m) for m in names])

    return run


arc_pearson = _metric(("pearson_r",))
arc_spearman = _metric(("spearman_rho",))
arc_pvalue = _metric(("pearson_p", "spearman_p"))
arc_errors = _metric(("rmse", "mean_abs_diff"))
arc_cosine = _metric(("cosine_similarity",))
arc_dtw = _metric(("dtw_distance",))
peak_alignment = _metric(("peak_alignment",))
trough_alignment = _metric(("trough_alignment",))


def results_table(spark, d):
    got = M.results(table(spark, d, "score_docs"))
    return got.select(*PAIR_KEY, "n", *[_r(m).alias(m) for m in METRICS])


def results_nested(spark, d):
    return W.nested(M.results(table(spark, d, "score_docs")))


def _divergences(spark, d):
    return D.top_divergences(_pairs(spark, d))


def top_divergence(spark, d):
    return _divergences(spark, d).select(
        *A.KEY, "pair", F.col("rank_no").cast("long").alias("rank_no"), F.col("window_index").cast("long").alias("window_index"), "narrative_pct",
        _r("score_a").alias("score_a"), _r("score_b").alias("score_b"),
    )


def divergence_passages(spark, d):
    texts = R.full_texts(table(spark, d, "chapters").where("text is not null"), ["run_id", "version"])
    found = _divergences(spark, d).where("method not like 'sw\\_%'")
    out = D.with_passages(found, texts.withColumn("window_words", F.lit(None).cast("int")))
    return out.select(*A.KEY, "pair", F.col("rank_no").cast("long").alias("rank_no"), "excerpt_a", "excerpt_b")


def window_passages(spark, d):
    texts = R.full_texts(table(spark, d, "chapters").where("text is not null"), ["run_id", "version"])
    found = _divergences(spark, d).where("method like 'sw\\_%'")
    out = D.with_passages(found, texts.withColumn("window_words", F.lit(WINDOW)))
    return out.select(*A.KEY, "pair", F.col("rank_no").cast("long").alias("rank_no"), "excerpt_a", "excerpt_b")


def qualitative_report(spark, d):
    """One report per book, run and method, headed by the book's title."""
    titles = table(spark, d, "books").select("slug", F.col("title").alias("book_title"))
    found = table(spark, d, "divergences").join(titles, "slug", "left")
    title = F.concat(F.coalesce("book_title", "slug"), F.lit(" ("), "method", F.lit(")"))
    return D.markdown(found, ["slug", "run_id", "method"], title)


def best_of_n(spark, d):
    c = table(spark, d, "candidates")
    got = L.best_of_n(c, ["run_id", "number"])
    return got.select("run_id", "number", "n_candidates", F.col("selected_index").cast("long").alias("selected_index"), _r("selected_correlation").alias("selected_correlation"), "input_tokens", "output_tokens")


def candidate_correlation(spark, d):
    """Mini arcs of candidates against their original chapter's."""
    lex = lexicon(spark, d)
    c = table(spark, d, "candidates").select("run_id", "number", "cand_id", F.col("translated_text").alias("text"))
    o = table(spark, d, "chapters").where("version like '%\\_original'").groupBy("run_id", "number").agg(F.min_by("text", "chapter_id").alias("text"))
    mini = lambda t, k: S.lexicon_windows(t, lex, k, points=10, mini=True)
    got = L.score_candidates(mini(c, ["run_id", "number", "cand_id"]), mini(o, ["run_id", "number"]), ["run_id", "number"])
    return got.select("cand_id", _r("correlation").alias("correlation"))


def temperature_sweep(spark, d):
    lex = lexicon(spark, d)
    c = table(spark, d, "candidates").where("translated_text is not null")
    scored = S.lexicon_score(c, lex, ["run_id", "number", "cand_idx", "temperature"], "translated_text")
    o = table(spark, d, "chapters").where("version like '%\\_original'").groupBy("run_id", "number").agg(F.min_by("text", "chapter_id").alias("text"))
    base = S.lexicon_score(o, lex, ["run_id", "number"]).withColumnRenamed("score", "original_score")
    got = L.temperature_sweep(scored.join(base, ["run_id", "number"]), ["run_id", "number"])
    return got.select("run_id", "number", _r("original_score").alias("original_score"), "selected_temperature", _r("selected_score").alias("selected_score"), _r("selected_delta").alias("selected_delta"))


def calibration_offset(spark, d):
    return L.calibration_offset(_arcs(spark, d)).select("direction", _r("offset").alias("offset"), "n_points")


def _work(spark, d):
    c = table(spark, d, "chapters")
    return c.where("version like '%\\_original'"), c.where("version like '%\\_llm%' and text is not null").select("run_id", "number")


def pending_work(spark, d):
    work, done = _work(spark, d)
    return L.pending(work, done, ["run_id", "number"]).select("chapter_id", "run_id", "number")


def dry_run(spark, d):
    return L.dry_run(*_work(spark, d), ["run_id", "number"], ["slug"])


def token_accounting(spark, d):
    return L.token_totals(table(spark, d, "candidates"), ["slug", "model"])


def judge_parse(spark, d):
    c = table(spark, d, "conversations").where("text is not null")
    return c.select("msg_id", _r(T.judge_score("text")).alias("score"))


def _raw_books(spark, d):
    """A raw text per run and version: each chapter under its heading, those without one as their text alone, within
    start and end marks; with the number of chapters and the headings."""
    c = table(spark, d, "chapters").where("text is not null and run_id is not null and version is not null")
    headed = F.coalesce(F.col("heading") != "", F.lit(False))
    t = F.when(headed, F.concat("heading", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("number", "chapter_id", t.alias("t"))))
    books = c.groupBy("run_id", "version", "lang").agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n\n").alias("t"), F.countDistinct("number").cast("int").alias("expected_chapters"),
        F.array_sort(F.collect_set(F.when(headed, F.col("heading")))).alias("titles"),
    )
    text = F.concat(F.lit("Notes\n*** START OF THE TEXT ***\n"), "t", F.lit("\n\n*** END OF THE TEXT ***\nMore notes"))
    return books.select("run_id", "version", "lang", text.alias("text"), "expected_chapters", "titles")


def strip_boilerplate(spark, d):
    t = T.strip_boilerplate(F.col("text"))
    return _raw_books(spark, d).select("run_id", "version", F.char_length(t).cast("long").alias("chars"), F.md5(t).alias("digest"))


def _segmented(raw):
    got = G.segment(raw.withColumn("text", T.strip_boilerplate(F.col("text"))), ["run_id", "version", "lang_of_text"])
    ints = [F.col(c).cast("long").alias(c) for c in ("number", "offset", "char_count", "word_count")]
    return got.select("run_id", "version", "lang_of_text", "pattern_used", "heading", "title", F.md5("text").alias("digest"), *ints)


def chapter_segmentation(spark, d):
    """Any number of chapters is accepted, and there are no titles."""
    raw = _raw_books(spark, d).withColumn("lang_of_text", F.col("lang"))
    return _segmented(raw.withColumn("expected_chapters", F.lit(None).cast("int")).withColumn("titles", F.lit(None).cast("array<string>")))


def chapter_segmentation_expected(spark, d):
    """As many chapters as the run has are expected; its headings are the titles to fall back on."""
    return _segmented(_raw_books(spark, d).withColumn("lang_of_text", F.col("lang")))


def chapter_validation(spark, d):
    return G.validate_counts(table(spark, d, "chapters"), table(spark, d, "books"))


def chapter_counts(spark, d):
    """Stored counts of chapters against the counts of their texts."""
    c = table(spark, d, "chapters").where("text is not null")
    chars, words = F.char_length("text"), T.word_count(F.col("text"))
    return c.groupBy("version").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("char_count") != chars, 1).otherwise(0)).alias("stale_chars"),
        F.sum(F.when(F.col("word_count") != words, 1).otherwise(0)).alias("stale_words"),
    )


def arc_overlay(spark, d):
    got = V.overlay(_open_arcs(spark, d))
    return got.select(*A.KEY, "version", F.col("pos").cast("long").alias("pos"), _r("x").alias("x"), _r("raw").alias("raw"), _r("smoothed").alias("smoothed"))


def arc_drift(spark, d):
    return V.drift(_arcs(spark, d)).select(*A.KEY, F.col("pos").cast("long").alias("pos"), _r("human_drift").alias("human_drift"), _r("llm_drift").alias("llm_drift"))


def metric_heatmap(spark, d):
    """The metrics that SQL can express."""
    return _heatmap(spark, d, ("pearson_r", "spearman_rho", "rmse", "mean_abs_diff", "cosine_similarity"))


def _heatmap(spark, d, names):
    got = V.heatmap(M.compare(_pairs(spark, d), names), names)
    return got.select(*A.KEY, "metric", _r("orig_human").alias("orig_human"), _r("orig_llm").alias("orig_llm"))


def metric_heatmap_all(spark, d):
    return _heatmap(spark, d, METRICS)


def fidelity_scatter(spark, d):
    got = V.fidelity(M.compare(_pairs(spark, d), ("pearson_r",)))
    return got.select(*A.KEY, _r("r_orig_human").alias("r_orig_human"), _r("r_orig_llm").alias("r_orig_llm"))


def strategy_comparison(spark, d):
    return V.strategy_comparison(_arcs(spark, d)).select(*A.KEY, "version", _r("mean_gap").alias("mean_gap"))


def best_of_n_summary(spark, d):
    got = V.best_of_n_summary(L.best_of_n(table(spark, d, "candidates"), ["run_id", "number"]))
    return got.select("n_candidates", "chapters", _r("mean_correlation").alias("mean_correlation"))


NAMES = (
    "version_triples", "wanted_texts", "missing_texts", "work_filter", "language_gate", "method_discovery", "full_texts", "tokenize_words",
    "lexicon_tokens", "lexicon_table", "labmt_score", "chunk_weighted_score", "sliding_window_arc", "mini_arc", "arc_build", "arc_resample",
    "arc_smooth", "arc_smooth_plots", "arc_peaks", "arc_troughs", "arc_pairs", "arc_completeness", "arc_pearson", "arc_spearman", "arc_pvalue",
    "arc_errors", "arc_cosine", "arc_dtw", "peak_alignment", "trough_alignment", "results_table", "results_nested", "top_divergence",
    "divergence_passages", "window_passages", "qualitative_report", "best_of_n", "candidate_correlation", "temperature_sweep",
    "calibration_offset", "pending_work", "dry_run", "token_accounting", "judge_parse", "strip_boilerplate", "chapter_segmentation", "chapter_segmentation_expected",
    "chapter_validation", "chapter_counts", "arc_overlay", "arc_drift", "metric_heatmap", "metric_heatmap_all", "fidelity_scatter", "strategy_comparison",
    "best_of_n_summary",
)


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}
