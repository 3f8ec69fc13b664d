"""Tokens, boilerplate, segmentation, scoring, selection, sources and sinks."""

import json
import re

import pytest
from pyspark.sql import functions as F

from fabulon.functions import text as T
from fabulon.operators import scoring as S
from fabulon.operators import segmentation as G
from fabulon.operators import selection as L
from fabulon.sources import readers as R
from fabulon.sources import writers as W
from fabulon.streaming import checkpoint as C


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_words_split_like_python(spark):
    texts = ["", "  a  b ", "a b　c", "x\x1cy", "a​b", "\n\n", "tab\tnl\n"]
    assert column(spark, texts, T.words) == [t.split() for t in texts]


def test_lexicon_tokens(spark):
    assert column(spark, ["L'Île de cœur, déjà 3"], T.lexicon_tokens)[0] == ["l", "île", "de", "c", "ur", "déjà"]


def test_boilerplate(spark):
    texts = ["pre\n*** START OF X ***\n body \n*** END OF X ***\npost", "*** start of\nb\n*** end of", "no marks", "*** START OF X", "*** END OF\n*** START OF X\nabc", None]
    assert column(spark, texts, T.strip_boilerplate) == ["body", "b", "no marks", "*** START OF X", "", None]


def test_judge(spark):
    assert column(spark, ["-11", "7.5/10", "n/a", "score: -3", ""], T.judge_score) == [-1.0, 0.75, 0.0, -0.3, 0.0]


def test_decoding(spark):
    df = spark.createDataFrame([("é".encode(),), ("é".encode("latin-1"),)], "b binary")
    assert [r[0] for r in df.select(T.decode_bytes(F.col("b"))).collect()] == ["é", "é"]


BODY = "word " * 150


def cut(spark, text, lang, expected, titles=None):
    df = spark.createDataFrame([(lang, text, expected, titles)], "lang string, text string, expected_chapters int, titles array<string>")
    return G.segment(df, []).orderBy("number").collect()


def test_headings(spark):
    text = "CONTENTS\nCHAPTER I\nCHAPTER II\n\n" + "".join(f"\n\nCHAPTER {r}\n{BODY}" for r in ("I", "II", "III"))
    got = cut(spark, text, "en", 3)
    assert {r["pattern_used"] for r in got} == {"CHAPTER_UPPER"} and len(got) == 3
    # a heading after blank lines: its match begins on the blank line, so the marker becomes the title
    assert (got[0]["heading"], got[0]["title"], got[0]["text"]) == ("", "CHAPTER I", BODY.strip())
    direct = f"CHAPTER I\nThe Start\n{BODY}\nCHAPTER II\n{BODY}"
    first = cut(spark, direct, "en", None)[0]
    assert (first["heading"], first["title"]) == ("CHAPTER I", "The Start")
    assert cut(spark, text, "en", 40) == [] and cut(spark, "nothing", "en", None) == []
    roman = f"I\r\n{BODY}\nII\n{BODY}"
    assert cut(spark, roman, "fr", 2)[0]["pattern_used"] == "Roman_Bare_FR"
    named = f"THE HAT\nTHE CAT\n{BODY}\nTHE HAT\n{BODY}\nTHE CAT\n{BODY}"
    got = cut(spark, named, "en", 2, ["THE HAT", "THE CAT", "THE DOG", "(.*)"])
    # the last line of each title counts, in order of the text
    assert {r["pattern_used"] for r in got} == {"EXPLICIT_TITLES"} and [r["offset"] for r in got] == [named.rindex("THE HAT"), named.rindex("THE CAT")]
    # eight chapters where five or twelve are expected
    eight = "".join(f"BOOK {k}\n{BODY}\n" for k in range(1, 9))
    assert [len(cut(spark, eight, "en", n)) for n in (4, 5, 10, 11, 12)] == [0, 8, 8, 8, 0]


def test_matches_are_where_regular_expressions_find_them(spark):
    texts = ["", "a", f"\n \n  IV \n\nx{BODY}\n\n\n\nV\n y", "I\n\n\nII\n\nIII", "CHAPTER ONE\nCHAPTER\nTWO .\n\n é\U0001f600\nCHAPTER 3", BODY]
    for label, body in G.HEADINGS["en"]:
        pattern = G.line_pattern(label, body)
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", G.match_starts(F.col("t"), F.lit(pattern)).alias("at"))
        for r in df.collect():
            assert r["at"] == [m.start() for m in re.finditer(pattern.replace("(?md)", "(?m)"), r["t"])], (label, r["t"])


def test_segment_nulls(spark):
    df = spark.createDataFrame([("a", "en", None, None, None), ("b", "en", f"BOOK I\n{BODY}\nBOOK II\n{BODY}", None, None)],
                               "slug string, lang string, text string, expected_chapters int, titles array<string>")
    assert [(r["slug"], r["number"], r["word_count"]) for r in G.segment(df, ["slug"]).collect()] == [("b", 1, 150), ("b", 2, 150)]


@pytest.mark.parametrize("n, chunks", [(0, 1), (400, 1), (401, 2), (750, 2), (751, 3)])
def test_chunks(spark, n, chunks):
    df = spark.createDataFrame([(1, " ".join(["w"] * n))], "k int, text string")
    assert S.chunks(df, ["k"]).count() == chunks


def test_lexicon_scores(spark):
    lex = S.clean_lexicon(spark.createDataFrame([("Good", 9.0, 0), ("good ", 7.0, 1), ("bad", 1.0, 2), ("four", 4.0, 3), ("six", 6.0, 4), ("", 9.0, 5)], "word string, happs double, ord int"))
    texts = spark.createDataFrame([(1, "good bad good"), (2, "four six"), (3, None), (4, "")], "k int, text string")
    got = dict(S.lexicon_score(texts, lex, ["k"]).collect())
    assert got[1] == pytest.approx(((7 + 1 + 7) / 3 - 5) / 4) and got[2] == got[3] == got[4] == 0.0
    assert S.lexicon_score(texts.limit(0), lex, ["k"]).count() == 0
    arcs = {r["k"]: r for r in S.lexicon_windows(texts, lex, ["k"], window=2, points=2).collect()}
    assert arcs[1]["scores"] == [pytest.approx((4 - 5) / 4)] * 2 and arcs[2]["scores"] == [0.0, 0.0]
    # half of a step rounds to even: 52 words, window 50, 4 points give starts 0, 0, 1, 2
    words = ["good"] + ["x"] * 51
    arc = S.lexicon_windows(spark.createDataFrame([(1, " ".join(words))], "k int, text string"), lex, ["k"], window=50, points=4).first()
    assert arc["scores"] == [0.5, 0.5, 0.0, 0.0]


def test_scorers(spark):
    S.register("length", lambda: lambda texts: [float(len(t)) for t in texts])
    df = spark.createDataFrame([("abc",), ("",), (None,)], "text string")
    assert [r["score"] for r in S.score_texts(df, "length").collect()] == [3.0, 0.0, 0.0]
    with pytest.raises(KeyError):
        S.score_texts(df, "unknown")


def test_selection(spark):
    rows = [(1, 0, 0.5, 10, 1), (1, 1, 0.9, 10, None), (1, 2, 0.9, 10, 3), (1, 3, None, 10, 1), (2, 0, None, 5, 5)]
    df = spark.createDataFrame(rows, "number int, cand_idx int, correlation double, input_tokens long, output_tokens long")
    got = L.best_of_n(df, ["number"]).collect()
    assert [tuple(r) for r in got] == [(1, 4, 1, 0.9, 40, 5)]
    swept = spark.createDataFrame([(1, 0, 0.1, 0.4, 0.5), (1, 1, 0.3, 0.6, 0.5), (1, 2, 0.5, 0.9, 0.5)], "number int, cand_idx int, temperature double, score double, original_score double")
    r = L.temperature_sweep(swept, ["number"]).first()
    assert (r["selected_temperature"], r["selected_score"]) == (0.1, 0.4)
    assert L.temperature_sweep(swept, ["number"], offset=0.3).first()["selected_temperature"] == 0.5
    assert L.strategy() == ("sequential", 1) and L.strategy(3) == ("best_of_n", 3) and L.strategy(parallel=True) == ("parallel", 1)
    assert L.strategy(1, explicit="best_of_n") == ("best_of_n", 5)


def test_pending_and_dry_run(spark):
    work = spark.createDataFrame([("a", 1, "xx"), ("a", 2, "yyy"), ("b", 1, "z")], "slug string, number int, text string")
    done = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1)], "slug string, number int")
    assert [tuple(r) for r in L.pending(work, done, ["slug", "number"]).collect()] == [("a", 2, "yyy")]
    got = {r["slug"]: tuple(r)[1:] for r in L.dry_run(work, done, ["slug", "number"], ["slug"]).collect()}
    assert got == {"a": (2, 1, 1, 3, "COMPLETE"), "b": (1, 1, 0, 0, "SKIP")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "12.txt").write_bytes("a\r\n*** START OF T ***\r\nné\r\n*** END OF T ***".encode("latin-1"))
    assert [tuple(r) for r in R.raw_texts(spark, str(tmp_path / "raw")).collect()] == [(12, "né")]
    (tmp_path / "scores").mkdir()
    for name in ("my_book_fr_llm_bon5_sw_xlm_roberta", "my_book_en_original_vader"):
        (tmp_path / "scores" / f"{name}.json").write_text(json.dumps({"title": "T", "version": "fr_llm", "method": "x", "scores": [0.1, None]}, indent=1))
    (tmp_path / "scores" / "broken_en_original_vader.json").write_text("{")
    got = sorted((r["slug"], r["version"], r["method"]) for r in R.score_docs(spark, str(tmp_path / "scores")).where("scores is not null").collect())
    assert got == [("my_book", "en_original", "vader"), ("my_book", "fr_llm_bon5", "sw_xlm_roberta")]
    doc = {"title": "T", "language": "fr", "chapters": [{"number": 1, "text": "a"}, None, {"number": 3, "text": "b"}]}
    (tmp_path / "ch").mkdir()
    (tmp_path / "ch" / "my_book_llm.json").write_text(json.dumps(doc))
    assert [(r["slug"], r["version"], r["position"]) for r in R.chapter_docs(spark, str(tmp_path / "ch")).collect()] == [("my_book", "llm", 1), ("my_book", "llm", 3)]
    res = spark.createDataFrame([("b", "m", "original_vs_human", "chapter", 0.5, None)], "slug string, method string, pair string, normalization string, pearson_r double, x double")
    for m in ("pearson_p", "spearman_rho", "spearman_p", "dtw_distance", "rmse", "mean_abs_diff", "cosine_similarity", "peak_alignment", "trough_alignment"):
        res = res.withColumn(m, F.lit(None).cast("double"))
    tree = json.loads(W.nested(res).first()["results"])
    assert tree["m"]["original_vs_human"]["chapter"]["pearson_r"] == 0.5 and tree["m"]["original_vs_human"]["chapter"]["rmse"] is None
    W.results_csv(res.coalesce(1), str(tmp_path / "csv"))
    line = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert line[0].startswith("book,method,pair,normalization,pearson_r") and line[1] == "b,m,original_vs_human,chapter,0.5" + ",nan" * 9


def test_books(spark):
    books = spark.createDataFrame([("a", "A Book", [1, 2], 9, 3, ["X", "Y"]), ("b", "B", None, None, 1, None)],
                                  "slug string, title string, fr_ids array<int>, en_id int, expected_chapters int, en_chapter_titles array<string>")
    assert R.wanted_texts(books).count() == 3
    assert R.missing_texts(books, spark.createDataFrame([(1,), (9,)], "gutenberg_id int")).count() == 1
    assert [r["slug"] for r in R.work_filter(books, [" a BOOK", "zz"]).collect()] == ["a"]
    raw = spark.createDataFrame([(1, "t"), (2, "u"), (9, "v")], "gutenberg_id int, text string")
    assert sorted((r["lang"], r["text"], r["titles"]) for r in R.book_texts(books, raw).collect()) == [("en", "v", ["X", "Y"]), ("fr", "t", None)]


def test_stream_keeps_each_chapter_once(spark, tmp_path):
    schema = "slug string, version string, number int, text string"
    for text in ("x", "again"):
        spark.createDataFrame([("a", "fr_llm", 1, text), ("a", "fr_llm", 2, text)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        C.follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_segmentation_keeps_texts_without_heading(spark, tmp_path):
    from fabulon.plans import catalog

    body = "word " * 200
    rows = [(i, 1, "en_original", "en", i, "" if i == 3 else None if i == 4 else f"CHAPTER {i}.", body) for i in range(1, 7)]
    kinds = "chapter_id long, run_id long, version string, lang string, number int, heading string, text string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/chapters.parquet")
    got = catalog.chapter_segmentation(spark, str(tmp_path)).orderBy("number").collect()
    assert [r["word_count"] for r in got] == [200, 600, 200, 200]
