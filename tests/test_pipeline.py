"""The phases from end to end on a book of two chapters."""

import json

import pytest

from fabulon.operators import scoring as S
from fabulon.plans import pipeline as P
from fabulon.sources import readers as R


@pytest.fixture
def book(spark, tmp_path, monkeypatch):
    def make():
        return lambda texts: [float(len(t.split())) for t in texts]

    monkeypatch.setitem(S._REGISTRY, "labmt", make)
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "1.txt").write_text("CHAPTER I.\n\nA\n\n" + "one two three " * 400 + "\n\nCHAPTER II.\n\nB\n\n" + "four five six " * 400)
    (tmp_path / "raw" / "2.txt").write_text("CHAPITRE I.\n\nA\n\n" + "un deux trois " * 1800 + "\n\nCHAPITRE II.\n\nB\n\n" + "quatre cinq six " * 1800)
    row = ("tale", "Tale", "en_to_fr", [2], 1, 2, None)
    kinds = "slug string, title string, direction string, fr_ids array<int>, en_id int, expected_chapters int, en_chapter_titles array<string>"
    spark.createDataFrame([row], kinds).write.parquet(f"{tmp_path}/books.parquet")
    (tmp_path / "docs").mkdir()
    for n, correlation in ((None, None), (5, 0.5)):
        chapters = [None, {"number": 2, "text": "sept huit neuf " * 300}]
        chapters[1] |= {"bon_metadata": {"selected_correlation": correlation}} if n else {}
        (tmp_path / "docs" / f"tale_llm{f'_bon{n}' if n else ''}.json").write_text(json.dumps({"language": "fr", "chapters": chapters}))
    (tmp_path / "scores").mkdir()
    for version, scores in (("en_original", [0.0, 1.0]), ("fr_human", [1.0, 0.0]), ("fr_llm", [0.5, 0.75]), ("fr_llm_bon5", [0.25, 1.0])):
        chapter = {"version": version, "method": "xlm_roberta", "scores": scores}
        windows = {"version": version, "method": "sw_xlm_roberta", "scores": scores, "n_windows": 100, "window_words": 100, "total_words": 2406}
        for d in (chapter, windows):
            (tmp_path / "scores" / f"tale_{version}_{d['method']}.json").write_text(json.dumps(d))
    return tmp_path


def arguments(book, phase):
    return P.parser().parse_args([
        "--phase", phase, "--books", f"{book}/books.parquet", "--raw", f"{book}/raw/*.txt", "--scores", f"{book}/scores/*.json",
        "--translations", f"{book}/docs/*.json", "--out", f"{book}/out",
    ])


def test_whole_pipeline(spark, book):
    assert set(P.run(spark, arguments(book, "all")).values()) == {"done"}
    # the passages of chapters and of windows
    reports = "\n".join(p.read_text() for p in (book / "out/reports").rglob("*.txt"))
    # headed by the book's title and the method
    assert "# Qualitative Analysis: Tale (xlm_roberta)\n" in reports
    parts = {r.split("\n")[0].split()[-1].strip("()"): r for r in reports.split("# Qualitative Analysis: ")[1:]}
    assert set(parts) == {"xlm_roberta", "sw_xlm_roberta"}
    for r in parts.values():
        assert "> CHAPTER I. A one two" in r and "un deux trois" in r and "sept huit neuf" in r and "> \n" not in r
    assert "> CHAPTER II. B four" in parts["xlm_roberta"] and "CHAPTER II" not in parts["sw_xlm_roberta"]  # window 1 of 100, not the middle
    nested = [json.loads(line) for p in (book / "out/reports_json").rglob("*.txt") for line in p.read_text().splitlines()]
    assert {(r["title"], r["slug"], r["method"], r["n_top"]) for r in nested} == {("Tale", "tale", m, 3) for m in parts}
    assert all(list(r["pairs"]) == ["original_vs_human", "original_vs_llm", "human_vs_llm"] for r in nested)
    assert all(p["excerpt_a"] and p["version_a"] == "en_original" for r in nested for p in r["pairs"]["original_vs_human"])
    # saved metrics read back
    saved = R.saved_results(spark, f"{book}/out/results_csv").where("method = 'xlm_roberta' and normalization = 'chapter'").collect()
    assert {r["pair"]: r["mean_abs_diff"] for r in saved} == {"original_vs_human": 1.0, "original_vs_llm": 0.375, "human_vs_llm": 0.625}
    # arcs of chapters and windows
    got = {(r["version"], r["method"]): r for r in spark.read.json(f"{book}/out/scores").collect()}
    assert set(got) == {(v, m) for v in ("fr_human", "fr_llm", "fr_llm_bon5") for m in ("labmt", "sw_labmt")}
    human, llm = got["fr_human", "sw_labmt"], got["fr_llm", "sw_labmt"]
    assert human["scores"] == [10_000.0] * 100 and human["n_windows"] == 100 and human["window_words"] == 10_000 and human["total_words"] == 10_806
    assert llm["scores"] == [900.0] * 100
    # best of n
    rows = spark.read.parquet(f"{book}/out/best_of_n_comparison").where("method = 'xlm_roberta'").orderBy("n_candidates", "pos").collect()
    assert [(r["n_candidates"], r["version"], r["x"], r["abs_diff"]) for r in rows] == [
        (1, "fr_llm", 0.0, 0.5), (1, "fr_llm", 100.0, 0.25), (5, "fr_llm_bon5", 0.0, 0.25), (5, "fr_llm_bon5", 100.0, 0.0)
    ]
    assert [tuple(r) for r in spark.read.parquet(f"{book}/out/best_of_n_fidelity").collect()] == [("tale", 5, 1, 0.5, None)]


def test_versions_by_direction(spark, book):
    chapters = P.split_phase(spark, spark.read.parquet(f"{book}/books.parquet"), f"{book}/raw/*.txt")
    assert {r["version"] for r in chapters.select("version").collect()} == {"en_original", "fr_human"}
