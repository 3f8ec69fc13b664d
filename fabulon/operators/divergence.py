"""Where two arcs differ most, with the passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import let
from ..functions.text import excerpt, words
from ..settings import DIVERGENCE_TOP, EXCERPT_CHARS, EXCERPT_WORDS, PAIR_TITLES
from . import arcs as A


def top_divergences(pairs_: DataFrame, keys: list[str] = A.KEY, top: int = DIVERGENCE_TOP) -> DataFrame:
    """(keys, pair, version_a, version_b, rank_no, window_index, narrative_pct, score_a, score_b, abs_diff, n): the points
    of largest absolute difference of each raw pair, ties by position.  Positions and ``n`` count the points that a side
    lacks as well.  Narrow: a pair's points lie in its row."""
    gap = F.transform(F.arrays_zip("a", "b", "at"), lambda p: F.struct(
        F.round(-F.abs(p["a"] - p["b"]), 12).alias("d"), p["at"].alias("i"), p["a"].alias("a"), p["b"].alias("b")))
    best = F.slice(F.array_sort(gap), 1, top)
    rows = pairs_.where("normalization = 'chapter'").select(*keys, "pair", "version_a", "version_b", F.col("length").alias("n"), F.posexplode(best).alias("k", "x"))
    return rows.select(
        *keys, "pair", "version_a", "version_b", (F.col("k") + 1).alias("rank_no"), F.col("x.i").alias("window_index"),
        F.bround(F.col("x.i") / F.col("n") * 100.0, 1).alias("narrative_pct"), F.bround("x.a", 4).alias("score_a"), F.bround("x.b", 4).alias("score_b"),
        F.bround(F.abs(F.col("x.a") - F.col("x.b")), 4).alias("abs_diff"), "n",
    )


def window_start(index: Column, total: Column, window: Column, n_windows: Column) -> Column:
    """First word of a sliding window: the gap times the index, rounded half to even."""
    return F.bround(index * ((total - window) / n_windows.cast("double"))).cast("int")


def passage(text: Column, ws: Column, index: Column, n: Column, window: Column) -> Column:
    """Opening of the passage of a point, ``ws`` being the text's words: of its window where ``window`` isn't null (texts
    no longer than a window give their own opening), else of the words at the same relative place."""
    inside = excerpt(ws, window_start(index, F.size(ws), window, n), window)
    in_window = F.when(F.size(ws) <= window, F.substring(text, 1, EXCERPT_CHARS)).otherwise(inside)
    return F.when(window.isNotNull(), in_window).otherwise(excerpt(ws, F.floor(F.size(ws) * index / n.cast("double")), EXCERPT_WORDS))


def with_passages(found: DataFrame, texts: DataFrame, keys: tuple[str, ...] = ("run_id",), windows: DataFrame | None = None) -> DataFrame:
    """``found`` with excerpt_a and excerpt_b from (keys, version, full_text, window_words); scores stay without text.

    ``windows`` (keys, version, method, window_words, n_windows) holds the windows of each arc where they differ by
    method; then ``texts`` needs no window_words.  The points of one text are gathered first, so each text meets them in
    one join and is split into words once, however many points and sides ask for it.
    """
    at = [*keys, "version"]
    asked = [found.select(*keys, F.col(f"version_{s}").alias("version"), "method", F.col("window_index").alias("i"), "n") for s in "ab"]
    asked = asked[0].unionByName(asked[1]).distinct()
    null = F.lit(None).cast("int")
    if windows is not None:
        w = windows.select(*at, "method", F.col("window_words").alias("w"), F.col("n_windows").alias("k"))
        asked = asked.join(w, [*at, "method"], "left")
    else:
        asked = asked.withColumns({"w": null, "k": null})
    points = asked.groupBy(*at).agg(F.collect_list(F.struct("method", "i", "n", "w", "k")).alias("points"))
    own = texts.select(*at, F.col("full_text").alias("t"), (null if windows is not None else F.col("window_words")).alias("own"))

    def cut(ws):
        of = lambda p: passage(F.col("t"), ws, p["i"], F.coalesce(p["k"], p["n"]), F.coalesce(p["w"], F.col("own")))
        return F.transform("points", lambda p: F.struct(p["method"].alias("method"), p["i"].alias("i"), p["n"].alias("n"), of(p).alias("e")))

    made = own.join(points, at).select(*at, F.explode(let(words(F.col("t")), cut)).alias("x")).select(*at, "x.*")
    out = found
    for side in "ab":
        mine = made.select(*keys, F.col("version").alias(f"version_{side}"), "method", F.col("i").alias("window_index"), "n", F.col("e").alias(f"excerpt_{side}"))
        out = out.join(mine, [*keys, f"version_{side}", "method", "window_index", "n"], "left")
    return out.withColumns({f"excerpt_{s}": F.coalesce(f"excerpt_{s}", F.lit("")) for s in "ab"})


def plain(number: Column) -> Column:
    """A number as the reports print it: the shortest decimal form, without an exponent from 0.0001 on."""
    text = F.regexp_replace(F.format_string("%.10f", number), r"(\.\d+?)0+$", "$1")
    return F.when(number.isNull() | F.isnan(number), "nan").otherwise(text)


# Fixed value: the form of the report.
_POINT = (
    "### Divergence Point %d (Window %d, %s%% of narrative)\n\n- **%s** score: %s\n- **%s** score: %s\n- Absolute difference: %s\n\n"
    "**%s:**\n\n> %s\n\n**%s:**\n\n> %s\n"
)


def _pair_rank() -> Column:
    return F.when(F.col("pair") == "original_vs_human", 1).when(F.col("pair") == "original_vs_llm", 2).otherwise(3)


def markdown(found: DataFrame, keys: list[str], title: Column | None = None) -> DataFrame:
    """(keys, report): one Markdown text per key of rows with excerpts; a report has at most top x 3 points.

    ``title`` heads the report; else the keys do.
    """
    pair = F.coalesce(*[F.when(F.col("pair") == p, F.lit(t)) for p, t in PAIR_TITLES.items()], F.col("pair"))
    point = F.format_string(
        _POINT, F.col("rank_no"), F.col("window_index"), plain(F.col("narrative_pct")), F.col("version_a"), plain(F.col("score_a")),
        F.col("version_b"), plain(F.col("score_b")), plain(F.col("abs_diff")), F.col("version_a"), F.coalesce("excerpt_a", F.lit("")),
        F.col("version_b"), F.coalesce("excerpt_b", F.lit("")),
    )
    head = F.when(F.col("rank_no") == 1, F.concat(F.lit("\n## "), pair, F.lit("\n\n"))).otherwise("")
    title = F.concat_ws(" ", *keys) if title is None else title
    rows = found.select(*keys, title.alias("_title"), F.struct(_pair_rank().alias("o"), "rank_no", F.concat(head, point).alias("s")).alias("x"))
    parts = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"])
    top = F.concat(F.lit("# Qualitative Analysis: "), F.coalesce("_title", F.lit("")), F.lit("\n"))
    return rows.groupBy(*keys).agg(F.min("_title").alias("_title"), F.array_join(parts, "\n").alias("body")).select(*keys, F.concat(top, F.col("body")).alias("report"))


def nested_json(found: DataFrame, keys: list[str], title: Column, top: int = DIVERGENCE_TOP) -> DataFrame:
    """(keys, report): one JSON text per (slug, method) with the title and the points of each pair."""
    fields = ("window_index", "narrative_pct", "score_a", "score_b", "abs_diff", "version_a", "version_b", "excerpt_a", "excerpt_b")
    rows = found.groupBy(*keys, "pair").agg(
        F.min(title).alias("_title"), F.transform(F.array_sort(F.collect_list(F.struct("rank_no", F.struct(*fields).alias("p")))), lambda x: x["p"]).alias("points")
    )
    rows = rows.groupBy(*keys).agg(F.min("_title").alias("_title"), F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct(_pair_rank().alias("o"), "pair", "points"))), lambda x: F.struct(x["pair"], x["points"]))).alias("pairs"))
    body = F.struct(F.col("_title").alias("title"), "slug", "method", F.lit(top).alias("n_top"), "pairs")
    return rows.select(*keys, F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))
