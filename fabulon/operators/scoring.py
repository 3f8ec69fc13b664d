"""Scoring of texts: a registry of scorers, lexicon scoring as a join, chunks and windows.

A scorer is a function from a list of texts to a list of scores, created once per Python worker; neural and judging
scorers plug in the same way but need models that are not part of this library.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lexicon_tokens, words
from ..settings import CHUNK_OVERLAP, CHUNK_WORDS, METHOD_LANGUAGES, NEUTRAL_BAND, WINDOW_POINTS, WINDOW_WORDS

Scorer = Callable[[list[str]], list[float]]
_REGISTRY: dict[str, Callable[[], Scorer]] = {}
#: A lexicon of up to so many words is broadcast.
BROADCAST_WORDS = 200_000


def register(method: str, make: Callable[[], Scorer]) -> None:
    _REGISTRY[method] = make


def score_texts(texts: DataFrame, method: str, text: str = "text", out: str = "score") -> DataFrame:
    """``texts`` with the score of each text by a registered scorer; empty texts and nulls score 0."""
    if method not in _REGISTRY:
        raise KeyError(f"no scorer for {method!r}; register one first")
    make = _REGISTRY[method]

    @F.pandas_udf("double")
    def run(batches: "pd.Series") -> "pd.Series":
        score = make()
        filled = batches.fillna("")
        full = filled[filled.str.len() > 0]
        got = pd.Series(0.0, index=batches.index)
        if len(full):
            got.loc[full.index] = score(full.tolist())
        return got

    return texts.withColumn(out, run(text))


def has_scorer(method: str) -> bool:
    return method in _REGISTRY


def scorer_windows(texts: DataFrame, method: str, keys: list[str], text: str = "full_text", window: int = WINDOW_WORDS, points: int = WINDOW_POINTS) -> DataFrame:
    """(keys, scores, total_words): the sliding-window arc of each text by a registered scorer.

    Texts within one window are scored once, as they are, and give that score at every point; empty ones give 0.
    """
    if method not in _REGISTRY:
        raise KeyError(f"no scorer for {method!r}; register one first")
    make = _REGISTRY[method]

    @F.pandas_udf("scores array<double>, total_words int")
    def run(batch: pd.Series) -> pd.DataFrame:
        score = make()
        scores, sizes = [], []
        for t in batch:
            ws = t.split()
            n = len(ws)
            if n <= window:
                own = [float(score([t])[0]) if t else 0.0] * points
            else:
                gap = (n - window) / points
                own = [float(x) for x in score([" ".join(ws[s : s + window]) for s in (round(i * gap) for i in range(points))])]
            scores.append(own)
            sizes.append(n)
        return pd.DataFrame({"scores": scores, "total_words": sizes})

    made = texts.select(*keys, run(F.coalesce(text, F.lit(""))).alias("x"))
    return made.select(*keys, "x.scores", "x.total_words")


def supported(method: str, lang: Column) -> Column:
    return lang.isin(list(METHOD_LANGUAGES.get(method, ())))


def language_gate(texts: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Every text with each method that supports its language (a handful of methods: a narrow expansion)."""
    gate = F.filter(
        F.array(*[F.struct(F.lit(m).alias("method"), F.array(*map(F.lit, langs)).alias("l")) for m, langs in METHOD_LANGUAGES.items() if not methods or m in methods]),
        lambda g: F.array_contains(g["l"], F.col("lang")),
    )
    return texts.withColumn("g", F.explode(gate)).withColumn("method", F.col("g.method")).drop("g")


def clean_lexicon(raw: DataFrame, word: str = "word", happs: str = "happs", order: str = "ord") -> DataFrame:
    """Lower-case, trimmed words with a score; of several the last one counts."""
    w = F.lower(F.trim(word))
    return raw.where((w != "") & F.col(happs).isNotNull()).groupBy(w.alias("word")).agg(F.max_by(happs, order).alias("happs"))


def lexicon_score(texts: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text", band: float = NEUTRAL_BAND) -> DataFrame:
    """(keys, score): mean happiness of the words outside the neutral band, mapped from 1..9 to -1..1; 0 without any.

    A lexicon of a checked size is broadcast: words meet it where they are and one partial sum per text is shuffled.  A
    larger one is joined after the words of each text have been counted.
    """
    telling = lexicon.where(F.abs(F.col("happs") - 5.0) > band)
    tokens = texts.select(*keys, F.explode_outer(lexicon_tokens(F.col(text))).alias("word"))
    if lexicon.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        joined = tokens.withColumn("n", F.lit(1)).join(F.broadcast(telling), "word", "left")
    else:
        joined = tokens.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n")).join(telling, "word", "left")
    total = F.sum(F.when(F.col("happs").isNotNull(), F.col("n")))
    return joined.groupBy(*keys).agg(
        F.coalesce((F.try_divide(F.sum(F.col("happs") * F.col("n")), total) - 5.0) / 4.0, F.lit(0.0)).alias("score")
    )


def chunk_starts(n: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """First words of the chunks of a text of n words: strides of size - overlap until a chunk reaches the end."""
    step = size - overlap
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / float(step)) * step).cast("int")
    return F.sequence(F.lit(0), last, F.lit(step))


def chunks(texts: DataFrame, keys: list[str], text: str = "text", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(keys, chunk_no, n_words, text): a text within the limit is one chunk, unchanged."""
    w = texts.select(*keys, F.col(text).alias("t"), words(F.coalesce(text, F.lit(""))).alias("w"))
    rows = w.select(*keys, "t", "w", F.posexplode(chunk_starts(F.size("w"), size, overlap)).alias("chunk_no", "s"))
    part = F.slice("w", F.col("s") + 1, size)
    body = F.when(F.size("w") <= size, F.coalesce("t", F.lit(""))).otherwise(F.array_join(part, " "))
    return rows.select(*keys, "chunk_no", F.size(part).alias("n_words"), body.alias("text"))


def weighted_mean(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score): mean of chunk scores weighted by words; 0 for texts without words."""
    return scored.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum(F.col("score") * F.col("n_words")), F.sum("n_words")), F.lit(0.0)).alias("score")
    )


def lexicon_windows(
    texts: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text", window: int = WINDOW_WORDS, points: int = WINDOW_POINTS,
    band: float = NEUTRAL_BAND, mini: bool = False,
) -> DataFrame:
    """(keys, scores, total_words): the sliding-window arc of each text by lexicon.

    Sums of happiness and counts are kept per word and accumulated, so a window costs two look-ups whatever its length.
    Texts within one window give their score at every point.  ``mini`` makes the short arcs of selection: windows of
    max(50, words // 5) that reach the end, at most ``points``; texts under 50 words give one point.
    The lexicon must be small (checked) as every task holds it.
    """
    import re

    telling = lexicon.where(F.abs(F.col("happs") - 5.0) > band)
    if telling.limit(BROADCAST_WORDS + 1).count() > BROADCAST_WORDS:
        raise ValueError(f"more than {BROADCAST_WORDS} words in the lexicon")
    shared = texts.sparkSession.sparkContext.broadcast({r["word"]: r["happs"] for r in telling.collect()})
    token = re.compile("[a-zà-ÿ]+")

    def arc(t: str) -> tuple[list[float], int]:
        happs = shared.value
        ws = t.split()
        n = len(ws)
        sums, counts = np.zeros(n + 1), np.zeros(n + 1)
        for i, w in enumerate(ws):
            for x in token.findall(w.lower()):
                h = happs.get(x)
                if h is not None:
                    sums[i + 1] += h
                    counts[i + 1] += 1
        sums, counts = np.cumsum(sums), np.cumsum(counts)

        def score(a, b):
            k = counts[b] - counts[a]
            return ((sums[b] - sums[a]) / k - 5.0) / 4.0 if k else 0.0

        if mini:
            size = max(50, n // 5)
            k = min(points, max(1, n - size + 1))
            if n < 50 or k <= 1:
                return [score(0, n)], n
            starts = [int(i * (n - size) / (k - 1)) for i in range(k)]
        else:
            size = window
            if n <= window:
                return [score(0, n)] * points, n
            gap = (n - window) / points
            starts = [round(i * gap) for i in range(points)]
        return [score(s, s + size) for s in starts], n

    @F.pandas_udf("scores array<double>, total_words int")
    def run(batch: pd.Series) -> pd.DataFrame:
        rows = [arc(t or "") for t in batch]
        return pd.DataFrame({"scores": [r[0] for r in rows], "total_words": [r[1] for r in rows]})

    made = texts.select(*keys, run(F.coalesce(text, F.lit(""))).alias("x"))
    return made.select(*keys, "x.scores", "x.total_words")
