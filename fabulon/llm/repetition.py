"""Repetition inside a single document (problem 5).

A trigram model with modified Kneser-Ney smoothing is counted by Spark over all texts; no n-gram is left out.  Each text
gets two perplexities: the plain one, and its own, in which a trigram that has occurred earlier in the text is foreseen
by the text itself (a cache component).  Bands per language bound both: plain perplexity above the upper band is noise;
an own perplexity under the lower band is repetition.

The lower band also has a part that follows from the definition of heavy repetition, so that no heavy text can miss it,
however common its phrases are in the corpus.  Let R words lie in runs of eight that start earlier in the text too.  In
such a run the last six words end trigrams seen before; a word of a run that doesn't is the first or second of every
run it lies in, and the six words after those two end such trigrams.  So at least 3/4 R words are foreseen, with
R = 0.3 n at least 0.225 n, and what they save is at least the sum of the 0.225 n smallest savings that the text's words
could bring.  Texts under the band are then measured exactly.

The priced n-grams are kept in sorted hash arrays, which tasks get whole while there are at most ``LOCAL_GRAMS`` of
them; beyond that they stay distributed and are joined, with the same result.
"""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowio import cut_lineage, table
from .truncation import candidates, normal_lang

#: Words of a repeated run.
RUN = 8
#: Share of repeated words from which a text is heavily repetitive.
HEAVY = 0.3
#: Trigrams that are broadcast (12 bytes each); more are joined.
LOCAL_GRAMS = 4_000_000
#: Part of the repeated words that end a trigram seen before, at least.
FORESEEN = 0.75
#: Weight of the text's own history.
CACHE = 0.9
#: A text is under the lower band if ln(own perplexity) / ln(perplexity) is at most this part of the language's median
#: (which counts as ``LEAST_RATIO`` at least, for languages where most texts repeat themselves).
LOWER, LEAST_RATIO = 0.96, 0.94
#: A text is also under it if its own perplexity is at most this power of the language's median perplexity: stock
#: phrases that the model foresees anyway leave no room between the two perplexities.
FLOOR = 0.6
#: Upper band as a power of the language's median perplexity.
UPPER = 2.0
_CHUNK = 400_000  # words per vectorised step

def _word_pattern(top: int) -> re.Pattern:
    """Letters, digits and the combining marks below ``top``, as ranges."""
    marks = [o for o in range(0x300, top) if not 0xD800 <= o < 0xE000 and ud.category(chr(o))[0] == "M"]
    known = set(marks)
    starts = [o for o in marks if o - 1 not in known]
    ends = [o for o in marks if o + 1 not in known]
    return re.compile("[\\w" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)) + "]+")


_WORD, _ASCII = _word_pattern(0x10000), re.compile(r"\w+")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words_of(text: str) -> list[str]:
    """Maximal runs of letters, combining marks and digits, in lower case."""
    text = text.lower().replace("_", " ")
    if text.isascii():
        return _ASCII.findall(text)
    # the pattern of all planes is slow, and hardly ever needed
    return (_word_pattern_all() if _ASTRAL.search(text) else _WORD).findall(text)


@lru_cache(maxsize=1)
def _word_pattern_all() -> re.Pattern:
    return _word_pattern(0x20000)


class _Ids(dict):
    """Stable 31-bit ids of words, remembered within a task."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = (xxhash.xxh32_intdigest(word) & 0x7FFFFFFE) + 1
        return value


def encode(texts: DataFrame) -> DataFrame:
    """(src, rec_id, lang, ids) of (src, rec_id, lang, t): the ids of each text's words, counted and priced from here on."""
    columns = ["src", "rec_id", "lang"]

    def rows(batches):
        ids = _Ids()
        for batch in batches:
            words = [[ids[w] for w in words_of(t)] if t else [] for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.list_(pa.int32()))], names=[*columns, "ids"])

    lang = F.coalesce("lang", F.lit("und")).alias("lang")
    kind = texts.schema["rec_id"].dataType.simpleString()
    return texts.select("src", "rec_id", lang, "t").mapInArrow(rows, f"src string, rec_id {kind}, lang string, ids array<int>")


def _chunks(column: pa.Array):
    """(first row, flat, offsets) of some rows at a time: the ids of a text stand together after a leading 0."""
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    words = column.flatten().to_numpy(zero_copy_only=False)
    done = np.concatenate([[0], np.cumsum(sizes)])
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + _CHUNK, side="right")) - 1)
        hi = min(hi, len(sizes))
        offsets = (done[lo : hi + 1] - done[lo]) + np.arange(hi - lo + 1)
        flat = np.zeros(offsets[-1], dtype=np.uint64)
        inside = np.ones(len(flat), dtype=bool)
        inside[offsets[:-1]] = False
        flat[inside] = words[done[lo] : done[hi]]
        yield lo, flat, offsets
        lo = hi


def _key(*words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words[0]), dtype=np.uint64)
    for w in words:
        h = (h ^ w) * _A
        h ^= h >> np.uint64(31)
        h *= _B
    return h


def _trigrams(flat: np.ndarray):
    """(w1, w2, w3) of every word; text starts count as word 0."""
    w3 = flat[1:]
    w2 = flat[:-1]
    w1 = np.concatenate([np.zeros(1, np.uint64), np.where(w2[1:] == 0, 0, flat[:-2])]) if len(w3) else w2
    word = w3 > 0
    return w1[word], w2[word], w3[word], word


def _count(batches):
    for batch in batches:
        for _, flat, _ in _chunks(batch.column(0)):
            w1, w2, w3, _ = _trigrams(flat)
            _, first, n = np.unique(_key(w1, w2, w3), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[first].astype(np.int32)) for x in (w1, w2, w3)] + [pa.array(n.astype(np.int64))], names=["w1", "w2", "w3", "n"]
            )


def _discounts(coc: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams seen 1 to 4 times."""
    n1, n2, n3, n4 = (coc.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a else 0.75 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _keyed(batches):
    for batch in batches:
        keys = _key(*[batch.column(k).to_numpy().astype(np.uint64) for k in range(3)])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(batch.column(3).to_numpy().astype(np.float32))], names=["k", "log_p"])


class NgramModel:
    """Log probabilities of all trigrams of the corpus, as a table (w1, w2, w3, log_p); ``local`` holds it in sorted hash
    arrays while it is small, else None."""

    def __init__(self, rows: DataFrame, local_grams: int = LOCAL_GRAMS):
        self.rows, self.local = rows, None
        if rows.count() <= local_grams:
            # executors hash the trigrams, the driver gets 12 bytes of each
            got = rows.mapInArrow(_keyed, "k long, log_p float").toArrow()
            keys = got["k"].to_numpy().view(np.uint64)
            order = np.argsort(keys)
            self.local = keys[order], got["log_p"].to_numpy()[order]

    def log_prob(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> np.ndarray:
        return look_up(self.local, _key(w1, w2, w3))


def look_up(local, keys: np.ndarray) -> np.ndarray:
    known, values = local
    some, back = np.unique(keys, return_inverse=True)
    return values[np.minimum(np.searchsorted(known, some), len(known) - 1)][back].astype(np.float64)


def fit_ngrams(encoded: DataFrame, local_grams: int = LOCAL_GRAMS) -> NgramModel:
    """Count the trigrams of all texts (column ids) and price them.  Shuffled are partial counts and tables of n-grams."""
    tri = cut_lineage(
        encoded.select("ids").mapInArrow(_count, "w1 int, w2 int, w3 int, n long").groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n"))
    )
    # continuation counts: in how many contexts an n-gram occurs
    bi = cut_lineage(tri.groupBy("w2", "w3").agg(F.count(F.lit(1)).alias("n")))
    uni = bi.groupBy("w3").agg(F.count(F.lit(1)).alias("n1"))
    n_types = max(bi.count(), 1)

    def discounted(df: DataFrame, hist: list[str]) -> tuple[DataFrame, str, str]:
        """(history, total, weight of the shorter context), and the expression for a discounted count."""
        coc = {r["k"]: r["c"] for r in df.groupBy(F.least("n", F.lit(5)).alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}
        d = _discounts(coc)
        held = " + ".join(f"{x!r} * count_if(n {test})" for x, test in zip(d, ("= 1", "= 2", "> 2")))
        return df.groupBy(*hist).agg(F.sum("n").alias("total"), F.expr(f"({held}) / sum(n)").alias("rest")), f"n - element_at(array({d[0]!r}d, {d[1]!r}d, {d[2]!r}d), cast(least(n, 3) as int))"

    h2, less = discounted(bi, ["w2"])
    p2 = bi.join(h2, "w2").join(uni, "w3").select("w2", "w3", F.expr(f"({less}) / total + rest * n1 / {n_types}d").alias("p2"))
    h3, less = discounted(tri, ["w1", "w2"])
    p3 = F.expr(f"({less}) / total + rest * p2")
    priced = tri.join(h3, ["w1", "w2"]).join(p2, ["w2", "w3"]).select("w1", "w2", "w3", F.log(F.least(F.greatest(p3, F.lit(1e-12)), F.lit(1.0))).alias("log_p"))
    return NgramModel(cut_lineage(priced), local_grams)


def _seen_before(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Those of ``places`` whose key occurs at an earlier one."""
    order = places[np.argsort(keys[places], kind="stable")]
    return order[1:][keys[order[1:]] == keys[order[:-1]]]


def _repeats(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose trigram ends a repetition of an earlier one of its text; whether each place lies in a repeated run."""
    n = len(flat)
    doc = np.repeat(np.arange(1, len(offsets), dtype=np.uint64), np.diff(offsets))
    again3 = np.zeros(0, dtype=np.int64)
    steps = np.zeros(n + 1, dtype=np.int32)
    m = n - RUN + 1
    if n >= 3:
        h = doc * _C
        for k in range(RUN if m > 0 else 3):
            left = n - k
            h = (h[:left] ^ flat[k:]) * _A
            h ^= h >> np.uint64(29)
            if k == 2:
                at = np.flatnonzero((flat[:left] != 0) & (doc[:left] == doc[2:]))
                again3 = _seen_before(h, at) + 2
        if m > 0:
            again = _seen_before(h, np.flatnonzero((flat[:m] != 0) & (doc[:m] == doc[RUN - 1 :])))
            steps[again] += 1
            steps[again + RUN] -= 1
    return again3, np.cumsum(steps[:-1]) > 0


def _saving(log_p: np.ndarray) -> np.ndarray:
    """What a word of this price saves where the text foresees it."""
    return np.log(CACHE + (1 - CACHE) * np.exp(log_p)) - log_p


def _least_savings(saving: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per text the sum of its smallest savings, as many as a heavy text has foreseen words at least."""
    doc = np.repeat(np.arange(len(words)), np.diff(offsets))
    order = np.lexsort((saving, doc))
    quota = np.ceil(FORESEEN * HEAVY * words - 1e-9).astype(np.int64)
    # texts begin with a 0, whose saving of -1 sorts first and isn't summed
    rank = np.arange(len(saving)) - np.repeat(offsets[:-1], np.diff(offsets))
    use = (rank >= 1) & (rank <= np.repeat(quota, np.diff(offsets)))
    return np.bincount(doc, weights=np.where(use, saving[order], 0.0), minlength=len(words))


def measure(column: pa.Array, local=None) -> np.ndarray:
    """Per text of word ids (words, repeated words, sum of log probabilities, what its own history saves, least saving of
    a heavy text); the last three are 0 without ``local`` prices."""
    out = np.zeros((len(column), 5))
    for lo, flat, offsets in _chunks(column):
        again, inside = _repeats(flat, offsets)
        hi = lo + len(offsets) - 1
        sums = lambda x: np.add.reduceat(x, offsets[:-1])
        out[lo:hi, 0], out[lo:hi, 1] = sums((flat > 0).astype(float)), sums(inside.astype(float))
        if local is not None and len(flat) > 1 and len(local[0]):
            w1, w2, w3, word = _trigrams(flat)
            log_p = np.zeros(len(flat))
            log_p[1:][word] = look_up(local, _key(w1, w2, w3))
            saving = np.where(flat > 0, _saving(log_p), -1.0)
            saved = np.zeros(len(flat))
            saved[again] = saving[again]
            out[lo:hi, 2], out[lo:hi, 3] = sums(log_p), sums(saved)
            out[lo:hi, 4] = _least_savings(saving, offsets, out[lo:hi, 0])
    return out


def is_heavy() -> F.Column:
    """At least ``HEAVY`` of the words are repeated; never for texts without words."""
    return (F.col("n_words") > 0) & (F.col("repeated") >= HEAVY * F.col("n_words"))


_FIGURES = ("n_words", "repeated", "log_p", "saved", "least_saving")


def _figures(encoded: DataFrame, local) -> DataFrame:
    """(src, rec_id, lang) and the figures of ``measure``; one narrow stage."""
    shared = encoded.sparkSession.sparkContext.broadcast(local)

    def rows(batches):
        for batch in batches:
            m = measure(batch.column(3), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(m[:, k]) for k in range(5)]], names=["src", "rec_id", "lang", *_FIGURES])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields[:3])
    return encoded.select("src", "rec_id", "lang", "ids").mapInArrow(rows, f"{kinds}, " + ", ".join(f"{c} double" for c in _FIGURES))


def _joined_figures(encoded: DataFrame, model: NgramModel) -> DataFrame:
    """The same by a join of each text's distinct trigrams with the table of prices."""
    encoded = cut_lineage(encoded.withColumn("_row", F.monotonically_increasing_id()))

    def grams(batches):
        for batch in batches:
            row = batch.column(0).to_numpy()
            for lo, flat, offsets in _chunks(batch.column(1)):
                again = np.zeros(len(flat), dtype=np.int64)
                again[_repeats(flat, offsets)[0]] = 1
                w1, w2, w3, word = _trigrams(flat)
                own = np.repeat(row[lo : lo + len(offsets) - 1], np.diff(offsets))[1:][word]
                _, first, back, n = np.unique(_key(own.astype(np.uint64), w1, w2, w3), return_index=True, return_inverse=True, return_counts=True)
                seen = np.bincount(back, weights=again[1:][word], minlength=len(first)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[first])] + [pa.array(x[first].astype(np.int32)) for x in (w1, w2, w3)] + [pa.array(n), pa.array(seen)],
                    names=["_row", "w1", "w2", "w3", "n", "again"],
                )

    asked = encoded.select("_row", "ids").mapInArrow(grams, "_row long, w1 int, w2 int, w3 int, n long, again long")
    saving = F.log(F.lit(CACHE) + F.lit(1 - CACHE) * F.exp("log_p")) - F.col("log_p")
    priced = asked.join(model.rows, ["w1", "w2", "w3"]).withColumn("s", saving)
    sums = priced.groupBy("_row").agg(
        F.sum("n").alias("words"), F.sum(F.col("log_p") * F.col("n")).alias("log_p"), F.sum(F.col("s") * F.col("again")).alias("saved"),
        F.array_sort(F.collect_list(F.struct("s", "n"))).alias("all"),
    )
    start = F.struct(F.ceil(F.lit(FORESEEN * HEAVY) * F.col("words") - F.lit(1e-9)).cast("long").alias("left"), F.lit(0.0).alias("sum"))

    def take(acc, x):
        n = F.least(acc["left"], x["n"])
        return F.struct((acc["left"] - n).alias("left"), (acc["sum"] + n * x["s"]).alias("sum"))

    sums = sums.select("_row", "log_p", "saved", F.aggregate("all", start, take, lambda acc: acc["sum"]).alias("least_saving"))
    shares = _repeated_words(encoded.select("_row", "src", "rec_id", "lang", "ids"))
    zero = F.lit(0.0)
    return shares.join(sums, "_row", "left").select(
        "src", "rec_id", "lang", "n_words", "repeated", *[F.coalesce(c, zero).alias(c) for c in ("log_p", "saved", "least_saving")]
    )


def _repeated_words(encoded: DataFrame) -> DataFrame:
    def rows(batches):
        for batch in batches:
            m = measure(batch.column(4))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(m[:, 0]), pa.array(m[:, 1])], names=["_row", "src", "rec_id", "lang", "n_words", "repeated"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields[:4])
    return encoded.mapInArrow(rows, f"{kinds}, n_words double, repeated double")


def repetition(texts: DataFrame, local_grams: int = LOCAL_GRAMS) -> DataFrame:
    """(src, rec_id, lang, n_words, repeated, share, perplexity, own_perplexity, lower_band, upper_band, verdict) per row
    of (src, rec_id, lang, t).

    ``verdict`` is 'repetitive' (share of at least ``HEAVY``, or own perplexity under the language's lower band), 'noise'
    (perplexity over the upper band) or 'ok'; ``lower_band`` is the higher one of the language's and the text's.  Texts
    without words get null figures and 'ok'.  Null and empty texts are kept with 0 words; repeated rows are judged
    alike.  One scan of the texts; shuffled are trigram counts, never texts.
    """
    encoded = cut_lineage(encode(texts))
    model = fit_ngrams(encoded, local_grams)
    figures = _figures(encoded, model.local) if model.local is not None else _joined_figures(encoded, model)
    some = F.col("n_words") > 0
    mean = lambda x: F.when(some, x / F.col("n_words"))
    scored = figures.select(
        "src", "rec_id", "lang", F.col("n_words").cast("long").alias("n_words"), F.col("repeated").cast("long").alias("repeated"),
        mean(F.col("repeated")).alias("share"), F.exp(mean(-F.col("log_p"))).alias("perplexity"), F.exp(mean(-F.col("log_p") - F.col("saved"))).alias("own_perplexity"),
        # the band is widened by rounding errors of the sums
        F.exp(mean(-F.col("log_p") - F.col("least_saving") * (1 - 1e-6)) + 1e-9).alias("own_band"),
    )
    scored = cut_lineage(scored).withColumn("ratio", F.try_divide(F.log("own_perplexity"), F.log("perplexity")))
    bands = scored.groupBy("lang").agg(
        F.percentile_approx("perplexity", 0.5, 1000).alias("middle"), F.percentile_approx("ratio", 0.5, 1000).alias("middle_ratio")
    )
    return (
        scored.join(bands, "lang", "left")
        .withColumn("bound", F.lit(LOWER) * F.greatest("middle_ratio", F.lit(LEAST_RATIO)))
        .withColumn("lang_band", F.greatest(F.pow("perplexity", "bound"), F.pow("middle", F.lit(FLOOR))))
        .withColumn("lower_band", F.greatest("lang_band", "own_band"))
        .withColumn("upper_band", F.pow("middle", F.lit(UPPER)))
        .withColumn(
            "verdict",
            F.when((is_heavy() & (F.col("own_perplexity") <= F.col("lower_band"))) | (F.col("own_perplexity") <= F.col("lang_band")), "repetitive")
            .when(F.col("perplexity") > F.col("upper_band"), "noise").otherwise("ok"),
        )
        .drop("middle", "middle_ratio", "ratio", "bound", "own_band", "lang_band")
    )


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("src"), F.col("doc_id").alias("rec_id"), normal_lang("lang").alias("lang"), F.col("text").alias("t")
    )
    cands = candidates(spark, sf_dir).select(
        F.lit("candidates").alias("src"), F.col("cand_id").alias("rec_id"), "lang", F.col("translated_text").alias("t")
    )
    return docs.unionByName(cands)


def p5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(_texts(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts under the lower band whose exact share is heavy."""
    under = F.col("own_perplexity") <= F.col("lower_band")
    return repetition(_texts(spark, sf_dir)).where(under & is_heavy()).select("src", "rec_id")
