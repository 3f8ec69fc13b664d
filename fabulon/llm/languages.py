"""Languages of texts, learned from the corpus' own labels (used by problem 2).

A multinomial classifier over hashed character trigrams: Spark counts them by label over all labelled texts, so the
driver gets a table of fixed width per language and no word lists are needed.  Texts wholly in a script that only one
label uses are told by their trigrams like any others.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BUCKETS = 1 << 14
_LABEL = re.compile(r"[a-z]{2}")
_OTHER = re.compile(r"[\W\d_]+")
#: How many times likelier (as a logarithm) the best language must be than the next one.
CLEAR = 3.0


def trigrams(text: str) -> np.ndarray:
    """Buckets of the character trigrams of the words of ``text``, in lower case, with word edges."""
    plain = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    p = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(p) < 3:
        return np.zeros(0, dtype=np.int64)
    h = (p[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (p[2:] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int64)


class Languages:
    """Log probabilities of trigrams by language."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        counts = counts + 0.1
        self.log_p = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32).T if names else np.zeros((_BUCKETS, 0), np.float32)

    def of(self, text: str) -> str | None:
        """The two-letter code of the language of ``text``, None where none is clearly the likeliest."""
        t = trigrams(text)
        if not len(t) or not self.names:
            return None
        score = self.log_p[t].sum(axis=0)
        order = np.argsort(-score, kind="stable")
        if len(order) > 1 and score[order[0]] - score[order[1]] < CLEAR:
            return None
        return self.names[int(order[0])]


def label(lang: str | None) -> str | None:
    """Two letters in lower case, None for anything else."""
    code = (lang or "").strip()[:2].lower()
    return code if _LABEL.fullmatch(code) else None


def fit_languages(texts: DataFrame) -> Languages:
    """Train on all rows of (lang, t); rows without label or text are left out.  Shuffled are counts by label and bucket."""

    def counts(batches):
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for lang, t in zip(*(c.to_pylist() for c in batch.columns)):
                code = label(lang)
                if code and t:
                    own = sums.setdefault(code, np.zeros(_BUCKETS, dtype=np.int64))
                    own += np.bincount(trigrams(t), minlength=_BUCKETS)
            for code, own in sums.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([code] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"]
                )

    got = texts.select("lang", "t").mapInArrow(counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(got["lang"]))
    table = np.zeros((len(names), _BUCKETS))
    place = {n: i for i, n in enumerate(names)}
    table[got["lang"].map(place).to_numpy(np.int64) if names else np.zeros(0, np.int64), got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return Languages(names, table)
