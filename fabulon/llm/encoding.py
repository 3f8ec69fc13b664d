"""Garbled text from wrong character encoding (problem 6).

A multinomial classifier over hashed byte bigrams predicts, for each run of non-ASCII characters, the exact chain of
wrong decodings that made it; the chain is inverted and kept only if the bytes decode strictly.  One class is the
reading that loses bytes to replacement characters, which nothing can invert.  The classifier is trained on
synthetically garbled runs of a bounded sample of the corpus' own records; executors sum the sample's bigrams by class,
so the driver gets the same few numbers whatever the corpus and its partitions.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowio import cut_lineage, flat_map, table

#: The single-byte character sets through which UTF-8 bytes are read wrongly.
CHARSETS = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "koi8-r")
#: Chains of one or two wrong readings; the last reading comes last.
CHAINS = tuple((c,) for c in CHARSETS) + (
    ("cp1252", "cp1252"), ("latin-1", "latin-1"), ("cp1252", "latin-1"), ("latin-1", "cp1252"),
    ("cp1251", "cp1251"), ("mac_roman", "mac_roman"), ("cp437", "cp437"), ("cp850", "cp850"),
)
#: Bytes of a single-byte charset read as UTF-8 leave replacement characters: a class of its own, without an inverse.
LOSSY = ("cp1252",)
#: Records of which the classifier's training runs are taken, on average (a documented bound; it scores every record).
TRAIN_ROWS = 2000
_BUCKETS = 4096
_RUN = re.compile(r"[^\x00-\x7f]+")
_LOST = "�"


@lru_cache(maxsize=None)
def _tables(charset: str) -> tuple[dict[int, str], dict[str, int]]:
    """Byte to character and back; bytes the set leaves open stand for the control characters of equal number."""
    to_char = {}
    for b in range(256):
        try:
            to_char[b] = bytes([b]).decode(charset)
        except UnicodeDecodeError:
            to_char[b] = chr(b)
    return to_char, {ch: b for b, ch in to_char.items()}


def garble(text: str, chain: tuple[str, ...]) -> str:
    """``text`` as it reads after its UTF-8 bytes went through each wrong charset of ``chain``."""
    for charset in chain:
        to_char = _tables(charset)[0]
        text = "".join(map(to_char.__getitem__, text.encode("utf-8", "replace")))
    return text


def invert(run: str, chain: tuple[str, ...]) -> str | None:
    """The original of a garbled run, None unless every step decodes strictly."""
    for charset in reversed(chain):
        to_byte = _tables(charset)[1]
        try:
            run = bytes(map(to_byte.__getitem__, run)).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return None
    return run


def _sound(original: str) -> bool:
    """A restored run must not hold control characters."""
    return all(ch >= "\xa0" or " " <= ch < "\x7f" for ch in original)


def _features(run: str) -> np.ndarray:
    data = np.frombuffer(b"\x02" + run.encode("utf-8", "replace") + b"\x03", dtype=np.uint8).astype(np.int64)
    return (data[:-1] * 257 + data[1:] * 7919) % _BUCKETS


def lose(text: str) -> str:
    """``text`` as it reads after bytes of a single-byte charset were taken for UTF-8."""
    return text.encode(LOSSY[0], "ignore").decode("utf-8", "replace")


class ChainModel:
    """Multinomial classifier: class 0 is sound text, class i the i-th chain, the last one loss."""

    def __init__(self, counts: np.ndarray, known: frozenset):
        counts = counts + 0.05
        self.log_p = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
        prior = np.full(len(counts), 0.5 / len(CHAINS))
        prior[0] = 0.5
        self.log_prior, self.known, self._seen = np.log(prior).astype(np.float32), known, {}

    def rank(self, run: str) -> np.ndarray:
        return np.argsort(-(self.log_prior + self.log_p[:, _features(run)].sum(axis=1)), kind="stable")

    def judge(self, run: str) -> tuple[str | None, tuple[str, ...], int] | None:
        """(original, chain, how many predictions were tried) of a run, None if it is sound.  Chains are tried in the
        classifier's order up to sound text; each must pass the strict decoding.  The original is None where the run
        was read with loss."""
        if run not in self._seen:
            if len(self._seen) > 100_000:
                self._seen.clear()
            found = None
            for tried, c in enumerate(self.rank(run), 1):
                if c == 0:
                    break
                if c > len(CHAINS):
                    if _LOST in run:
                        found = (None, LOSSY + ("utf-8",), tried)
                        break
                    continue
                text = invert(run, CHAINS[c - 1])
                # two look-alike letters may spell a character; a single one must be known
                if text is not None and text != run and _sound(text) and (len(text) > 1 or text in self.known):
                    again = self.restore(text) if _RUN.search(text) else None
                    found = (again[0], again[1] + CHAINS[c - 1], tried) if again else (text, CHAINS[c - 1], tried)
                    break
            self._seen[run] = found
        return self._seen[run]

    def restore(self, run: str) -> tuple[str, tuple[str, ...]] | None:
        """(original, chain) of a run that can be put right, else None."""
        hit = self.judge(run)
        return hit[:2] if hit and hit[0] is not None else None

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}


#: Letters and marks that count once beside the corpus' own, so rare ones are known too (code points).
ALPHABETS = (
    (0xA1, 0x17F), (0x300, 0x36F), (0x391, 0x3C9), (0x401, 0x45F), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2122, 0x2122),
    (0x2150, 0x215F), (0x3000, 0x301F),
)


def _basics() -> Counter:
    return Counter(chr(o) for a, b in ALPHABETS for o in range(a, b + 1))


def class_counts(runs: Counter) -> np.ndarray:
    """Hashed bigrams of the runs by class: as they are, after each chain, after loss."""
    counts = np.zeros((len(CHAINS) + 2, _BUCKETS))
    for run, n in runs.items():
        np.add.at(counts[0], _features(run), n)
        for i, chain in enumerate(CHAINS, 1):
            np.add.at(counts[i], _features(garble(run, chain)), n)
        for lost in _RUN.findall(lose(f"a{run}a")):
            np.add.at(counts[-1], _features(lost), n)
    return counts


def _own_runs(text: str, model: ChainModel | None) -> list[str]:
    """The non-ASCII runs of a text; none if ``model`` finds one of them garbled."""
    runs = [r for r in _RUN.findall(text) if _LOST not in r]
    return [] if _LOST in text or (model and any(model.judge(r) for r in set(runs))) else runs


def train(texts: list[str]) -> ChainModel:
    """Fit on the non-ASCII runs of ``texts``, then again without the records that the first fit finds garbled."""
    known, basics = frozenset("".join(texts)), _basics()
    model = None
    for _ in range(2):
        runs = sum((Counter(_own_runs(t, model)) for t in texts), Counter())
        model = ChainModel(class_counts(runs + basics), known | frozenset(basics))
    return model


def fit_chains(df: DataFrame, key: str, text: str, rows: int = TRAIN_ROWS) -> ChainModel:
    """Train on a sample of about ``rows`` records, whole, chosen by the hash of key and text, so the same however the
    rows are spread; known characters are gathered over all rows.

    The driver receives at most 18 x 4096 sums and the distinct characters of the corpus (bounded by Unicode).
    """
    sc = df.sparkSession.sparkContext
    odd = df.select(df[text].alias("t"), F.xxhash64(df[key], df[text]).alias("h")).where("t rlike '[^\\\\x00-\\\\x7f]'")

    def characters(batches):
        for batch in batches:
            found = sorted(map(ord, set().union(*batch.column(0).to_pylist()) - _ASCII))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([0] * len(found), pa.int64())], names=["c", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([batch.num_rows], pa.int64())], names=["c", "n"])

    census = odd.select("t").mapInArrow(characters, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    known = frozenset(chr(r["c"]) for r in census if r["c"] >= 0)
    total = sum(r["n"] for r in census if r["c"] < 0)
    unit = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    sample = cut_lineage(odd.where(unit < rows / max(total, 1)).dropDuplicates(["h"]).select("t"))
    model, basics = None, _basics()
    for _ in range(2):
        shared = sc.broadcast(model)

        def sums(batches, shared=shared):
            for batch in batches:
                runs = Counter(r for t in batch.column(0).to_pylist() for r in _own_runs(t, shared.value))
                counts = class_counts(runs)
                cls, bucket = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[cls, bucket])], names=["cls", "bucket", "n"]
                )

        got = sample.mapInArrow(sums, "cls int, bucket int, n double").groupBy("cls", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts = class_counts(basics)
        counts[got["cls"].to_numpy(np.int64), got["bucket"].to_numpy(np.int64)] += got["n"].to_numpy(np.float64)
        model = ChainModel(counts, known | frozenset(basics))
    return model


_ASCII = frozenset(map(chr, range(128)))


def repair(text: str | None, model: ChainModel) -> tuple[str | None, str, int, int, int] | None:
    """(restored text, chain, restored runs, lost characters, runs whose first prediction was right) of a garbled value,
    None for a sound one."""
    if not text or text.isascii():
        return None
    lost = first = 0
    last = len(text.rstrip(" \n\t.…"))
    chains: Counter = Counter()

    def one(m: re.Match) -> str:
        nonlocal lost, first
        run = m.group()
        hit = model.judge(run)
        if hit is None and chains and len(run) > 1 and m.end() == len(text):
            # the cut of a garbled text can leave half a character at its very end
            hit = next((h for k in (1, 2) if (h := model.judge(run[:-k])) and h[0] is not None), None)
        if hit is None:
            return run
        if hit[0] is None:
            lost += run.count(_LOST)
            return run
        chains["+".join(hit[1])] += 1
        first += hit[2] == 1
        return hit[0]

    fixed = _RUN.sub(one, text)
    if lost == 1 and not chains and text.find(_LOST) == last - 1:
        return None  # a character that a cut has halved
    if not chains and not lost:
        return None
    if not chains:
        return None, "lost", 0, lost, 0
    return fixed, chains.most_common(1)[0][0], sum(chains.values()), lost, first


def is_garbled(text: str | None, model: ChainModel) -> bool:
    return repair(text, model) is not None


def restore_encoding(df: DataFrame, key: str, fields: list[str], model: ChainModel) -> DataFrame:
    """One row per garbled field: (key, field, chain, restored_runs, lost_chars, first_right, restored).

    ``restored`` is the text with every verified run put right, null where only replacement characters are left.
    Null, empty and pure ASCII values are sound; repeated rows are judged like any other; other columns are ignored.
    ``first_right`` counts the runs for which the classifier's first prediction was the one that decoded.
    One scan, one narrow stage, no shuffle; the model is a fixed table of 18 x 4096 numbers.
    """
    key_type = df.schema[key].dataType.simpleString()
    picked = df.select(df[key].alias("k"), *[df[f].alias(f"f{i}") for i, f in enumerate(fields)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def rows(k, *values):
        out = []
        for field, value in zip(fields, values):
            hit = repair(value, shared.value)
            if hit:
                out.append((k, field, hit[1], hit[2], hit[3], hit[4], hit[0]))
        return out

    return flat_map(
        picked, rows, f"{key} {key_type}, field string, chain string, restored_runs int, lost_chars int, first_right int, restored string"
    )


def chapter_model(spark: SparkSession, sf_dir: str) -> ChainModel:
    return fit_chains(table(spark, sf_dir, "chapters"), "chapter_id", "text")


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = chapter_model(spark, sf_dir)
    return restore_encoding(table(spark, sf_dir, "chapters"), "chapter_id", ["text", "title"], model)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_restored(spark, sf_dir).select("chapter_id", "field")
