"""Sentence alignment in bilingual documents (problem 1).

Word translation tables are estimated by expectation-maximisation over all pairs of documents: every round scores the
sentence pairs of each document with the current table, takes the mutually best ones as parallel text, and re-counts
word pairs (Spark sums the partial counts).  Competitive linking then accepts the best compatible spans anywhere in a
document, greedily; sentences left over may join the span of a linked neighbour (merges) or stay alone (omissions).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrowio import cut_lineage, flat_map, table
from .encoding import _RUN, ChainModel, chapter_model
from .repetition import words_of
from .sentences import sentence_spans
from .visual import _ODD, _rewrite_word
from .visual import _WORD as _ANY_WORD

#: Rounds of expectation-maximisation after the positional start.
ROUNDS = 3
#: Least part of either word's expected counts that a pair of the table has.
LEAST_PROB = 0.02
#: Pairs and words of the table that are broadcast (some 40 bytes each); a larger table is joined.
LOCAL_PAIRS = 2_000_000
#: Similarity from which two sentences are linked, and the parts that a joining sentence must have and add.
LINK, COVER, GAIN = 0.42, 0.6, 0.3
#: What the difference of relative positions takes off a similarity; it decides between equal sentences.
DRIFT = 0.08
#: Documents that are scored at a time, and places of a grid up to which sums are dense.
DOCS, DENSE = 128, 20_000_000
#: Words that tell where an excerpt begins or ends in its source.
EDGE = 6

#: Weight of words outside the table: too rare to have been counted, so matched by equality only.
RARE = 6.0
#: How much more often than by chance a pair of the table must occur together.
LIFT = 3.0


class _Ids(dict):
    """Stable 31-bit ids of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = (xxhash.xxh32_intdigest(word) & 0x7FFFFFFE) + 1
        return value


def _clean(text: str, chains: ChainModel | None) -> tuple[str, list[int] | None]:
    """``text`` with wrong encodings and odd characters put right, and the place each character comes from (None: its
    own).  Sentences are found in the clean form, so an invisible character in an abbreviation ends nothing."""
    places = None
    for pattern, odd, rewrite in (
        (_RUN, _RUN, (lambda run: (hit := chains.restore(run)) and hit[0]) if chains else None),
        (_ANY_WORD, _ODD, _rewrite_word),
    ):
        if rewrite is None or odd.search(text) is None:
            continue
        out, origin, at = [], [], 0
        for m in pattern.finditer(text):
            new = rewrite(m.group())
            if new is not None and new != m.group():
                out += [text[at : m.start()], new]
                origin += range(at, m.start())
                origin += [min(m.start() + k, m.end() - 1) for k in range(len(new))]
                at = m.end()
        if out:
            origin += range(at, len(text))
            text = "".join(out) + text[at:]
            places = [places[k] for k in origin] if places else origin
    return text, places


def _tokens(text: str, chains: ChainModel | None, ids: _Ids) -> tuple[list[int], list[list[int]]]:
    """Starts (in the stored text) and distinct word ids of the sentences of a text."""
    clean, places = _clean(text, chains)
    starts, words = [], []
    for a, b in sentence_spans(clean):
        starts.append(places[a] if places else a)
        words.append(list(dict.fromkeys(ids[w] for w in words_of(clean[a:b]))))
    return starts, words


def sentence_pairs(pairs: DataFrame, chains: ChainModel | None) -> DataFrame:
    """(src, key_a, key_b, flip, starts_a, words_a, starts_b, words_b) of (src, key_a, key_b, lang_a, lang_b, text_a, text_b).

    ``flip`` tells that side b's language sorts first: counts are kept in one direction per pair of languages.  Nulls
    and blank texts have no sentences.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(chains)

    def row(ids, src, key_a, key_b, lang_a, lang_b, text_a, text_b):
        sa, wa = _tokens(text_a or "", shared.value, ids)
        sb, wb = _tokens(text_b or "", shared.value, ids)
        return [(src, key_a, key_b, (lang_a or "") > (lang_b or ""), sa, wa, sb, wb)] if sa and sb else []

    picked = pairs.select("src", "key_a", "key_b", "lang_a", "lang_b", "text_a", "text_b")
    return flat_map(
        picked, row, "src string, key_a long, key_b long, flip boolean, starts_a array<int>, words_a array<array<int>>, "
        "starts_b array<int>, words_b array<array<int>>", setup=_Ids,
    )


class WordTable:
    """Translation probabilities of word pairs and weights of words, in sorted arrays.

    Only pairs that occur together more often than chance are kept; a word's probabilities are taken relative to their
    sum, which scales its weight: words without clear translations say little.
    """

    def __init__(self, left, right, forward, backward, mass_l, mass_r, weights: list):
        order = np.lexsort((right, left))
        self.left, self.right, self.raw = left[order], right[order], forward[order].astype(np.float32)
        self.keys = (self.left.astype(np.uint64) << np.uint64(32)) | self.right.astype(np.uint64)
        self.relative = [(p / np.maximum(m, 1e-9))[order].astype(np.float32) for p, m in ((forward, mass_l), (backward, mass_r))]
        self.weights = weights

    def probability(self, keys: np.ndarray) -> np.ndarray:
        """Forward probability of pairs, a small constant for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), 1e-3)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.raw[at], 1e-3)

    def weight(self, words: np.ndarray, side: int) -> np.ndarray:
        known, values = self.weights[side]
        if not len(known):
            return np.ones(len(words))
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        return np.where(known[at] == words, values[at], RARE)


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``n`` items from ``first`` on: which run, and which item, of all items in turn."""
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _sums(size: int, *parts: tuple[np.ndarray, np.ndarray]) -> tuple:
    """Keys below ``size`` with the sum of the weights of each part; sparse where the range of keys is large."""
    if size <= DENSE:
        sums = [np.bincount(k, weights=w, minlength=size) for k, w in parts]
        some = np.flatnonzero(np.logical_or.reduce([s != 0 for s in sums]))
        return some, *[s[some] for s in sums]
    some, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    out, at = [], 0
    for k, w in parts:
        out.append(np.bincount(back[at : at + len(k)], weights=w, minlength=len(some)))
        at += len(k)
    return some, *out


class Side:
    """The sentences of one side of several documents: tokens, and each document's vocabulary with its holders."""

    def __init__(self, column: pa.Array):
        sents = column.flatten()
        n = np.diff(column.offsets.to_numpy()).astype(np.int64)
        self.count, self.first = n, np.cumsum(n) - n
        self.doc = np.repeat(np.arange(len(n)), n)
        self.size = np.diff(sents.offsets.to_numpy()).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.of = np.repeat(np.arange(len(sents)), self.size)
        self.word = sents.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocab, self.at = np.unique((self.doc[self.of] << 32) | self.word, return_inverse=True)
        self.words = self.vocab & 0xFFFFFFFF
        docs = np.arange(len(n) + 1) << 32
        edges = np.searchsorted(self.vocab, docs)
        self.v_first, self.v_count = edges[:-1], np.diff(edges)
        order = np.argsort(self.at, kind="stable")
        self.holders = self.of[order]
        self.h_count = np.bincount(self.at, minlength=len(self.vocab))
        self.h_first = np.cumsum(self.h_count) - self.h_count
        self.local = np.arange(len(sents)) - self.first[self.doc]


class Scores:
    """Similarities of the sentences of pairs of documents (left and right in the table's direction).

    An inverted index: only translations that a document's words have in the document on the other side are followed,
    and only sentence pairs that share a translation are scored.
    """

    def __init__(self, t: WordTable, left: Side, right: Side):
        self.l, self.r = left, right
        self.wl, self.wr = t.weight(left.words, 0), t.weight(right.words, 1)
        self.total_l = np.bincount(left.of, weights=self.wl[left.at], minlength=len(left.doc)) + 1e-9
        self.total_r = np.bincount(right.of, weights=self.wr[right.at], minlength=len(right.doc)) + 1e-9
        lo, hi = np.searchsorted(t.left, left.words), np.searchsorted(t.left, left.words, side="right")
        li, row = _spread(lo, hi - lo)
        ri, ok = self._find(right, (left.vocab[li] & ~0xFFFFFFFF) | t.right[row])
        ok &= left.words[li] != t.right[row]
        # equal words translate each other
        si, sok = self._find(right, left.vocab)
        one = np.ones(int(sok.sum()))
        li, ri = np.concatenate([li[ok], np.flatnonzero(sok)]), np.concatenate([ri[ok], si[sok]])
        forward, backward = (np.concatenate([p[row[ok]], one]) for p in t.relative)
        # how much of each right word's translations each left sentence holds, and the other way round
        self.best_r = self._held(left, right, li, ri, backward)
        self.best_l = self._held(right, left, ri, li, forward)

    @staticmethod
    def _find(side: Side, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(side.vocab):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(side.vocab, keys), len(side.vocab) - 1)
        return at, side.vocab[at] == keys

    @staticmethod
    def _held(own: Side, other: Side, oi: np.ndarray, xi: np.ndarray, p: np.ndarray):
        """(sentence of own, word of other, part) in the order of the sentences."""
        run, sentence = _spread(own.h_first[oi], own.h_count[oi])
        sentence, word, p = own.holders[sentence], xi[run], p[run]
        # places in a grid of each document's sentences and words
        base = np.cumsum(own.count * other.v_count) - own.count * other.v_count
        doc = own.doc[sentence]
        keys = base[doc] + own.local[sentence] * other.v_count[doc] + (word - other.v_first[doc])
        some, part = _sums(int((own.count * other.v_count).sum()), (keys, p))
        doc = np.searchsorted(base, some, side="right") - 1
        rest = some - base[doc]
        width = np.maximum(other.v_count[doc], 1)
        return own.first[doc] + rest // width, other.v_first[doc] + rest % width, np.minimum(part, 1.0)

    def candidates(self, least: float):
        """(similarity, i, j, left part, right part) of the pairs at or above ``least``, or with a part above COVER."""
        left, right = self.l, self.r
        base = np.cumsum(left.count * right.count) - left.count * right.count
        parts = []
        for (own, word, part), holder, weight, swap in ((self.best_l, left, self.wl, True), (self.best_r, right, self.wr, False)):
            run, other = _spread(holder.h_first[word], holder.h_count[word])
            other, own = holder.holders[other], own[run]
            i, j = (other, own) if swap else (own, other)
            doc = left.doc[i]
            parts.append((base[doc] + left.local[i] * right.count[doc] + right.local[j], (part * weight[word])[run]))
        some, pl, pr = _sums(int((left.count * right.count).sum()), *parts)
        doc = np.searchsorted(base, some, side="right") - 1
        rest, width = some - base[doc], np.maximum(right.count[doc], 1)
        il, jl = rest // width, rest % width
        i, j = left.first[doc] + il, right.first[doc] + jl
        sim = (pl + pr) / (self.total_l[i] + self.total_r[j])
        pl, pr = pl / self.total_l[i], pr / self.total_r[j]
        drift = DRIFT * np.abs(il / np.maximum(left.count[doc] - 1, 1) - jl / np.maximum(right.count[doc] - 1, 1))
        keep = (sim >= least) | (pl >= COVER) | (pr >= COVER)
        return tuple(x[keep] for x in (sim - drift, i, j, pl, pr))

    def explained(self, best, side: Side, sentence: int, by: list[int]) -> np.ndarray:
        """How much of each word of ``sentence`` (on ``side``) the sentences ``by`` of the other side explain."""
        own, word, part = best
        words = side.at[side.start[sentence] : side.start[sentence] + side.size[sentence]]
        out = np.zeros(len(words))
        for k in by:
            lo, hi = np.searchsorted(own, k), np.searchsorted(own, k, side="right")
            if hi > lo:
                at = lo + np.minimum(np.searchsorted(word[lo:hi], words), hi - lo - 1)
                out = np.maximum(out, np.where(word[at] == words, part[at], 0.0))
        return out


def link(s: Scores) -> list[tuple[int, int]]:
    """Competitive linking of all documents of ``s``: the best compatible spans first, wherever they stand.

    A span is a sentence, or two neighbours that a single sentence of the other side explains.  Sentences left over then
    join a neighbour's link if its partner explains them and has something left to explain; others stay alone.
    """
    sim, ci, cj, pl, pr = s.candidates(LINK)
    spans = [(sim[c], (int(ci[c]),), (int(cj[c]),)) for c in np.flatnonzero(sim >= LINK)]
    by_j: dict[int, list[int]] = {}
    by_i: dict[int, list[int]] = {}
    for c in np.flatnonzero((pl >= COVER) & (pr < 1.0)):
        by_j.setdefault(int(cj[c]), []).append(int(ci[c]))
    for c in np.flatnonzero((pr >= COVER) & (pl < 1.0)):
        by_i.setdefault(int(ci[c]), []).append(int(cj[c]))
    single = {(i, j): x for x, i, j in zip(sim.tolist(), ci.tolist(), cj.tolist())}
    wide = lambda best, side, one, two: (s.explained(best, side, one, list(two)) * (s.wr if side is s.r else s.wl)[side.at[side.start[one] : side.start[one] + side.size[one]]]).sum()
    for groups, best, side, total, other in ((by_j, s.best_r, s.r, s.total_r, s.total_l), (by_i, s.best_l, s.l, s.total_l, s.total_r)):
        part = dict(zip(zip(ci.tolist(), cj.tolist()), (pl if side is s.r else pr).tolist()))
        for one, many in groups.items():
            many = sorted(many)
            for x, y in zip(many, many[1:]):
                if y != x + 1:
                    continue
                key = (lambda k: (k, one)) if side is s.r else (lambda k: (one, k))  # noqa: B023
                mine = part[key(x)] * other[x] + part[key(y)] * other[y]
                value = (mine + wide(best, side, one, (x, y))) / (other[x] + other[y] + total[one])
                if value > max(single[key(x)], single[key(y)]) and value >= LINK:
                    spans.append((value, (x, y), (one,)) if side is s.r else (value, (one,), (x, y)))
    of_l: dict[int, list[int]] = {}
    of_r: dict[int, list[int]] = {}
    links: list[tuple[int, int]] = []
    for _, i, j in sorted(spans, key=lambda x: -x[0]):
        if not any(k in of_l for k in i) and not any(k in of_r for k in j):
            for a in i:
                of_l[a] = list(j)
            for b in j:
                of_r[b] = list(i)
            links += [(a, b) for a in i for b in j]
    for c in np.argsort(-np.maximum(pl, pr), kind="stable"):
        i, j = int(ci[c]), int(cj[c])
        if i not in of_l and j in of_r and pl[c] >= COVER and min(abs(i - k) for k in of_r[j]) <= len(of_r[j]) + 1:
            # what the right sentence says beyond its links must be said by the left one
            words = s.r.at[s.r.start[j] : s.r.start[j] + s.r.size[j]]
            new = s.explained(s.best_r, s.r, j, [i]) - s.explained(s.best_r, s.r, j, of_r[j])
            if (np.maximum(new, 0) * s.wr[words]).sum() >= GAIN * s.total_l[i]:
                of_l[i] = [j]
                of_r[j].append(i)
                links.append((i, j))
        elif j not in of_r and i in of_l and pr[c] >= COVER and min(abs(j - k) for k in of_l[i]) <= len(of_l[i]) + 1:
            words = s.l.at[s.l.start[i] : s.l.start[i] + s.l.size[i]]
            new = s.explained(s.best_l, s.l, i, [j]) - s.explained(s.best_l, s.l, i, of_l[i])
            if (np.maximum(new, 0) * s.wl[words]).sum() >= GAIN * s.total_r[j]:
                of_r[j] = [i]
                of_l[i].append(j)
                links.append((i, j))
    return links


def _beads(left: Side, right: Side, t: WordTable | None):
    """Parallel sentence pairs of the documents with weights: near the diagonal at first, then the mutually best ones."""
    if t is None:
        doc = left.doc
        mid = np.rint(left.local * (right.count[doc] - 1) / np.maximum(left.count[doc] - 1, 1)).astype(np.int64)
        i = np.repeat(np.arange(len(doc)), 3)
        j = np.repeat(mid, 3) + np.tile([-1, 0, 1], len(doc))
        ok = (j >= 0) & (j < right.count[doc[i]])
        i, near, j = i[ok], (j == np.repeat(mid, 3))[ok], j[ok]
        base = np.cumsum(left.count * right.count) - left.count * right.count
        place = lambda a, b: base[doc[a]] + left.local[a] * right.count[doc[a]] + b
        at, hit = Scores._find(right, left.vocab[left.at])
        run, other = _spread(right.h_first[at[hit]], right.h_count[at[hit]])
        some, n = _sums(int((left.count * right.count).sum()), (place(left.of[hit][run], right.local[right.holders[other]]), np.ones(len(run))))
        keys = place(i, j)
        found = np.minimum(np.searchsorted(some, keys), max(len(some) - 1, 0))
        common = np.where(some[found] == keys, n[found], 0.0) if len(some) else np.zeros(len(keys))
        return i, right.first[doc[i]] + j, np.where(near, 1.0, 0.4) * (1 + common)
    sim, i, j, _, _ = Scores(t, left, right).candidates(LINK)
    best_i, best_j = np.full(len(left.doc), -1.0), np.full(len(right.doc), -1.0)
    np.maximum.at(best_i, i, sim)
    np.maximum.at(best_j, j, sim)
    keep = (sim >= best_i[i]) & (sim >= best_j[j]) & (sim >= LINK)
    return i[keep], j[keep], sim[keep]


def _sides(batches):
    """(rows of the batch, left side, right side) of documents in the table's direction, some at a time."""
    for batch in batches:
        for flip in (False, True):
            rows = batch.filter(pc.equal(batch.column("flip"), flip))
            for lo in range(0, rows.num_rows, DOCS):
                part = rows.slice(lo, DOCS).take(pa.array(np.arange(min(DOCS, rows.num_rows - lo))))
                a, b = Side(part.column("words_a")), Side(part.column("words_b"))
                yield (part, b, a) if flip else (part, a, b)


def _expect(table_of):
    """The E-step over batches of sentence pairs: expected counts of word pairs, summed per step."""

    def run(batches):
        t = table_of()
        for _, left, right in _sides(batches):
            bi, bj, w = _beads(left, right, t)
            nr = right.size[bj]
            bead, k = _spread(np.zeros(len(bi), np.int64), left.size[bi] * nr)
            width = nr[bead]
            e = left.word[left.start[bi][bead] + k // np.maximum(width, 1)]
            place = k % np.maximum(width, 1)
            f = right.word[right.start[bj][bead] + place]
            keys = (e.astype(np.uint64) << np.uint64(32)) | f.astype(np.uint64)
            some, back = np.unique(keys, return_inverse=True)
            p = (np.ones(len(some)) if t is None else t.probability(some))[back]
            # each right word shares its count among the left words of its sentence
            group = (np.cumsum(nr) - nr)[bead] + place
            c = w[bead] * p / np.bincount(group, weights=p)[group]
            yield pa.RecordBatch.from_arrays(
                [pa.array((some >> np.uint64(32)).astype(np.int32)), pa.array((some & np.uint64(0xFFFFFFFF)).astype(np.int32)),
                 pa.array(np.bincount(back, weights=c, minlength=len(some)))], names=["e", "f", "c"],
            )

    return run


class Table:
    """The word table of a round: rows (e, f, forward, backward, mass_e, mass_f) and the words' weights, distributed;
    ``local`` holds a WordTable while both are small, else None."""

    def __init__(self, rows: DataFrame, weights: DataFrame, local_pairs: int):
        self.rows, self.word_weights, self.local = rows, weights, None
        if rows.count() + weights.count() <= local_pairs:
            self.local = _word_table(rows.toArrow(), weights.toArrow())


def _word_table(rows: pa.Table, words: pa.Table) -> WordTable:
    sides = []
    side = words["side"].to_numpy()
    for k in (0, 1):
        w, value = words["word"].to_numpy()[side == k].astype(np.int64), words["weight"].to_numpy()[side == k]
        order = np.argsort(w)
        sides.append((w[order], value[order]))
    e, f = (rows[c].to_numpy().astype(np.int64) for c in ("e", "f"))
    return WordTable(e, f, *[rows[c].to_numpy() for c in ("forward", "backward", "mass_e", "mass_f")], sides)


def _maximize(counts: DataFrame, local_pairs: int) -> Table:
    """The M-step: normalise the expected counts.  A pair stays if it has its part of either word's mass and occurs more
    often than chance, whatever its number; weights cover all words."""
    counts = cut_lineage(counts.groupBy("e", "f").agg(F.sum("c").alias("c")))
    by_e = counts.groupBy("e").agg(F.sum("c").alias("ce"))
    by_f = counts.groupBy("f").agg(F.sum("c").alias("cf"))
    total = counts.agg(F.sum("c")).first()[0] or 1.0
    rows = (
        counts.join(by_e, "e").join(by_f, "f")
        .where((F.col("c") >= LEAST_PROB * F.col("ce")) | (F.col("c") >= LEAST_PROB * F.col("cf")))
        .where(F.col("c") * F.lit(total) >= LIFT * F.col("ce") * F.col("cf"))
        .select("e", "f", (F.col("c") / F.col("ce")).alias("forward"), (F.col("c") / F.col("cf")).alias("backward"))
    )
    rows = cut_lineage(rows)
    mass_e = rows.groupBy("e").agg(F.sum("forward").alias("mass_e"))
    mass_f = rows.groupBy("f").agg(F.sum("backward").alias("mass_f"))

    def weights(side: int, own: DataFrame, word: str, c: str, mass: DataFrame, m: str) -> DataFrame:
        clear = F.when(F.col(m).isNull(), 0.1).otherwise(F.least(m, F.lit(1.0)))
        plain = F.least(F.greatest(F.log(F.lit(total) / F.col(c)) - 2.0, F.lit(0.2)), F.lit(12.0))
        return own.join(mass, word, "left").select(F.lit(side).alias("side"), F.col(word).alias("word"), (plain * clear).alias("weight"))

    words = cut_lineage(weights(0, by_e, "e", "ce", mass_e, "mass_e").unionByName(weights(1, by_f, "f", "cf", mass_f, "mass_f")))
    return Table(cut_lineage(rows.join(mass_e, "e").join(mass_f, "f")), words, local_pairs)


def _with_tables(docs: DataFrame, t: Table, fn, schema: str) -> DataFrame:
    """``fn(table)`` over the documents: the whole table where it is small; else each group of documents gets the part of
    it that its words ask for, by joins on the words."""
    if t.local is not None:
        shared = docs.sparkSession.sparkContext.broadcast(t.local)
        return docs.mapInArrow(fn(lambda: shared.value), schema)
    docs = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))
    group = F.floor(F.col("_row") / DOCS)
    docs = docs.withColumn("_group", group)
    lefts = F.flatten(F.when(F.col("flip"), F.col("words_b")).otherwise(F.col("words_a")))
    rights = F.flatten(F.when(F.col("flip"), F.col("words_a")).otherwise(F.col("words_b")))
    side = lambda k, ws: docs.select("_group", F.lit(k).alias("side"), F.explode(ws).alias("word")).distinct()
    left, right = side(0, lefts), side(1, rights)
    pairs = left.select("_group", F.col("word").alias("e")).join(t.rows, "e").join(right.select("_group", F.col("word").alias("f")), ["_group", "f"], "left_semi")
    weights = left.unionByName(right).join(t.word_weights, ["side", "word"])
    null = lambda kind: F.lit(None).cast(kind)
    cols = ("forward", "backward", "mass_e", "mass_f")
    parts = pairs.select("_group", "e", "f", *cols, null("int").alias("side"), null("double").alias("weight")).unionByName(
        weights.select("_group", F.col("word").alias("e"), null("int").alias("f"), *[null("double").alias(c) for c in cols], "side", "weight")
    )

    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def both(key, own, part):
        of_words = pc.is_valid(part["side"])
        rows, words = part.filter(pc.invert(of_words)).combine_chunks(), part.filter(of_words).combine_chunks()
        table = _word_table(rows, words.rename_columns([{"e": "word"}.get(c, c) for c in words.column_names]))
        made = list(fn(lambda: table)(own.combine_chunks().to_batches()))
        return pa.Table.from_batches(made, schema=arrow)

    parts = parts.withColumn("_part", F.col("_group") + 0).drop("_group")
    return docs.groupBy("_group").cogroup(parts.groupBy("_part")).applyInArrow(both, schema)


def fit_table(docs: DataFrame, rounds: int = ROUNDS, local_pairs: int = LOCAL_PAIRS) -> Table:
    """Estimate the table on all documents of ``sentence_pairs``."""
    picked = docs.select("flip", "words_a", "words_b")
    schema = "e int, f int, c double"
    t = _maximize(picked.mapInArrow(_expect(lambda: None), schema), local_pairs)
    for _ in range(rounds):
        t = _maximize(_with_tables(picked, t, _expect, schema), local_pairs)
    return t


def align(docs: DataFrame, t: Table) -> DataFrame:
    """(src, key_a, key_b, index_a, index_b, last_a, last_b, start_a, start_b): one row per linked pair of sentences."""
    names = ["src", "key_a", "key_b", "index_a", "index_b", "last_a", "last_b", "start_a", "start_b"]

    def fn(table_of):
        def run(batches):
            table = table_of()
            for part, left, right in _sides(batches):
                links = np.array(link(Scores(table, left, right)), dtype=np.int64).reshape(-1, 2)
                flip = part.column("flip")[0].as_py()
                a, b, ia, ib = (right, left, links[:, 1], links[:, 0]) if flip else (left, right, links[:, 0], links[:, 1])
                doc = a.doc[ia]
                starts = [part.column(c).flatten().to_numpy() for c in ("starts_a", "starts_b")]
                keys = [part.column(c).take(pa.array(doc)) for c in ("src", "key_a", "key_b")]
                ints = (a.local[ia], b.local[ib], a.count[doc] - 1, b.count[doc] - 1, starts[0][ia], starts[1][ib])
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(x.astype(np.int32)) for x in ints]], names=names)

        return run

    schema = "src string, key_a long, key_b long, index_a int, index_b int, last_a int, last_b int, start_a int, start_b int"
    return _with_tables(docs, t, fn, schema)


def chapter_pairs(chapters: DataFrame) -> DataFrame:
    """The original and human version of one run and number."""
    side = lambda kind, s: chapters.where(f"version like '%\\\\_{kind}'").select(
        "run_id", "number", F.col("chapter_id").alias(f"key_{s}"), F.coalesce("lang", F.substring("version", 1, 2)).alias(f"lang_{s}"), F.col("text").alias(f"text_{s}")
    )
    return side("original", "a").join(side("human", "b"), ["run_id", "number"]).select(
        F.lit("chapters").alias("src"), "key_a", "key_b", "lang_a", "lang_b", "text_a", "text_b"
    )


def excerpt_pairs(divergences: DataFrame) -> DataFrame:
    return divergences.where("pair = 'original_vs_human'").select(
        F.lit("divergences").alias("src"), F.col("div_id").alias("key_a"), F.col("div_id").alias("key_b"),
        F.substring("version_a", 1, 2).alias("lang_a"), F.substring("version_b", 1, 2).alias("lang_b"),
        F.col("excerpt_a").alias("text_a"), F.col("excerpt_b").alias("text_b"),
    )


def _edge(run_id, version, kind: str, words: list[str]) -> int:
    return xxhash.xxh64_intdigest(f"{run_id}\x1f{version}\x1f{kind}\x1f" + " ".join(words)) - (1 << 63)


def whole_edges(divergences: DataFrame, chapters: DataFrame, chains: ChainModel | None = None) -> DataFrame:
    """(div_id, side, kind) of the edges ('S' start, 'E' end) of excerpts that fall on a sentence's edge in the source.

    The first or last words of the excerpt are looked up among those at the edges of all sentences of its run and
    version: an equi-join of hashes, no text is compared with another.  Both are compared in their clean form.
    """
    shared = divergences.sparkSession.sparkContext.broadcast(chains)

    def of_chapter(run_id, version, text):
        text, _ = _clean(text or "", shared.value)
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", text)]
        starts = {a: k for k, (a, _, _) in enumerate(words)}
        ends = {b: k for k, (_, b, _) in enumerate(words)}
        keys = set()
        for a, b in sentence_spans(text):
            if (k := starts.get(a)) is not None:
                keys.add(_edge(run_id, version, "S", [w for _, _, w in words[k : k + EDGE]]))
            if (k := ends.get(b)) is not None:
                keys.add(_edge(run_id, version, "E", [w for _, _, w in words[max(0, k + 1 - EDGE) : k + 1]]))
        return [(k,) for k in keys]

    def of_excerpt(div_id, run_id, version_a, version_b, a, b):
        out = []
        for side, version, text in (("a", version_a, a), ("b", version_b, b)):
            words = _clean(text or "", shared.value)[0].split()
            if words:
                out.append((div_id, side, "S", _edge(run_id, version, "S", words[:EDGE])))
                out.append((div_id, side, "E", _edge(run_id, version, "E", words[-EDGE:])))
        return out

    known = flat_map(chapters.where("text is not null").select("run_id", "version", "text"), of_chapter, "h long").distinct()
    asked = flat_map(
        divergences.select("div_id", "run_id", "version_a", "version_b", "excerpt_a", "excerpt_b"), of_excerpt,
        "div_id long, side string, kind string, h long",
    )
    return asked.join(known, "h", "left_semi").select("div_id", "side", "kind").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair of sentences of original and human version that render each other."""
    chapters, divergences = table(spark, sf_dir, "chapters"), table(spark, sf_dir, "divergences")
    chains = chapter_model(spark, sf_dir)
    docs = cut_lineage(sentence_pairs(chapter_pairs(chapters).unionByName(excerpt_pairs(divergences)), chains))
    t = fit_table(docs.where("src = 'chapters'"))
    links = align(docs, t)
    edges = (
        whole_edges(divergences, chapters, chains).groupBy("div_id")
        .agg(*[F.max((F.col("side") == s) & (F.col("kind") == k)).alias(f"{k}{s}") for s in "ab" for k in "SE"])
    )
    cut = F.lit(False)
    for s in "ab":
        cut = cut | ((F.col(f"index_{s}") == 0) & ~F.coalesce(f"S{s}", F.lit(False)))
        cut = cut | ((F.col(f"index_{s}") == F.col(f"last_{s}")) & ~F.coalesce(f"E{s}", F.lit(False)))
    excerpts = links.where("src = 'divergences'").join(edges, links["key_a"] == edges["div_id"], "left").where(~cut)
    columns = ["src", "key_a", "key_b", "start_a", "start_b"]
    return links.where("src = 'chapters'").select(columns).unionByName(excerpts.select(columns))
