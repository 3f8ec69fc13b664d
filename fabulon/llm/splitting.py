"""Splitting oversized items at natural boundaries (problem 3).

Recursive bisection: an item over its limit less the overlap is cut at the strongest boundary near its middle
(paragraph, sentence, clause, word), the halves again until they fit; then every piece but the first is extended
backwards by exactly the overlap.  A cut is chosen for both places it makes: where the piece before it ends and where,
one overlap earlier, the piece after it begins.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowio import flat_map, table
from .sentences import sentence_spans

PARAGRAPH, SENTENCE, CLAUSE, WORD = 3, 2, 1, 0
_NAMES = ("word", "clause", "sentence", "paragraph")
#: Part of an item on either side of its middle in which a stronger boundary is preferred to a nearer one.
REACH = 0.25
_WORD = re.compile(r"\S+")
_CLAUSE_END = re.compile(r"[,;:—–，、；：][\"”»“’)]*\Z")


def _boundaries(text: str, words: list[tuple[int, int]]) -> list[int]:
    """Strength of the boundary before each word."""
    starts = {a for a, _ in sentence_spans(text)}
    out = [PARAGRAPH]
    for (a0, b0), (a, _) in zip(words, words[1:]):
        if text.count("\n", b0, a) > 1:
            out.append(PARAGRAPH)
        elif a in starts:
            out.append(SENTENCE)
        elif _CLAUSE_END.search(text[a0:b0]):
            out.append(CLAUSE)
        else:
            out.append(WORD)
    return out


def _bisect(strength: list[int], first: int, n: int, most: int, overlap: int) -> list[int]:
    """Ascending cuts of the words ``first`` to ``n`` into parts of at most ``most`` words."""
    cuts, todo = [], [(first, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= most:
            continue
        mid, reach = (lo + hi) / 2, max(1, int((hi - lo) * REACH))
        best, cut = None, 0
        for k in range(max(lo + 1, int(mid) - reach), min(hi - 1, int(mid) + reach) + 1):
            end, begin = strength[k], strength[k - overlap]
            score = (min(end, begin), end + begin, end, -abs(k - mid))
            if best is None or score > best:
                best, cut = score, k
        cuts.append(cut)
        todo += [(lo, cut), (cut, hi)]
    return sorted(cuts)


def check_limit(max_size: int, overlap: int) -> None:
    """Raise ValueError for an overlap that no pieces of ``max_size`` words can have."""
    if max_size < 1 or not 0 <= overlap < max_size:
        raise ValueError(f"pieces of {max_size} words can't overlap by {overlap}")


def pieces(text: str | None, max_size: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """(start, end, words, overlap words, kind of boundary) of each piece; a text within the limit is one piece.

    Every piece has at most ``max_size`` words and consecutive pieces share exactly ``overlap`` words.  Null and blank
    texts have no pieces.  An overlap that isn't smaller than the limit is an error.
    """
    check_limit(max_size, overlap)
    if not text:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    n = len(words)
    if not n:
        return []
    if n <= max_size:
        return [(words[0][0], words[-1][1], n, 0, "whole")]
    strength = _boundaries(text, words)
    # the first piece, too, holds one overlap before its own part, so all parts have the same room
    cuts = _bisect(strength, overlap, n, max_size - overlap, overlap)
    out = []
    for k, lo in enumerate([overlap, *cuts]):
        hi = cuts[k] if k < len(cuts) else n
        begin = lo - overlap
        out.append((words[begin][0], words[hi - 1][1], hi - begin, overlap if k else 0, _NAMES[strength[lo] if k else PARAGRAPH]))
    return out


def split_items(df: DataFrame, key: str, text: str, limits: list[tuple[str, int, int]]) -> DataFrame:
    """(key, limit_name, piece_no, piece_start, piece_end, n_words, overlap_words, boundary, piece) for each limit
    (name, max_size, overlap) in words.

    Null and blank texts give no row, repeated rows repeated pieces, other columns are ignored; a limit with an
    impossible overlap raises ValueError.  One narrow stage.
    """
    for _, size, overlap in limits:
        check_limit(size, overlap)
    key_type = df.schema[key].dataType.simpleString()

    def rows(k, t):
        return [
            (k, name, i, a, b, n, o, kind, t[a:b])
            for name, size, overlap in limits
            for i, (a, b, n, o, kind) in enumerate(pieces(t, size, overlap))
        ]

    return flat_map(
        df.select(df[key].alias("k"), df[text].alias("t")).where("t is not null"), rows,
        f"{key} {key_type}, limit_name string, piece_no int, piece_start int, piece_end int, n_words int, overlap_words int, boundary string, piece string",
    )


def word_limits(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, int]]:
    """The limits in words; the table is a handful of settings."""
    rows = table(spark, sf_dir, "size_limits").where("unit = 'words' and limit_name like 'chapter_piece%'").orderBy("limit_name").collect()
    return [(r["limit_name"], r["max_size"], r["overlap"]) for r in rows]


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(table(spark, sf_dir, "chapters"), "chapter_id", "text", word_limits(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that the first limit splits."""
    limits = [x for x in word_limits(spark, sf_dir) if x[0] == "chapter_piece"]
    cut = split_items(table(spark, sf_dir, "chapters"), "chapter_id", "text", limits)
    return cut.where(F.col("piece_no") == 1).select("chapter_id")
