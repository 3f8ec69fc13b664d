"""Chapter segmentation of raw texts by heading patterns: column expressions only, one narrow stage in the JVM.

Offsets come from what lies between the matches: a text split at a pattern has one piece before each match, so running
sums of the lengths of pieces and matches give all places at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import let
from ..functions.text import WHITE, word_count
from ..settings import EXPLICIT_LABEL, HEADINGS, TITLE_CHARS, TOC_GAP

#: A line: its beginning with white space before it, its end with white space after it.
_LINE, _NARROW, _END = r"(?md)^\s*", r"(?md)^\s{0,4}", r"\s*$"


def line_pattern(label: str, body: str) -> str:
    """The pattern of a heading line; numerals alone stand at most four blanks in, other headings may follow blank lines."""
    return (_NARROW if label.startswith("Roman") else _LINE) + f"(?:{body})" + _END


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WHITE}+|{WHITE}+\z", "")


def match_starts(text: Column, pattern: Column) -> Column:
    """0-based offsets of the matches of ``pattern`` in ``text``."""
    lengths = lambda a: F.transform(a, F.char_length)
    gaps, found = lengths(F.split(text, pattern, -1)), lengths(F.regexp_extract_all(text, pattern, F.lit(0)))

    def starts(gaps, found):
        # as many pieces before the k-th match as matches before it, and one more
        total = lambda a, k: F.aggregate(F.slice(a, 1, k), F.lit(0), lambda acc, x: acc + x)
        return F.transform(found, lambda _, k: total(gaps, k + 1) + total(found, k))

    return let(gaps, lambda g: let(found, lambda f: starts(g, f)))


def _body_starts(text: Column, starts: Column) -> Column:
    """Headings that have more than ``TOC_GAP`` characters up to the next one; the others are lines of a table of contents."""
    following = lambda k: F.coalesce(F.get(starts, k + 1), F.char_length(text))
    return F.filter(starts, lambda s, k: following(k) - s > TOC_GAP)


def boundaries(text: Column, lang: Column, expected: Column, titles: Column) -> Column:
    """(label, offsets) of the first pattern of the language whose headings are as many as expected, else of the explicit
    titles; null if neither fits.

    Counts within 3 or a fifth of the expected number are accepted, any of at least 2 where none is expected.  Of a
    title's lines the last one counts, at least two titles must be found.
    """

    def plausible(n):
        off = F.abs(n - expected)
        return (n >= 2) & (expected.isNull() | (off <= 3) | (off <= F.lit(0.2) * expected))

    def attempt(rows):
        # a later pattern is looked for only where no earlier one fits
        out = F.lit(None).cast("struct<label:string,offsets:array<int>>")
        for label, body in reversed(rows):
            starts = let(match_starts(text, F.lit(line_pattern(label, body))), lambda s: _body_starts(text, s))
            rest = out
            out = let(starts, lambda s: F.when(plausible(F.size(s)), F.struct(F.lit(label).alias("label"), s.alias("offsets"))).otherwise(rest))  # noqa: B023
        return out

    def last_line(title):
        pattern = F.concat(F.lit(_LINE + r"\Q"), title, F.lit(r"\E" + _END))
        return F.try_element_at(match_starts(text, pattern), F.lit(-1))

    named = F.array_sort(F.filter(F.transform(F.coalesce(titles, F.array().cast("array<string>")), last_line), lambda x: x.isNotNull()))
    explicit = let(named, lambda s: F.when(F.size(s) >= 2, F.struct(F.lit(EXPLICIT_LABEL).alias("label"), s.alias("offsets"))))
    fits = F.when(lang == "fr", attempt(HEADINGS["fr"])).otherwise(attempt(HEADINGS["en"]))
    return let(fits, lambda x: F.when(x.isNotNull(), x).otherwise(explicit))


def parts_of(chunk: Column) -> Column:
    """(heading, title, text) of a chapter's lines: the first one, the first visible one after it if it is short, the rest."""
    heading, after = F.regexp_extract(chunk, r"\A[^\n]*", 0), F.regexp_replace(chunk, r"\A[^\n]*\n?", "")
    first = rf"\A{WHITE}*(?!{WHITE})[^\n]+"

    def split_title(rest):
        line = _strip(F.regexp_extract(rest, first, 0))
        short = (line != "") & (F.char_length(line) < TITLE_CHARS)
        body = F.when(short, F.regexp_replace(rest, first, "")).otherwise(rest)
        return F.struct(_strip(heading).alias("heading"), F.when(short, line).otherwise("").alias("title"), _strip(body).alias("text"))

    return let(after, split_title)


def segment(raw: DataFrame, keys: list[str]) -> DataFrame:
    """One row per chapter of (keys, lang, text, expected_chapters, titles): (keys, lang, pattern_used, number, offset,
    heading, title, text, char_count, word_count).

    Texts in which no pattern is accepted give no rows, as do null ones.  A text is a row, so the stage is narrow and
    the longest text bounds a task; offsets count code points.
    """
    text = F.col("_t")
    found = raw.select(*keys, "lang", F.col("text").alias("_t"), boundaries(F.col("text"), F.col("lang"), F.col("expected_chapters"), F.col("titles")).alias("_b"))
    rows = found.where("_b is not null").select(*keys, "lang", "_t", "_b", F.posexplode("_b.offsets").alias("_k", "offset"))
    end = F.coalesce(F.get("_b.offsets", F.col("_k") + 1), F.char_length(text))
    rows = rows.select(*keys, "lang", F.col("_b.label").alias("pattern_used"), (F.col("_k") + 1).alias("number"), "offset", parts_of(F.substring(text, F.col("offset") + 1, end - F.col("offset"))).alias("_p"))
    return rows.select(
        *keys, "lang", "pattern_used", "number", "offset", "_p.heading", "_p.title", "_p.text", F.char_length("_p.text").alias("char_count"),
        word_count(F.col("_p.text")).alias("word_count"),
    )


def validate_counts(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(slug, title, expected_chapters, fr, en, status): chapters per language against the registry; status is 'ok' if
    both equal the expectation, 'missing' if a language has none, else 'differs'."""
    counts = chapters.groupBy("slug").pivot("lang", ["fr", "en"]).agg(F.countDistinct("number"))
    status = (
        F.when(F.col("fr").isNull() | F.col("en").isNull(), "missing")
        .when((F.col("fr") == F.col("en")) & (F.col("en") == F.col("expected_chapters")), "ok").otherwise("differs")
    )
    return books.select("slug", "title", "expected_chapters").join(counts, "slug", "left").select(
        "slug", "title", F.col("expected_chapters").cast("long").alias("expected_chapters"),
        F.coalesce("fr", F.lit(0)).alias("fr"), F.coalesce("en", F.lit(0)).alias("en"), status.alias("status"),
    )
