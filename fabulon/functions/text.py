"""Text expressions: all JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import EXCERPT_CHARS

#: White space as Python's str.split sees it: all Unicode kinds and the four separators.
WHITE = r"[\s\u0085   -     　\x1c-\x1f]"


def words(text: Column | str) -> Column:
    """Words between white space of any kind; null for null."""
    return F.filter(F.split(text, WHITE + "+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def lexicon_tokens(text: Column | str) -> Column:
    """Runs of a-z and à-ÿ in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ]+"), F.lit(0))


def strip_boilerplate(text: Column) -> Column:
    """Body between the first START line and the first END marker, trimmed; unchanged unless both markers occur.

    A text whose END stands before its START has no body.
    """
    start, end = r"(?imd)^\*\*\*\s*START OF", r"(?imd)^\*\*\*\s*END OF"
    body = F.regexp_extract(text, r"(?imds)\A(?:(?!^\*\*\*\s*END OF).)*?^\*\*\*\s*START OF[^\n]*\n(.*?)^\*\*\*\s*END OF", 1)
    return F.when(text.rlike(start) & text.rlike(end), F.regexp_replace(body, rf"\A{WHITE}+|{WHITE}+\z", "")).otherwise(text)


def excerpt(words_: Column, start: Column, length: Column | int, chars: int = EXCERPT_CHARS) -> Column:
    """The first ``chars`` characters of ``length`` words from the 0-based ``start``."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.substring(F.array_join(F.slice(words_, (start + 1).cast("int"), length.cast("int")), " "), 1, chars)


def judge_score(reply: Column | str) -> Column:
    """First number of a reply, clamped to -10..10 and scaled to -1..1; 0 if there is none."""
    number = F.nullif(F.regexp_extract(reply, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")
    # greatest and least would skip a null
    return F.when(number.isNull(), 0.0).otherwise(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), number)) / 10.0)


def role_of(version: Column) -> Column:
    """original, human or llm; llm versions have an open suffix."""
    return (
        F.when(version.rlike("^[a-z]{2}_original$"), "original").when(version.rlike("^[a-z]{2}_human$"), "human")
        .when(version.rlike("^[a-z]{2}_llm"), "llm")
    )


def decode_bytes(content: Column) -> Column:
    """UTF-8 where it is valid, else ISO-8859-1 (which never fails)."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
