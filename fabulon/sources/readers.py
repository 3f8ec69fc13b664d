"""Sources: raw texts, chapter and score documents, lexicons; keys come from the file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import decode_bytes, strip_boilerplate
from ..settings import METHOD_SUFFIXES, METRICS

CHAPTER_DOC = """
    title STRING, author STRING, language STRING, source_language STRING, direction STRING, model STRING, gutenberg_id INT,
    pattern_used STRING, n_chapters INT, chapters ARRAY<STRUCT<number: INT, heading: STRING, title: STRING, text: STRING,
    char_count: INT, word_count: INT, input_tokens: BIGINT, output_tokens: BIGINT, timestamp: STRING,
    bon_metadata: STRUCT<selected_correlation: DOUBLE, selection_diff: DOUBLE>>>
"""
SCORE_DOC = "title STRING, version STRING, method STRING, scores ARRAY<DOUBLE>, n_chapters INT, n_windows INT, window_words INT, total_words INT"


def file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[A-Za-z]+)?$", 1)


def raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """(gutenberg_id, text): one file per text, decoded as UTF-8 or ISO-8859-1, line ends unified, boilerplate stripped."""
    files = spark.read.format("binaryFile").load(path).select(file_stem().alias("stem"), decode_bytes(F.col("content")).alias("t"))
    text = strip_boilerplate(F.regexp_replace("t", "\r\n?", "\n"))
    return files.select(F.regexp_extract("stem", r"^(\d+)", 1).try_cast("int").alias("gutenberg_id"), text.alias("text"))


def wanted_texts(books: DataFrame) -> DataFrame:
    """(slug, gutenberg_id, lang) of all texts of the registry."""
    fr = books.select("slug", F.explode("fr_ids").alias("gutenberg_id"), F.lit("fr").alias("lang"))
    en = books.select("slug", F.col("en_id").alias("gutenberg_id"), F.lit("en").alias("lang"))
    return fr.unionByName(en).where("gutenberg_id is not null")


def missing_texts(books: DataFrame, cached: DataFrame) -> DataFrame:
    """Texts of the registry that aren't cached yet."""
    return wanted_texts(books).join(cached.select("gutenberg_id").distinct(), "gutenberg_id", "left_anti")


def book_texts(books: DataFrame, raw: DataFrame) -> DataFrame:
    """(slug, lang, text, expected_chapters, titles): the first French text and the English one of each book."""
    base = books.select("slug", "expected_chapters", "en_chapter_titles", F.get("fr_ids", 0).alias("fr"), F.col("en_id").alias("en"))
    long = base.select(
        "slug", "expected_chapters",
        F.explode(F.array(F.struct(F.lit("fr").alias("lang"), F.col("fr").alias("id"), F.lit(None).cast("array<string>").alias("titles")),
                          F.struct(F.lit("en").alias("lang"), F.col("en").alias("id"), F.col("en_chapter_titles").alias("titles")))).alias("x"),
    )
    picked = long.select("slug", "expected_chapters", "x.lang", F.col("x.id").alias("gutenberg_id"), "x.titles")
    return picked.join(raw, "gutenberg_id").select("slug", "lang", "text", "expected_chapters", "titles")


def chapter_docs(spark: SparkSession, path: str) -> DataFrame:
    """(slug, version, lang, number, heading, title, text, ..): chapters of JSON documents, unfinished ones (null) left
    out; slug and version are the file's name."""
    docs = spark.read.schema(CHAPTER_DOC).json(path, multiLine=True, mode="FAILFAST").withColumn("stem", file_stem())
    version = F.regexp_extract("stem", r"_((?:[a-z]{2}_)?(?:original|human|llm\w*)|[a-z]{2})$", 1)
    rows = docs.select("stem", version.alias("version"), F.col("language").alias("lang"), "model", F.posexplode("chapters").alias("pos", "c"))
    return rows.where("c is not null").select(
        F.expr("substring(stem, 1, length(stem) - length(version) - 1)").alias("slug"), "version", "lang", "model", (F.col("pos") + 1).alias("position"), "c.*"
    )


def full_texts(chapters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, full_text): non-null chapters of a text in order, joined by blank lines.  A group is one text."""
    ordered = F.array_sort(F.collect_list(F.struct("number", "chapter_id", F.coalesce("text", F.lit("")).alias("t"))))
    return chapters.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda c: c["t"]), "\n\n").alias("full_text"))


def score_docs(spark: SparkSession, path: str) -> DataFrame:
    """(slug, version, method, scores, window and word counts): keys from the file name, as the payload may disagree."""
    docs = spark.read.schema(SCORE_DOC).json(path, multiLine=True, mode="DROPMALFORMED").withColumn("stem", file_stem())
    method = F.regexp_extract("stem", f"_({'|'.join(METHOD_SUFFIXES)})$", 1)
    rest = F.expr("substring(stem, 1, length(stem) - length(m) - 1)")
    version = F.regexp_extract("rest", r"_((?:en|fr)_(?:original|human|llm\w*|[a-z]+))$", 1)
    keyed = docs.withColumn("m", method).withColumn("rest", rest).withColumn("v", version).where("m <> '' and v <> ''")
    return keyed.select(
        F.expr("substring(rest, 1, length(rest) - length(v) - 1)").alias("slug"), F.col("v").alias("version"), F.col("m").alias("method"),
        "scores", "n_chapters", "n_windows", "window_words", "total_words",
    )


def methods(docs: DataFrame) -> DataFrame:
    return docs.select("method").where("method is not null").distinct().orderBy("method")


def lexicon_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("happs", T.DoubleType())])
    return spark.read.schema(schema).csv(path, header=True).withColumn("ord", F.monotonically_increasing_id())


def saved_results(spark: SparkSession, path: str) -> DataFrame:
    """Metrics that ``writers.results_csv`` has saved; undefined values come back as null."""
    schema = "slug string, method string, pair string, normalization string, " + ", ".join(f"{m} double" for m in METRICS)
    return spark.read.csv(path, header=True, schema=schema, nullValue="nan", enforceSchema=True)


def work_filter(books: DataFrame, names: list[str]) -> DataFrame:
    """Books by title or slug, whatever case and outer blanks; unknown names match nothing."""
    wanted = [n.strip().lower() for n in names]
    return books.where(F.lower("title").isin(wanted) | F.lower("slug").isin(wanted))
