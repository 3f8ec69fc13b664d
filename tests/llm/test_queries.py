"""Every query on empty tables, and on tables with rows of nulls, repeated rows and extra columns."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fabulon.llm import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = ("books", "chapters", "candidates", "divergences", "conversations", "documents", "glossary", "size_limits", "source_targets")
QUERIES = registry.queries()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        full = spark.read.parquet(f"{DATA}/{t}.parquet")
        (full if t in ("size_limits", "source_targets") else full.limit(0)).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        full = spark.read.parquet(f"{DATA}/{t}.parquet")
        if t not in ("size_limits", "glossary", "books", "source_targets"):
            # a row of nulls, repeated rows, columns named like those the operators make
            nulls = full.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in full.schema])
            full = full.unionByName(full.limit(5)).unionByName(nulls).withColumns({c: F.lit("x") for c in ("k", "t", "n_tokens", "src", "words", "share", "u", "h")})
        full.write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert rows == [] or name == "p9_shares"


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.endswith("_found") or n in ("p8_packed", "p9_shares")))
def test_odd_tables(spark, odd, name):
    got = QUERIES[name](spark, odd)
    assert got.count() > 0
    key = {"p1_found": "key_a", "p2_found": "rec_id", "p5_found": "rec_id", "p7_found": "rec_id"}.get(name)
    if key:
        assert set(got.columns) == set(QUERIES[name](spark, str(DATA)).columns)
