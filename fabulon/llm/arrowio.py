"""Arrow plumbing shared by the text operators.

Every operator is a narrow ``mapInArrow`` over (keys, text): one pass, no shuffle, rows of a batch at a time.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows and characters of strings that an output batch holds before it is handed on.
OUT_ROWS, OUT_CHARS = 20_000, 4_000_000


def flat_map(df: DataFrame, fn, schema: str, setup=None) -> DataFrame:
    """Rows ``fn(*row)`` yields for each input row; ``setup()`` runs once per task and is passed first when given.

    Output leaves in batches of bounded size, whatever the number of rows an input row gives.
    """
    spark_schema = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema, timestamp_utc=True)
    strings = [i for i, f in enumerate(spark_schema.fields) if isinstance(f.dataType, T.StringType)]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches):
        state = (setup(),) if setup else ()
        rows, chars = [], 0
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols):
                for out in fn(*state, *row):
                    rows.append(out)
                    for i in strings:
                        chars += len(out[i] or "")
                    if len(rows) >= OUT_ROWS or chars >= OUT_CHARS:
                        yield pack(rows)
                        rows, chars = [], 0
        if rows:
            yield pack(rows)

    return df.mapInArrow(run, spark_schema)


def batch_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(lists of column values) -> lists of output columns`` for each batch."""
    spark_schema = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema, timestamp_utc=True)

    def run(batches):
        for batch in batches:
            out = fn(*[c.to_pylist() for c in batch.columns])
            arrays = [pa.array(c, type=f.type) for c, f in zip(out, arrow)]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, spark_schema)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``.

    Only a session within one JVM (tests) may go without: it gets a folder of its own, removed at exit.  On a cluster a
    missing setting is an error, as executors elsewhere couldn't read a local folder.  Checkpoints are removed once
    their DataFrame is gone.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="fabulon-ckpt-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    conf = sc._jsc.sc().conf()
    if not conf.contains("spark.cleaner.referenceTracking.cleanCheckpoints"):
        conf.set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, so lost executors cost no recomputation of Python stages."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank(col) -> F.Column:
    """True for null and for text of white space only (all Unicode kinds)."""
    return F.coalesce(~F.expr(f"{col} rlike '(?U)\\\\S'"), F.lit(True))
