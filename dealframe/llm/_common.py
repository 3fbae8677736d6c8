"""Shared pieces: tables, folds, Arrow column appending; written tables come from the core."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealframe.written import Scratch, Written, shared_dir  # noqa: F401


#: Rows of an Arrow batch at most.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on: texts are long, and a batch is held by both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def append_columns(
    df: DataFrame,
    keep: list[str],
    new: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """``keep`` of df plus ``new``, computed an Arrow batch at a time.

    ``make()`` runs once a task and returns batch -> arrays. A kept column with
    the name of a new one is dropped.
    """
    bound_batches(df.sparkSession)
    names = {n for n, _ in new}
    keep = [k for k in dict.fromkeys(keep) if k not in names]
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(n, t, True) for n, t in new])
    out = [n for n, _ in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(k)) for k in keep] + fn(b), names=keep + out)

    return df.mapInArrow(run, schema)
