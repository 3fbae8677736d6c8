"""Tables written to the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session (tests) gets a folder of its own; a cluster is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        at = tempfile.mkdtemp(prefix="dealframe-ckpt-")
        atexit.register(shutil.rmtree, at, True)
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


class Written:
    """A table in the shared folder. It can be dropped early, and goes at the end of the application otherwise."""

    def __init__(self, df: DataFrame, kind: str = "parquet", by: tuple[str, ...] | list[str] = (), **options):
        """kind: the format; by: columns with few values, a folder each; options: of its writer and reader."""
        spark = df.sparkSession
        self.spark, self.path = spark, f"{shared_dir(spark)}/dealframe/{uuid.uuid4().hex}"
        df.write.format(kind).options(**options).partitionBy(*by).save(self.path)
        fs, path = self._place()
        fs.deleteOnExit(path)
        self.df = spark.read.format(kind).options(**options).schema(df.schema).load(self.path)

    def _place(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def drop(self) -> None:
        fs, path = self._place()
        fs.delete(path, True)
        fs.cancelDeleteOnExit(path)


class Scratch:
    """The written tables of one job: dropped together once its result is written."""

    def __init__(self) -> None:
        self.held: list[Written] = []

    def keep(self, df: DataFrame | Written, **options) -> DataFrame:
        """df, written (or taken over)."""
        w = df if isinstance(df, Written) else Written(df, **options)
        self.held.append(w)
        return w.df

    def settle(self, spark: SparkSession) -> None:
        """Have the shuffle files of jobs whose results are written removed now.

        Spark's cleaner acts once their plans are collected; the second pass gets what the
        first one let go, and the cleaner runs beside us.
        """
        for _ in range(2):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)

    def drop(self) -> None:
        for w in self.held:
            w.drop()
        self.held = []

    def result(self, df: DataFrame) -> DataFrame:
        """df, written; all else that was kept is dropped."""
        out = Written(df).df
        self.drop()
        return out
