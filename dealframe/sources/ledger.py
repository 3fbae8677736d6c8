"""LIN files read once each: a ledger of versions, boards and rejects by chunk."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealframe.operators.relational import with_row_index
from dealframe.sources.boards import _tag, lin_call, parse_lin, tag_texts
from dealframe.written import Scratch

#: Files of one chunk: the names of so many are on the driver at a time.
FILES = 20_000

LEDGER = "path string, length long, modified timestamp, digest string, chunk string, run long, boards long, rejected long"
RUNS = "run long, files long, new_files long, skipped_files long, boards long, rejected long"


def _text(content: Column) -> Column:
    """UTF-8 where it is that, and Latin-1 otherwise."""
    t = content.cast("string")
    return F.when(F.is_valid_utf8(t), t).otherwise(F.decode(content, "ISO-8859-1"))


def lin_records(files: DataFrame, value: str = "value") -> DataFrame:
    """files (..., value) with one row a record: record (from 1) and its text. A file's boards start at ``qx``.

    What stands before the first board (names, scores) is no record; a file without a deal is one.
    """
    parts = F.split(F.col(value), r"(?=(?<![^|\s])qx\|)", -1)
    deals = F.filter(parts, lambda p: p.contains("md|"))
    told = F.when(F.size(deals) > 0, deals).otherwise(F.array(F.coalesce(F.col(value), F.lit(""))))
    rows = files.select(*[c for c in files.columns if c != value], F.posexplode(told).alias("_n", "text"))
    return rows.withColumn("record", F.col("_n") + 1).drop("_n")


def _calls(text: Column) -> Column:
    each = F.transform(tag_texts(text, "mb"), lambda x: F.struct(F.substring_index(x, "|", 1).alias("said"), x.alias("x")))
    # A call's text is taken apart once; an announcement stands right after it.
    after = lambda e, start: F.substring(e["x"], F.length(e["said"]) + start, F.length(e["x"]))
    each = F.transform(
        each,
        lambda e: F.struct(
            lin_call(F.replace(e["said"], F.lit("!"), F.lit(""))).alias("call"),
            e["said"].contains("!").alias("alert"),
            F.when(after(e, 1).startswith("|an|"), F.nullif(F.substring_index(after(e, 5), "|", 1), F.lit(""))).alias("announcement"),
        ),
    )
    each = F.filter(each, lambda x: x["call"].isNotNull())
    return F.transform(each, lambda x, i: F.struct((i + 1).alias("ordinal"), x["call"].alias("call"), x["alert"].alias("alert"), x["announcement"].alias("announcement")))


def _plays(text: Column) -> Column:
    cards = F.transform(tag_texts(text, "pc"), lambda x: F.substring_index(x, "|", 1))
    cards = F.filter(F.transform(cards, lambda c: F.regexp_replace(F.upper(F.trim(c)), "10$", "T")), lambda c: c.rlike("^[SHDC][AKQJT2-9]$"))
    return F.transform(cards, lambda c, i: F.struct((i + 1).alias("ordinal"), (F.floor(i / 4) + 1).cast("int").alias("trick"), c.alias("card")))


def read_records(records: DataFrame) -> DataFrame:
    """Records (..., text) parsed: the columns of ``parse_lin``, players, calls and plays as arrays of structs, claim, and reason.

    reason: why a record is no board (no deal, no dealer, cards, no vulnerability; the first that holds), null for a board.
    """
    out = parse_lin(records.withColumn("_v", F.col("text")), "_v")
    hands = [F.col(f"Hand_{d}") for d in "NESW"]
    cards = F.lit(True)
    for h in hands:
        cards = cards & (F.length(h) == 16)
    t = F.col("text")
    # Without its dealer's digit a deal's first letter is lost, so the dealer is asked for before the cards.
    reason = F.when(~F.coalesce(t.contains("md|"), F.lit(False)), "no deal").when(F.coalesce("dealer", F.lit("")) == "", "no dealer").when(~cards, "cards").when(F.col("vul").isNull(), "no vulnerability")
    players = F.when(_tag(t, "pn") != "", F.split(_tag(t, "pn"), ",", -1))
    return out.select("*", players.alias("players"), _calls(t).alias("calls"), _plays(t).alias("plays"), _tag(t, "mc").try_cast("int").alias("claim"), reason.alias("reason"))


class LinStore:
    """Boards of LIN files in a folder: tables boards, rejects, ledger and runs.

    A file's version is its path, length, time and SHA-256. Versions that the ledger has
    by path, length and time aren't opened; one whose bytes it has at that path (touched,
    or put back) is noted and not parsed. A changed file's new boards take the place of
    its old ones; those of a file that is gone stay. New files are taken in chunks of
    ``files``: a chunk's boards and rejects are written, then its rows of the ledger, and
    boards count only through the ledger, so a run that died is simply run again. One run
    at a time. Files of no bytes hold nothing and aren't seen; Spark lists none of them.
    """

    def __init__(self, spark: SparkSession, path: str, files: int = FILES) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), files

    def _has(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._has(name) else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def runs(self) -> DataFrame:
        """One row a run: files seen, new or changed ones, those skipped, boards and rejected records."""
        return self._read("runs", RUNS)

    def _current(self, name: str) -> DataFrame:
        last = Window.partitionBy("path").orderBy(F.desc("run"), F.desc("modified"))
        now = self.ledger().withColumn("_r", F.row_number().over(last)).where("_r = 1").select("path", "chunk")
        if not self._has(name):
            empty = self.spark.createDataFrame([], "path string, digest string, text string, record int, chunk string")
            return read_records(empty).drop("reason" if name == "boards" else "")
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{name}").join(now, ["path", "chunk"])

    def boards(self) -> DataFrame:
        """Boards of the files' newest versions; columns that only some chunks have are null in the others."""
        return self._current("boards")

    def rejects(self) -> DataFrame:
        """Records that are no boards, with their text and the reason."""
        return self._current("rejects")

    def ingest(self, source: str, glob: str = "*.lin") -> int:
        """Read what is new below ``source``; the run's number."""
        run = (self.runs().agg(F.max("run")).first()[0] or 0) + 1
        tmp = Scratch()
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(source)
        listed = tmp.keep(listed.select("path", "length", F.col("modificationTime").alias("modified")))
        known = self.ledger().select("path", "length", "modified").distinct()
        todo = tmp.keep(with_row_index(listed.join(known, ["path", "length", "modified"], "left_anti"), ["path"], "_n"))
        for start in range(0, todo.count(), self.files):
            self._chunk([r["path"] for r in todo.where(F.col("_n").between(start, start + self.files - 1)).select("path").collect()], run)
        own = self.ledger().where(F.col("run") == run).agg(
            F.count(F.when(F.col("boards").isNotNull(), 1)).alias("new_files"), F.coalesce(F.sum("boards"), F.lit(0)).alias("boards"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected")
        )
        note = listed.agg(F.count("*").alias("files")).join(F.broadcast(own)).select(F.lit(run).cast("long").alias("run"), "files", "new_files", (F.col("files") - F.col("new_files")).alias("skipped_files"), "boards", "rejected")
        note.coalesce(1).write.mode("append").parquet(f"{self.path}/runs")
        tmp.drop()
        return run

    def _opened(self, paths: list[str]) -> DataFrame:
        """Files by their names, looked up in as many tasks as a shuffle has: Spark's default is a task a name."""
        name, conf = "spark.sql.sources.parallelPartitionDiscovery.parallelism", self.spark.conf
        had = conf.get(name, None)
        conf.set(name, conf.get("spark.sql.shuffle.partitions"))
        try:
            return self.spark.read.format("binaryFile").load(paths)
        finally:
            conf.unset(name) if had is None else conf.set(name, had)

    def _chunk(self, paths: list[str], run: int) -> None:
        tmp, chunk = Scratch(), f"{run:06d}-{uuid.uuid4().hex}"
        raw = self._opened(paths)
        raw = tmp.keep(raw.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"), _text(F.col("content")).alias("value")))
        had = self.ledger().select("path", "digest", F.col("chunk").alias("_chunk")).dropDuplicates(["path", "digest"])
        facts = raw.select("path", "length", "modified", "digest").join(had, ["path", "digest"], "left")
        # Dealt out: what a task reads of the few files of a table says nothing of the records in it.
        fresh = raw.join(had, ["path", "digest"], "left_anti").select("path", "digest", "value").repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "path")
        read = tmp.keep(read_records(lin_records(fresh)).withColumn("chunk", F.lit(chunk)))
        read.where("reason is null").drop("reason", "text").write.mode("append").partitionBy("chunk").option("compression", "zstd").parquet(f"{self.path}/boards")
        read.where("reason is not null").select("path", "digest", "record", "text", "reason", "chunk").write.mode("append").partitionBy("chunk").option("compression", "zstd").parquet(f"{self.path}/rejects")
        counts = read.groupBy("path").agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("boards"), F.count("reason").alias("rejected"))
        new = F.col("_chunk").isNull()
        rows = facts.join(counts, "path", "left").select(
            "path",
            "length",
            "modified",
            "digest",
            F.coalesce("_chunk", F.lit(chunk)).alias("chunk"),
            F.lit(run).cast("long").alias("run"),
            F.when(new, F.coalesce("boards", F.lit(0))).alias("boards"),
            F.when(new, F.coalesce("rejected", F.lit(0))).alias("rejected"),
        )
        rows.write.mode("append").parquet(f"{self.path}/ledger")
        tmp.drop()
