"""Reading and writing: Parquet, JSON lines, gzip, one-row documents, versioned ledgers, templates."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.operators.cleaning import budget_prefix, running

LEDGER = "event string, ledger_offset long, run_branch_id string, global_step long, checkpoint_id string, shard_ids array<string>, token_span_ids array<string>, seq_len int, loss_mask_hash string"


def corpus(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """A Parquet corpus; only the named columns are read."""
    return spark.read.parquet(path).select(*columns)


def json_lines(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """JSON lines, plain or gzip, under a declared schema; blank lines are skipped.

    A gzip file cannot be split, so its rows are spread before further work.
    """
    read = spark.read.schema(schema).json(path)
    return read.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else read


def append_events(events: DataFrame, path: str) -> None:
    """Events added to a ledger of JSON lines."""
    events.write.mode("append").json(path)


def write_document(row: DataFrame, path: str) -> None:
    """One row (a manifest, a report) as one JSON document."""
    row.limit(1).coalesce(1).write.mode("overwrite").json(path)


def within_budget(docs: DataFrame, order: str, tokens: str, budget: int) -> DataFrame:
    """The rows a streaming source would have taken before its token budget was spent."""
    return docs.join(budget_prefix(docs.select(order, tokens), order, tokens, budget).select(order), order, "left_semi")


class VersionedLedger:
    """A ledger in numbered folders on any store that Hadoop reaches: rollback writes a new version, readers see whole ones.

    A version counts once its writer has put its success mark, so a rollback that is broken
    off leaves the version before it in force.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.mkdirs(self.root)

    def _version(self) -> int | None:
        """The last version that was written to its end, None before the first."""
        names = [f.getPath().getName() for f in self.files.listStatus(self.root)]
        whole = [n for n in names if n.startswith("v") and n[1:].isdigit() and self.files.exists(self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max((int(n[1:]) for n in whole), default=None)

    def read(self) -> DataFrame:
        at = self._version()
        return self.spark.createDataFrame([], LEDGER) if at is None else self.spark.read.schema(LEDGER).json(f"{self.path}/v{at}")

    def append(self, events: DataFrame) -> None:
        append_events(events, f"{self.path}/v{self._version() or 0}")

    def truncate_after(self, offset: int) -> int:
        """Keep events up to ``offset`` and those without one; returns how many were dropped."""
        now = self.read()
        n = now.count()
        version = (self._version() or 0) + 1
        now.where(F.coalesce("ledger_offset", F.lit(-1)) <= offset).write.mode("overwrite").json(f"{self.path}/v{version}")
        return n - self.read().count()


def append_checkpoints(index: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Checkpoints with an ``index_position`` of their own each, going on from the index's last, by offset and then branch."""
    last = index.agg(F.coalesce(F.max("index_position"), F.lit(-1)).alias("m")) if index is not None else fresh.sparkSession.range(1).select(F.lit(-1).cast("long").alias("m"))
    per = fresh.groupBy("ledger_offset").agg(F.count(F.lit(1)).alias("k"))
    starts = running(per, "ledger_offset", "k").select("ledger_offset", "before")
    inside = F.row_number().over(Window.partitionBy("ledger_offset").orderBy("run_branch_id", "checkpoint_id"))
    numbered = fresh.withColumn("n", inside).join(starts, "ledger_offset")
    added = numbered.join(F.broadcast(last)).withColumn("index_position", F.col("m") + F.col("before") + F.col("n")).drop("m", "n", "before")
    return added.select(*fresh.columns, "index_position") if index is None else index.unionByName(added.select(*fresh.columns, "index_position"))


def write_corpus(docs: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """A corpus as Parquet, in folders by the columns named."""
    docs.write.mode("overwrite").partitionBy(*by).parquet(path) if by else docs.write.mode("overwrite").parquet(path)


def fill_template(template: str, data: dict, mark: str = "__DATA__") -> str:
    """JSON put in a page; an end tag inside it cannot close the page's script. Fails without its mark."""
    if mark not in template:
        raise ValueError(f"no {mark} in the template")
    return template.replace(mark, json.dumps(data, allow_nan=False).replace("</", "<\\/"))


def file_hash(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()
