"""The ledger as a stream: offsets are committed once, whatever is delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.runtime import Stage

_ROW = "ledger_offset long, run_branch_id string"


def committed_once(e: DataFrame, files: int = 4) -> DataFrame:
    """``ledger_offset`` and ``run_branch_id`` of a file stream of events, repeats dropped.

    The stream keeps no state: each batch is held against what earlier batches wrote,
    looked up by its own range of offsets, and written to a folder of its own number, so a
    batch that is run again writes over itself. The query runs until its input is used up;
    its checkpoint in the shared folder lets a run that was broken off go on.
    """
    spark = e.sparkSession
    stage = Stage(spark, "stream")
    out = f"{stage.path}/out"
    e.select("event", "ledger_offset", "run_branch_id").write.mode("overwrite").parquet(f"{stage.path}/in")
    spark.createDataFrame([], _ROW).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def commit(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        ends = batch.agg(F.min("ledger_offset").alias("a"), F.max("ledger_offset").alias("b")).first()
        seen = session.read.schema(f"{_ROW}, batch long").option("basePath", out).parquet(out).where(F.col("batch") < number)
        if ends["a"] is not None:
            seen = seen.where(F.col("ledger_offset").between(ends["a"], ends["b"]))
        fresh = batch.groupBy("ledger_offset").agg(F.min("run_branch_id").alias("run_branch_id"))
        fresh.join(seen.select("ledger_offset"), "ledger_offset", "left_anti").write.mode("overwrite").parquet(f"{out}/batch={number}")

    read = spark.readStream.schema(f"event string, {_ROW}").option("maxFilesPerTrigger", files).parquet(f"{stage.path}/in")
    rows = read.where((F.col("event") == "batch_committed") & F.col("ledger_offset").isNotNull()).select("ledger_offset", "run_branch_id")
    run = rows.writeStream.foreachBatch(commit).option("checkpointLocation", f"{stage.path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(f"{_ROW}, batch long").option("basePath", out).parquet(out).drop("batch")
