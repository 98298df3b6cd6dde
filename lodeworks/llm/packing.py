"""Placing documents in containers of fixed capacity, splitting only those above it.

Sum-of-squares packing: each document goes, in order of arrival, to the fill level that
leaves the least sum of squared counts of partly filled containers, kept in an array by
level (a filled container no longer counts; ties go to the fullest level). A document
above the capacity gives full containers of its own and a rest that is packed like any
other. A lane is cut by a hash of the id into chunks of bounded size that are packed
apart; the documents of the containers that stay partly filled are then placed once more
across chunks, largest first, each into the container that it leaves the least room in.

Documents of no tokens (null and empty texts) need no room: they come out without a
container. Lanes without a policy, and documents without a lane, form groups of their own
at the default capacity. Documents are told apart by row, so repeated ids are packed
once per row, numbered in ``copy``. Columns not named are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm import encoding
from lodeworks.runtime import Stage

DEFAULT_CAPACITY = 1024
#: Documents that one task packs, and containers that one task combines, about.
CHUNK = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container of each size, in the order given, and the fill of each container."""
    count = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    at, fills = np.empty(len(sizes), np.int64), []
    for i, size in enumerate(sizes.tolist()):
        to = count[size:]
        grown = 2 * to + 1
        grown[-1] = 0  # filled up: no longer counted
        cost = grown + np.where(count[: capacity + 1 - size] > 0, 1 - 2 * count[: capacity + 1 - size], 1 << 40)
        cost[0] = grown[0]  # a new container
        level = len(cost) - 1 - int(np.argmin(cost[::-1]))
        if level:
            box = open_[level].pop()
            count[level] -= 1
        else:
            box = len(fills)
            fills.append(0)
        fills[box] = full = level + size
        if full < capacity:
            open_[full].append(box)
            count[full] += 1
        at[i] = box
    return at, np.array(fills, np.int64)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each size, the largest placed first, each where the least room remains."""
    at = np.empty(len(sizes), np.int64)
    rooms: list[tuple[int, int]] = []
    boxes = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect.bisect_left(rooms, (size, -1))
        if k < len(rooms):
            room, box = rooms.pop(k)
        else:
            room, box, boxes = capacity, boxes, boxes + 1
        at[i] = box
        bisect.insort(rooms, (room - size, box))
    return at


_PLACED = "lane string, capacity int, id string, copy long, piece int, start long, n_tokens long, chunk long, box long, fill long"


def _place(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["id", "copy"], kind="stable", ignore_index=True)
    box, fills = sum_of_squares(pdf["n_tokens"].to_numpy(), int(pdf["capacity"].iloc[0]))
    return pdf.assign(box=box, fill=fills[box])


def _again(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["id", "copy"], kind="stable", ignore_index=True)
    return pdf.assign(box=best_fit_decreasing(pdf["n_tokens"].to_numpy(), int(pdf["capacity"].iloc[0])))


def packed(df: DataFrame, policy: DataFrame, id: str = "doc_id", text: str = "text", lane: str = "lane", default: int = DEFAULT_CAPACITY, chunk: int = CHUNK, **kw) -> DataFrame:
    """A row per document or piece: ``lane``, ``id``, ``copy``, ``piece``, ``start``, ``n_tokens``, ``capacity``, ``container``."""
    stage = Stage(df.sparkSession, "packing")
    kind = df.schema[id].dataType.simpleString()
    sized = stage.keep(encoding.token_counts(df, {"id": f"cast(`{id}` as string)", "lane": f"`{lane}`"}, text, **kw), "sized")
    caps = policy.groupBy("lane").agg(F.max("seq_len").alias("capacity")).where("capacity > 0")
    rows = sized.join(caps, "lane", "left").withColumn("capacity", F.coalesce("capacity", F.lit(default)).cast("int"))
    per_lane = sized.groupBy("lane").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("chunks"))
    rows = rows.join(per_lane.withColumnRenamed("lane", "its"), F.col("lane").eqNullSafe(F.col("its"))).drop("its")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("id", "lane").orderBy("n_tokens")).cast("long") - 1)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "copy"), F.col("chunks"))).drop("chunks")
    whole = F.floor(F.col("n_tokens") / F.col("capacity")).cast("int")
    pieces = rows.withColumn("whole", whole).withColumn("rest", F.col("n_tokens") - F.col("whole") * F.col("capacity"))
    full = pieces.where("whole > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).select(
        "lane", "capacity", "id", "copy", "piece", (F.col("piece").cast("long") * F.col("capacity")).alias("start"), F.col("capacity").cast("long").alias("n_tokens"),
        F.concat_ws("-", F.coalesce("lane", F.lit("(none)")), F.lit("whole"), "id", "copy", "piece").alias("container"),
    )
    loose = pieces.where("rest > 0").select(
        "lane", "capacity", "id", "copy", F.col("whole").alias("piece"), (F.col("whole").cast("long") * F.col("capacity")).alias("start"), F.col("rest").alias("n_tokens"), "chunk"
    )
    # As many partitions as groups, stated, so that small groups of much work are not run one after the other in one task.
    groups = int(per_lane.agg(F.sum("chunks")).first()[0] or 1)
    placed = stage.keep(loose.repartition(2 * groups, "lane", "chunk").groupBy("lane", "chunk").applyInPandas(_place, _PLACED), "placed")
    partly = placed.where("fill < capacity").drop("fill", "box", "chunk")
    left = partly.groupBy("lane").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("groups")).withColumnRenamed("lane", "its")
    grouped = partly.join(left, F.col("lane").eqNullSafe(F.col("its"))).withColumn("chunk", F.pmod(F.xxhash64("id", "copy", F.lit("again")), F.col("groups"))).drop("its", "groups")
    again = grouped.repartition(2 * groups, "lane", "chunk").groupBy("lane", "chunk").applyInPandas(_again, _PLACED.replace(", fill long", ""))
    label = lambda round_: F.concat_ws("-", F.coalesce("lane", F.lit("(none)")), F.lit(round_), "chunk", "box").alias("container")
    kept = ["lane", "capacity", "id", "copy", "piece", "start", "n_tokens"]
    ended = placed.where("fill = capacity").select(*kept, label("a")).unionByName(again.select(*kept, label("b")))
    nothing = rows.where("n_tokens = 0").select("lane", "capacity", "id", "copy", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "n_tokens", F.lit(None).cast("string").alias("container"))
    out = full.unionByName(ended).unionByName(nothing)
    return out.select("lane", F.col("id").cast(kind).alias(id), "copy", "piece", "start", "n_tokens", "capacity", "container")


def containers(placed: DataFrame) -> DataFrame:
    """``container``, ``lane``, ``capacity``, ``fill``, ``n_pieces`` and ``unused`` of each container."""
    return placed.where("container is not null").groupBy("container").agg(
        F.first("lane").alias("lane"), F.max("capacity").alias("capacity"), F.sum("n_tokens").alias("fill"), F.count(F.lit(1)).alias("n_pieces"),
        (F.max("capacity") - F.sum("n_tokens")).alias("unused"),
    )


def utilization(placed: DataFrame) -> DataFrame:
    """Per lane: containers, tokens, the fewest containers that could hold them, and the share in use."""
    per = containers(placed).groupBy("lane").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("fill").alias("tokens"), F.sum("capacity").alias("room"), F.max("capacity").alias("capacity"))
    return per.select("lane", "n_containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), (F.col("tokens") / F.col("room")).alias("used_share"))
