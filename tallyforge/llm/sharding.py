"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import saved

CELL_BITS = 16
_PLAN = T.StructType([T.StructField(n, T.LongType()) for n in ("__cell", "__lo", "__hi", "__shard", "__base")])


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell of the ring, shard) of every virtual node, clockwise. A shard's points don't depend on the others."""
    where = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()) >> (64 - CELL_BITS)
    return sorted((where(s, v), s) for s in range(shards) for v in range(vnodes))


def fill_ring(counts: dict[int, int], shards: int, vnodes: int, capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Which ranks of each cell go to which shard: (cell, first rank, end, shard, first slot).

    counts: rows by cell. A row belongs to the next virtual node clockwise. A shard takes its own rows
    in ring order until it is full; what is left moves on clockwise, first come first served, to nodes with room.
    """
    points = ring_points(shards, vnodes)
    cells = [c for c, _ in points]
    used, out = [0] * shards, []
    at_node: list[deque] = [deque() for _ in points]
    left: list[deque] = [deque() for _ in points]
    for cell in sorted(counts):
        at_node[bisect_left(cells, cell) % len(points)].append((cell, 0, counts[cell]))

    def take(node: int, queue: deque, rest: deque | None) -> None:
        shard = points[node][1]
        while queue:
            room = capacity[shard] - used[shard]
            if room <= 0:
                break
            cell, lo, hi = queue.popleft()
            end = min(hi, lo + room)
            if end > lo:
                out.append((cell, lo, end, shard, used[shard]))
                used[shard] += end - lo
            if end < hi:
                queue.appendleft((cell, end, hi))
        if rest is not None:
            rest.extend(queue)

    for node in range(len(points)):
        take(node, at_node[node], left[node])
    moving: deque = deque()
    for lap in range(2):
        for node in range(len(points)):
            if lap == 0:
                moving.extend(left[node])
            take(node, moving, None)
    if moving:
        raise ValueError("the shards' capacities hold fewer keys than there are")
    return out


def ring_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Every row's shard and slot: id, size (UTF-8 bytes and one), text_crc32, shard, slot.

    Law: a shard holds at most ceil((1 + slack) * rows / shards) rows; with slack 0 the counts are at most one apart
    (the first shards take the odd rows). A row's place on the ring is the hash of its id and its text's checksum, so
    that an id that many rows share is spread, and placement depends on the rows alone, not on files or partitions.
    Only counts by ring cell reach the driver: 2**CELL_BITS at most, however many rows there are. The order within a
    cell is by hash, id, checksum, size.

    A null text has size 1 and the checksum of an empty one; null ids are hashed as one of their own; repeated rows
    are counted before they are shuffled and placed one by one; an empty table gives no rows; columns other than the
    two named are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("__id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("__id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", F.xxhash64("__id", "text_crc32"))
    rows = saved(rows.withColumn("__cell", F.shiftrightunsigned("__h", 64 - CELL_BITS)))
    counts = {r["__cell"]: r["n"] for r in rows.groupBy("__cell").agg(F.sum("__n").alias("n")).collect()}
    total = sum(counts.values())
    whole = [total // shards + (s < total % shards) for s in range(shards)]
    capacity = [int(-(-total * (1 + slack) // shards)) for _ in range(shards)] if slack else whole
    plan = df.sparkSession.createDataFrame(fill_ring(counts, shards, vnodes, capacity), _PLAN)
    order = Window.partitionBy("__cell").orderBy("__h", "__id", "text_crc32", "size")
    ranked = rows.withColumn("__rank", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
    ranked = ranked.withColumn("__rank", F.explode(F.sequence(F.col("__rank"), F.col("__rank") + F.col("__n") - 1))).alias("r")
    # The plan has one row per cell and shard at most, so its size is bounded by the parameters.
    here = ranked.join(F.broadcast(plan).alias("p"), (F.col("r.__cell") == F.col("p.__cell")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    return here.select(F.col("__id").alias(id_col), "size", "text_crc32", F.col("__shard").cast("int").alias("shard"), (F.col("__base") + F.col("__rank") - F.col("__lo")).alias("slot"))
