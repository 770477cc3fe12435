"""Batches of a cached table: while the cache is filled, in the order of the rows; after that, chunk by chunk in a new order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.plans.planner import shuffle_key, shuffled


def _share(place: Column, size: int, shares: int) -> Column:
    """Consecutive shares of size rows; the last has the rest."""
    return F.lit(shares - 1).cast("long") if size == 0 else F.least(F.floor(place / size), F.lit(shares - 1)).cast("long")


def _turn(place: Column, num_workers: int, batch_size: int) -> Column:
    """The turn of a worker's batch: round by round, worker by worker. Where a worker has no more, its turn has no rows."""
    return (F.floor(place / batch_size) * num_workers + F.col("worker")).cast("long")


def filling_batches(rows: DataFrame, n: int, world_size: int, num_workers: int, batch_size: int, order: str = "idx") -> DataFrame:
    """rows, numbered 0..n-1 by order, with rank, worker and batch: each worker has consecutive rows, so it writes them in order. No shuffle is needed."""
    a_rank, a_worker = n // world_size, n // (world_size * num_workers)
    out = rows.withColumn("rank", _share(F.col(order), a_rank, world_size)).withColumn("_place", F.col(order) - F.col("rank") * a_rank)
    out = out.withColumn("worker", _share(F.col("_place"), a_worker, num_workers))
    return out.withColumn("batch", _turn(F.col("_place") - F.col("worker") * a_worker, num_workers, batch_size)).drop("_place")


def filled_batches(data: DataFrame, chunks: DataFrame, world_size: int, num_workers: int, batch_size: int, seed: int = 42, epoch: int = 1) -> DataFrame:
    """data(chunk, row, ...) with rank, worker, place (from 0 in a worker) and batch.

    The permuted chunks(chunk, size) are dealt to the ranks in turn and a rank's to its workers in turn; a chunk's rows
    are permuted. Windows run over the table of chunks and inside single chunks.
    """
    dealt = shuffled(chunks, seed, epoch).withColumn("rank", F.col("ord") % world_size).withColumn("worker", F.floor(F.col("ord") / world_size) % num_workers)
    run = Window.partitionBy("rank", "worker").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.select("chunk", "rank", "worker", F.coalesce(F.sum("size").over(run), F.lit(0)).cast("long").alias("_start"))
    within = F.row_number().over(Window.partitionBy("chunk").orderBy(shuffle_key(seed, epoch, F.col("chunk"), F.col("row")), "row")) - 1
    out = data.withColumn("_within", within).join(starts, "chunk").withColumn("place", (F.col("_start") + F.col("_within")).cast("long"))
    return out.withColumn("batch", _turn(F.col("place"), num_workers, batch_size)).drop("_start", "_within")
