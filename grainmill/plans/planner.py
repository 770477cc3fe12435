"""Read plans: which rows of which chunks each worker of each rank reads, and in what order.

All of it is relational, on the small table of chunks: a worker's share of the global row order is an interval, and so is
a chunk; a plan is made in one run over the ends of both. Windows without partitions here run over chunks or workers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(seed: int, *parts) -> Column:
    """The order of the native shuffle: md5 of seed and parts, the same in any engine."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def intervals(chunks: DataFrame, order: list | None = None) -> DataFrame:
    """chunks(chunk, size[, roi_start, roi_end]) with their interval lo..hi in the row order.

    With a region of interest (null ends: the whole chunk) only its rows count.
    """
    if "roi_start" in chunks.columns:
        start = F.coalesce("roi_start", F.lit(0))
        chunks = chunks.withColumn("size", F.greatest(F.least(F.coalesce("roi_end", "size"), F.col("size")) - start, F.lit(0)).cast("long")).withColumn("roi_start", start.cast("long"))
    else:
        chunks = chunks.withColumn("roi_start", F.lit(0).cast("long"))
    run = Window.orderBy(*(order or ["chunk"])).rowsBetween(Window.unboundedPreceding, 0)
    hi = F.sum("size").over(run).cast("long")
    return chunks.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("size"))


def token_intervals(chunks: DataFrame, block_size: int) -> DataFrame:
    """chunks(chunk, dim) of dim tokens each: intervals of whole blocks; a chunk's last tokens that fill none are dropped."""
    return intervals(chunks.withColumn("size", F.floor(F.col("dim") / block_size).cast("long")))


def budgets(chunks: DataFrame, world_size: int, num_workers: int, batch_size: int = 1, drop_last: bool | None = None) -> DataFrame:
    """(rank, worker, w, budget, blo, bhi): rows for each worker, in batches as even as can be.

    Rows that fill no batch for every rank go to one worker of the last rank, or are dropped. drop_last is on by
    default where there are several ranks.
    """
    drop_last = world_size > 1 if drop_last is None else drop_last
    n = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n"))
    per = n.withColumn("per", F.floor(F.floor(F.col("n") / batch_size) / world_size).cast("long"))
    spark = chunks.sparkSession
    workers = spark.range(world_size * num_workers, numPartitions=1).select(F.col("id").alias("w"), F.floor(F.col("id") / num_workers).cast("long").alias("rank"), (F.col("id") % num_workers).alias("worker"))
    rows = workers.join(F.broadcast(per), F.lit(True))  # one row of totals
    own = (F.floor(F.col("per") / num_workers) + F.when(F.col("worker") < F.col("per") % num_workers, 1).otherwise(0)) * batch_size
    if not drop_last:
        last = (F.col("rank") == world_size - 1) & (F.col("worker") == (F.col("per") % num_workers) % num_workers)
        own = own + F.when(last, F.col("n") - world_size * F.col("per") * batch_size).otherwise(0)
    run = Window.orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("budget", own.cast("long")).withColumn("bhi", F.sum("budget").over(run).cast("long"))
    return out.withColumn("blo", F.col("bhi") - F.col("budget")).select("rank", "worker", "w", "budget", "blo", "bhi")


def assign(spans: DataFrame, shares: DataFrame) -> DataFrame:
    """(rank, worker, w, chunk, pos, start, end): the rows start..end of a chunk that a worker reads, pos its place there.

    Empty chunks and workers have no rows to overlap in; they do not join.
    """
    held = spans.where("lo < hi").select(F.col("lo").alias("at"), F.struct("chunk", "lo", "hi", "roi_start").alias("c"))
    due = shares.where("blo < bhi").select(F.col("blo").alias("at"), F.struct("rank", "worker", "w", "bhi").alias("b"))
    # Both rows of intervals are in order and without gaps: wherever one of either kind begins, a piece of a plan begins.
    ends = held.unionByName(due, allowMissingColumns=True).groupBy("at").agg(F.first("c", ignorenulls=True).alias("c"), F.first("b", ignorenulls=True).alias("b"))
    run = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    met = ends.select("at", F.last("c", ignorenulls=True).over(run).alias("c"), F.last("b", ignorenulls=True).over(run).alias("b"))
    met = met.where((F.col("at") < F.col("c.hi")) & (F.col("at") < F.col("b.bhi"))).select("at", "c.*", "b.*")
    start = F.col("at") - F.col("lo") + F.col("roi_start")
    end = F.least("hi", "bhi") - F.col("lo") + F.col("roi_start")
    pos = F.row_number().over(Window.partitionBy("w").orderBy("at")).cast("long") - 1
    return met.select("rank", "worker", "w", "chunk", pos.alias("pos"), start.cast("long").alias("start"), end.cast("long").alias("end"))


def shuffled(chunks: DataFrame, seed: int, epoch: int, num_nodes: int = 1) -> DataFrame:
    """chunks with their place `ord` in the epoch's order; over several nodes the order of epoch 1 stays, so that nodes keep their chunks."""
    at = 1 if num_nodes > 1 else epoch
    key = shuffle_key(seed, at, F.col("chunk"))
    return chunks.withColumn("ord", F.row_number().over(Window.orderBy(key, "chunk")).cast("long") - 1)


def reshuffled_in_nodes(plan: DataFrame, seed: int, epoch: int, workers_per_node: int) -> DataFrame:
    """From the second epoch over several nodes on: each node's chunks in a new order, each once however many workers share it."""
    node = F.floor(F.col("w") / workers_per_node).cast("long")
    each = plan.withColumn("node", node).groupBy("node", "chunk").agg(F.min(F.struct("w", "pos")).alias("first"))
    return each.select("node", "chunk", (F.row_number().over(Window.partitionBy("node").orderBy(shuffle_key(seed, epoch, F.col("chunk")), "chunk")).cast("long") - 1).alias("ord"))


def node_regions(plan: DataFrame, workers_per_node: int) -> DataFrame:
    """(node, chunk, roi_start, roi_end): the rows of a chunk that a node reads. A node's share is an interval of the row
    order, so they are one run; where two nodes share a chunk, each has its own."""
    node = F.floor(F.col("w") / workers_per_node).cast("long")
    return plan.groupBy(node.alias("node"), "chunk").agg(F.min("start").alias("roi_start"), F.max("end").alias("roi_end"))


def plan(chunks: DataFrame, world_size: int, num_workers: int, batch_size: int = 1, drop_last: bool | None = None, shuffle: bool = False, seed: int = 42, epoch: int = 1, num_nodes: int = 1) -> DataFrame:
    """The plan of an epoch for chunks(chunk, size[, roi_start, roi_end])."""
    rows = shuffled(chunks, seed, epoch, num_nodes) if shuffle else chunks
    spans = intervals(rows, ["ord"] if shuffle else ["chunk"])
    first = assign(spans, budgets(spans, world_size, num_workers, batch_size, drop_last))
    if not (shuffle and num_nodes > 1 and epoch > 1):
        return first
    per_node = world_size * num_workers // num_nodes
    again = reshuffled_in_nodes(first, seed, epoch, per_node).join(node_regions(first, per_node), ["node", "chunk"])
    joined = rows.drop("ord", "roi_start", "roi_end").join(again, "chunk")
    spans = intervals(joined.withColumn("chunk_order", F.col("node") * (1 << 40) + F.col("ord")), ["chunk_order"])
    return assign(spans, budgets(spans, world_size, num_workers, batch_size, drop_last))


def rows_of(data: DataFrame, plan_: DataFrame, shuffle: bool = False, seed: int = 42, epoch: int = 1) -> DataFrame:
    """data(chunk, row, ...) that the plan reads, with rank, worker, w and each worker's order `rn`, from 1.

    The join is on the chunk, so a worker's rows come from its chunks alone; a shuffle permutes inside each worker's part of a chunk.
    """
    met = data.join(F.broadcast(plan_), "chunk").where((F.col("row") >= F.col("start")) & (F.col("row") < F.col("end")))
    within = [shuffle_key(seed, epoch, F.col("w"), F.col("pos"), F.col("row")), F.col("row")] if shuffle else [F.col("row")]
    return met.withColumn("rn", F.row_number().over(Window.partitionBy("w").orderBy("pos", *within)).cast("long"))


def lengths(plan_: DataFrame) -> DataFrame:
    return plan_.groupBy("rank").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n"))


def shared_chunks(plan_: DataFrame) -> DataFrame:
    """Chunks that several workers read, and how many."""
    return plan_.groupBy("chunk").agg(F.count_distinct("w").alias("workers")).where("workers > 1")
