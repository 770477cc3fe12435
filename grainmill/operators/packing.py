"""Packing rows into chunks, and items into workers."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.plans.index import bounds, range_of

#: More items than that are not collected: whole numbers as weights are packed by runs of equal ones.
DRIVER_ITEMS = 100_000


def by_count(df: DataFrame, size: int, order: str = "idx", worker: str | None = None, name: str = "chunk") -> DataFrame:
    """Chunks of size rows each in order, for each worker on its own; order numbers a worker's rows from 0 without gaps if worker is None."""
    if worker is None:
        return df.withColumn(name, F.floor(F.col(order) / size).cast("long"))
    place = F.row_number().over(Window.partitionBy(worker).orderBy(order)) - 1
    return df.withColumn(name, F.floor(place / size).cast("long"))


def greedy(weights: np.ndarray, limit: int) -> np.ndarray:
    """Chunk numbers: a chunk closes before the item that would bring it over the limit; an item over it is a chunk by itself."""
    ends = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
    out, at, chunk = np.zeros(len(weights), dtype=np.int64), 0, 0
    while at < len(weights):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        out[at:to] = chunk
        at, chunk = to, chunk + 1
    return out


def by_weight(df: DataFrame, weight: str, limit: int, worker: str, order: str = "idx", name: str = "chunk") -> DataFrame:
    """(worker, order, weight, chunk): greedy chunks of a total weight (bytes, tokens) up to the limit, for each worker.

    Packing is a running sum that starts anew, so a worker's (order, weight) pairs are packed by one task; a worker is a
    bounded unit by definition, and the rows themselves do not move. Join the result to the rows by worker and order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        pdf[name] = greedy(pdf[weight].to_numpy(dtype=np.int64), limit)
        return pdf

    schema = f"`{worker}` {kinds[worker]}, `{order}` {kinds[order]}, `{weight}` {kinds[weight]}, `{name}` bigint"
    return df.select(worker, order, weight).groupBy(worker).applyInPandas(pack, schema)


def largest_first(weights: list[float], bins: int) -> list[int]:
    """The bin of each item: by falling weight (equal ones in their order) to the bin with the least, the first of several.

    Sequential by nature, on the driver: the items are inputs such as files, not rows.
    """
    if bins <= 0 or any(w <= 0 for w in weights):
        raise ValueError("bins and weights must be positive")
    heap, out = [(0, b) for b in range(bins)], [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: -weights[i]):
        total, b = heapq.heappop(heap)
        out[i] = b
        heapq.heappush(heap, (total + weights[i], b))
    return out


def largest_first_runs(counts: list[tuple[int, int]], bins: int) -> list[tuple[int, list[int], list[int]]]:
    """The same as largest_first() of items by number: of (weight, items) each weight, the bins of its first items, and
    those that the rest take in turn.

    Once the totals differ by less than the weight, an item's bin becomes the fullest: all bins take one each, again and again.
    """
    if bins <= 0 or any(w <= 0 for w, _ in counts):
        raise ValueError("bins and weights must be positive")
    heap, out = [(0, b) for b in range(bins)], []
    for w, n in sorted(counts, reverse=True):
        most, head = max(heap)[0], []
        while len(head) < n and most - heap[0][0] >= w:
            total, b = heap[0]
            head.append(b)
            heapq.heapreplace(heap, (total + w, b))
        turns = sorted(heap)
        whole, rest = divmod(n - len(head), bins)
        heap = [(total + w * (whole + (i < rest)), b) for i, (total, b) in enumerate(turns)]
        heapq.heapify(heap)
        out.append((w, head, [b for _, b in turns]))
    return out


def balanced(items: DataFrame, weight: str, bins: int, order: str) -> DataFrame:
    """items(order, weight) with their bin.

    Up to DRIVER_ITEMS items are placed one by one. Of more, the driver sees how many have each weight, and an item's
    place among those of its weight says its bin. Weights that are no whole numbers are always placed one by one.
    """
    spark, kinds = items.sparkSession, {f.name: f.dataType.simpleString() for f in items.schema.fields}
    few = items.count() <= DRIVER_ITEMS
    if few or kinds[weight] not in ("tinyint", "smallint", "int", "bigint"):
        rows = items.select(order, weight).orderBy(order).collect()
        placed = [(r[0], b) for r, b in zip(rows, largest_first([r[1] for r in rows], bins), strict=True)]
        table = spark.createDataFrame(placed, f"`_k` {kinds[order]}, bin long")
        return items.join(F.broadcast(table) if few else table, F.col(order) == F.col("_k")).drop("_k")
    counts = [(r[0], r[1]) for r in items.groupBy(weight).agg(F.count("*")).collect()]
    runs = largest_first_runs(counts, bins)
    placed = items.withColumn("_range", range_of(F.col(order), bounds(items, order), kinds[order]))
    starts = placed.groupBy(weight, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(weight).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(F.col(weight).alias("_w"), F.col("_range").alias("_r"), before.alias("_start"))  # rows: weights times ranges
    rank = F.row_number().over(Window.partitionBy(weight, "_range").orderBy(order)) - 1
    placed = placed.withColumn("_rank", rank).join(starts, (F.col(weight) == F.col("_w")) & (F.col("_range") == F.col("_r"))).withColumn("_rank", F.col("_rank") + F.col("_start")).drop("_w", "_r", "_start", "_range")
    table = spark.createDataFrame(runs, "`_w` bigint, head array<bigint>, turns array<bigint>")
    first = F.size("head")
    bin_ = F.when(F.col("_rank") < first, F.get("head", F.col("_rank").cast("int"))).otherwise(F.get("turns", ((F.col("_rank") - first) % bins).cast("int")))
    placed = placed.join(table, F.col(weight) == F.col("_w")).withColumn("bin", bin_)
    return placed.select(*[F.col(f"`{c}`") for c in items.columns], "bin")


def split_evenly(df: DataFrame, workers: int, order: str = "idx") -> DataFrame:
    """df with the worker of each of its rows 0..n-1 in order: n div workers each, one more for each of the last n mod workers."""
    n = df.agg(F.count("*").alias("_n"))
    base, rest = F.floor(F.col("_n") / workers), F.col("_n") % workers
    short = (F.lit(workers) - rest) * base  # rows of the workers that get no more
    worker = F.when(F.col(order) < short, F.floor(F.col(order) / F.greatest(base, F.lit(1)))).otherwise(F.lit(workers) - rest + F.floor((F.col(order) - short) / (base + 1)))
    return df.join(F.broadcast(n), F.lit(True)).withColumn("worker", worker.cast("long")).drop("_n")
