"""Datasets put together: one after the other, or mixed by weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """All rows of the parts with their part's number; their columns and types must be the same."""
    first = parts[0].schema
    for p in parts[1:]:
        if [(f.name, f.dataType) for f in p.schema.fields] != [(f.name, f.dataType) for f in first.fields]:
            raise ValueError("the datasets' columns differ")
    numbered = [p.withColumn("dataset", F.lit(i).cast("long")) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b), numbered)


def mixed(df: DataFrame, stream: str, weights: dict | None, order: str, iterate_over_all: bool = True, batch_size: int = 1) -> DataFrame:
    """df with `vt`, a virtual time in the order of which streams mix in proportion to their weights.

    The r-th row (or batch of batch_size rows, which stay together) of a stream of weight w is at (r - 1/2) / w; the mix
    is the order by vt, stream, order. Without weights these are the streams' lengths. If iterate_over_all is off, the
    mix ends when the first stream does. Ratios are those of drawing at random, with less variance.
    """
    if weights is not None and iterate_over_all:
        raise ValueError("weights are for a mix that ends with its first stream")
    rank = F.floor((F.row_number().over(Window.partitionBy(stream).orderBy(order)) - 1) / batch_size) + 1
    sizes = df.groupBy(stream).agg(F.count("*").alias("_n")).withColumnRenamed(stream, "_s")
    placed = df.withColumn("_r", rank).join(F.broadcast(sizes), F.col(stream) == F.col("_s"))
    weight: Column = F.col("_n").cast("double")
    if weights is not None:
        total = sum(weights.values())
        weight = F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, w / total)])[F.col(stream)]
    placed = placed.withColumn("vt", (F.col("_r") - 0.5) / weight)
    if not iterate_over_all:
        end = (F.floor((F.col("_n") + batch_size - 1) / batch_size) + 0.5) / weight
        ends = placed.select(end.alias("_e")).agg(F.min("_e").alias("_end"))
        placed = placed.join(F.broadcast(ends), F.lit(True)).where(F.col("vt") < F.col("_end")).drop("_end")
    return placed.drop("_r", "_s", "_n")
