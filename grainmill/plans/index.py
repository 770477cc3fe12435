"""Positions of rows in a global order, without putting all rows in one task."""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range; sampled keys for each range.
RANGE_ROWS, SAMPLED = 250_000, 20


def bounds(df: DataFrame, key: str, seed: int = 7, weight: Column | None = None, size: int | None = None) -> list:
    """Sorted keys that cut df into ranges of about RANGE_ROWS rows, or of about so much weight (a number for each row).

    None for a small df. What is collected grows with the ranges alone.
    """
    weight = F.lit(1) if weight is None else weight
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    ranges = -(-total // (size or RANGE_ROWS))
    if ranges < 2:
        return []
    drawn = df.where(F.col(key).isNotNull()).select(key, weight.alias("_w")).sample(min(1.0, SAMPLED * ranges / n), seed)
    rows = sorted(tuple(r) for r in drawn.limit(4 * SAMPLED * ranges).collect())
    upto = list(itertools.accumulate(w for _, w in rows))
    return sorted({rows[bisect.bisect_right(upto, upto[-1] * i // ranges)][0] for i in range(1, ranges)}) if upto else []


def range_of(key: Column, cuts: list, kind: str) -> Column:
    """How many of the cuts are at most key, by binary search; 0 for null."""
    if not cuts:
        return F.lit(0)
    listed, steps = F.array(*[F.lit(c).cast(kind) for c in cuts]), len(cuts).bit_length()
    sizes = F.array(*[F.lit(1 << (steps - 1 - i)) for i in range(steps)])
    return F.aggregate(sizes, F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.get(listed, at + s - 1) <= key), at + s).otherwise(at))


def with_position(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """df with each row's position, from 0, in the order of the columns (ascending, nulls first).

    Rows are numbered in ranges of the first column; a range starts at the number of rows in those before it.
    """
    cuts = bounds(df, order[0])
    placed = df.withColumn("_range", range_of(F.col(order[0]), cuts, df.schema[order[0]].dataType.simpleString()))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    if not cuts:
        return placed.withColumn(name, rank.cast("long")).drop("_range")
    starts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(F.col("_range").alias("_r"), before.alias("_start"))  # one row for each range
    return placed.join(F.broadcast(starts), F.col("_range") == F.col("_r")).withColumn(name, (rank + F.col("_start")).cast("long")).drop("_range", "_r", "_start")
