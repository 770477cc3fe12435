"""Token blocks: a chunk's items as one run of tokens, cut into blocks of equal length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.plans import index

#: Tokens of a range of items, about.
RANGE_TOKENS = 2_000_000


def blocks(items: DataFrame, block_size: int, tokens: str = "tokens", chunk: str = "chunk", order: str = "idx") -> DataFrame:
    """(chunk, block, tokens) of items(chunk, idx, tokens array): blocks go across items, not across chunks; what fills none is dropped.

    Items get their places in ranges of their order, of about RANGE_TOKENS tokens, in which a row that comes first has the
    number of its chunk's tokens in the ranges before; so the tokens of a chunk need not meet. Each item then cuts itself
    into pieces of blocks, and a block gathers its pieces, those across ranges once more.
    """
    n, items = F.size(tokens).cast("long"), items.where(F.size(tokens) > 0)
    cuts = index.bounds(items, order, weight=n, size=RANGE_TOKENS)
    placed = items.select(chunk, order, tokens, n.alias("_n"), index.range_of(F.col(order), cuts, items.schema[order].dataType.simpleString()).alias("_range"))
    if cuts:
        totals = placed.groupBy(chunk, "_range").agg(F.sum("_n").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(chunk).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = placed.unionByName(totals.select(chunk, "_range", before.alias("_n")), allowMissingColumns=True)  # a row for each range of a chunk
    earlier = Window.partitionBy(chunk, "_range").orderBy(F.col(tokens).isNotNull(), order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where(F.col(tokens).isNotNull())
    first, last = F.floor(F.col("_from") / block_size), F.floor((F.col("_from") + F.size(tokens) - 1) / block_size)
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
    a = F.greatest(F.col("block") * block_size - F.col("_from"), F.lit(0))
    b = F.least((F.col("block") + 1) * block_size - F.col("_from"), F.size(tokens).cast("long"))
    pieces = pieces.select(chunk, "_range", "block", (F.col("_from") + a).alias("at"), F.slice(tokens, (a + 1).cast("int"), (b - a).cast("int")).alias("piece"))
    inside = _gathered(pieces, chunk, "_range", "block")  # where its pieces are
    whole = inside.where(F.size("piece") == block_size)
    if cuts:
        whole = whole.unionByName(_gathered(inside.where(F.size("piece") < block_size), chunk, "block").where(F.size("piece") == block_size), allowMissingColumns=True)
    return whole.select(chunk, "block", F.col("piece").alias("tokens"))


def _gathered(pieces: DataFrame, *by: str) -> DataFrame:
    every = F.array_sort(F.collect_list(F.struct("at", "piece")))
    return pieces.groupBy(*by).agg(F.min("at").alias("at"), F.flatten(F.transform(every, lambda x: x["piece"])).alias("piece"))
