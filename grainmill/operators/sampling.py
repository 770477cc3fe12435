"""Exact parts of a dataset, taken on the table of chunks: subsets, copies, splits."""

from __future__ import annotations

from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.plans.planner import intervals, shuffle_key


def _exact(n: int, share: float) -> int:
    return int((Decimal(n) * Decimal(repr(float(share)))).to_integral_value(ROUND_FLOOR))


def _total(spans: DataFrame) -> int:
    return spans.agg(F.sum("size")).first()[0] or 0


def _spans(chunks: DataFrame, seed: int | None, *parts) -> DataFrame:
    key = [shuffle_key(seed, *parts, F.col("chunk")), "chunk"] if seed is not None else ["chunk"]
    return intervals(chunks.select("chunk", "size", *[c for c in ("roi_start", "roi_end") if c in chunks.columns]), key)


def _cut(spans: DataFrame, a: int, b: int) -> DataFrame:
    """The rows a..b of the spans' order, by chunk; `lo` keeps the order."""
    start, end = F.greatest("lo", F.lit(a)), F.least("hi", F.lit(b))
    part = spans.where((F.col("lo") < b) & (F.col("hi") > a))
    return part.select("chunk", (start - F.col("lo") + F.col("roi_start")).cast("long").alias("start"), (end - F.col("lo") + F.col("roi_start")).cast("long").alias("end"), "lo")


def subsample(chunks: DataFrame, share: float, seed: int | None = None) -> DataFrame:
    """(copy, chunk, start, end): floor(n * share) rows in the order of chunks (permuted if there is a seed), exactly.

    Above 1: whole copies, each with an order of its own, and the rest of share as above. 1 is the whole, in its order.
    """
    if not isinstance(share, float) or share <= 0:
        raise ValueError("share must be a float above 0")
    whole = int(Decimal(repr(share)).to_integral_value(ROUND_FLOOR))
    rest = float(Decimal(repr(share)) - whole)
    parts = []
    for copy in range(whole):
        spans = _spans(chunks, None if share == 1.0 else seed, copy)
        parts.append(_cut(spans, 0, _total(spans)).withColumn("copy", F.lit(copy).cast("long")))
    if rest > 0:
        spans = _spans(chunks, seed, whole)
        parts.append(_cut(spans, 0, _exact(_total(spans), rest)).withColumn("copy", F.lit(whole).cast("long")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("copy", "chunk", "start", "end")


def split(chunks: DataFrame, shares: list[float], seed: int | None = None) -> DataFrame:
    """(part, chunk, start, end): consecutive cuts of floor(n * share) rows each, without overlap; what is left is in none."""
    if not all(isinstance(s, float) and 0 <= s <= 1 for s in shares) or sum(map(lambda s: Decimal(repr(s)), shares)) > 1:
        raise ValueError("shares must be floats from 0 to 1 with a sum up to 1")
    spans = _spans(chunks, seed)
    n, at, parts = _total(spans), 0, []
    for i, s in enumerate(shares):
        k = _exact(n, s)
        parts.append(_cut(spans, at, at + k).withColumn("part", F.lit(i).cast("long")))
        at += k
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("part", "chunk", "start", "end")


def named_chunks(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """The manifest's rows for names(ord, filename), in that order and as often as named. Raises if one is not there."""
    missing = names.join(manifest, "filename", "left_anti").select("filename").first()
    if missing:
        raise ValueError(f"{missing[0]} is not in the manifest")
    return names.join(manifest, "filename")


def rows_of(data: DataFrame, taken: DataFrame) -> DataFrame:
    """The rows of data(chunk, row, ...) that (chunk, start, end, ...) takes."""
    return data.join(F.broadcast(taken), "chunk").where((F.col("row") >= F.col("start")) & (F.col("row") < F.col("end"))).drop("start", "end")


def first_rows(df: DataFrame, n: int, worker: str, order: str) -> DataFrame:
    """A trial run's rows: the first n of each worker."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(worker).orderBy(order))).where(F.col("_k") <= n).drop("_k")
