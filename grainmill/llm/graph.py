"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm._common import Workspace


def _summary(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def connected_components(edges: DataFrame, work: Workspace, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has an edge (a, b); root is the least node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges stay as they are, which is when
    each node has one edge, to its root. A step's minima are aggregated before they are shuffled, and each round is
    written to the shared folder. Edges with a null end and loops give no rows. a and b may be of any one ordered type.
    Raises RuntimeError if most_rounds are not enough (rounds grow with the logarithm of the longest path).
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    now = work.stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _summary(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.union(now.select("v", "u")).toDF("n", "other")
        low = both.groupBy("n").agg(F.min("other").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("other > n").join(low, "n").select(F.col("other").alias("u"), F.col("m").alias("v")).distinct()
        large = work.stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = work.stored(moved.union(least.select("u", "m")).distinct(), "small-star")
        before, state = state, _summary(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
