"""Batches of a planned read, and the cursor from which it goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batches(rows: DataFrame, batch_size: int, drop_last: bool = False) -> DataFrame:
    """rows(w, rn, ...) with local_batch, each worker's batch, and batch, their turn over all workers: round by round, worker by worker."""
    out = rows.withColumn("local_batch", F.floor((F.col("rn") - 1) / batch_size).cast("long"))
    if drop_last:
        full = out.groupBy("w", "local_batch").agg(F.count("*").alias("_n")).where(F.col("_n") == batch_size).drop("_n")
        out = out.join(full, ["w", "local_batch"], "left_semi")
    turns = out.select("local_batch", "w").distinct()  # one row for each batch
    counts = turns.groupBy("local_batch").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("local_batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("local_batch", before.alias("_start"))
    turn = F.row_number().over(Window.partitionBy("local_batch").orderBy("w")) - 1
    turns = turns.join(starts, "local_batch").withColumn("batch", (F.col("_start") + turn).cast("long")).drop("_start")
    return out.join(turns, ["local_batch", "w"])


def n_batches(n_rows: Column, batch_size: int, drop_last: bool = False) -> Column:
    return (F.floor(n_rows / batch_size) if drop_last else F.ceil(n_rows / batch_size)).cast("long")


def consumed(n: Column, worker: Column, num_workers: int, batch_size: int) -> Column:
    """How many rows a worker has given when n were given in all: whole rounds, and then batch by batch."""
    a_round = num_workers * batch_size
    rest = n % a_round - worker * batch_size
    return (F.floor(n / a_round) * batch_size + F.least(F.lit(batch_size), F.greatest(F.lit(0), rest))).cast("long")


def chunk_cursor(plan: DataFrame, used: DataFrame) -> DataFrame:
    """(w, pos, chunk, offset): where each worker goes on after n rows of used(w, n)."""
    run = Window.partitionBy("w").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    spans = plan.withColumn("hi", F.sum(F.col("end") - F.col("start")).over(run)).withColumn("lo", F.col("hi") - (F.col("end") - F.col("start")))
    return spans.join(used, "w").where((F.col("lo") <= F.col("n")) & (F.col("n") < F.col("hi"))).select("w", "pos", "chunk", (F.col("n") - F.col("lo")).alias("offset"))


def resumed(rows: DataFrame, n: int, num_workers: int, batch_size: int) -> DataFrame:
    """The rows(rank, worker, rn, ...) that are left when each rank has given n."""
    return rows.where(F.col("rn") > consumed(F.lit(n), F.col("worker"), num_workers, batch_size))


def going_on(rows: DataFrame, n: int, num_workers: int, batch_size: int) -> DataFrame:
    """The batches that are left of rows(w, rn, ...) when n rows were given, numbered on from 0.

    The first is the worker's whose turn it is, so their order is that of a read without a break. Of a batch that was
    given in part the rest comes first. Batches must be full but for each worker's last.
    """
    out = batches(rows, batch_size)
    first = n // batch_size
    left = (F.col("batch") > first) | ((F.col("batch") == first) & ((F.col("rn") - 1) % batch_size >= n % batch_size))
    return out.where(left).withColumn("batch", F.col("batch") - first).withColumn("turn", F.pmod(F.col("w") - first % num_workers, F.lit(num_workers)))


def collated(rows: DataFrame, columns: list[str], collate=None) -> DataFrame:
    """One row for each batch of rows(batch, rn, ...): batch, n, and an array of each column in the order of rn.

    collate(name, array column) may make another column of each array. A batch is bounded, so its arrays are.
    """
    items = F.array_sort(F.collect_list(F.struct("rn", *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])))
    made = rows.groupBy("batch").agg(F.count("*").alias("n"), items.alias("_items"))
    arrays = [F.col("_items").getField(f"_{i}") for i in range(len(columns))]
    return made.select("batch", "n", *[(collate(c, a) if collate else a).alias(c) for c, a in zip(columns, arrays, strict=True)])


FIXED = ("shuffle", "num_workers", "input_dir", "seed", "item_loader", "drop_last")


def state(n: int, epoch: int, **settings) -> dict:
    return {"num_samples_yielded": n, "current_epoch": epoch, **settings}


def checked(saved: dict, now: dict, length: int, override: bool = False) -> list[str]:
    """What differs between a saved state and the settings now; raises unless override."""
    found = [f"{k}: {saved[k]!r} then, {now[k]!r} now" for k in FIXED if k in saved and k in now and saved[k] != now[k]]
    if saved["num_samples_yielded"] > length:
        found.append(f"{saved['num_samples_yielded']} rows given of {length}")
    if found and not override:
        raise ValueError("; ".join(found))
    return found


def combined_state(draws: list[int], n_streams: int, n: int) -> list[int]:
    """Rows taken from each stream when n draws were made."""
    return [draws[:n].count(i) for i in range(n_streams)]
