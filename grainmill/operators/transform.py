"""User functions over inputs: rows in, rows out, packed into chunks with a manifest; or files as they make them."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from grainmill.operators.packing import balanced, split_evenly
from grainmill.operators.sampling import first_rows
from grainmill.plans.index import with_position

TRIAL_ROWS = 10
#: Lots of inputs that a run with a checkpoint ends one after the other.
LOTS = 16
CHECKPOINT = "_checkpoint"


def flat_map(df: DataFrame, fn: Callable, schema: str, skip_errors: bool = False) -> DataFrame:
    """fn of each row (a dict of plain Python values, nulls as None): the dict it returns, none for None, or all that a generator yields. Errors end the job unless they are skipped."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    made = fn(row)
                    if inspect.isgenerator(made):
                        out.extend(made)
                    elif made is not None:
                        out.append(made)
                except Exception:
                    if not skip_errors:
                        raise
            yield from pa.Table.from_pylist(out, schema=shape).to_batches()

    shape = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.mapInArrow(run, schema)


def dealt(inputs: DataFrame, workers: int, order: str, weight: str | None = None) -> DataFrame:
    """inputs with idx, their place in order, and worker: consecutive shares, or bins of equal weight."""
    placed = with_position(inputs, order)
    return balanced(placed, weight, workers, "idx").withColumnRenamed("bin", "worker") if weight else split_evenly(placed, workers)


def batched(inputs: DataFrame, size: int, order: str = "idx") -> DataFrame:
    """Consecutive groups of size rows as one row each: batch, items (structs in order)."""
    names = inputs.columns
    rows = inputs.withColumn("batch", F.floor(F.col(order) / size).cast("long"))
    return rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in names if c != order]))).alias("items"))


def with_last(inputs: DataFrame, worker: str = "worker", order: str = "idx") -> DataFrame:
    """inputs with is_last, true for each worker's last row."""
    return inputs.withColumn("is_last", F.lead(order).over(Window.partitionBy(worker).orderBy(order)).isNull())


def optimize(inputs: DataFrame, fn: Callable, schema: str, output: str, order: str, chunk_size: int | None = None, chunk_bytes: int | str | None = None, workers: int = 1, weight: str | None = None, mode: str | None = None, fast_dev_run: bool | int = False, batch_size: int | None = None, compression: str | None = None, use_checkpoint: bool = False) -> DataFrame:
    """Apply fn to the inputs and write its rows as chunks with a manifest; the table of chunks.

    Workers have consecutive shares of the inputs, or shares of equal weight. A chunk has up to chunk_size rows, or up
    to chunk_bytes bytes of values; one of the two must be given. mode: None (the output must not be there), append, overwrite.
    With use_checkpoint, what fn made of a lot of inputs stays in the output's folder until the manifest is there, and a
    run of the same inputs and workers that follows a lost one goes on with the next lot.
    """
    from grainmill.functions.helpers import bytes_of
    from grainmill.sources import manifest

    if mode not in (None, "append", "overwrite"):
        raise ValueError("mode is None, append or overwrite")
    if (chunk_size is None) == (chunk_bytes is None):
        raise ValueError("give one of chunk_size and chunk_bytes")
    if inputs.isEmpty():
        raise ValueError("there are no inputs")
    rows = dealt(inputs, workers, order, weight)
    if fast_dev_run:
        rows = first_rows(rows, TRIAL_ROWS if fast_dev_run is True else int(fast_dev_run), "worker", "idx")
    if batch_size:
        rows = batched(rows, batch_size).withColumn("idx", F.col("batch")).withColumn("worker", F.col("items")[0]["worker"])
    limit = bytes_of(chunk_bytes) if isinstance(chunk_bytes, str) else chunk_bytes
    if not use_checkpoint:
        return manifest.write_chunks(_numbered(rows, fn, schema), output, chunk_size, limit, mode, compression)
    if mode is None and manifest.exists(rows.sparkSession, f"{output}/{manifest.INDEX}"):
        raise ValueError(f"{output} has a dataset; say append or overwrite")
    made = _lot_by_lot(rows, fn, schema, f"{output}/{CHECKPOINT}")
    table = manifest.write_chunks(made, output, chunk_size, limit, mode, compression)
    manifest.remove(rows.sparkSession, f"{output}/{CHECKPOINT}")
    return table


def _lot_by_lot(rows: DataFrame, fn: Callable, schema: str, folder: str) -> DataFrame:
    """fn's rows of all lots of rows(idx, worker, ...), from files; lots that folder has whole are not made again."""
    from grainmill.sources import manifest

    spark = rows.sparkSession
    n, last, digest = rows.agg(F.count("*"), F.max("idx"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)"))).first()
    now = {"schema": schema, "inputs": [str(n), str(last), str(digest)]}
    if manifest.exists(spark, f"{folder}/{manifest.INDEX}"):
        if manifest.read_index(spark, folder) != now:
            raise ValueError(f"{folder} is of other inputs or workers")
    else:
        rows.withColumn("_lot", F.floor(F.col("idx") * LOTS / (last + 1)).cast("int")).write.mode("overwrite").partitionBy("_lot").parquet(f"{folder}/inputs")
        manifest.save_index(spark, folder, now)
    ended = []
    for i in range(LOTS):
        if not manifest.exists(spark, f"{folder}/inputs/_lot={i}"):
            continue
        ended.append(f"{folder}/made-{i}")
        if not manifest.exists(spark, f"{ended[-1]}/_SUCCESS"):
            _numbered(spark.read.schema(rows.schema).parquet(f"{folder}/inputs/_lot={i}"), fn, schema).write.mode("overwrite").parquet(ended[-1])
    return spark.read.schema(f"{schema}, _worker long, _idx long, _sub long").parquet(*ended)


def _numbered(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn's rows with the worker and the place (idx, sub) of their input."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                made = fn({k: v for k, v in row.items() if k not in ("idx", "worker")})
                made = made if inspect.isgenerator(made) else [] if made is None else [made]
                out.extend({**m, "_worker": row["worker"], "_idx": row["idx"], "_sub": i} for i, m in enumerate(made))
            yield from pa.Table.from_pylist(out, schema=shape).to_batches()

    schema = f"{schema}, _worker long, _idx long, _sub long"
    shape = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return rows.mapInArrow(run, schema)


def run_for_files(inputs: DataFrame, fn: Callable, output: str, workers: int, order: str) -> None:
    """fn(row, folder, is_last) for each input; it writes files under the folder and returns nothing. The folder must be shared."""
    rows = with_last(dealt(inputs, workers, order)).repartition(workers, "worker").sortWithinPartitions("idx")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                last = bool(row.pop("is_last"))
                if fn({k: v for k, v in row.items() if k not in ("idx", "worker")}, output, last) is not None:
                    raise ValueError("a function for files must return None")
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()
