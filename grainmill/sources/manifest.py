"""Chunks on storage and their manifest, index.json: writing, reading, appending, merging.

Files go through Spark's own file systems, so a folder may be on any that Spark knows. The manifest is small, a row for
each chunk; it is the only thing that passes the driver.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEX = "index.json"
CHUNKS = "chunk long, rank long, filename string, chunk_size long, chunk_bytes long, dim long"


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def read_index(spark: SparkSession, folder: str) -> dict:
    text = spark.read.text(f"{folder}/{INDEX}", wholetext=True).first()
    return json.loads(text[0])


def save_index(spark: SparkSession, folder: str, index: dict) -> None:
    """Written beside and renamed, so that a reader never sees half of it."""
    fs, p = _path(spark, f"{folder}/{INDEX}")
    _, beside = _path(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(index, sort_keys=True).encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"{folder}/{INDEX} could not be written")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The table of chunks: chunk (their order), filename, chunk_size, chunk_bytes, dim."""
    rows = [(i, c.get("rank", 0), c["filename"], c["chunk_size"], c["chunk_bytes"], c.get("dim")) for i, c in enumerate(read_index(spark, folder)["chunks"])]
    return spark.createDataFrame(rows, CHUNKS)


def _value_bytes(df: DataFrame):
    sizes = {"string": lambda c: F.octet_length(c), "binary": lambda c: F.octet_length(c), "boolean": lambda c: F.lit(1), "tinyint": lambda c: F.lit(1), "smallint": lambda c: F.lit(2), "int": lambda c: F.lit(4), "float": lambda c: F.lit(4)}
    total = F.lit(0)
    for name, kind in df.dtypes:
        if not name.startswith("_"):
            total = total + F.coalesce(sizes.get(kind, lambda c: F.octet_length(F.to_json(F.struct(c))) if "<" in kind else F.lit(8))(F.col(name)), F.lit(0))  # noqa: B023
    return total.cast("long")


def write_chunks(rows: DataFrame, folder: str, chunk_size: int | None, chunk_bytes: int | None, mode: str | None, compression: str | None) -> DataFrame:
    """Write rows(_worker, _idx, _sub, columns) as Parquet chunks of each worker and the manifest; the table of chunks.

    rows are made once, into a staging table of the folder; what numbers, packs and counts them reads that. An overwrite
    replaces the manifest when the new chunks are whole, and only then are the old ones deleted.
    """
    from grainmill.operators.packing import by_weight

    spark = rows.sparkSession
    there = exists(spark, f"{folder}/{INDEX}")
    if there and mode is None:
        raise ValueError(f"{folder} has a dataset; say append or overwrite")
    before = read_index(spark, folder) if there else None
    old = before if mode == "append" else None
    names = [c for c in rows.columns if not c.startswith("_")]
    config = {"data_format": [f"{n}:{t}" for n, t in rows.select(names).dtypes], "compression": compression, "chunk_size": chunk_size, "chunk_bytes": chunk_bytes, "encryption": None, "item_loader": "parquet"}
    if old and (old["config"]["data_format"] != config["data_format"] or old["config"]["compression"] != compression):
        raise ValueError("the dataset has another format")
    run = uuid.uuid4().hex[:8]
    staging = f"{folder}/_staging-{run}"
    rows.write.parquet(staging)
    rows = spark.read.schema(rows.schema).parquet(staging)
    first = {c.get("rank", 0): c["number"] for c in sorted(old["chunks"], key=lambda c: c["number"])} if old else {}
    place = Window.partitionBy("_worker").orderBy("_idx", "_sub")
    ordered = rows.withColumn("_bytes", _value_bytes(rows)).withColumn("_place", F.row_number().over(place).cast("long") - 1)
    if chunk_size:
        packed = ordered.withColumn("_number", F.floor(F.col("_place") / chunk_size).cast("long"))
    else:
        numbers = by_weight(ordered, "_bytes", chunk_bytes, "_worker", "_place", "_number").drop("_bytes")
        packed = ordered.join(numbers, ["_worker", "_place"])
    start = F.create_map(*[F.lit(x) for r, n in first.items() for x in (r, n + 1)])[F.col("_worker")] if first else F.lit(None)
    packed = packed.withColumn("_number", F.col("_number") + F.coalesce(start, F.lit(0)))
    target = f"{folder}/run-{run}"
    dealt = packed.repartition("_worker", "_number").sortWithinPartitions("_worker", "_number", "_place")
    writer = dealt.select(*names, "_place", F.col("_worker").alias("rank"), F.col("_number").alias("number")).write
    writer.option("compression", compression or "snappy").partitionBy("rank", "number").parquet(target)
    stats = packed.groupBy("_worker", "_number").agg(F.count("*").alias("n"), F.sum("_bytes").alias("b")).orderBy("_worker", "_number").collect()
    made = [{"rank": r["_worker"], "number": r["_number"], "filename": f"run-{run}/rank={r['_worker']}/number={r['_number']}", "chunk_size": r["n"], "chunk_bytes": r["b"], "dim": None} for r in stats]
    # By rank and number as numbers; an appended run comes after what is there.
    save_index(spark, folder, {"chunks": [*(old["chunks"] if old else []), *made], "config": config, "updated_at": str(time.time())})
    gone = {c["filename"].partition("/")[0] for c in before["chunks"]} if mode == "overwrite" and before else set()
    for name in (f"_staging-{run}", *gone):
        remove(spark, f"{folder}/{name}")
    return chunks(spark, folder)


def read_rows(spark: SparkSession, folder: str, taken: DataFrame | None = None) -> DataFrame:
    """The dataset's rows with chunk and row (their place in it); only the files of the chunks in taken(chunk), if given."""
    table = chunks(spark, folder)
    wanted = table if taken is None else table.join(taken.select("chunk").distinct(), "chunk", "left_semi")
    listed = wanted.select("chunk", "filename").collect()
    if not listed:
        raise ValueError(f"no chunk of {folder} is wanted")
    files = spark.read.parquet(*[f"{folder}/{r['filename']}" for r in listed])
    where = F.regexp_extract(F.col("_metadata.file_path"), r"(run-[0-9a-f]{8}/rank=\d+/number=\d+)", 1)
    names = F.broadcast(spark.createDataFrame([(r["chunk"], r["filename"]) for r in listed], "chunk long, _f string"))
    rows = files.withColumn("_w", where).join(names, F.col("_w") == F.col("_f"))
    return rows.withColumn("row", F.row_number().over(Window.partitionBy("chunk").orderBy("_place")).cast("long") - 1).drop("_w", "_f", "_place")


def merge(spark: SparkSession, folders: list[str], output: str) -> DataFrame:
    """A dataset of the folders' chunks, in the order of the folders; the table of chunks. The files are copied by Spark."""
    if len(folders) < 2 or len({f.rstrip("/") for f in folders}) < len(folders):
        raise ValueError("two different datasets or more are needed")
    for f in folders:
        if not exists(spark, f"{f}/{INDEX}"):
            raise ValueError(f"{f} has no {INDEX}")
    if exists(spark, f"{output}/{INDEX}"):
        raise ValueError(f"{output} has a dataset")
    found = [read_index(spark, f) for f in folders]
    for i in found[1:]:
        if any(i["config"][k] != found[0]["config"][k] for k in ("data_format", "compression")):
            raise ValueError("the datasets' formats differ")
    util, conf, made, number = spark._jvm.org.apache.hadoop.fs.FileUtil, spark.sparkContext._jsc.hadoopConfiguration(), [], 0
    for folder, index in zip(folders, found, strict=True):
        for c in index["chunks"]:
            name = f"run-{number // 1_000_000:08x}/rank=0/number={number}"
            (a, p), (b, q) = _path(spark, f"{folder}/{c['filename']}"), _path(spark, f"{output}/{name}")
            b.mkdirs(q.getParent())
            util.copy(a, p, b, q, False, conf)
            made.append({**c, "rank": 0, "number": number, "filename": name})
            number += 1
    save_index(spark, output, {"chunks": made, "config": found[0]["config"], "updated_at": str(time.time())})
    return chunks(spark, output)


def mds_chunks(index: dict) -> list[dict]:
    """The shards of an MDS index as chunks, in their order."""
    out = []
    for s in index["shards"]:
        raw = s.get("zip_data") or s["raw_data"]
        out.append({"filename": raw["basename"], "chunk_size": s["samples"], "chunk_bytes": raw["bytes"], "dim": None, "column_names": s["column_names"], "column_encodings": s["column_encodings"], "column_sizes": s["column_sizes"], "compression": s.get("compression")})
    return out


def index_parquet(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Parquet files as chunks: chunk (by name), filename, chunk_size (rows), chunk_bytes. No column is read, only footers and sizes."""
    reader = spark.read.option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)
    counts = files.groupBy(F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_size").alias("chunk_bytes")).agg(F.count("*").alias("chunk_size"))
    return counts.withColumn("chunk", F.row_number().over(Window.orderBy("filename")).cast("long") - 1).select("chunk", "filename", "chunk_size", "chunk_bytes")


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of every file under folder that is not empty; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
