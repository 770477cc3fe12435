"""Row chunks in one binary layout, as a Spark data source of the name `chunkbin`.

A chunk is: the number of items, their offsets (one more than items, from the start of the file), and the items. An item
is the sizes of its leaves, then the leaves; all numbers are unsigned 32-bit little-endian. A null leaf has the size NULL
and no bytes. Options: path, a folder that driver and executors share; compression, a codec's name; chunk_size, rows.
A write in append mode adds its chunks behind those that are there, overwrite replaces them once the new ones are whole.
"""

from __future__ import annotations

import glob
import json
import os
import struct
import uuid

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from grainmill.functions import codecs

KEYS = {"string": "str", "boolean": "bool", "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "binary": "bytes"}
#: The size of a leaf that is null; no leaf is as long.
NULL = (1 << 32) - 1
#: Up to so many chunks are read in a task each; of more, a task reads up to so many bytes.
SINGLE, READ_BYTES = 64, 16 << 20
TYPES = {"str": "string", "bool": "boolean", "int": "bigint", "float": "double", "bytes": "binary", "pickle": "binary"}


def packed(items: list[list[bytes | None]]) -> bytes:
    rows = [struct.pack(f"<{len(x)}I", *[NULL if leaf is None else len(leaf) for leaf in x]) + b"".join(leaf or b"" for leaf in x) for x in items]
    at, offsets = 4 + 4 * (len(rows) + 1), []
    for r in rows:
        offsets.append(at)
        at += len(r)
    return struct.pack(f"<{len(rows) + 2}I", len(rows), *offsets, at) + b"".join(rows)


def item(data: bytes, i: int, leaves: int) -> list[bytes | None]:
    """The leaves of item i, found by its offset alone."""
    a, b = struct.unpack_from("<2I", data, 4 + 4 * i)
    sizes, at, out = struct.unpack_from(f"<{leaves}I", data, a), a + 4 * leaves, []
    for n in sizes:
        out.append(None if n == NULL else data[at : at + n])
        at += 0 if n == NULL else n
    assert at == b
    return out


class _Chunks(InputPartition):
    def __init__(self, chunks: list[tuple[str, int]]):
        self.chunks = chunks


def dealt(chunks: list[dict]) -> list[list[tuple[str, int]]]:
    """Runs of chunks (file name, rows) to read in a task each: single chunks up to SINGLE of them, else of up to READ_BYTES, or one chunk, in SINGLE runs at least."""
    most = min(READ_BYTES, sum(c["chunk_bytes"] for c in chunks) // SINGLE) if len(chunks) > SINGLE else 0
    runs, held = [], 0
    for c in chunks:
        if not runs or held + c["chunk_bytes"] > most:
            runs.append([])
            held = 0
        runs[-1].append((c["filename"], c["chunk_size"]))
        held += c["chunk_bytes"]
    return runs


class _Reader(DataSourceReader):
    """Every task gets a copy of it, so it has no list of chunks."""

    def __init__(self, folder: str, config: dict):
        self.folder, self.config = folder, config

    def partitions(self):
        with open(os.path.join(self.folder, "index.json")) as f:
            return [_Chunks(run) for run in dealt(json.load(f)["chunks"])]

    def read(self, partition):
        keys = self.config["data_format"]
        expand = codecs.compressor(self.config["compression"])[1]
        decode = [codecs.codec(k)[1] for k in keys]
        for name, rows in partition.chunks if partition else ():
            with open(os.path.join(self.folder, name), "rb") as f:
                data = expand(f.read())
            for i in range(rows):
                yield tuple(None if x is None else d(x) for d, x in zip(decode, item(data, i, len(keys)), strict=True))


class _Done(WriterCommitMessage):
    def __init__(self, chunks: list[dict]):
        self.chunks = chunks


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, schema, options, overwrite: bool):
        self.folder, self.names, self.overwrite = folder, schema.names, overwrite
        self.keys = [KEYS[f.dataType.simpleString()] for f in schema.fields]
        self.compression, self.size = options.get("compression"), int(options.get("chunk_size", 1024))
        self.run = uuid.uuid4().hex[:8]
        if os.path.exists(there := os.path.join(folder, "index.json")):
            with open(there) as f:
                index = json.load(f)
            config = index["config"]
            if not overwrite and (config["data_format"], config.get("data_spec"), config["compression"]) != (self.keys, self.names, self.compression):
                raise ValueError(f"{folder} has another format")

    def _old(self) -> list[dict]:
        if not os.path.exists(there := os.path.join(self.folder, "index.json")):
            return []
        with open(there) as f:
            return json.load(f)["chunks"]

    def write(self, rows):
        from pyspark import TaskContext

        rank, press = TaskContext.get().partitionId(), codecs.compressor(self.compression)[0]
        encode, made, waiting = [codecs.codec(k)[0] for k in self.keys], [], []
        suffix = f".{self.compression.partition(':')[0]}" if self.compression else ""

        def close():
            name = f"chunk-{self.run}-{rank}-{len(made)}{suffix}.bin"
            data = packed(waiting)
            beside = os.path.join(self.folder, f".{name}.{TaskContext.get().taskAttemptId()}")
            os.makedirs(self.folder, exist_ok=True)
            with open(beside, "wb") as f:
                f.write(press(data))
            os.replace(beside, os.path.join(self.folder, name))
            made.append({"filename": name, "chunk_size": len(waiting), "chunk_bytes": len(data), "dim": None, "rank": rank, "number": len(made)})
            waiting.clear()

        for row in rows:
            waiting.append([None if v is None else e(v) for e, v in zip(encode, row, strict=True)])
            if len(waiting) == self.size:
                close()
        if waiting:
            close()
        return _Done(made)

    def commit(self, messages):
        made = sorted((c for m in messages if m for c in m.chunks), key=lambda c: (c["rank"], c["number"]))
        os.makedirs(self.folder, exist_ok=True)
        config = {"data_format": self.keys, "data_spec": self.names, "compression": self.compression, "chunk_size": self.size, "chunk_bytes": None, "encryption": None, "item_loader": "pytree"}
        old = self._old()
        index, beside = os.path.join(self.folder, "index.json"), os.path.join(self.folder, f".index-{self.run}")
        with open(beside, "w") as f:
            json.dump({"chunks": [*([] if self.overwrite else old), *made], "config": config}, f)
        os.replace(beside, index)
        for c in old if self.overwrite else ():
            os.remove(os.path.join(self.folder, c["filename"]))

    def abort(self, messages):
        for path in [p for shape in (".chunk-", "chunk-") for p in glob.glob(os.path.join(self.folder, f"{shape}{self.run}-*"))]:
            os.remove(path)


class ChunkBin(DataSource):
    @classmethod
    def name(cls):
        return "chunkbin"

    def _index(self) -> dict:
        with open(os.path.join(self.options["path"], "index.json")) as f:
            return json.load(f)

    def schema(self):
        config = self._index()["config"]
        names = config.get("data_spec") or [f"_{i}" for i in range(len(config["data_format"]))]
        return ", ".join(f"`{n}` {TYPES.get(k, 'binary')}" for n, k in zip(names, config["data_format"], strict=True))

    def reader(self, schema):
        return _Reader(self.options["path"], self._index()["config"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], schema, self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(ChunkBin)
