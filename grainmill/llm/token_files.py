"""Token ids in Arrow files of equal-length sequences.

A file is an Arrow IPC file, uncompressed: record batches with a fixed-size list of ids and one of mask bits, so row r
of a batch is at a place that its number alone gives, and a memory map of the file is the arrays themselves. The ids of
the documents follow each other through the sequences; a mask is a bit for each id, 0 in the filling after a file's last
id. Beside it, a
file of the same format lists its documents: doc_id, where their ids start in the file, how many they are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm import pretokens
from grainmill.llm._common import Workspace, input_bytes, ship, table

#: Ids of a sequence, sequences of a record batch, and bytes of the input for each file.
LENGTH, ROWS, FILE_BYTES = 2048, 512, 16 << 20
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 8 << 20

FILES = "part int, path string, n_ids long, n_docs long"


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder that Spark names; Spark's scheme names are put as Arrow knows them."""
    scheme, found, rest = uri.partition(":")
    if not found or "/" in scheme:
        return pa.fs.LocalFileSystem(), uri
    names = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfss": "abfss", "abfs": "abfs"}
    return pa.fs.FileSystem.from_uri(f"{names.get(scheme, scheme)}://{rest.lstrip('/')}" if scheme in names else f"{scheme}:///{rest.lstrip('/')}" if scheme == "file" else uri)


def sequence_schema(dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Writes ids as they come; close() fills up the last sequence."""

    def __init__(self, sink, dtype, length: int = LENGTH, rows: int = ROWS, fill: int = 0):
        self.schema, self.dtype, self.length, self.rows, self.fill = sequence_schema(dtype, length), dtype, length, rows, fill
        self.out, self.rest, self.n = pa.ipc.new_file(sink, self.schema), [], 0
        self.waiting = 0

    def _write(self, ids: np.ndarray, n_real: int) -> None:
        mask = np.arange(len(ids)) < n_real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def write(self, ids: np.ndarray) -> None:
        self.rest.append(ids.astype(self.dtype, copy=False))
        self.waiting += len(ids)
        self.n += len(ids)
        step = self.length * self.rows
        if self.waiting >= step:
            every = np.concatenate(self.rest)
            full = len(every) // step * step
            for at in range(0, full, step):
                self._write(every[at : at + step], step)
            self.rest, self.waiting = [every[full:].copy()], len(every) - full

    def close(self) -> None:
        every = np.concatenate(self.rest) if self.rest else np.zeros(0, dtype=self.dtype)
        if len(every):
            filled = np.full(-(-len(every) // self.length) * self.length, self.fill, dtype=self.dtype)
            filled[: len(every)] = every
            self._write(filled, len(every))
        self.out.close()


class SequenceFile:
    """Random access to the sequences of a file: sequence(i) is a view of the mapped file, without a copy."""

    def __init__(self, source):
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        rows = [self.reader.get_batch(i).num_rows for i in range(self.reader.num_record_batches)]
        self.starts = np.concatenate([[0], np.cumsum(rows)]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.starts[-1])

    def _batch(self, b: int, name: str) -> pa.Array:
        return self.reader.get_batch(b).column(name).flatten()

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The ids as an array, the mask as bits in Arrow's array: views of the file both."""
        b = int(np.searchsorted(self.starts, i, side="right")) - 1
        at = (i - int(self.starts[b])) * self.length
        ids, mask = (self._batch(b, name).slice(at, self.length) for name in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask

    def batches(self):
        """(place of the first id in the file, ids without the filling) of each record batch."""
        for b in range(self.reader.num_record_batches):
            ids, mask = self._batch(b, "ids").to_numpy(zero_copy_only=True), self._batch(b, "mask").to_numpy(zero_copy_only=False)
            yield int(self.starts[b]) * self.length, ids if mask.all() else ids[mask]


def _write_files(folder: str, content, kind: str, end_id: int, length: int):
    def run(batches):
        tokenizer = pretokens.load(content.value, kind)
        fs, path = open_folder(folder)
        task = TaskContext.get()
        part, own = task.partitionId(), f"{path}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        writer, documents, sinks, n_docs = None, None, [], 0
        for batch in batches:
            texts, doc_ids = pretokens.text_column(batch), batch.column("doc_id").cast(pa.int64())
            for at, to in pretokens.slices(texts, ENCODE_BYTES):
                ids, ends = tokenizer.encode_texts(texts.slice(at, to - at))
                k = to - at
                with_end = np.insert(ids, ends[1:], tokenizer.dtype(end_id))
                ends = ends + np.arange(k + 1)
                if writer is None:
                    fs.create_dir(path, recursive=True)
                    sinks = [fs.open_output_stream(f"{own}.{x}") for x in ("ids", "docs")]
                    writer, documents = SequenceWriter(sinks[0], tokenizer.dtype, length, fill=end_id), pa.ipc.new_file(sinks[1], DOCUMENTS)
                documents.write_batch(pa.RecordBatch.from_arrays([doc_ids.slice(at, k), pa.array(writer.n + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64())], schema=DOCUMENTS))
                writer.write(with_end)
                n_docs += k
        if writer is not None:
            writer.close()
            documents.close()
            for s in sinks:
                s.close()
            for x in ("ids", "docs"):  # a repeated task's file is the same; the last one to be moved stays
                fs.move(f"{own}.{x}", f"{path}/part-{part:06d}.{x}.arrow")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"part-{part:06d}"]), pa.array([writer.n], pa.int64()), pa.array([n_docs], pa.int64())], names=["part", "path", "n_ids", "n_docs"])

    return run


def write_sequences(docs: DataFrame, folder: str, path: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Encode docs(doc_id, text) in ascending doc_id order into files in folder; the files' table: part, path, n_ids, n_docs, base.

    folder must be one that all executors and readers see. Documents are dealt by ranges of doc_id, one file a range, so
    that file order and order in a file are doc_id order (nulls first, equal ids by text). base: ids in all files before.
    """
    spark = docs.sparkSession
    ship(spark)
    content, kind = pretokens.read_tokenizer(spark, path)
    size = input_bytes(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(max(1, -(-size // FILE_BYTES)), "doc_id").sortWithinPartitions("doc_id", "text")
    files = rows.mapInArrow(_write_files(folder, content, kind, end_id, length), FILES)
    files = Workspace(spark).stored(files, "files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read_files(folder: str):
    def run(batches):
        fs, path = open_folder(folder)
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                local = isinstance(fs, pa.fs.LocalFileSystem)
                source = pa.memory_map(f"{path}/{name}.ids.arrow") if local else fs.open_input_file(f"{path}/{name}.ids.arrow")
                docs = pa.ipc.open_file(fs.open_input_file(f"{path}/{name}.docs.arrow")).read_all()
                start, n = (docs.column(x).to_numpy() for x in ("start", "n_tokens"))
                ends, crc, at = start + n, np.zeros(len(n), dtype=np.int64), 0
                for first, ids in SequenceFile(source).batches():
                    wide, last = ids.astype("<u4"), first + len(ids)
                    while at < len(n) and start[at] < last:
                        a, b = max(int(start[at]), first), min(int(ends[at]), last)
                        crc[at] = zlib.crc32(wide[a - first : b - first].data, int(crc[at]))
                        if ends[at] > last:
                            break
                        at += 1
                yield pa.RecordBatch.from_arrays([docs.column("doc_id").combine_chunks(), pa.array(start + base, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; a file is read by one task, batch by batch."""
    dealt = files.select("part", "path", "base").repartitionByRange(max(1, files.count()), "part")
    return dealt.mapInArrow(_read_files(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = Workspace(spark).path("sequences")
    files = Workspace(spark).stored(write_sequences(docs, folder, public_tokenizers.path("word_bpe_49k.json")), "bases")
    return read_documents(files, folder)
