"""Token counts without ids: pieces are counted once for each distinct pre-token of the corpus.

1. Each block of documents is split into pre-tokens: its dictionary, and for each document the frequencies of its
   pre-tokens as codes in that dictionary. A pre-token leaves a block once, however often it occurs there.
2. The dictionaries meet by hash of the pre-token. There each distinct pre-token goes through the library once.
3. The counts go back to the blocks' codes, are joined to the documents' frequencies, and summed.

What is shuffled are packed columns of a block or of a run of its documents, not rows of words, so the sizes are near to those of the data itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm import pretokens
from grainmill.llm._common import Workspace, input_bytes, ship, table

#: Bytes of text in a block, and of input for each part of the dictionaries.
BLOCK_BYTES, PART_BYTES = 32 << 20, 8 << 20
#: Words of the documents whose frequencies are a row: values of more than half a MB are moved and kept by the JVM as humongous objects.
RUN_WORDS = 100_000

BLOCKS = "part int, block long, docs binary, freq binary, idx binary, words binary"
COUNTS = "block long, idx binary, n binary"


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative whole numbers, by planes of their bytes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=max(4 * n, 1)), dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    lengths = pack(np.array([len(w) for w in words], dtype=np.int64))
    return len(lengths).to_bytes(8, "little") + lengths + zstandard.ZstdCompressor(level=1).compress(b"".join(words))


def unpack_words(data: bytes) -> pa.Array:
    n = int.from_bytes(data[:8], "little")
    lengths = unpack(data[8 : 8 + n])
    flat = zstandard.ZstdDecompressor().decompress(data[8 + n :], max_output_size=max(int(lengths.sum()), 1))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat)).cast(pa.large_string())


def _table_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _runs(ends: np.ndarray):
    """Ranges of documents with up to RUN_WORDS words, or one longer."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + RUN_WORDS, side="right")) - 1)
        yield at, to
        at = to


def _block(batch: pa.RecordBatch, texts: pa.Array, block: int, parts: int, tokenizer) -> pa.RecordBatch:
    split, codes, ends = pretokens.factorized(tokenizer.split(texts))
    first, second = tokenizer.parts(split.to_pylist())
    code_of = {p: i for i, p in enumerate(dict.fromkeys(p for p in (*first, *second) if p))}
    listed = [p.encode() for p in code_of]
    of = [np.array([code_of.get(p, -1) for p in x], dtype=np.int64) for x in (first, second)]
    del first, second, split
    width, docs, freq = max(len(listed), 1), [], []
    named = batch.select(["doc_id"]).append_column("n_bytes", pc.binary_length(texts).cast(pa.int64()))
    for at, to in _runs(ends):
        row = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))
        words = codes[ends[at] : ends[to]]
        code = np.concatenate([x[words] for x in of])
        pairs, counts = np.unique((np.concatenate([row, row]) * width + code)[code >= 0], return_counts=True)
        row, code = np.divmod(pairs, width)
        n = np.bincount(row, minlength=to - at)
        code[1:] -= np.where(row[1:] == row[:-1], code[:-1], 0)  # gaps within a document
        docs.append(_table_bytes(named.slice(at, to - at)))
        freq.append(b"".join(len(x).to_bytes(8, "little") + x for x in (pack(n), pack(code), pack(counts))))
    part = np.fromiter((zlib.crc32(w) for w in listed), dtype=np.int64, count=len(listed)) % parts
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    full = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
    idx = [pack(order[cuts[p] : cuts[p + 1]]) for p in full]
    packed = [pack_words([listed[i] for i in order[cuts[p] : cuts[p + 1]]]) for p in full]
    none, no_words = [None] * len(full), [None] * len(docs)
    return pa.RecordBatch.from_arrays(
        [pa.array([-1] * len(docs) + full, pa.int32()), pa.array([block] * (len(docs) + len(full)), pa.int64()), *[pa.array(x, pa.binary()) for x in (docs + none, freq + none, no_words + idx, no_words + packed)]],
        names=["part", "block", "docs", "freq", "idx", "words"],
    )


def _blocks(content, kind: str, parts: int):
    def run(batches):
        tokenizer = pretokens.load(content.value, kind)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = pretokens.text_column(batch)
            for at, to in pretokens.slices(texts, BLOCK_BYTES):
                yield _block(batch.slice(at, to - at), texts.slice(at, to - at), block, parts, tokenizer)
                block += 1
                pretokens.trim()

    return run


def _count_part(content, kind: str):
    def run(part: pa.Table) -> pa.Table:
        tokenizer = pretokens.load(content.value, kind)
        each = [unpack_words(x) for x in part.column("words").to_pylist()]
        coded = pa.chunked_array(each, pa.large_string()).combine_chunks().dictionary_encode()
        n = tokenizer.count(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        counts = [pack(n[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        del each, coded
        pretokens.trim()
        return pa.table({"block": part.column("block"), "idx": part.column("idx"), "n": pa.array(counts, pa.binary())})

    return run


def _sum_block(key, block: pa.Table, counts: pa.Table) -> pa.Table:
    idx = [unpack(x) for x in counts.column("idx").to_pylist()]
    n = [unpack(x) for x in counts.column("n").to_pylist()]
    pieces = np.zeros(1 + max((int(x.max()) for x in idx if len(x)), default=-1), dtype=np.int64)
    for i, k in zip(idx, n, strict=True):
        pieces[i] = k
    out = [_sum_run(docs, freq, pieces) for docs, freq in zip(*(block.column(c).to_pylist() for c in ("docs", "freq")), strict=True)]
    pretokens.trim()
    return pa.concat_tables(out)


def _sum_run(docs: bytes, data: bytes, pieces: np.ndarray) -> pa.Table:
    docs, packed = pa.ipc.open_stream(docs).read_all(), []
    while data:
        size = int.from_bytes(data[:8], "little")
        packed.append(unpack(data[8 : 8 + size]))
        data = data[8 + size :]
    each, code, count = packed
    ends = np.concatenate([[0], np.cumsum(each)])
    total = np.concatenate([[0], np.cumsum(code)])
    if len(code):  # undo the gaps: a document's codes are running sums from its own start
        starts = np.repeat(total[ends[:-1]], each)
        code = total[1:] - starts
    words = np.concatenate([[0], np.cumsum(pieces[code] * count)])
    return pa.table({"doc_id": docs.column("doc_id").cast(pa.int64()), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(words[ends[1:]] - words[ends[:-1]], pa.int64())})


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs(doc_id, text), by the tokenizer file at path.

    A json file is read by tokenizers, a model file by sentencepiece; counts are theirs, without added begin, end or
    special tokens. A null text counts as empty: 0 bytes, 0 tokens. Rows that repeat, also with null doc_id, each give
    a row. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    content, kind = pretokens.read_tokenizer(spark, path)
    work = Workspace(spark)
    size = input_bytes(docs)
    parts = min(max(8, size // PART_BYTES), 1 << 20)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = work.stored(rows.mapInArrow(_blocks(content, kind, parts), BLOCKS), "blocks", "uncompressed")
    words = blocks.where("part >= 0").select("part", "block", "idx", "words")
    counted = words.groupBy("part").applyInArrow(_count_part(content, kind), COUNTS)
    freq = blocks.where("part < 0").select("block", "docs", "freq")
    return freq.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_sum_block, "doc_id long, n_bytes long, n_tokens long")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("over_limit", F.col("n_tokens") > 2048)
