import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
from grainmill.llm import pretokens, token_counts, token_files, unigram  # noqa: E402

TEXTS = ["", "  a  b ", "<|endoftext|> Hello <|ENDOFTEXT|>", "É x it's DON'T 12 3́ ß İ", "a\n\n  b\x0b\tc   ", "the, the. The!? the", "日本語 😀 x", "word " * 500, "x" * 400]
EDGE = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, None), (None, "null id"), (50, None)]


def frame(spark, rows=EDGE):
    return spark.createDataFrame([(i, t, "s", -1, "x") for i, t in rows], "doc_id long, text string, source string, n_tokens long, ids string")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_pretokens_give_the_library_ids(name):
    with open(P.path(name), "rb") as f:
        t = pretokens.Pretokenizer(f.read(), name.rpartition(".")[2])
    ids, ends = t.encode_texts(pa.array(TEXTS))
    want = t.library.encode(TEXTS) if name.endswith("model") else [e.ids for e in t.library.encode_batch(TEXTS, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def order(row):
    return (row[0] is not None, row[0] or 0, row[1:])


def test_counts(spark):
    t = library()
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in EDGE]
    got = [tuple(r) for r in token_counts.token_counts(frame(spark), P.path("word_bpe_49k.json")).collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert token_counts.token_counts(frame(spark).limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_packed_numbers():
    for x in ([], [0], [1, 2**31, 5], list(range(300))):
        assert token_counts.unpack(token_counts.pack(np.array(x, dtype=np.int64))).tolist() == x
    assert token_counts.unpack_words(token_counts.pack_words([b"", "é".encode(), b"abc"])).to_pylist() == ["", "é", "abc"]


def test_files(spark, tmp_path):
    t, want, at = library(), [], 0
    for i, x in sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    folder = f"file://{tmp_path}/files"
    files = token_files.write_sequences(frame(spark), folder, P.path("word_bpe_49k.json"), length=16)
    got = [tuple(r) for r in token_files.read_documents(files, folder).orderBy("start").collect()]
    assert got == want
    assert token_files.read_documents(token_files.write_sequences(frame(spark).limit(0), folder + "0", P.path("word_bpe_49k.json")), folder + "0").count() == 0


def test_random_access(tmp_path):
    path = str(tmp_path / "x.arrow")
    with pa.OSFile(path, "wb") as sink:
        w = token_files.SequenceWriter(sink, np.uint16, length=8, rows=4)
        w.write(np.arange(50))
        w.write(np.arange(50, 75))
        w.close()
    f = token_files.SequenceFile(pa.memory_map(path))
    assert len(f) == 10
    ids, mask = f.sequence(9)
    assert ids.tolist() == [72, 73, 74, 0, 0, 0, 0, 0] and mask.to_pylist() == [True] * 3 + [False] * 5
    assert f.sequence(4)[0].tolist() == list(range(32, 40))
    assert ids.base is not None  # a view


def test_unigram_is_the_best_way(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        content = f.read()
    model = unigram.Unigram(*unigram.compiled(content))
    _, scores, _, _ = unigram.read_pieces(content)
    proto = pb.ModelProto()
    proto.ParseFromString(content)
    proto.trainer_spec.model_type = 1
    for p, s in zip(proto.pieces, scores, strict=True):
        p.score = s
    processor = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    ids, ends = model.encode_texts(pa.array(TEXTS))
    total = lambda x: sum(scores[i] for i in x)
    for text, a, b in zip(TEXTS, ends[:-1], ends[1:], strict=True):
        own, other = ids[a:b].tolist(), processor.encode(text)
        assert own == other or total(own) >= total(other) - 1e-6  # the library adds up in single precision
        assert processor.decode(own) == text or text.strip(" ") != text
    assert [x.decode() for x in model.decode(ids, ends)] == TEXTS


def test_encode_and_decode(spark):
    path = P.path("piece_bpe_32k.model")
    encoded = unigram.encode(frame(spark), path)
    assert encoded.where("not round_trip").count() == 0 and encoded.count() == len(EDGE)
    got = sorted((tuple(r) for r in unigram.decode(encoded, path).collect()), key=order)
    assert got == sorted([(i, t or "") for i, t in EDGE], key=order)
    marked = unigram.encode(frame(spark, [(1, "a▁b")]), path).first()
    assert not marked["round_trip"]
    assert unigram.encode(frame(spark).limit(0), path).count() == 0
    assert unigram.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).first()["text"] == ""


def test_trie():
    keys = [b"a", b"ab", b"b", "é".encode(), bytes([255, 0])]
    base, check, value = unigram.build_trie(keys)

    def find(key):
        node = 0
        for c in key:
            child = base[node] + c + 1
            if check[child] != node:
                return -1
            node = child
        return value[node]

    assert [find(k) for k in keys] == list(range(5)) and find(b"ac") == -1 and find("é".encode()[:1]) == -1


def test_no_value_of_a_block_is_large(spark, monkeypatch):
    """A document is in one run; what a run has grows with RUN_WORDS, not with the Arrow batch."""
    rows = [(i, " ".join(f"w{(i * k) % 4999}x{k % 13}" for k in range(1 + i * 7 % 500))) for i in range(3000)] + [(5000, None), (5001, ""), (None, "null id"), (5002, "long " * 150_000)]
    texts, sizes = pa.array([t or "" for _, t in rows]), []
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), texts], names=["doc_id", "text"])
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        block = token_counts._block(batch, texts, 0, 8, pretokens.load(f.read(), "json"))
    for name in ("docs", "freq", "idx", "words"):
        sizes += [len(x) for x in block.column(name).to_pylist() if x is not None]
    assert max(sizes) < 512 << 10
    monkeypatch.setattr(token_counts, "RUN_WORDS", 700)
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), P.path("word_bpe_49k.json"))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
