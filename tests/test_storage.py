import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.functions import codecs, helpers
from grainmill.operators import transform
from grainmill.sources import chunkbin, manifest


same = lambda row: row  # noqa: E731  pickled by value: the executors do not have the tests


def test_modes(spark, tmp_path):
    rows, folder = spark.range(5).selectExpr("id", "id * id sq"), str(tmp_path / "a")
    write = lambda mode, **k: transform.optimize(rows, same, "id long, sq long", folder, "id", **({"chunk_size": 2} | k), mode=mode)
    assert [r["chunk_size"] for r in write(None).orderBy("chunk").collect()] == [2, 2, 1]
    with pytest.raises(ValueError):
        write(None)
    assert write("append").count() == 6
    assert write("overwrite").count() == 3
    for wrong in ({"mode": "x"}, {"mode": "append", "chunk_size": None}, {"mode": "append", "chunk_bytes": 10}):
        with pytest.raises(ValueError):
            write(**wrong)


def test_byte_chunks(spark, tmp_path):
    rows = spark.createDataFrame([(i, bytearray(n)) for i, n in enumerate((500, 10000, 150, 200))], "id long, data binary")
    table = transform.optimize(rows, same, "id long, data binary", str(tmp_path / "b"), "id", chunk_bytes=9000)
    assert [r["chunk_size"] for r in table.orderBy("chunk").collect()] == [1, 1, 2]


def test_workers_batches_and_trial(spark, tmp_path):
    rows = spark.range(40).selectExpr("id")
    table = transform.optimize(rows, same, "id long", str(tmp_path / "c"), "id", chunk_size=100, workers=2, fast_dev_run=3)
    assert [r["chunk_size"] for r in table.collect()] == [3, 3]
    batches = transform.batched(spark.range(5).withColumnRenamed("id", "idx"), 2)
    assert [[x["idx"] for x in r["items"]] for r in batches.orderBy("batch").collect()] == [[0, 1], [2, 3], [4]]
    with pytest.raises(ValueError):
        transform.optimize(rows.limit(0), same, "id long", str(tmp_path / "d"), "id", chunk_size=1)


def test_merge_checks(spark, tmp_path):
    for name, schema in (("x", "id long"), ("y", "id long"), ("z", "id string")):
        transform.optimize(spark.range(10).selectExpr(f"cast(id as {schema.split()[1]}) id"), same, schema, str(tmp_path / name), "id", chunk_size=4)
    with pytest.raises(ValueError):
        manifest.merge(spark, [str(tmp_path / "x")], str(tmp_path / "o"))
    with pytest.raises(ValueError):
        manifest.merge(spark, [str(tmp_path / "x"), str(tmp_path / "z")], str(tmp_path / "o"))
    assert manifest.merge(spark, [str(tmp_path / "x"), str(tmp_path / "y")], str(tmp_path / "o")).count() == 6
    with pytest.raises(ValueError):
        manifest.merge(spark, [str(tmp_path / "x"), str(tmp_path / "y")], str(tmp_path / "o"))


def test_files_of_a_function(spark, tmp_path):
    def write(row, folder, last):
        with open(f"{folder}/{row['id']}{'-last' if last else ''}", "w") as f:
            f.write("x")

    transform.run_for_files(spark.range(5), write, str(tmp_path), 2, "id")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0", "1-last", "2", "3", "4-last"]


def test_leaves_round_trip():
    for value in ("é", True, -5, 2.5, b"\0x", np.arange(4, dtype=np.int16), np.arange(6, dtype=np.float32).reshape(2, 3)):
        encode, decode = codecs.codec(codecs.key_of(value))
        assert np.array_equal(decode(encode(value)), value)
    for name in (None, "zstd", "zstd:22"):
        press, expand = codecs.compressor(name)
        assert expand(press(b"abc" * 100)) == b"abc" * 100
    with pytest.raises(ValueError):
        codecs.compressor("lz9")
    assert codecs.flattened({"a": (1, [2, 3]), "b": "x"}) == [("a._0", 1), ("a._1._0", 2), ("a._1._1", 3), ("b", "x")]


def test_layout_of_a_chunk():
    data = chunkbin.packed([[b"ab", b""], [b"c", b"defg"]])
    assert chunkbin.item(data, 0, 2) == [b"ab", b""] and chunkbin.item(data, 1, 2) == [b"c", b"defg"]
    # Two leaves of 8 bytes and their sizes are 24 bytes; an item of three is 36.
    assert len(chunkbin.packed([[b"x" * 8] * 3])) == 4 + 8 + 36


def test_mds_shards():
    shard = {"samples": 100, "column_names": ["class"], "column_encodings": ["int"], "column_sizes": [8], "compression": "zstd", "raw_data": {"basename": "s.mds", "bytes": 9}, "zip_data": {"basename": "s.mds.zstd", "bytes": 5}}
    assert manifest.mds_chunks({"shards": [shard]})[0]["filename"] == "s.mds.zstd"


def test_sizes():
    assert helpers.bytes_of("64MB") == 64_000_000 and helpers.bytes_of("1.5kb") == 1500
    with pytest.raises(ValueError):
        helpers.bytes_of("12b")


def test_chunkbin_modes_and_nulls(spark, tmp_path):
    chunkbin.register(spark)
    folder = str(tmp_path / "bin")

    def write(lo, hi, mode, **options):
        rows = spark.range(lo, hi).selectExpr("id", "if(id % 7 = 0, null, concat('v', id)) v", "cast(null as binary) b", "if(id % 5 = 0, null, id / 2) d")
        rows.write.format("chunkbin").options(path=folder, chunk_size=30, **options).mode(mode).save()

    def read():
        return sorted(tuple(r) for r in spark.read.format("chunkbin").option("path", folder).load().collect())

    want = [(i, None if i % 7 == 0 else f"v{i}", None, None if i % 5 == 0 else i / 2) for i in range(200)]
    write(0, 100, "append")
    write(100, 150, "append")
    assert read() == want[:150]
    with pytest.raises(Exception, match="another format"):
        write(0, 5, "append", compression="zstd")
    assert read() == want[:150]
    write(150, 200, "overwrite")
    assert read() == want[150:]
    assert len(list((tmp_path / "bin").glob("chunk-*"))) == len(spark.read.format("chunkbin").option("path", folder).load().rdd.glom().collect())


def test_chunkbin_reads_runs_of_chunks(spark, tmp_path):
    chunks = [{"filename": f"c{i}", "chunk_size": 1, "chunk_bytes": 1000 + i} for i in range(5000)]
    for n in (0, 1, 64, 65, 5000):
        runs = chunkbin.dealt(chunks[:n])
        assert [x for run in runs for x in run] == [(c["filename"], 1) for c in chunks[:n]] and min(n, 64) <= len(runs) <= 130
    assert len(chunkbin.dealt([c | {"chunk_bytes": 8 << 20} for c in chunks])) == 2500
    chunkbin.register(spark)
    folder = str(tmp_path / "bin")
    spark.range(0, 400, 1, 2).write.format("chunkbin").options(path=folder, chunk_size=2).mode("append").save()
    read = spark.read.format("chunkbin").option("path", folder).load()
    assert read.rdd.getNumPartitions() < 200 and sorted(r[0] for r in read.collect()) == list(range(400))


def test_a_function_runs_once_for_a_row(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def count(row):
        calls.add(1)
        return {"id": row["id"], "big": None if row["id"] % 3 == 0 else (1 << 60) + row["id"]}

    for options in ({"chunk_size": 3}, {"chunk_bytes": 40}):
        before = calls.value
        folder = str(tmp_path / next(iter(options)))
        transform.optimize(spark.range(20).toDF("id"), count, "id long, big long", folder, "id", **options)
        assert calls.value - before == 20
        got = sorted((r["id"], r["big"]) for r in manifest.read_rows(spark, folder).collect())
        assert got == [(i, None if i % 3 == 0 else (1 << 60) + i) for i in range(20)]
    seen = transform.flat_map(spark.range(4).selectExpr("id", "if(id = 1, null, id + (1L << 60)) x"), lambda row: {"kind": type(row["x"]).__name__, "x": row["x"]}, "kind string, x long").collect()
    assert sorted((r["kind"], r["x"]) for r in seen if r["x"] is not None) == [("int", (1 << 60) + i) for i in (0, 2, 3)]
    assert [r["kind"] for r in seen if r["x"] is None] == ["NoneType"]


def test_overwrite_of_what_is_read(spark, tmp_path):
    folder = str(tmp_path / "o")
    transform.optimize(spark.range(10).toDF("id"), same, "id long", folder, "id", chunk_size=4)
    rows = manifest.read_rows(spark, folder).selectExpr("id + 100 id")
    transform.optimize(rows, same, "id long", folder, "id", chunk_size=5, mode="overwrite")
    assert sorted(r["id"] for r in manifest.read_rows(spark, folder).collect()) == list(range(100, 110))
    assert len([p for p in (tmp_path / "o").iterdir() if p.is_dir()]) == 1

    def fails(row):
        raise ValueError("no")

    with pytest.raises(Exception):
        transform.optimize(spark.range(3).toDF("id"), fails, "id long", folder, "id", chunk_size=5, mode="overwrite")
    assert manifest.read_rows(spark, folder).count() == 10


def test_dtype_codes():
    """Fixed values of the format."""
    assert [helpers.TORCH_DTYPES[i] for i in (9, 10, 11, 13, 17, 19)] == ["half", "bfloat16", "uint8", "int16", "int64", "bool"]
    assert [helpers.NUMPY_DTYPES[i] for i in (0, 4, 10, 13)] == ["int8", "uint8", "float64", "bool"]


def test_pieces_of_parquet_files(spark, tmp_path):
    from grainmill.sources import readers

    source, output = str(tmp_path / "s"), str(tmp_path / "p")
    spark.range(30, numPartitions=3).write.parquet(source)
    table = readers.reshard(spark, source, output, 4)
    assert sorted((r["start"], r["end"]) for r in table.collect()) == sorted([(0, 4), (4, 8), (8, 10)] * 3)
    rows = spark.read.parquet(output)
    assert sorted(r["id"] for r in rows.collect()) == list(range(30))
    assert {r["count"] for r in rows.groupBy("piece").count().collect()} == {4, 2}
    assert readers.reshard(spark, source, str(tmp_path / "q"), 5).count() == 6
    with pytest.raises(ValueError):
        readers.pieces(spark, source, 0)


def test_pieces_of_a_table_go_across_files(spark, tmp_path):
    from grainmill import catalogue
    from grainmill.sources import readers
    from oracle import assert_same, connect

    source = f"{tmp_path}/documents.parquet"
    spark.range(1000, numPartitions=3).withColumnRenamed("id", "doc_id").write.parquet(source)  # 333, 333 and 334 rows
    assert_same(catalogue.q_pieces(spark, str(tmp_path)), connect(str(tmp_path)), catalogue.oracle_sql()["q_pieces"])
    at = [(p["file"], p["start"], p["end"]) for r in readers.table_pieces(spark, source, 150).orderBy("start").collect() for p in r["parts"]]
    assert len(at) == 9 and at == sorted(at) and sum(b - a for _, a, b in at) == 1000
    assert all(x[2] == y[1] if x[0] == y[0] else y[1] == 0 for x, y in zip(at, at[1:], strict=False))
    assert readers.table_pieces(spark, source, 1000).count() == 1
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert readers.table_pieces(spark, str(tmp_path / "none"), 150).count() == 0
    with pytest.raises(ValueError):
        readers.table_pieces(spark, source, 0)


def test_token_blocks_go_across_ranges(spark, monkeypatch):
    from grainmill.plans import index
    from grainmill.sources import tokens

    rows = [("ab"[i % 3 == 0] if i % 11 else None, i if i else None, [f"{i}.{k}" for k in range(i * i % 23)] if i % 13 else None) for i in range(300)]
    items = spark.createDataFrame(rows, "chunk string, idx long, tokens array<string>").repartition(4)
    runs = {c: [t for d, _, ts in rows if d == c and ts for t in ts] for c in ("a", "b", None)}
    want = {(c, k): run[16 * k : 16 * k + 16] for c, run in runs.items() for k in range(len(run) // 16)}
    for size in (100, 1 << 30):
        monkeypatch.setattr(tokens, "RANGE_TOKENS", size)
        made = tokens.blocks(items, 16)
        assert {(r["chunk"], r["block"]): r["tokens"] for r in made.collect()} == want and made.count() == len(want)
        assert made.schema.names == ["chunk", "block", "tokens"]
    cuts = index.bounds(items.where("size(tokens) > 0"), "idx", weight=F.size("tokens"), size=100)
    total = sum(len(t or ()) for *_, t in rows)
    parts = [sum(len(t or ()) for _, i, t in rows if (i or 0) >= a and (i or 0) < b) for a, b in zip([0, *cuts], [*cuts, 300], strict=True)]
    assert len(cuts) >= total // 200 and max(parts) < 300  # no task has a chunk's tokens


def test_file_weights(spark, tmp_path):
    from grainmill.sources import readers

    for name, n in (("a", 3), ("b", 5), ("empty", 0)):
        (tmp_path / name).write_bytes(b"x" * n)
    files = manifest.walk(spark, str(tmp_path))
    rows = [(1, str(tmp_path / "a"), [str(tmp_path / "b"), None]), (2, f"file://{tmp_path}/b", None), (3, "no file", []), (4, None, [str(tmp_path / "a")] * 2)]
    inputs = spark.createDataFrame(rows, "k long, one string, more array<string>")
    found = readers.file_weights(inputs, ["one", "more"], files, "k")
    assert {r["k"]: r["weight"] for r in found.collect()} == {1: 8, 2: 5, 3: 0, 4: 6}
    listed = spark.createDataFrame([(f"file:{tmp_path}/empty", 0)], "path string, length long")
    with pytest.raises(Exception, match="an empty file"):
        readers.file_weights(spark.createDataFrame([(1, str(tmp_path / "empty"))], "k long, one string"), ["one"], listed, "k").collect()


def test_a_lost_run_goes_on(spark, tmp_path):
    folder, marks = str(tmp_path / "o"), str(tmp_path / "marks")
    (tmp_path / "marks").mkdir()

    def fn(row):
        import os
        import uuid

        open(f"{marks}/{row['id']}-{uuid.uuid4().hex}", "w").close()
        if row["id"] == 40 and not os.path.exists(f"{marks}/mended"):
            raise RuntimeError("lost")
        return row

    run = lambda n=64, **k: transform.optimize(spark.range(n).toDF("id"), fn, "id long", folder, "id", chunk_size=10, use_checkpoint=True, **k)
    with pytest.raises(Exception, match="lost"):
        run()
    (tmp_path / "marks" / "mended").write_text("")
    for other in ({"n": 63}, {"workers": 2}):
        with pytest.raises(ValueError):
            run(**other)
    assert [r["chunk_size"] for r in run().orderBy("chunk").collect()] == [10] * 6 + [4]
    assert [r["id"] for r in manifest.read_rows(spark, folder).orderBy("chunk", "row").collect()] == list(range(64))
    calls = [int(p.name.partition("-")[0]) for p in (tmp_path / "marks").iterdir() if "-" in p.name]
    assert all(calls.count(i) == 1 for i in [*range(40), *range(44, 64)])
    assert not (tmp_path / "o" / "_checkpoint").exists()
    with pytest.raises(ValueError):
        run()
