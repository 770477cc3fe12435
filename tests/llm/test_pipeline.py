import pytest

P = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from grainmill.llm import jaccard, unigram  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        if i < 3:
            assert docs.columns == columns
        if i == 1:
            pairs = jaccard.join(docs.select("doc_id", "text"), corpus_pipeline.WORDS, corpus_pipeline.SHARE)
            assert pairs.where("doc_id <> component_id").count() == 0
    assert counts[0] == counts[1] > counts[2] and counts[3] == counts[4]
    mixed = spark.read.parquet(str(tmp_path / "2"))
    decoded = unigram.decode(docs, P.path("piece_bpe_32k.model"))
    assert decoded.exceptAll(mixed.select("doc_id", "text")).count() == 0


def test_rejects_rows_without_letters(spark):
    rows = [(1, "hello there my friend", "en", "a", 0), (2, "12 34", "en", "a", 0), (3, None, "en", "a", 0), (4, "bonjour mon ami", "fr", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.languages(spark, docs, "").collect()} == {1, 4}
    assert corpus_pipeline.languages(spark, docs.limit(0), "").count() == 0


def test_rejects_an_unlearned_language_and_random_letters(spark, sf_dir):
    import random

    draw = random.Random(3)
    noise = [(10_000_000 + i, "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200 + 20 * i)), None) for i in range(20)]
    rows = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    unlearned = rows.withColumn("lang", F.when(F.col("lang") != "es", F.col("lang")))
    docs = unlearned.union(spark.createDataFrame(noise, rows.schema))
    left = corpus_pipeline.languages(spark, docs, "")
    n, m = ({r["lang"]: r["count"] for r in d.groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).count().collect()} for d in (unlearned, left))
    assert m.get("none", 0) <= 0.15 * n["none"] and left.where("doc_id >= 10000000").count() == 0
    assert all(m[x] >= 0.99 * n[x] for x in ("de", "en", "fr"))
