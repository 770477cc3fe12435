"""A corpus pipeline of four stages: language ID, near duplicates, mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import jaccard, language_id, mixing, unigram
from grainmill.llm._common import Workspace, table

#: Near duplicates: words of a shingle, least Jaccard in per cent.
WORDS, SHARE = 5, 80


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language. Rejected: a null text, one without a letter, and one whose language none is like.

    Learns from the rows with a lang. A row goes only if it is `und`: its best score is below what nearly all texts of
    its size in the learned languages have, short ones being held to less. Where too few rows with a lang say what that
    is, and without any, only rows without a letter go.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns])
    model = language_id.learn(rows, F.lit(True)) if "lang" in docs.columns else None
    if model is None:
        return rows.where(F.col("text").rlike(r"\p{L}"))
    return language_id.select_known(rows, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; all that link with none."""
    return jaccard.keep_first(docs, WORDS, SHARE)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, n_byte_ids and round_trip of each row."""
    import public_tokenizers

    return unigram.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language ID", languages), ("near duplicates", near_duplicates), ("mixing", mixed_sources), ("SentencePiece", encoded)]

#: SQL expresses neither a learned classifier nor the encoder; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    work = Workspace(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.stored(docs, f"stage-{i + 1}")
    return docs
