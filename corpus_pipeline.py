"""The corpus pipeline: documents to packed training sequences.

Each stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablecare.llm.mixing import ADDED, mix
from tablecare.llm.packing import document_pieces, pack_pieces
from tablecare.llm.paragraphs import without_passages
from tablecare.llm.queries import tokenizer_path
from tablecare.llm.rules import learn_quality, score_quality
from tablecare.llm.simhash import keep_first
from tablecare.session import configure, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    model = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).where("predicted = 1").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with fingerprints linked by four bits or fewer the first stays."""
    return keep_first(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs and passages that occur elsewhere go, and documents of which nothing is left.

    ``n_chars`` follows the text of the documents that were cut.
    """
    from pyspark.sql import functions as F

    cleaned = without_passages(docs)
    cut = (F.size("removed_paragraphs") > 0) | (F.size("cut_passages") > 0)
    cleaned = cleaned.where(~cut | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        kept = F.when(cut, F.char_length("text")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", kept.cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to twice as often as the largest; none is cut."""
    added = [c for c in docs.columns if c in ADDED]
    if added:  # never in documents as they come; ``mix`` would replace them
        raise ValueError(f"columns {added} clash with those of the mixture")
    return mix(docs).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 4096 tokens."""
    pieces = document_pieces(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False)
    return pack_pieces(pieces).drop("row")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("mixing sources", mixture),
    ("best-fit packing", packed),
]

#: stages 1, 2, 3 and 5 learn, hash by XXH64, verify sets and use a tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    configure(spark)
    path = scratch_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{number}")
        docs = spark.read.parquet(f"{path}/{number}")
    return docs
