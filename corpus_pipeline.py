"""From raw documents to token ids: five stages, each over all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import byte_bpe, decontaminate, jaccard_join, suffix_dedup, toxicity
from lexarium.llm.common import scratch, stored, table
from lexarium.storage import dropped


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learned from ``labels``, is below 0.5."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that five-word shingles of similarity 0.8 or more join, the one with the smallest doc_id."""
    return jaccard_join.drop_near_copies(docs, size=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 51 words or strings of 400 bytes that occur elsewhere; ``n_chars`` follows the text."""
    cut = suffix_dedup.drop_repeated(docs, words=suffix_dedup.PASSAGE)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of ``benchmark`` occurs within the edit limit."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes that they decode to."""
    import public_tokenizers

    encoded = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, offsets=True)
    return byte_bpe.digests(encoded, "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", drop_repeated_passages),
    ("decontaminate", drop_benchmark_copies),
    ("byte_bpe", encode),
]

#: No SQL form: learned scores, edit distances and byte-pair merges can't be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one by one; a stage's table goes when the next one's is written, and so does what the stages wrote on their way."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            done = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        dropped(docs)
        docs = done
    return docs
