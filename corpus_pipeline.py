"""From raw documents to tokens: quality, repeated passages, near duplicates, benchmark passages, encoding.

Each stage is written as Parquet in the shared folder and read again by the next one, so a lost executor costs the tasks
it ran and a stage never computes its predecessors anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, decontaminate, linededup, quality, simhash
from tidemark.llm.common import table
from tidemark.llm.queries import word_vocabulary
from tidemark.workspace import Workspace


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages and chunks of lines that stand earlier; documents of which nothing is left go, others keep their columns.

    ``n_chars`` follows the text.
    """
    rid = linededup.without_repeats(docs, Workspace(spark))
    left = rid.filter((F.col("removed_lines") == 0) | F.col("text").rlike(r"\S"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    changed = F.col("removed_lines") > 0
    return left.select(
        *[F.when(changed, new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns]
    )


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 verified, found by fingerprints and bands."""
    return simhash.representatives(docs, Workspace(spark), width=5, limit=3, least=0.8, bands=True)


def without_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"), Workspace(spark))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with what they decode to as a digest."""
    coded = bpe.encode(docs, word_vocabulary())
    return coded.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark_passages),
    ("BPE encoding", encoded),
]

#: A fitted classifier, rolling hashes and merge queues are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    space = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = space.keep(stage(spark, docs, sf_dir), f"stage{n}")
    return docs
