"""The registered queries of this subpackage: each operator over its whole table, with its production parameters."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, decontaminate, knn, language, linededup, manifest, pages, quality, simhash, substrings, toxicity, warc, whitening
from tidemark.llm.common import remainder, table
from tidemark.workspace import Workspace

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    REGISTRY[function.__name__] = function
    return function


def word_vocabulary() -> str:
    """The public word-end vocabulary, read from where it is installed."""
    import public_tokenizers

    return bpe.definition(public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_bpe(spark, sf_dir):
    """Tokens of every document and what they decode to, as digests."""
    coded = bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), word_vocabulary())
    return coded.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op9_simhash(spark, sf_dir):
    """Near-duplicate classes of all documents by three-word shingles and three differing bits."""
    docs = table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, Workspace(spark), width=3, limit=3).select("doc_id", "fingerprint", "component_id")


@query
def op3_line_dedup(spark, sf_dir):
    """All documents without repeated passages and chunks of lines; texts as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rid = linededup.without_repeats(docs, Workspace(spark))
    return rid.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "removed_lines",
        "removed_words",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("text"), 256).alias("text_sha256"),
    )


@query
def op4_decontaminate(spark, sf_dir):
    """Words of all documents that stand in a ten-word window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), Workspace(spark))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        F.size("hit").cast("bigint").alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


@query
def op2_quality(spark, sf_dir):
    """Quality scores of all documents from co-trained views of text and metadata."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), Workspace(spark)))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"), "text_score", "metadata_score", "score",
        (F.col("score") >= quality.THRESHOLD).alias("accepted"),
    )


@query
def op1_language(spark, sf_dir):
    """Language of every document; a quarter of the documents, by their id's fold, teaches nothing."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = language.fit(docs.filter(~held_out).select("text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), model).select("row.*", "nearest", "score", "rejected")
    return found.select("doc_id", held_out.alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


@query
def op5_toxicity(spark, sf_dir):
    """Toxicity of every document; labels of a fifth of the documents, by their id's fold, are not looked at."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    scored = toxicity.score(docs, toxicity.fit(docs, labels, Workspace(spark))).select("row.doc_id", "score", F.size("passages").alias("n_passages"))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("n_passages").cast("bigint").alias("n_passages"),
    )


@query
def op6_pages(spark, sf_dir):
    """Main text of every page."""
    found = pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op8_knn(spark, sf_dir):
    """Five best inner products of every fiftieth embedding among all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", knn.scaled("embedding").alias("vector"))
    return knn.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5, Workspace(spark))


@query
def op10_warc(spark, sf_dir):
    """Write every page to an archive, read all records back."""
    space = Workspace(spark)
    folder = space.path("archive")
    pages_table = table(spark, sf_dir, "pages")
    warc.write_archive(pages_table, folder, space)
    records = warc.read_archive(spark, folder)
    kind = pages_table.schema["page_id"].dataType
    page = lambda name: F.nullif(F.regexp_extract(warc.field(name), "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    return records.select(
        page("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        warc.field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
    )


@query
def op13_manifest(spark, sf_dir):
    """Merkle roots and proofs of all documents; a fifth of them, by the hash of their id, is checked in lower case."""
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    made = manifest.manifest(docs, Workspace(spark), F.when(tampered, lowered).otherwise(F.col("text")))
    folded = made.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_hash(F.col("steps")).alias("proof_sha256"),
        manifest.folded(F.col("altered_leaf"), F.col("steps")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_whitening(spark, sf_dir):
    """All embeddings on the four leading components of their distinct vectors, scaled to unit variance."""
    made = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", Workspace(spark))
    return made.select(
        "row.vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained",
        "identity_error",
    )


@query
def op11_substrings(spark, sf_dir):
    """All documents without spans of fifty words and more that a document of smaller id holds, as digests."""
    found = substrings.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark))
    return found.select(
        "doc_id", "n_words", "n_removed",
        F.when(F.col("n_removed") > 0, F.sha2("kept", 256)).otherwise(F.col("whole")).alias("kept_sha256"),
    )
