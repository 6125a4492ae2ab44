"""A training corpus from raw documents: accepted, told apart, clean of benchmarks, packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcount.llm import decontaminate, exact, jaccard, packing, quality
from fieldcount.llm.workers import small_batches
from fieldcount.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by the labels of ``docs``, accepts.

    Each row is judged by its own text, null as an empty one; equal rows stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = quality.train(*quality.training_sample(docs, labels, "quality", 4000))
    scored = quality.score_quality(docs.withColumn("__scored", F.col("text")), net, "__scored", "__score")
    # written here, as whole texts must reach the workers in small batches whoever reads the result
    with small_batches(spark):
        return materialize(scored.filter("__score >= 0.3").select(*COLUMNS), "accepted")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the longest; then the smallest id, null first.

    Null, empty and blank texts equal each other. Of rows equal in both, one stays.
    """
    kept = exact.deduplicate(docs).filter("kept").select("doc_id", "text_sha256")
    keyed = docs.withColumn("text_sha256", exact.sha256(exact.without_space(F.col("text"))))
    same = keyed["doc_id"].eqNullSafe(kept["doc_id"]) & (keyed["text_sha256"] == kept["text_sha256"])
    longest = keyed.join(kept, same, "left_semi")
    # rows that share id and text but for white space
    first = F.max_by(F.struct(*COLUMNS), F.length(F.coalesce("text", F.lit(""))))
    return longest.groupBy("doc_id", "text_sha256").agg(first.alias("row")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5 words, similarity of 0.8), the document of smallest id.

    Rows that share an id are one document and stay or go together; rows without an id, and those
    without words, link with nothing and stay.
    """
    groups = jaccard.near_duplicates(docs)
    return docs.join(groups.filter("component_id != doc_id").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not quote the benchmark at length.

    Texts are judged, not ids: rows of one text go together, whatever their ids, and a clean text stays
    whoever shares its id. Null and empty texts stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn("__text", exact.sha256(F.coalesce("text", F.lit(""))))
    found = decontaminate.contamination(keyed, items, id_col="__text").filter("contaminated")
    return keyed.join(found.select("__text").distinct(), "__text", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 ids.

    Null and empty texts are one id; repeated rows are packed each.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: The classifier and the tokenizer are no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with small_batches(spark):
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
