"""Exact deduplication as a stream with keyed state.

A stream of (digest, id, length, locator) rows updates one state row per digest: how many rows had
it and which one stays. The state lives in RocksDB on the executors' disks, is checkpointed to the
shared folder and never expires, so deliveries can be added for ever and a lost executor's part is
loaded again. Rows of one digest are combined before they are shuffled, so a text of which there are
millions of copies costs one row per task. Digests only say where copies may be: the bytes of all
rows whose digest was seen more than once are compared before anything is reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcount.llm.sketch import bloom
from fieldcount.session import discard, materialize, scratch_path

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no space set aside for each one's logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def _best() -> Column:
    """Of equal texts: the longest, then the smallest id."""
    return F.min(F.struct((-F.col("n_chars")).alias("less"), "id", "row", "locator")).alias("best")


def without_space(text: Column) -> Column:
    """A text without its ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def update_state(spark: SparkSession, arrivals: str, changes: str, checkpoint: str, batch_bytes: int = 4 << 30) -> None:
    """Take the files of ``arrivals`` that are new since the last call into the keyed state.

    ``arrivals`` has the columns digest, n_chars, id, row, locator. Each micro-batch of at most
    ``batch_bytes`` writes the state rows that it changed to ``changes``/batch=N; a batch that is
    repeated after a failure replaces its own folder.
    """
    schema = spark.read.parquet(arrivals).schema
    with _settings(spark, STORE):
        state = (
            spark.readStream.schema(schema)
            .option("maxBytesPerTrigger", str(batch_bytes))
            .parquet(arrivals)
            .groupBy("digest")
            .agg(
                F.count(F.lit(1)).alias("group_size"),
                _best(),
            )
        )

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(keep)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        try:
            query.awaitTermination()
        finally:
            query.stop()


def read_state(spark: SparkSession, changes: str) -> DataFrame:
    """The last state of each digest: digest, group_size, keep_id, keep_row, locator."""
    last = (
        spark.read.option("basePath", changes)
        .parquet(changes)
        .groupBy("digest")
        .agg(F.max(F.struct("batch", "group_size", "best")).alias("last"))
    )
    best = F.col("last.best")
    return last.select(
        "digest",
        F.col("last.group_size").alias("group_size"),
        best["id"].alias("keep_id"),
        best["row"].alias("keep_row"),
        best["locator"].alias("keep_locator"),
    )


def _unequal(texts: DataFrame, state: DataFrame) -> DataFrame:
    """Digests seen more than once whose rows differ in a byte.

    The least and the greatest text of a digest are equal if and only if all are; both are
    combined before the shuffle. A filter of fixed size spares most texts seen once the way.
    """
    seen = texts.sparkSession.sparkContext.broadcast(
        bloom(state.filter("group_size > 1").select(F.xxhash64("digest").alias("key")), "key")
    )

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        return pd.Series(seen.value.has(keys.to_numpy("int64")))

    return (
        texts.filter(hit(F.xxhash64("digest")))
        .groupBy("digest")
        .agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
        .filter(F.col("least") != F.col("most"))
        .select("digest")
    )


def _arrivals(texts: DataFrame) -> DataFrame:
    return texts.select(
        "digest",
        F.length("text").cast("long").alias("n_chars"),
        "id",
        F.monotonically_increasing_id().alias("row"),
        F.input_file_name().alias("locator"),
        sha256(F.col("norm")).alias("text_sha256"),
    )


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    batch_bytes: int = 4 << 30,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, locator.

    Texts are equal when they are without ASCII white space; null counts as empty, and empty texts
    equal each other. Of equal texts the row with the most code points stays, then the one with the
    smallest id (null first); of rows equal in both, one of them. ``locator`` is the file the row
    that stays was read from, empty where Spark knows none. Other columns of ``docs`` are not
    looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).select("id", "text", without_space(F.col("text")).alias("norm"))
    texts = texts.withColumn("digest", digest(F.col("norm")))
    arrivals, changes, checkpoint = (scratch_path(spark, f"exact-{x}") for x in ("arrivals", "changes", "state"))
    _arrivals(texts).write.parquet(arrivals)
    rows = spark.read.parquet(arrivals)
    if rows.isEmpty():
        none = F.lit(None)
        return rows.select(
            F.col("id").alias(id_col),
            F.col("id").alias("keep_id"),
            none.cast("long").alias("group_size"),
            none.cast("boolean").alias("kept"),
            "text_sha256",
            "locator",
        )
    update_state(spark, arrivals, changes, checkpoint, batch_bytes)
    state = materialize(read_state(spark, changes), "exact-seen")
    for path in (changes, checkpoint):
        discard(spark, path)
    unequal = materialize(_unequal(texts, state), "exact-unequal")
    if not unequal.isEmpty():
        rows, state = _by_bytes(rows, state, texts, unequal)
    joined = rows.join(state, "digest")
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        "text_sha256",
        F.col("keep_locator").alias("locator"),
    )


def _by_bytes(
    rows: DataFrame, state: DataFrame, texts: DataFrame, unequal: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Tell texts apart that share a digest: for them, the text itself is the key."""
    mixed = materialize(
        _arrivals(texts.join(unequal, "digest", "left_semi").withColumn("digest", F.concat(F.lit(":"), "norm"))),
        "exact-mixed",
    )
    parted = (
        mixed.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), _best())
        .select(
            "digest",
            "group_size",
            F.col("best.id").alias("keep_id"),
            F.col("best.row").alias("keep_row"),
            F.col("best.locator").alias("keep_locator"),
        )
    )
    alone = rows.join(unequal, "digest", "left_anti").unionByName(mixed)
    return alone, state.join(unequal, "digest", "left_anti").unionByName(parted)
