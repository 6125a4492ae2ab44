"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcount.session import discard, scratch_path


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges ``a``, ``b``: the smallest node reachable.

    Every node hands the smallest node it knows of to its larger neighbours, then its smaller ones
    to that smallest; both alternate until nothing changes. Rounds grow with the logarithm of the
    longest path. Minima are combined before the shuffle, so a node with very many neighbours costs
    a row per task there. Each round is a table in the shared folder; the last one stays.
    """
    spark = edges.sparkSession
    given = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links, path = _store(given.filter("u != v").distinct(), None)
    seen = _mark(links)
    while seen[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links, path = _store(large.filter("u != v").distinct(), path)
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        small = links.join(least, "u").select(
            F.inline(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m")))
        )
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        links, path = _store(small.filter("u != v").distinct(), path)
        now = _mark(links)
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _store(links: DataFrame, before: str | None) -> tuple[DataFrame, str]:
    spark = links.sparkSession
    path = scratch_path(spark, "links")
    links.write.parquet(path)
    if before:
        discard(spark, before)
    return spark.read.schema(links.schema).parquet(path), path


def _mark(links: DataFrame) -> tuple[int, int]:
    """A number of rows and a sum of hashes that tell two edge tables apart."""
    row = links.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)
