"""A Merkle manifest of a dataset: one tree per source, and one over the sources' roots.

The nodes of a level are numbered within their tree. Windows over blocks of consecutive nodes look
back and ahead by fixed offsets; masked by a node's slot in its run of 16 and by the run's length,
these lag and lead columns are the node's siblings. The first child of each run hashes its parent.
Blocks hold whole runs, so a source with a third of all rows is as many tasks as it has blocks.

On the way down each parent's path to the root is put before its first child as one more row of the
children's window, and from there reaches the others of the run: paths are kept per run, not per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcount.llm.ordered import in_order, source_key
from fieldcount.session import discard, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
#: Nodes in a window: a multiple of FAN.
BLOCK = 256

_ABOVE = "struct<path: array<struct<before: string, after: string>>, subroot: string, root: string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def row_digest(values: Sequence[Column]) -> Column:
    """A row's leaf: of each value its UTF-8 length, a colon and itself, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return digest(
        *[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    )


def _sides(nodes: DataFrame) -> tuple[Column, Column, Column]:
    """A node's slot in its run, and its siblings before and after it, as joined digests."""
    window = Window.partitionBy("key", F.col("pos") - F.col("pos") % BLOCK).orderBy("pos", "child")
    slot = F.col("pos") % FAN
    length = F.least(F.lit(FAN), F.col("n") - (F.col("pos") - slot))

    def sibling(k: int) -> Column:
        shown = F.lag("digest", -k) if k < 0 else F.lead("digest", k)
        return F.when((slot + k >= 0) & (slot + k < length), shown.over(window)).otherwise("")

    return slot, F.concat(*map(sibling, range(1 - FAN, 0))), F.concat(*map(sibling, range(1, FAN)))


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level: of every tree that still has several nodes, a node for each run."""
    slot, _, after = _sides(nodes)
    seen = nodes.withColumn("child", F.lit(1)).withColumns({"slot": slot, "after": after})
    return seen.filter("slot = 0 AND n > 1").select(
        "key",
        F.expr(f"pos div {FAN}").alias("pos"),
        F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"),
        digest(F.col("digest"), F.col("after")).alias("digest"),
    )


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """All levels, from the given leaves to where each tree has one node."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = [nodes]
    while most > 1:
        levels.append(materialize(_parents(levels[-1]), "manifest-level"))
        most = -(-most // FAN)
    return levels


def _roots(levels: Sequence[DataFrame]) -> DataFrame:
    tops = [level.filter("n = 1").select("key", "digest") for level in levels]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def _below(nodes: DataFrame, parents: DataFrame | None, tops: DataFrame) -> DataFrame:
    """``nodes`` with ``above``: their siblings level by level up to the root, and both roots.

    ``parents`` has the same of the next level; ``tops`` has it for the one node of each tree.
    """
    alone = nodes.filter("n = 1").select("key", "pos").join(tops, "key")
    heads = alone.select("key", "pos", "above")
    if parents is not None:
        heads = heads.unionByName(parents.select("key", (F.col("pos") * FAN).alias("pos"), "above"))
    rows = nodes.withColumn("child", F.lit(1)).unionByName(
        heads.withColumn("child", F.lit(0)), allowMissingColumns=True
    )
    _, before, after = _sides(rows)
    block = Window.partitionBy("key", F.col("pos") - F.col("pos") % BLOCK).orderBy("pos", "child")
    seen = rows.withColumns(
        {
            "before": before,
            "after": after,
            "above": F.last("above", ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).filter("child = 1")
    own = F.when(F.col("n") > 1, F.array(F.struct("before", "after"))).otherwise(F.array())
    path = F.concat(own, F.col("above.path")).alias("path")
    return seen.select(
        *nodes.columns, F.struct(path, "above.subroot", "above.root").cast(_ABOVE).alias("above")
    )


def _paths(levels: Sequence[DataFrame], tops: DataFrame) -> DataFrame:
    """``levels[0]`` with ``above``; of the levels between, only the first one's is left stored."""
    found = None
    for k, level in reversed(list(enumerate(levels))):
        lower = _below(level, found, tops)
        if k == 0:
            return lower
        lower = materialize(lower.select("key", "pos", "above"), "manifest-paths")
        if found is not None:
            drop_tables(found)
        found = lower
    raise ValueError("a tree has one level at least")


def drop_tables(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        for folder in {path.rpartition("/")[0] for path in table.inputFiles()}:
            discard(table.sparkSession, folder)


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "source",
    fields: Sequence[str] = FIELDS,
    offered: Mapping[str, Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """One row per row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of ``fields``. Within a source, leaves go by id (null first), then digest;
    every 16 make a parent until one node is left, the subroot. Subroots, by source in the order of
    its UTF-8 bytes and null first, make ``root`` in the same way. ``proof_sha256`` is the digest of all
    siblings of a leaf and of the nodes above it, level by level, left to right.

    ``offered`` has the values that another copy of the data shows for some fields, in rows for which
    ``where`` is true. ``folded_root`` is folded from the offered row's leaf and the stored siblings, and
    ``verified`` says whether it is the root.

    Null and empty fields differ. Null sources are a source. Rows that are the same in all fields are
    leaves of their own beside each other. A source of one row has its leaf as subroot; one source
    alone has its subroot as root. Other columns are not looked at. An empty table gives an empty result.
    """
    values = {f: F.col(f) for f in fields}
    shown = row_digest(list((values | dict(offered or {})).values()))
    leaves = materialize(
        docs.select(
            source_key(F.col(group_col)).alias("key"),
            F.col(id_col).alias("id"),
            row_digest(list(values.values())).alias("digest"),
            F.when(F.lit(False) if where is None else where, shown).alias("other"),
        ),
        "manifest-leaves",
    )
    nodes = in_order(leaves, "key", ["id", "digest"]).withColumnRenamed("place", "pos")
    levels = _levels(nodes)
    drop_tables(leaves)

    sources = materialize(_roots(levels), "manifest-subroots")
    named = in_order(sources.select(F.lit("").alias("key"), F.col("key").alias("source"), "digest"), "key", ["source"])
    upper = _levels(named.withColumnRenamed("place", "pos"))
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<struct<before: string, after: string>>")
    top = _roots(upper).select("key", F.struct(empty.alias("path"), none.alias("subroot"), F.col("digest").alias("root")).alias("above"))
    tops = materialize(
        _paths(upper, top).select(
            F.col("source").alias("key"),
            F.struct("above.path", F.col("digest").alias("subroot"), "above.root").cast(_ABOVE).alias("above"),
        ),
        "manifest-tops",
    )
    rows = _paths(levels, tops)
    drop_tables(sources, *levels[1:], *upper[1:])

    sides = F.transform("above.path", lambda s: F.concat(s["before"], s["after"]))
    folded = F.aggregate(
        "above.path",
        F.coalesce("other", "digest"),
        lambda so_far, s: digest(s["before"], so_far, s["after"]),
    )
    return rows.select(
        F.col("id").alias(id_col),
        F.col("digest").alias("leaf"),
        F.col("above.subroot").alias("subroot"),
        F.col("above.root").alias("root"),
        F.sha2(F.concat_ws("", sides), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
