"""Places and running sums in a whole table's order, where one group may hold most of the rows.

A window over a group would sort the group in one task. Here the rows are range-partitioned on
(group, order), so that a large group is spread over many tasks; what comes before a row is what its
own run (the rows of its group in its partition) has before it plus the sums of the earlier runs.
Runs are at most partitions and groups together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcount.session import materialize


def source_key(column: Column) -> Column:
    """A group's name as a key without nulls, in the order of its bytes; null comes first."""
    return F.coalesce(F.concat(F.lit(":"), column.cast("string")), F.lit(""))


def in_order(
    rows: DataFrame, group: str, order: Sequence[str], value: str | None = None, groups: DataFrame | None = None
) -> DataFrame:
    """``rows`` with ``place`` (from 0) in their group and ``n``, the rows of the group; with ``value``,
    also ``before``, the sum of that column over the group's earlier rows, and ``total``. ``groups`` has
    more columns of each group; they reach the rows by way of the runs, not by a join on the group.

    ``group`` has no nulls; of ``order``, nulls come first. The row's place in the input breaks ties, so
    that copies of one row spread over tasks. ``rows`` is read twice, once for a sample, and should
    be a stored table of few columns. The sorted rows are kept in the shared folder: runs and places
    must come from one and the same partitioning.
    """
    keys = [group, *order, "__row"]
    runs = materialize(
        rows.withColumn("__row", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("__row")
        .withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__run", F.shiftright("__at", 33)),
        "in-order",
    )
    sums = {"__n": F.count(F.lit(1)), "__start": F.min("__at")} | ({"__sum": F.sum(value)} if value else {})
    same = Window.partitionBy(group)
    earlier = same.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = {"__offset": F.coalesce(F.sum("__n").over(earlier), F.lit(0)), "n": F.sum("__n").over(same)}
    if value:
        offsets |= {
            "__earlier": F.coalesce(F.sum("__sum").over(earlier), F.lit(0)),
            "total": F.sum("__sum").over(same),
        }
    pieces = runs.groupBy(group, "__run").agg(*[c.alias(k) for k, c in sums.items()]).withColumns(offsets)
    pieces = pieces.drop("__n", "__sum")
    if groups is not None:
        pieces = pieces.join(groups, group)
    joined = runs.join(pieces, [group, "__run"])
    out = {"place": F.col("__offset") + F.col("__at") - F.col("__start")}
    if value:
        within = Window.partitionBy(group, "__run").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        out["before"] = F.col("__earlier") + F.coalesce(F.sum(value).over(within), F.lit(0))
    kept = [*rows.columns, "n", *(["total"] if value else [])]
    kept += [c for c in groups.columns if c != group] if groups is not None else []
    return joined.select(*kept, *[c.alias(k) for k, c in out.items()])
