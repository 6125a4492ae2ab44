"""Flight lines as sets of points: pieces that lie on each other count once, and parts that hang together
are numbered.

Pieces of a line that run along the same straight line are merged as intervals on it, by one window over
each straight line. What is left meets at ends only, or crosses; parts are the connected components
over common ends. A line of few stretches is one row and finds its parts by itself. For longer lines each
end is handed the smallest end known to its neighbours and then follows those, which takes as many rounds
as the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcount.session import discard, materialize, scratch_path


def union_lines(pieces: DataFrame, keys: Sequence[str] = ("transect",), digits: int = 6) -> DataFrame:
    """The straight stretches (keys, x1, y1, x2, y2, length) of each line: pieces flown twice, back or in
    part are one, and pieces that go straight on are joined.

    Coordinates, and the distances of pieces from the straight lines they are on, are taken to
    ``digits`` decimals. Pieces with a null or without a length are left out.
    """
    ends = [F.round(c, digits) for c in ("x1", "y1", "x2", "y2")]
    named = pieces.select(*keys, *[e.alias(c) for e, c in zip(ends, ("x1", "y1", "x2", "y2"))]).dropna(
        subset=["x1", "y1", "x2", "y2"]
    )
    low, high = (F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2))
    turned = (
        named.select(*keys, F.least(low, high).alias("low"), F.greatest(low, high).alias("high"))
        .distinct()
        .filter("low <> high")
        .withColumns({"dx": F.expr("high.x - low.x"), "dy": F.expr("high.y - low.y")})
        .withColumn("size", F.expr("sqrt(dx * dx + dy * dy)"))
        .withColumns({"ux": F.expr("dx / size"), "uy": F.expr("dy / size")})
    )
    # a straight line: its direction, and how far from the origin it passes, in units of the last decimal
    unit = 10.0**digits
    on = turned.select(
        *keys,
        "low",
        "high",
        F.rint(F.col("ux") * (unit * 1000)).alias("lx"),
        F.rint(F.col("uy") * (unit * 1000)).alias("ly"),
        F.rint(F.expr("low.y * ux - low.x * uy") * unit).alias("off"),
        F.rint(F.expr("low.x * ux + low.y * uy") * unit).alias("a"),
        F.rint(F.expr("high.x * ux + high.y * uy") * unit).alias("b"),
    )
    line = [*keys, "lx", "ly", "off"]
    along = Window.partitionBy(*line).orderBy("a", "b")
    reached = F.max("b").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = on.withColumn("new", F.when(F.col("a") <= reached, 0).otherwise(1))
    stretch = F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0))
    joined = (
        marked.withColumn("stretch", stretch)
        .groupBy(*line, "stretch")
        .agg(F.min(F.struct("a", "low")).alias("first"), F.max(F.struct("b", "high")).alias("last"))
    )
    out = joined.selectExpr(
        *[f"`{k}`" for k in keys], "first.low.x AS x1", "first.low.y AS y1", "last.high.x AS x2", "last.high.y AS y2"
    )
    return out.withColumn("length", _length())


def _length() -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return F.sqrt(dx * dx + dy * dy)


def _stored(df: DataFrame, before: str | None) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, "line-ends")
    df.write.parquet(path)
    if before:
        discard(df.sparkSession, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Stretches of a line that find their parts within one row; the work grows with the square.
_SHORT = 256

# Sets of ends that hang together, least end first; then the place of each stretch's set among them.
_SETS = """array_sort(transform(
  aggregate(own, cast(array() AS array<array<struct<x: double, y: double>>>), (sets, s) -> concat(
    filter(sets, t -> NOT (array_contains(t, s.low) OR array_contains(t, s.high))),
    array(array_union(array(s.low, s.high), flatten(filter(sets, t -> array_contains(t, s.low) OR array_contains(t, s.high))))))),
  t -> struct(array_min(t) AS least, t AS ends)))"""
_NUMBERED = """transform(own, s -> struct(
  s.row AS row, cast(array_position(transform(sets, t -> array_contains(t.ends, s.low)), true) AS int) AS part))"""


def line_parts(stretches: DataFrame, keys: Sequence[str] = ("transect",), short: int = _SHORT) -> DataFrame:
    """``stretches`` with ``part``: 1, 2, ... within each line, for stretches that hang together by their
    ends, in the order of their least end. Ends are compared as they are; null keys are a line.

    Lines of more than ``short`` stretches spread over tasks."""
    stretches = materialize(stretches, "stretches")
    long_lines = stretches.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > short)
    if long_lines.isEmpty():
        return _parts_by_line(stretches, keys)
    named = long_lines.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    few, many = (stretches.join(named, same, kind) for kind in ("left_anti", "left_semi"))
    return _parts_by_line(few, keys).union(_parts_by_rounds(many, keys))


def _parts_by_line(stretches: DataFrame, keys: Sequence[str]) -> DataFrame:
    ends = [F.struct(F.col(f"x{i}").cast("double").alias("x"), F.col(f"y{i}").cast("double").alias("y")) for i in (1, 2)]
    rest = [c for c in stretches.columns if c not in keys]
    own = F.struct(ends[0].alias("low"), ends[1].alias("high"), F.struct(*rest).alias("row"))
    lines = stretches.groupBy(*keys).agg(F.collect_list(own).alias("own"))
    numbered = lines.withColumn("sets", F.expr(_SETS)).select(*keys, F.inline(F.expr(_NUMBERED)))
    return numbered.select(*keys, "row.*", "part").select(*stretches.columns, "part")


def _parts_by_rounds(stretches: DataFrame, keys: Sequence[str]) -> DataFrame:
    own = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    point = {i: F.struct(*own, F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2)}
    pairs = stretches.select(F.array(point[1], point[2]).alias("ends"))
    steps = pairs.select(F.inline(F.expr("array(struct(ends[0] AS u, ends[1] AS v), struct(ends[1] AS u, ends[0] AS v))")))
    edges, edge_path = _stored(steps.distinct(), None)
    label, path = _stored(edges.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("least")), None)
    while True:
        # the least of the neighbours' least, then the least of that one's
        seen = edges.join(label, edges["v"] == label["node"]).groupBy("u").agg(F.min("least").alias("near"))
        nearer = label.join(seen, label["node"] == seen["u"]).select("node", F.least("least", "near").alias("least"))
        jump = nearer.select(F.col("node").alias("at"), F.col("least").alias("beyond"))
        moved = nearer.join(jump, nearer["least"] == jump["at"]).select("node", F.least("least", "beyond").alias("least"))
        before = label.select(F.col("node").alias("was"), F.col("least").alias("old"))
        new = moved.join(before, moved["node"] == before["was"]).select("node", "least", (F.col("least") < F.col("old")).alias("fell"))
        label, path = _stored(new, path)
        fell = label.filter("fell").isEmpty()
        label = label.drop("fell")
        if fell:
            break
    discard(stretches.sparkSession, edge_path)
    first = label.select("node", "least").distinct()
    per_line = Window.partitionBy(*[f"least.k{i}" for i in range(len(keys))]).orderBy("least")
    numbers = first.select("least").distinct().withColumn("part", F.row_number().over(per_line))
    named = first.join(numbers.withColumnRenamed("least", "root"), F.col("least") == F.col("root")).select("node", "part")
    return stretches.withColumn("__end", point[1]).join(named, F.col("__end") == F.col("node")).drop("__end", "node")


def dissolve_union(stretches: DataFrame, keys: Sequence[str] = ("transect",)) -> DataFrame:
    """A row per line of ``line_parts``: stretches, parts, length, box and centroid, nothing counted twice."""
    w = F.col("length")
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return stretches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_stretches"),
        F.max("part").alias("n_parts"),
        F.sum(w).alias("length"),
        F.min(F.least("x1", "x2")).alias("xmin"),
        F.max(F.greatest("x1", "x2")).alias("xmax"),
        F.min(F.least("y1", "y2")).alias("ymin"),
        F.max(F.greatest("y1", "y2")).alias("ymax"),
        (F.sum(x * w) / F.sum(w)).alias("x"),
        (F.sum(y * w) / F.sum(w)).alias("y"),
    )
