"""Flight lines, borders and gridded values, as long tables with coordinates.

Spatial joins are equi-joins on buckets followed by an exact test, and they run on the
distinct cells, so the number of months or years per cell does not multiply the work.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcount.functions.columns import ratio

#: How many times as many tasks as a shuffle has deal with the cells beside lines.
DEALT = 4

# ------------------------------------------------------------------ lines


def _length() -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return F.sqrt(dx * dx + dy * dy)


def dissolve_lines(pieces: DataFrame, key: str = "transect") -> DataFrame:
    """One row per line: number of pieces, length and bounding box."""
    return pieces.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_pieces"),
        F.sum(_length()).alias("length"),
        F.min(F.least("x1", "x2")).alias("xmin"),
        F.max(F.greatest("x1", "x2")).alias("xmax"),
        F.min(F.least("y1", "y2")).alias("ymin"),
        F.max(F.greatest("y1", "y2")).alias("ymax"),
    )


def line_centroid(pieces: DataFrame, key: str = "transect") -> DataFrame:
    """Centroid of each line: midpoints of its pieces weighted by length."""
    w = _length()
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return pieces.groupBy(key).agg(
        ratio(F.sum(x * w), F.sum(w)).alias("x"), ratio(F.sum(y * w), F.sum(w)).alias("y")
    )


def _with_joints(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mark the piece ends where another piece of the line goes on (``joint1``, ``joint2``).

    A piece flown twice, in either direction, is one piece. Ends are counted per line and
    point, not per line, so a line of very many pieces still spreads over tasks.
    """
    ends = [
        F.struct(F.col(f"x{i}").alias("px"), F.col(f"y{i}").alias("py")) for i in (1, 2)
    ]
    unique = pieces.select(
        *keys, F.least(*ends).alias("low"), F.greatest(*ends).alias("high")
    ).distinct()
    met = F.count(F.lit(1)).over(Window.partitionBy(*keys, "px", "py")) > 1
    both = F.array(
        F.struct(F.lit(1).alias("end"), "low.px", "low.py"),
        F.struct(F.lit(2).alias("end"), "high.px", "high.py"),
    )
    joints = [F.bool_or((F.col("end") == i) & F.col("met")).alias(f"joint{i}") for i in (1, 2)]
    marked = (
        unique.select(*keys, "low", "high", F.inline(both))
        .withColumn("met", met)
        .groupBy(*keys, "low", "high")
        .agg(*joints)
    )
    named = [
        F.col(f"{end}.p{c}").alias(f"{c}{i}")
        for i, end in ((1, "low"), (2, "high"))
        for c in ("x", "y")
    ]
    return marked.select(*keys, *named, "joint1", "joint2")


def _piece_buckets(pieces: DataFrame, dist: float, size: float) -> DataFrame:
    """Each piece once per bucket its corridor may touch: along x first, then only the y
    range the piece has there, so that a long slanting piece does not fill its whole box."""
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    columns = pieces.withColumn(
        "bx",
        F.explode(
            F.sequence(F.floor((low - dist) / size), F.floor((high + dist) / size))
        ),
    )
    left = F.greatest(low, F.col("bx") * size - dist)
    right = F.least(high, (F.col("bx") + 1) * size + dist)
    dx = F.col("x2") - F.col("x1")
    slope = ratio(F.col("y2") - F.col("y1"), dx)

    def y_at(x: Column, otherwise: Column) -> Column:
        return F.coalesce(F.col("y1") + slope * (x - F.col("x1")), otherwise)

    at_left, at_right = y_at(left, F.col("y1")), y_at(right, F.col("y2"))
    bottom = F.least(at_left, at_right) - dist
    top = F.greatest(at_left, at_right) + dist
    return columns.withColumn(
        "by", F.explode(F.sequence(F.floor(bottom / size), F.floor(top / size)))
    )


def _near_piece(dist: float, x: Column, y: Column) -> Column:
    """Point (x, y) within ``dist`` of the piece: beside it, or around one of its joints.
    Free ends are cut off flat."""
    px, py = x - F.col("x1"), y - F.col("y1")
    qx, qy = x - F.col("x2"), y - F.col("y2")
    vx, vy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length2 = vx * vx + vy * vy
    along = px * vx + py * vy
    across = px * vy - py * vx
    beside = (along >= 0) & (along <= length2) & (across * across <= length2 * dist**2)
    around = (F.col("joint1") & (px * px + py * py <= dist**2)) | (
        F.col("joint2") & (qx * qx + qy * qy <= dist**2)
    )
    return ((length2 > 0) & beside) | around


def candidate_cells(
    cells: DataFrame,
    pieces: DataFrame,
    reach: float,
    bucket: float | None,
    keys: Sequence[str],
    of_pieces: Mapping[str, Column] = {},
    zones: Sequence[str] | None = None,
    together: bool = False,
) -> DataFrame:
    """Distinct cells beside the pieces whose bucket they share. A cell has one bucket and a
    piece each bucket within ``reach``, so a (cell, piece) pair comes up at most once. ``of_pieces`` are
    computed once a piece, before the join. With ``zones``, some of the keys, a piece that several lines of
    a zone have alike is one. With ``together``, the pieces are dealt by line and bucket (``bx``, ``by``)
    into ``DEALT`` times as many tasks as a shuffle has, since pairs outnumber pieces."""
    size = bucket or 2 * reach
    if size < reach:
        raise ValueError("the bucket must not be smaller than the corridor distance")
    keyed = (
        cells.select("cell_id", "x", "y")
        .distinct()
        .withColumns({"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)})
    )
    jointed = _with_joints(pieces, keys)
    if zones is not None:
        jointed = jointed.select(*zones, "x1", "y1", "x2", "y2", "joint1", "joint2").distinct()
    jointed = jointed.withColumns(dict(of_pieces))
    placed = _piece_buckets(jointed, reach, size)
    if together:
        parts = DEALT * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = placed.repartition(parts, *keys, "bx", "by")
    met = keyed.join(placed, ["bx", "by"])
    in_box = [
        F.col(c).between(
            F.least(f"{c}1", f"{c}2") - reach, F.greatest(f"{c}1", f"{c}2") + reach
        )
        for c in ("x", "y")
    ]
    return met.filter(in_box[0] & in_box[1])


def within_corridor(
    cells: DataFrame,
    pieces: DataFrame,
    dist: float = 201.168,
    bucket: float | None = None,
    keys: Sequence[str] = ("transect",),
    zones: Sequence[str] | None = None,
) -> DataFrame:
    """Distinct (line, cell) pairs of the cells inside the flat-ended corridors.

    Lines are told apart by ``keys``; ``zones``, some of them, give the (zone, cell) pairs of all lines of a
    zone without making those of each line."""
    inside = _near_piece(dist, F.col("x"), F.col("y"))
    near = candidate_cells(cells, pieces, dist, bucket, keys, zones=zones).filter(inside)
    return near.select(*(keys if zones is None else zones), "cell_id").distinct()


def corridor_coverage(
    cells: DataFrame,
    pieces: DataFrame,
    dist: float,
    cell_size: float,
    n: int = 5,
    bucket: float | None = None,
    keys: Sequence[str] = ("transect",),
) -> DataFrame:
    """Points (of n x n spread over the cell) and share of each cell inside each corridor.

    The points are bits: pieces of a line cover a point once however many of them reach it, so their
    bits are or-ed. That happens where the pieces of a line and bucket are; cells are not shuffled.
    Points must not be farther apart than a corridor is wide, or thin corridors would slip between them.
    """
    if cell_size / n > 2 * dist:
        raise ValueError(f"{n} points a side leave gaps of {cell_size / n:g}, wider than the corridor")
    steps = [((i + 0.5) / n - 0.5) * cell_size for i in range(n)]
    reach = dist + cell_size * 0.5**0.5
    points = F.array(
        *[
            F.struct(
                F.lit(dx).alias("dx"),
                F.lit(dy).alias("dy"),
                F.lit(k // 62).alias("word"),
                F.lit(1 << (k % 62)).cast("long").alias("bit"),
            )
            for k, (dx, dy) in enumerate((dx, dy) for dy in steps for dx in steps)
        ]
    )
    line_cell = [*keys, "bx", "by", "cell_id"]
    covered = (
        candidate_cells(cells, pieces, reach, bucket, keys, together=True)
        .select("*", F.inline(points))
        .filter(_near_piece(dist, F.col("x") + F.col("dx"), F.col("y") + F.col("dy")))
        .groupBy(*line_cell, *(["word"] if n * n > 62 else []))
        .agg(F.bit_count(F.bit_or("bit")).alias("points"))
    )
    if n * n > 62:
        covered = covered.groupBy(*line_cell).agg(F.sum("points").cast("int").alias("points"))
    covered = covered.select(*keys, "cell_id", "points")
    return covered.withColumn("weight", F.col("points").cast("double") / (n * n))


def zonal_mean(
    values: DataFrame,
    zones: DataFrame,
    keys: Sequence[str] = ("transect",),
    by: Sequence[str] = (),
    value: str = "value",
    weight: str | None = None,
) -> DataFrame:
    """Mean value per zone, cells weighted by ``weight`` where given.

    Values are summed per cell before the join, so a cell with very many values joins as a
    single row.
    """
    per_cell = (
        values.filter(F.col(value).isNotNull())
        .groupBy("cell_id", *by)
        .agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    )
    w = F.col(weight) if weight else F.lit(1.0)
    return (
        zones.join(per_cell, "cell_id")
        .groupBy(*keys, *by)
        .agg(ratio(F.sum(F.col("_sum") * w), F.sum(F.col("_n") * w)).alias(value))
    )


# ------------------------------------------------------------------ seasons and anomalies


def season_of(df: DataFrame) -> DataFrame:
    """Season and its year: October to February is the winter of the later year, March to
    May spring; other months have none."""
    month, year = F.col("month"), F.col("year")
    autumn = month >= 10
    season = F.when(autumn | (month <= 2), "winter").when(month.between(3, 5), "spring")
    season_year = F.when(autumn, year + 1).when(month <= 5, year)
    return df.withColumns({"season": season, "season_year": season_year})


def season_stack(
    values: DataFrame,
    fun: Callable[[str], Column] = F.sum,
    by: Sequence[str] = ("season_year",),
    complete: bool = True,
) -> DataFrame:
    """One value per cell and season: ``F.sum`` for precipitation, ``F.avg`` for temperature.

    ``n_months`` counts the months with a value; seasons that lack one are left out unless
    ``complete`` is false. ``by=()`` stacks months without a year, as normals come.
    """
    months = F.bit_count(F.bit_or(F.when(F.col("value").isNotNull(), F.expr("shiftleft(1, month)"))))
    stacked = (
        season_of(values.withColumn("year", F.lit(None).cast("int")) if "year" not in values.columns else values)
        .filter(F.col("season").isNotNull())
        .groupBy("cell_id", "season", *by)
        .agg(fun("value").alias("value"), F.coalesce(months, F.lit(0)).alias("n_months"))
    )
    whole = F.when(F.col("season") == "winter", 5).otherwise(3)
    return stacked.filter(F.col("n_months") == whole) if complete else stacked


def cell_anomaly(
    current: DataFrame,
    normal: DataFrame,
    fun: Callable[[Column, Column], Column] = lambda x, y: x - y,
    keys: Sequence[str] = ("cell_id", "season"),
) -> DataFrame:
    """A function of two grids, cell by cell; by default their difference."""
    right = normal.select(*keys, F.col("value").alias("_normal"))
    joined = current.join(right, list(keys))
    return joined.select(*keys, fun(F.col("value"), F.col("_normal")).alias("value"))


# ------------------------------------------------------------------ polygons


def ring_edges(ring: DataFrame) -> DataFrame:
    """Closed edges (x1, y1, x2, y2) of ring vertices, whose ``seq`` counts up by one.

    A vertex meets the next one by an equi-join, so one long ring spreads over tasks. A ring whose
    ``seq`` has gaps, repeats or nulls is an error.
    """
    ends = ring.groupBy("ring").agg(
        F.min("seq").alias("least"),
        F.max("seq").alias("most"),
        F.count(F.lit(1)).alias("vertices"),
        F.count_distinct("seq").alias("places"),
    )
    span = F.col("most") - F.col("least") + 1
    dense = (F.col("vertices") == span) & (F.col("places") == span)
    following = (
        F.when(~F.coalesce(dense, F.lit(False)), F.raise_error(F.lit("seq of a ring does not count up by one")).cast("int"))
        .when(F.col("seq") == F.col("most"), F.col("least"))
        .otherwise(F.col("seq") + 1)
    )
    numbered = ring.join(ends, "ring").select(
        "ring", F.col("x").alias("x1"), F.col("y").alias("y1"), following.alias("seq")
    )
    after = ring.select("ring", "seq", F.col("x").alias("x2"), F.col("y").alias("y2"))
    return numbered.join(after, ["ring", "seq"]).drop("seq")


def mask_polygon(values: DataFrame, ring: DataFrame, cell_size: float) -> DataFrame:
    """The rows of cells inside a polygon, given as rings; inner rings cut holes.

    The bounding box comes first, as scalar subqueries in filters on the scan. A cell is inside
    when a ray from it crosses an odd number of edges; cells meet edges by horizontal strips
    one cell high, so that a strip holds few edges.
    """
    strip = float(cell_size)
    cropped = values
    for axis in ("x", "y"):
        low, high = (ring.agg(f(axis).alias("edge")).scalar() for f in (F.min, F.max))
        cropped = cropped.filter((F.col(axis) >= low) & (F.col(axis) <= high))
    spots = cropped.select("cell_id", "x", "y").distinct()
    edges = ring_edges(ring).withColumn(
        "strip",
        F.explode(
            F.sequence(
                F.floor(F.least("y1", "y2") / strip), F.floor(F.greatest("y1", "y2") / strip)
            )
        ),
    )
    y = F.col("y")
    at = F.col("x1") + ratio(y - F.col("y1"), F.col("y2") - F.col("y1")) * (
        F.col("x2") - F.col("x1")
    )
    crosses = ((F.col("y1") > y) != (F.col("y2") > y)) & (F.col("x") < at)
    inside = (
        spots.withColumn("strip", F.floor(y / strip))
        .join(edges, "strip")
        .filter(crosses)
        .groupBy("cell_id")
        .agg(F.count(F.lit(1)).alias("_crossings"))
        .filter(F.col("_crossings") % 2 == 1)
    )
    return cropped.join(inside, "cell_id", "left_semi")


# ------------------------------------------------------------------ projection


@dataclass(frozen=True)
class TransverseMercator:
    """A transverse Mercator system; the defaults are a statewide one on GRS80."""

    a: float = 6378137.0
    inverse_flattening: float = 298.257222101
    lon0: float = -90.0
    scale: float = 0.9996
    false_easting: float = 520000.0
    false_northing: float = -4480000.0

    @property
    def n(self) -> float:
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def rectifying_radius(self) -> float:
        n = self.n
        return self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def forward_terms(self) -> tuple[float, ...]:
        n = self.n
        return (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
            13 * n**2 / 48 - 3 * n**3 / 5,
            61 * n**3 / 240,
        )

    @property
    def inverse_terms(self) -> tuple[float, ...]:
        n = self.n
        return (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96,
            n**2 / 48 + n**3 / 15,
            17 * n**3 / 480,
        )

    @property
    def latitude_terms(self) -> tuple[float, ...]:
        n = self.n
        return (
            2 * n - 2 * n**2 / 3 - 2 * n**3,
            7 * n**2 / 3 - 8 * n**3 / 5,
            56 * n**3 / 15,
        )


def project_points(
    df: DataFrame,
    tm: TransverseMercator = TransverseMercator(),
    lon: str = "lon",
    lat: str = "lat",
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Longitude and latitude in degrees to plane coordinates (Krueger series)."""
    k = 2 * tm.n**0.5 / (1 + tm.n)
    sin_lat = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin_lat) - F.atanh(sin_lat * k) * k)
    turn = F.radians(F.col(lon) - tm.lon0)
    xi = F.atan2(t, F.cos(turn))
    eta = F.atanh(F.sin(turn) / F.sqrt(t * t + 1))
    east, north = eta, xi
    for j, term in enumerate(tm.forward_terms, start=1):
        east = east + F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * term
        north = north + F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * term
    unit = tm.scale * tm.rectifying_radius
    return df.withColumns(
        {x: east * unit + tm.false_easting, y: north * unit + tm.false_northing}
    )


def unproject_points(
    df: DataFrame,
    tm: TransverseMercator = TransverseMercator(),
    x: str = "x",
    y: str = "y",
    lon: str = "lon",
    lat: str = "lat",
) -> DataFrame:
    """Plane coordinates back to longitude and latitude in degrees."""
    unit = tm.scale * tm.rectifying_radius
    xi = (F.col(y) - tm.false_northing) / unit
    eta = (F.col(x) - tm.false_easting) / unit
    xi0, eta0 = xi, eta
    for j, term in enumerate(tm.inverse_terms, start=1):
        xi0 = xi0 - F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * term
        eta0 = eta0 - F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * term
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    latitude = chi
    for j, term in enumerate(tm.latitude_terms, start=1):
        latitude = latitude + F.sin(chi * 2 * j) * term
    turn = F.atan2(F.sinh(eta0), F.cos(xi0))
    return df.withColumns({lon: F.degrees(turn) + tm.lon0, lat: F.degrees(latitude)})


def pearson_corr(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation over the pairs without a NULL, and their number."""
    pairs = df.dropna(subset=[x, y])
    return pairs.groupBy(*by).agg(
        F.corr(x, y).alias("corr"), F.count(F.lit(1)).alias("n_pairs")
    )
