"""Views that read the given tables as survey tables.

Each view is one SQL text that Spark and DuckDB both run: integer arithmetic and CASE
only, so both sides start from the same rows. ``{lineitem}`` and the other names in
braces stand for the given tables.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

SLOTS = 2
STEMS = ("sp", "pr", "lm", "fm", "us")

RAW_COUNTS = """
SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
  CAST(day(l_shipdate) AS INT) AS day,
  CAST(CASE WHEN l_partkey % 66 < 55 THEN l_partkey % 66 + 1 ELSE l_partkey % 66 + 6 END AS INT) AS transect,
  CASE WHEN (l_partkey % 66) % 5 < 2 AND l_linenumber % 4 = 1 THEN 1
       WHEN (l_partkey % 66) % 5 < 2 AND l_linenumber % 4 = 2 THEN 2 ELSE NULL END AS grd,
  CASE WHEN (l_suppkey + l_orderkey) % 13 < 10 THEN CAST((l_suppkey + l_orderkey) % 13 AS INT) ELSE NULL END AS wetype,
  CASE l_orderkey % 17 WHEN 0 THEN 32 WHEN 1 THEN 40 WHEN 2 THEN 44 WHEN 3 THEN 72 WHEN 4 THEN 46
       WHEN 5 THEN 47 WHEN 6 THEN 50 WHEN 7 THEN 67 WHEN 8 THEN 81 WHEN 9 THEN 84 WHEN 10 THEN 86
       WHEN 11 THEN 20 WHEN 12 THEN 45 WHEN 13 THEN 32 WHEN 14 THEN 32 WHEN 15 THEN 0 ELSE NULL END AS sp1,
  CAST(CAST(l_quantity AS INT) % 4 AS INT) AS pr1, CAST(l_orderkey % 3 AS INT) AS lm1,
  CAST(l_partkey % 5 AS INT) AS fm1,
  CASE WHEN CAST(l_quantity AS INT) % 7 = 0 THEN CAST(l_orderkey % 31 AS INT) ELSE NULL END AS us1,
  CASE l_partkey % 5 WHEN 0 THEN 40 WHEN 1 THEN 44 WHEN 2 THEN 63 ELSE NULL END AS sp2,
  CAST(l_suppkey % 3 AS INT) AS pr2, CAST(l_partkey % 2 AS INT) AS lm2,
  CAST(l_orderkey % 2 AS INT) AS fm2, CAST(l_suppkey % 6 AS INT) AS us2,
  CASE WHEN l_orderkey % 11 = 0 THEN CAST(l_quantity AS INT) ELSE 0 END AS coots,
  CAST(l_suppkey % 25 AS INT) AS observer1,
  CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_orderkey % 29 AS INT) ELSE NULL END AS observer2,
  CASE WHEN l_partkey % 2 = 0 THEN 'N' ELSE 'S' END AS direct,
  CASE WHEN l_suppkey % 2 = 0 THEN 'L' ELSE 'R' END AS side
FROM {lineitem}
"""

_WET = ", ".join(
    f"CASE WHEN (l_orderkey + {i}) % {7 + i} < 3 THEN CAST((l_partkey + l_linenumber * {i}) % {3 + i} AS INT) ELSE NULL END AS {name}"
    for i, name in enumerate(["typ1", "typ2", "typ3", "typ4", "typ5", "typ6", "typ7", "typ8", "str", "dit"], start=1)
)
RAW_WETLANDS = f"""
SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
  CAST(CASE WHEN l_partkey % 66 < 55 THEN l_partkey % 66 + 1 ELSE l_partkey % 66 + 6 END AS INT) AS transect,
  CASE WHEN (l_partkey % 66) % 5 < 2 THEN 1 WHEN l_linenumber = 7 THEN NULL ELSE 0 END AS ground,
  {_WET}
FROM {{lineitem}}
"""


def _values(rows: list[tuple], columns: str) -> str:
    text = ", ".join("(" + ", ".join(str(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {text}) AS v({columns})"


TRANSECTS = _values(
    [(t, 1 if t < 30 else 2 if t < 43 else 3 if t < 61 else 4) for t in [*range(1, 56), *range(61, 72)]],
    "transect, region",
)

SPECIES_CODES = _values(
    [
        (32, "'Mallard'"),
        (40, "'Blue-winged Teal'"),
        (44, "'Wood Duck'"),
        (46, "'Redhead'"),
        (47, "'Canvasback'"),
        (50, "'Ring-necked Duck'"),
        (67, "'Ruddy Duck'"),
        (39, "'Green-winged Teal'"),
        (42, "'Northern Shoveler'"),
        (43, "'Northern Pintail'"),
        (35, "'Gadwall'"),
        (36, "'American Wigeon'"),
        (33, "'Black Duck'"),
        (30, "'Hooded Merganser'"),
        (29, "'Common Merganser'"),
        (31, "'Red-breasted Merganser'"),
        (51, "'Goldeneye'"),
        (72, "'Canada Goose'"),
        (81, "'Trumpeter Swan'"),
    ],
    "species, common_name",
)

# Wetland type codes and names.
WETLAND_CODES = _values(
    [
        (1, "'Temporary'"),
        (2, "'Wet Meadow'"),
        (3, "'Seasonal'"),
        (4, "'Semi-permanent'"),
        (5, "'Permanent/Open'"),
        (6, "'Shrub Swamps'"),
        (7, "'Wooded Swamps'"),
        (8, "'Bogs'"),
        (9, "'Stream'"),
        (0, "'Ditch'"),
    ],
    "wetype, wetland_name",
)

OBSERVERS = """
SELECT CAST(n_nationkey AS INT) AS code, concat(n_name, ', ', r_name) AS full_name
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

# One wide row per year, one column per species, as historical series arrive.
WIDE_SERIES = """
SELECT CAST(year(l_shipdate) AS INT) AS year,
  CAST(sum(CASE WHEN l_orderkey % 6 = 0 THEN CAST(l_quantity AS INT) END) AS DOUBLE) AS mall,
  CAST(sum(CASE WHEN l_orderkey % 6 = 1 THEN CAST(l_quantity AS INT) END) AS DOUBLE) AS bwte,
  CAST(sum(CASE WHEN l_orderkey % 6 = 2 THEN CAST(l_quantity AS INT) END) AS DOUBLE) AS wodu,
  CAST(sum(CASE WHEN l_orderkey % 6 = 3 THEN CAST(l_quantity AS INT) END) AS DOUBLE) AS o_ducks,
  CAST(sum(CASE WHEN l_orderkey % 6 = 4 THEN CAST(l_quantity AS INT) END) AS DOUBLE) AS t_ducks,
  CAST(sum(CASE WHEN l_orderkey % 6 = 5 THEN CAST(l_quantity AS INT) END) AS DOUBLE) AS geese
FROM {lineitem} GROUP BY year(l_shipdate)
"""

_SPECIES_CASE = """CASE l_orderkey % 7 WHEN 0 THEN 'mallard' WHEN 1 THEN 'blue-winged teal' WHEN 2 THEN 'wood duck'
       WHEN 3 THEN 'other ducks' WHEN 4 THEN 'total ducks' WHEN 5 THEN 'canada goose' ELSE 'trumpeter swan' END"""

# Stored estimates: ducks and geese, and swans, one row per year; 1998 is missing.
_POP_SERIES = f"""
SELECT year, species, CAST(sum(birds) AS DOUBLE) AS n
FROM (SELECT CAST(year(l_shipdate) AS INT) AS year, {_SPECIES_CASE} AS species,
        CAST(l_quantity AS INT) AS birds FROM {{lineitem}}) q
WHERE year <> 1998 AND species {{test}} 'trumpeter swan' GROUP BY year, species
"""
POP_ESTIMATES = _POP_SERIES.replace("{test}", "<>")
SWAN_ESTIMATES = _POP_SERIES.replace("{test}", "=")

# A trend result joined to its survey estimate, as the report stage reads it.
TREND_RESULTS = f"""
SELECT species, year, CAST(sum(birds) AS DOUBLE) AS mean,
  CAST(sum(birds) AS DOUBLE) / 16 AS sd,
  CAST(sum(birds) AS DOUBLE) * 3 / 4 AS lcl,
  CAST(sum(birds) AS DOUBLE) * 5 / 4 AS ucl,
  CAST(sum(birds) AS DOUBLE) * 15 / 16 AS median,
  CASE WHEN year <> 1998 THEN CAST(sum(CASE WHEN odd = 1 THEN birds END) * 2 AS DOUBLE) END AS n
FROM (SELECT CAST(year(l_shipdate) AS INT) AS year, {_SPECIES_CASE} AS species,
        CAST(l_quantity AS INT) AS birds, CAST(l_partkey % 2 AS INT) AS odd FROM {{lineitem}}) q
GROUP BY species, year
"""

# Monthly totals of each flag as a series; one month is missing.
SERIES = """
SELECT l_returnflag AS series_id, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT) AS t,
  CASE WHEN (year(l_shipdate) - 1995) * 12 + month(l_shipdate) <> 30
       THEN CAST(sum(CAST(l_quantity AS INT)) AS DOUBLE) END AS n
FROM {lineitem} GROUP BY l_returnflag, (year(l_shipdate) - 1995) * 12 + month(l_shipdate)
"""

# A 50 x 50 grid of monthly values.
GRID = """
SELECT CAST(cell AS INT) AS cell_id, CAST(cell % 50 AS DOUBLE) AS x,
  CAST((cell - cell % 50) / 50 AS DOUBLE) AS y, year, month, CAST(sum(amount) AS DOUBLE) AS value
FROM (SELECT l_partkey % 2500 AS cell, CAST(year(l_shipdate) AS INT) AS year,
        CAST(month(l_shipdate) AS INT) AS month, CAST(l_quantity AS INT) AS amount FROM {lineitem}) q
GROUP BY cell, year, month
"""

# The same on 10 x 10 cells, of which most have every month.
CLIMATE = """
SELECT CAST(cell AS INT) AS cell_id, CAST(cell % 10 AS DOUBLE) AS x,
  CAST((cell - cell % 10) / 10 AS DOUBLE) AS y, year, month, CAST(sum(amount) AS DOUBLE) AS value
FROM (SELECT l_partkey % 100 AS cell, CAST(year(l_shipdate) AS INT) AS year,
        CAST(month(l_shipdate) AS INT) AS month, CAST(l_quantity AS INT) AS amount FROM {lineitem}) q
GROUP BY cell, year, month
"""

# Flight lines over the grid: every order is a line, its line numbers the pieces flown.
# Consecutive pieces meet; a missing number leaves a gap. Each line belongs to a transect.
PIECES = """
SELECT DISTINCT l_orderkey AS line_id, CAST(l_orderkey % 66 + 1 AS INT) AS transect, l_linenumber AS seq,
  CAST(l_orderkey * 7 % 41 + l_linenumber AS DOUBLE) AS x1,
  CAST(l_orderkey * 11 % 37 + (l_orderkey + l_linenumber) % 3 AS DOUBLE) AS y1,
  CAST(l_orderkey * 7 % 41 + l_linenumber + 1 AS DOUBLE) AS x2,
  CAST(l_orderkey * 11 % 37 + (l_orderkey + l_linenumber + 1) % 3 AS DOUBLE) AS y2
FROM {lineitem}
"""

# The same lines as they may be flown: some pieces back again, and some in part once more.
FLOWN = f"""
WITH p AS ({PIECES.strip()})
SELECT * FROM p
UNION ALL SELECT line_id, transect, seq, x2, y2, x1, y1 FROM p WHERE (line_id + seq) % 3 = 0
UNION ALL SELECT line_id, transect, seq, (x1 + x2) / 2, (y1 + y2) / 2, x2 + (x2 - x1) / 4, y2 + (y2 - y1) / 4 FROM p
  WHERE (line_id + seq) % 4 = 0
"""

# Places in degrees.
PLACES = """
SELECT l_orderkey AS record_id, l_linenumber AS line,
  CAST(l_partkey % 600 AS DOUBLE) / 100 - 93 AS lon, CAST(l_suppkey * 13 % 450 AS DOUBLE) / 100 + 42 AS lat
FROM {lineitem}
"""

# A border: one outer ring with a notch, and a hole.
_OUTER = [(5.5, 4.5), (40.5, 2.5), (46.5, 24.5), (30.5, 28.5), (42.5, 45.5), (10.5, 43.5), (14.5, 22.5)]
_HOLE = [(18.5, 10.5), (24.5, 10.5), (24.5, 16.5), (18.5, 16.5)]
RING = _values(
    [
        (ring, seq, f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)")
        for ring, points in ((1, _OUTER), (2, _HOLE))
        for seq, (x, y) in enumerate(points, start=1)
    ],
    "ring, seq, x, y",
)

# Stored rows and a new delivery that overlaps them.
YEAR_BATCHES = """
SELECT o_orderkey AS record_id, CAST(year(o_orderdate) AS INT) AS year,
  CAST(o_custkey % 66 + 1 AS INT) AS transect FROM {orders}
"""

# Text numbers with a '.' for missing, and nullable counts.
TEXT_COUNTS = """
SELECT l_orderkey AS record_id, l_linenumber AS line,
  CASE WHEN l_linenumber = 4 THEN NULL ELSE CAST(l_linenumber AS INT) END AS month,
  CASE WHEN l_partkey % 3 = 0 THEN CAST(l_quantity AS INT) END AS typ1,
  CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_quantity AS INT) END AS typ2,
  CASE WHEN l_orderkey % 4 = 0 THEN '.' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(12)) END AS n
FROM {lineitem}
"""

VIEWS = {
    "raw_counts": RAW_COUNTS,
    "raw_wetlands": RAW_WETLANDS,
    "transects_regions": TRANSECTS,
    "species_codes": SPECIES_CODES,
    "wetland_codes": WETLAND_CODES,
    "observers": OBSERVERS,
    "wide_series": WIDE_SERIES,
    "pop_estimates": POP_ESTIMATES,
    "swan_estimates": SWAN_ESTIMATES,
    "trend_results": TREND_RESULTS,
    "series": SERIES,
    "grid": GRID,
    "climate": CLIMATE,
    "pieces": PIECES,
    "flown": FLOWN,
    "places": PLACES,
    "ring": RING,
    "year_batches": YEAR_BATCHES,
    "text_counts": TEXT_COUNTS,
}


def _tables(sql: str) -> set[str]:
    return {name for _, name, _, _ in Formatter().parse(sql) if name}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _tables(sql)}
    return spark.sql(sql, **frames)


def view_sql(name: str) -> str:
    sql = VIEWS[name]
    return sql.format(**{t: t for t in _tables(sql)}).strip()
