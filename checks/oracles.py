"""SQL that every registered query must agree with, written apart from the operators."""

from __future__ import annotations

import numpy as np

from checks.adapters import SLOTS, STEMS, VIEWS, view_sql
from checks.queries import CLASSES, DIGITS, DIST, RECENT, SINCE, THIN, WIDE_LABELS, YEAR

ORACLES: dict[str, str] = {}

COUNTS = [f"{s}{i}" for i in range(1, SLOTS + 1) for s in STEMS]
OTHER = [
    "year", "month", "day", "transect", "coots", "observer1", "observer2", "direct", "side",
]

# Named steps a query may start from; each is a CTE over the ones before it.
STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    name: ((), view_sql(name)) for name in VIEWS
}
STEPS["clean"] = (
    ("raw_counts",),
    f"""SELECT {", ".join(OTHER)}, COALESCE(grd, 4) AS grd,
      CASE WHEN wetype IS NULL AND sp1 >= 1 THEN 10 ELSE wetype END AS wetype,
      {", ".join(f"COALESCE({c}, 0) AS {c}" for c in COUNTS)} FROM raw_counts""",
)
STEPS["slots"] = (
    ("clean",),
    " UNION ALL ".join(
        f"""SELECT year, month, day, transect, grd, wetype, sp{i} AS species,
        CAST(pr{i} AS DOUBLE) AS pairs, CAST(lm{i} AS DOUBLE) AS lonedrake,
        CAST(fm{i} AS DOUBLE) AS flockdrake, CAST(us{i} AS DOUBLE) AS groups FROM clean"""
        for i in range(1, SLOTS + 1)
    ),
)
P_SPECIES = """CASE WHEN species = 32 THEN 1 WHEN species = 40 THEN 2 WHEN species = 44 THEN 3
    WHEN species = 72 THEN 4
    WHEN species < 29 OR species IN (45, 49, 53, 63, 66) OR species >= 72 THEN 9 ELSE 5 END"""
STEPS["classified"] = (
    ("slots", "transects_regions"),
    f"""SELECT s.*, t.region, {P_SPECIES} AS p_species FROM slots s
      LEFT JOIN transects_regions t ON s.transect = t.transect WHERE species <> 0""",
)
STEPS["merged"] = (
    ("classified",),
    """SELECT year, month, day, transect, grd, wetype, species, region, p_species, pairs, groups,
      CASE WHEN flockdrake = 1 THEN lonedrake + 1 ELSE lonedrake END AS lonedrake,
      CASE WHEN flockdrake = 1 THEN 0 ELSE flockdrake END AS flockdrake FROM classified""",
)
SMALL = "p_species <> 4 AND groups > 0 AND groups < 5"
STEPS["structured"] = (
    ("merged",),
    f"""SELECT year, month, day, transect, grd, wetype, species, region, p_species, flockdrake,
      CASE WHEN {SMALL} THEN pairs + floor(groups / 2) ELSE pairs END AS pairs,
      CASE WHEN {SMALL} THEN lonedrake + groups - 2 * floor(groups / 2) ELSE lonedrake END AS lonedrake,
      CASE WHEN {SMALL} THEN 0 ELSE groups END AS groups FROM merged""",
)
ONCE = "species IN (46, 47, 50, 67)"
STEPS["indexed"] = (
    ("structured",),
    f"""SELECT *, 2 * pairs + flockdrake + lonedrake + groups AS seen,
      CASE WHEN {ONCE} THEN 2 * pairs + flockdrake + lonedrake + groups
           ELSE 2 * (pairs + flockdrake + lonedrake) + groups END AS indicated,
      CASE WHEN {ONCE} THEN 2 * pairs + flockdrake + lonedrake
           ELSE 2 * (pairs + flockdrake + lonedrake) END AS old_indicated,
      CASE WHEN species = 81 THEN 2 * pairs + flockdrake + lonedrake
           WHEN {ONCE} THEN 2 * pairs + flockdrake + lonedrake + groups
           ELSE 2 * (pairs + flockdrake + lonedrake) + groups END AS ratio_birds FROM structured""",
)
STEPS["capped"] = (
    ("structured",),
    "SELECT * REPLACE (CASE WHEN groups > 19 THEN 0 ELSE groups END AS groups) FROM structured",
)
STEPS["capped_indexed"] = (
    ("capped",),
    f"""SELECT *,
      CASE WHEN species = 81 THEN 2 * pairs + flockdrake + lonedrake
           WHEN {ONCE} THEN 2 * pairs + flockdrake + lonedrake + groups
           ELSE 2 * (pairs + flockdrake + lonedrake) + groups END AS ratio_birds FROM capped""",
)


def _with(needs: tuple[str, ...], body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for n in STEPS[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    ctes = ",\n".join(f"{n} AS (\n{STEPS[n][1]}\n)" for n in order)
    return f"WITH {ctes}\n{body}" if ctes else body


def oracle(name: str, needs: tuple[str, ...] | str, body: str) -> None:
    needs = (needs,) if isinstance(needs, str) else needs
    digits = DIGITS.get(name)
    if digits:
        rounded = ", ".join(f"round({c}, {n}) AS {c}" for c, n in digits.items())
        body = f"SELECT * REPLACE ({rounded}) FROM (\n{body}\n) AS result"
    ORACLES[name] = _with(needs, body)


def step(name: str, needs: tuple[str, ...] | str, body: str) -> None:
    STEPS[name] = ((needs,) if isinstance(needs, str) else needs, body)


# ------------------------------------------------------------------ A

_DOUBLES = ["year", "month", "day", "transect", "grd", "wetype", *COUNTS, "coots", "observer1", "observer2"]
_INTEGERS = ("year", "month", "day", "transect", "grd", "wetype", "sp1", "sp2")


def _typed(column: str) -> str:
    return f"CAST({column} AS {'INT' if column in _INTEGERS else 'DOUBLE'}) AS {column}"


oracle(
    "read_counts",
    "raw_counts",
    f"SELECT {', '.join(map(_typed, _DOUBLES))}, direct, CASE WHEN year < 1998 THEN side END AS side FROM raw_counts",
)
_WETLAND = ["year", "month", "transect", "ground", *[f"typ{i}" for i in range(1, 9)], "str", "dit"]
oracle(
    "file_catalog",
    ("raw_counts", "raw_wetlands"),
    """SELECT DISTINCT year || '_waterfowl.csv' AS file_name, 'waterfowl' AS file_type, year AS file_year FROM raw_counts
      UNION ALL SELECT DISTINCT year || '_air_wetlands.csv', 'air_wetlands', year FROM raw_wetlands""",
)
oracle(
    "read_year_files",
    "raw_wetlands",
    f"""SELECT {", ".join(map(_typed, _WETLAND))},
      '{YEAR}_air_wetlands.csv' AS file_name FROM raw_wetlands WHERE year = {YEAR}""",
)
oracle(
    "load_table",
    ("raw_counts", "transects_regions", "species_codes", "wetland_codes"),
    """SELECT r.year, month, day, r.transect, r.wetype, sp1, pr1, region, common_name, wetland_name
      FROM raw_counts r LEFT JOIN transects_regions t ON r.transect = t.transect
      LEFT JOIN species_codes c ON r.sp1 = c.species LEFT JOIN wetland_codes w ON r.wetype = w.wetype
      WHERE r.year IN (2000, 2001)""",
)
for _name in ("append_year", "append_year_stream"):
    oracle(_name, "year_batches", "SELECT record_id, year, transect FROM year_batches")
oracle(
    "append_year_rejects",
    "year_batches",
    "SELECT CAST(year AS INT) AS year, 'all' AS delivery, count(*) AS n FROM year_batches WHERE year <= 1999 GROUP BY year",
)
oracle(
    "append_year_deliveries",
    "year_batches",
    "SELECT record_id, year, transect FROM year_batches WHERE year <= 1999",
)
oracle("write_output", "structured", "SELECT *, year AS analysis_year FROM structured")
oracle(
    "null_policy",
    "text_counts",
    """SELECT record_id, line, month, COALESCE(typ1, 0) AS typ1, COALESCE(typ2, 0) AS typ2,
      CASE WHEN n = '.' THEN NULL ELSE CAST(n AS DOUBLE) END AS n
      FROM text_counts WHERE month IS NOT NULL""",
)
oracle(
    "wide_series_to_long",
    "wide_series",
    " UNION ALL ".join(
        f"SELECT year, '{label}' AS species, {c} AS n FROM wide_series WHERE year <> 2001"
        for c, label in WIDE_LABELS.items()
    ),
)

# ------------------------------------------------------------------ B

oracle(
    "normalize_year",
    "raw_counts",
    "SELECT year AS true_year, year, month, transect FROM raw_counts",
)
oracle(
    "default_platform",
    "raw_counts",
    "SELECT year, month, day, transect, COALESCE(grd, 4) AS grd FROM raw_counts",
)
oracle(
    "field_sighting_code",
    "raw_counts",
    """SELECT year, month, day, transect, sp1,
      CASE WHEN wetype IS NULL AND sp1 >= 1 THEN 10 ELSE wetype END AS wetype FROM raw_counts""",
)
_ORDER = ["year", "month", "day", "grd", "wetype", *COUNTS, "coots", "observer1", "observer2", "direct", "side"]
oracle(
    "number_within",
    "raw_counts",
    f"""SELECT *, row_number() OVER (PARTITION BY transect
      ORDER BY {", ".join(f"{c} NULLS FIRST" for c in _ORDER)}) AS basin_no FROM raw_counts""",
)
oracle("slots_to_long", "slots", "SELECT * FROM slots")
oracle(
    "attach_region",
    ("raw_counts", "transects_regions"),
    """SELECT year, month, day, r.transect, sp1, sp2, region FROM raw_counts r
      LEFT JOIN transects_regions t ON r.transect = t.transect""",
)
oracle(
    "band_region",
    "raw_counts",
    """SELECT year, month, day, transect + 3 AS transect,
      CASE WHEN transect + 3 < 30 THEN 1 WHEN transect + 3 < 43 THEN 2 WHEN transect + 3 < 61 THEN 3
           WHEN transect + 3 < 72 THEN 4 END AS region FROM raw_counts""",
)
oracle(
    "classify_species",
    "slots",
    f"SELECT year, transect, species, pairs, {P_SPECIES} AS p_species FROM slots",
)
oracle("drop_empty_slots", "slots", "SELECT * FROM slots WHERE species <> 0")
oracle("merge_single_flocked", "merged", "SELECT * FROM merged")
oracle("small_groups_to_pairs", "structured", "SELECT * FROM structured")
oracle("cap_large_groups", "capped", "SELECT * FROM capped")
oracle("bird_indices", "indexed", "SELECT * FROM indexed")
oracle(
    "platform_views",
    "structured",
    """SELECT view, year, count(*) AS n, CAST(sum(species) AS BIGINT) AS sum_species,
      CAST(sum(transect) AS BIGINT) AS sum_transect
      FROM structured JOIN (VALUES ('air', 1), ('air', 4), ('paired', 1), ('paired', 2), ('ground', 2),
        ('all', 1), ('all', 2), ('all', 4), ('known', 1), ('known', 2), ('known', 4)) AS v(view, code)
      ON grd = code GROUP BY view, year""",
)

# ------------------------------------------------------------------ C

AIR = "grd IN (1, 4)"


def _regions(value: str, where: str = "TRUE") -> str:
    labels = ((1, "SEC"), (2, "NHI"), (3, "NLO"), (4, "SWD"))
    return ", ".join(
        f"sum({value}) FILTER (WHERE region = {code} AND {where}) AS {label}" for code, label in labels
    )


step(
    "group_table",
    "indexed",
    f"""SELECT year, p_species, {_regions("groups")} FROM indexed WHERE {AIR} AND groups >= 5
      GROUP BY year, p_species""",
)
step(
    "bird_table",
    "indexed",
    f"SELECT year, p_species, {_regions('indicated')} FROM indexed WHERE {AIR} GROUP BY year, p_species",
)
oracle("groups_by_region", "group_table", "SELECT * FROM group_table")
oracle("birds_by_region", "bird_table", "SELECT * FROM bird_table")
oracle(
    "groups_by_region_year",
    "group_table",
    f"""SELECT year, p_species, COALESCE(SEC, 0) AS SEC, COALESCE(NHI, 0) AS NHI,
      COALESCE(NLO, 0) AS NLO, COALESCE(SWD, 0) AS SWD,
      COALESCE(SEC, 0) + COALESCE(NHI, 0) + COALESCE(NLO, 0) + COALESCE(SWD, 0) AS total
      FROM group_table WHERE year = {YEAR}""",
)
oracle(
    "grouped_sightings",
    "structured",
    f"SELECT * FROM structured WHERE {AIR} AND groups >= 5 AND year = {YEAR}",
)
oracle(
    "previous_survey_year",
    "structured",
    "SELECT max(year) AS previous_year FROM structured WHERE year < (SELECT max(year) FROM structured)",
)
oracle(
    "group_and_bird_union",
    ("group_table", "bird_table"),
    """SELECT *, 'groups' AS measure FROM group_table
      UNION ALL SELECT *, 'birds' AS measure FROM bird_table""",
)
oracle(
    "seen_by_platform",
    "indexed",
    f"""SELECT COALESCE(a.year, g.year) AS year, COALESCE(a.p_species, g.p_species) AS p_species,
      air_seen, ground_seen
      FROM (SELECT year, p_species, sum(seen) AS air_seen FROM indexed WHERE {AIR} GROUP BY ALL) a
      FULL JOIN (SELECT year, p_species, sum(seen) AS ground_seen FROM indexed WHERE grd = 2 GROUP BY ALL) g
      ON a.year = g.year AND a.p_species = g.p_species
      WHERE COALESCE(a.year, g.year) >= {YEAR - 1}""",
)
step(
    "composition",
    "indexed",
    f"""SELECT year, region, species, 'region' AS level, sum(indicated) AS birds FROM indexed
        WHERE {AIR} AND p_species = 5 AND groups < 20 GROUP BY year, region, species
      UNION ALL SELECT year, NULL, species, 'state', sum(indicated) FROM indexed
        WHERE {AIR} AND p_species = 5 AND groups < 20 GROUP BY year, species""",
)
oracle("composition_counts", "composition", "SELECT * FROM composition")
# The species of the composition table.
COMPOSITION = [
    "common_merganser",
    "hooded_merganser",
    "green_winged_teal",
    "northern_shoveler",
    "northern_pintail",
    "redhead",
    "canvasback",
    "ring_necked_duck",
    "goldeneye",
    "ruddy_duck",
    "red_breasted_merganser",
    "black_duck",
    "gadwall",
    "american_wigeon",
]
_SHARES = ", ".join(
    f"COALESCE(max(percent) FILTER (WHERE name = '{n}'), '0%') AS {n}" for n in COMPOSITION
)
oracle(
    "composition_share",
    ("composition", "species_codes", "structured"),
    f"""SELECT p.year, p.region, p.level, {_SHARES}
      FROM (SELECT DISTINCT year, region, 'region' AS level FROM structured WHERE {AIR}
            UNION ALL SELECT DISTINCT year, NULL, 'state' FROM structured WHERE {AIR}) p
      LEFT JOIN (
        SELECT n.year, n.region, n.level, name,
          CAST(CAST(round_even(birds / whole * 100, 0) AS INT) AS VARCHAR) || '%' AS percent
        FROM (SELECT c.year, c.region, c.level, lower(replace(replace(common_name, ' ', '_'), '-', '_')) AS name,
                sum(birds) AS birds
              FROM composition c LEFT JOIN species_codes s ON c.species = s.species GROUP BY ALL) n
        JOIN (SELECT year, region, level, sum(birds) AS whole FROM composition GROUP BY ALL) w
          ON n.year = w.year AND n.level = w.level AND n.region IS NOT DISTINCT FROM w.region) q
        ON q.year = p.year AND q.level = p.level AND q.region IS NOT DISTINCT FROM p.region
      GROUP BY p.year, p.region, p.level""",
)
oracle(
    "last_n_years_total",
    "clean",
    """SELECT year, CAST(sum(coots) AS BIGINT) AS coots FROM clean WHERE coots <> 0 AND grd <> 2
      GROUP BY year ORDER BY year DESC LIMIT 5""",
)
oracle(
    "total_vs_ungrouped",
    "indexed",
    f"""SELECT t.year, cranes_total, cranes_no_groups
      FROM (SELECT year, sum(seen) AS cranes_total FROM indexed WHERE {AIR} AND species = 86 GROUP BY year) t
      LEFT JOIN (SELECT year, sum(seen) AS cranes_no_groups FROM indexed
        WHERE {AIR} AND species = 86 AND groups = 0 GROUP BY year) u ON t.year = u.year""",
)
oracle(
    "species_since",
    "indexed",
    f"""SELECT year, month, day, transect, grd, seen FROM indexed
      WHERE {AIR} AND species = 84 AND year >= {SINCE}""",
)
oracle(
    "species_total",
    "indexed",
    f'SELECT sum(seen) AS "count" FROM indexed WHERE species = 84 AND year = {YEAR}',
)
oracle(
    "swans_small_groups",
    "indexed",
    f"""SELECT year, sum(seen) AS seen FROM indexed
      WHERE {AIR} AND species = 81 AND groups < 5 AND year >= {SINCE} GROUP BY year""",
)
oracle(
    "species_by_region_transect",
    "capped_indexed",
    f"""SELECT region, transect, sum(ratio_birds) AS birds FROM capped_indexed
        WHERE {AIR} AND species = 81 AND year = {YEAR} GROUP BY region, transect
      UNION ALL SELECT region, NULL, sum(ratio_birds) FROM capped_indexed
        WHERE {AIR} AND species = 81 AND year = {YEAR} GROUP BY region""",
)


def _day(column: str) -> str:
    return f"strftime({column}, '%B ') || CAST(day({column}) AS VARCHAR)"


def _lags(keys: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    mine = ", ".join(f"b.{k}" for k in keys.split(", "))
    return f"""SELECT {mine}, b.date, b.grd, CAST(b.date - a.date AS INT) AS diff
      FROM numbered a JOIN numbered b ON {on} AND a.rn = 1 AND b.rn = 2 AND a.n = 2"""


def _numbered(keys: str) -> str:
    return f"""SELECT *, count(*) OVER (PARTITION BY {keys}) AS n,
        row_number() OVER (PARTITION BY {keys} ORDER BY grd, date) AS rn
      FROM (SELECT DISTINCT {keys}, make_date(year, month, day) AS date, grd FROM clean WHERE grd IN (1, 2)) d"""


oracle(
    "air_ground_lag_days",
    "clean",
    f"""SELECT * FROM (WITH numbered AS ({_numbered("year, month, transect")})
      {_lags("year, month, transect")}) q""",
)
oracle(
    "survey_timing",
    "clean",
    f"""SELECT q.year, {_day("air_min")} AS aerial_start_survey_date,
        CASE WHEN air_days > 1 THEN {_day("air_max")} END AS aerial_end_survey_date,
        air_days AS aerial_total_survey_days,
        {_day("ground_min")} AS ground_start_survey_date,
        CASE WHEN ground_days > 1 THEN {_day("ground_max")} END AS ground_end_survey_date,
        ground_days AS ground_total_survey_days, overlap AS air_ground_overlap,
        {_day("any_min")} AS min_air_ground_survey_date, {_day("any_max")} AS max_air_ground_survey_date
      FROM (SELECT year, min(d) FILTER (WHERE grd <> 2) AS air_min, max(d) FILTER (WHERE grd <> 2) AS air_max,
              count(DISTINCT d) FILTER (WHERE grd <> 2) AS air_days, min(d) FILTER (WHERE grd = 2) AS ground_min,
              max(d) FILTER (WHERE grd = 2) AS ground_max, count(DISTINCT d) FILTER (WHERE grd = 2) AS ground_days,
              min(d) AS any_min, max(d) AS any_max
            FROM (SELECT year, grd, make_date(year, month, day) AS d FROM clean) c GROUP BY year) q
      LEFT JOIN (SELECT year, max(abs(diff)) AS overlap
        FROM (WITH numbered AS ({_numbered("year, transect")}) {_lags("year, transect")}) l GROUP BY year) o
      ON q.year = o.year""",
)
oracle(
    "mean_count_by_transect",
    ("indexed", "species_codes"),
    f"""SELECT transect, common_name, sum(birds) / count(*) AS "count"
      FROM (SELECT transect, species, year, sum(indicated) AS birds FROM indexed
            WHERE {AIR} AND species IN (50, 32, 40, 44) GROUP BY ALL) y
      LEFT JOIN species_codes c ON y.species = c.species GROUP BY transect, common_name""",
)
oracle(
    "air_vs_ground_series",
    "capped_indexed",
    """SELECT p_species, year, CASE grd WHEN 1 THEN 'Air' ELSE 'Ground' END AS count_type,
      sum(ratio_birds) AS birds FROM capped_indexed WHERE grd IN (1, 2) GROUP BY p_species, year, grd""",
)
oracle(
    "grouped_share",
    "indexed",
    f"""SELECT *, 100 * (grouped / NULLIF(indicated, 0)) AS share FROM (
      SELECT year, p_species, region, 'region' AS level,
        COALESCE(sum(groups) FILTER (WHERE groups >= 5), 0) AS grouped, sum(indicated) AS indicated
        FROM indexed WHERE {AIR} GROUP BY year, p_species, region
      UNION ALL SELECT year, p_species, NULL, 'state',
        COALESCE(sum(groups) FILTER (WHERE groups >= 5), 0), sum(indicated)
        FROM indexed WHERE {AIR} GROUP BY year, p_species) q""",
)

# ------------------------------------------------------------------ D

TYPES = [*[f"typ{i}" for i in range(1, 9)], "stream", "ditch"]
REGION = "CASE WHEN transect < 30 THEN 1 WHEN transect < 43 THEN 2 WHEN transect < 61 THEN 3 WHEN transect < 72 THEN 4 END"
step(
    "unoccupied",
    "raw_wetlands",
    f"""SELECT year, {REGION} AS region,
      {", ".join(f"CAST(COALESCE(sum({c}), 0) AS DOUBLE) AS {t}" for t, c in zip(TYPES, [*TYPES[:8], "str", "dit"]))}
      FROM raw_wetlands GROUP BY ALL""",
)
step(
    "occupied",
    "clean",
    f"""SELECT year, {REGION} AS region,
      {", ".join(f"CAST(sum(CASE WHEN wetype = {k} THEN 1 ELSE 0 END) AS DOUBLE) AS {t}" for t, k in zip(TYPES, [1, 2, 3, 4, 5, 6, 7, 8, 9, 0]))}
      FROM clean WHERE sp1 <> 0 AND grd <> 2 GROUP BY ALL""",
)
step(
    "total_wet",
    ("unoccupied", "occupied"),
    f"""SELECT u.year, u.region, {", ".join(f"2 * u.{t} + COALESCE(o.{t}, 0) AS {t}" for t in TYPES)}
      FROM unoccupied u LEFT JOIN occupied o ON u.year = o.year AND u.region = o.region""",
)
step(
    "density",
    "total_wet",
    f"""SELECT year, t.region, {", ".join(f"{t} / n / 7.5::DOUBLE AS {t}" for t in TYPES)} FROM total_wet t
      JOIN (VALUES (1, 29::DOUBLE), (2, 13::DOUBLE), (3, 13::DOUBLE), (4, 11::DOUBLE)) AS d(region, n)
      ON t.region = d.region""",
)
step(
    "wetlands",
    "density",
    """SELECT year, region, typ1 + typ2 + typ6 AS i_ii_vi, typ3 AS iii, typ4 + typ5 AS iv_v,
      typ7 + typ8 AS vii_viii, typ1 + typ2 + typ3 + typ4 + typ5 + typ6 + typ7 + typ8 AS non_linear,
      stream, ditch, stream + ditch AS linear FROM density""",
)
oracle("unoccupied_wetlands", "unoccupied", "SELECT * FROM unoccupied")
oracle("occupied_wetlands", "occupied", "SELECT * FROM occupied")
oracle("total_wetlands", "total_wet", "SELECT * FROM total_wet")
oracle("wetland_density", "density", "SELECT * FROM density")
oracle("wetland_classes", "wetlands", "SELECT * FROM wetlands")

# ------------------------------------------------------------------ E

step(
    "paired",
    "capped_indexed",
    """SELECT species, year, transect, air, ground, air * air AS sqx, ground * ground AS sqy, air * ground AS xy
      FROM (SELECT p_species AS species, year, transect,
              sum(CASE WHEN grd = 1 THEN ratio_birds ELSE 0 END) AS air,
              sum(CASE WHEN grd = 2 THEN ratio_birds ELSE 0 END) AS ground
            FROM capped_indexed WHERE grd IN (1, 2) GROUP BY p_species, year, transect) s""",
)
# Each window is summed afresh over its own years, not as a running total.
step(
    "windows",
    "paired",
    """SELECT species, CAST(i AS INT) AS n_years, sum_sqx, sum_sqy, sum_xy, sum_air, sum_grd, min_year, max_year, r,
        var_top, var_bottom, var_top / NULLIF(var_bottom, 0) AS var_r, sqrt(var_top / NULLIF(var_bottom, 0)) AS se_r,
        sqrt(var_top / NULLIF(var_bottom, 0)) / NULLIF(r, 0) AS cvr_r, max_year - min_year AS year_span
      FROM (SELECT *, sum_sqy + r * r * sum_sqx - 2 * r * sum_xy AS var_top,
              (sum_air / n) * (sum_air / n) * (n * (n - 1)) AS var_bottom
            FROM (SELECT *, sum_grd / NULLIF(sum_air, 0) AS r, CAST(27 * i AS DOUBLE) AS n
                  FROM (SELECT sp.species, w.i, COALESCE(sum(sqx), 0) AS sum_sqx, COALESCE(sum(sqy), 0) AS sum_sqy,
                          COALESCE(sum(xy), 0) AS sum_xy, COALESCE(sum(air), 0) AS sum_air,
                          COALESCE(sum(ground), 0) AS sum_grd, min(p.year) AS min_year, max(p.year) AS max_year
                        FROM (VALUES (1), (2), (3), (4), (5)) AS sp(species)
                        CROSS JOIN (SELECT row_number() OVER (ORDER BY year DESC) AS i, year AS start
                              FROM (SELECT DISTINCT year FROM paired) y) w
                        LEFT JOIN paired p ON p.species = sp.species AND p.year >= w.start
                        WHERE w.i >= 2 GROUP BY sp.species, w.i) a) b) c""",
)


def _chosen(cv: float) -> str:
    return f"""SELECT w.*, COALESCE(first_met IS NOT NULL, FALSE) AS target_met FROM windows w
      JOIN (SELECT species, min(CASE WHEN cvr_r < {cv} THEN n_years END) AS first_met, max(n_years) AS widest
            FROM windows GROUP BY species) c
      ON w.species = c.species AND w.n_years = COALESCE(first_met, widest)"""


oracle("paired_transect_sums", "paired", "SELECT * FROM paired")
oracle("ratio_windows", "windows", "SELECT * FROM windows")
step("chosen", "windows", _chosen(0.20))
oracle("ratio_correction", "chosen", "SELECT * FROM chosen")
oracle("ratio_correction_cv08", "windows", _chosen(0.08))
oracle("ratio_correction_cv05", "windows", _chosen(0.05))

_STRATA = """(VALUES (1, 29::DOUBLE, 17949::DOUBLE), (2, 13::DOUBLE, 9431::DOUBLE),
      (3, 13::DOUBLE, 15979::DOUBLE), (4, 11::DOUBLE, 12311::DOUBLE)) AS d(region, n, area)"""


def _population(source: str, keys: str, r: str) -> str:
    return f"""SELECT {keys}, total_air, 56.25::DOUBLE AS sqm, sum_sq_air, 56.25::DOUBLE * n AS sum_sq,
        total_air * 7.5::DOUBLE AS sum_air_xm, var_b, sqrt(var_b) AS se_b, sqrt(var_b) / NULLIF(b, 0) AS cv_b, b, area,
        {"r," if r else ""} round_even(b * area * r, 0) AS pop_est, pop_var, sqrt(pop_var) AS pop_se_1,
        sqrt(pop_var) / sqrt(n) AS pop_se_2
      FROM (SELECT *, area * area * (var_b * (r * r) + var_r * (b * b) - var_b * var_r) AS pop_var
            FROM (SELECT *, (sum_sq_air + b * b * (56.25::DOUBLE * n) - 2 * b * (total_air * 7.5::DOUBLE))
                    / (56.25::DOUBLE * n * (n - 1)) AS var_b
                  FROM (SELECT *, total_air / n / 7.5::DOUBLE AS b FROM ({source}) s) t) u) v"""


step(
    "transect_sums",
    "capped_indexed",
    f"""SELECT p_species, species, region, transect, sum(ratio_birds) AS t FROM capped_indexed
      WHERE {AIR} AND year = {YEAR} GROUP BY ALL""",
)
step(
    "by_region",
    ("transect_sums", "chosen"),
    _population(
        f"""SELECT sp.species, d.region, n, area, r, var_r, COALESCE(total_air, 0) AS total_air,
          COALESCE(sum_sq_air, 0) AS sum_sq_air
          FROM {_STRATA} CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS sp(species)
          LEFT JOIN (SELECT species, region, sum(t) AS total_air, sum(t * t) AS sum_sq_air
            FROM (SELECT p_species AS species, region, transect, sum(t) AS t FROM transect_sums GROUP BY ALL) x
            GROUP BY species, region) c ON c.species = sp.species AND c.region = d.region
          LEFT JOIN chosen k ON k.species = sp.species""",
        "species, region",
        "r",
    ),
)
oracle("population_by_region", "by_region", "SELECT * FROM by_region")
oracle(
    "population_by_region_uncorrected",
    "transect_sums",
    _population(
        f"""SELECT 81 AS species, d.region, n, area, CAST(1 AS DOUBLE) AS r, CAST(0 AS DOUBLE) AS var_r,
          COALESCE(total_air, 0) AS total_air, COALESCE(sum_sq_air, 0) AS sum_sq_air FROM {_STRATA}
          LEFT JOIN (SELECT region, sum(t) AS total_air, sum(t * t) AS sum_sq_air FROM transect_sums
            WHERE species = 81 GROUP BY region) c ON c.region = d.region""",
        "species, region",
        "",
    ),
)
oracle(
    "population_statewide",
    ("transect_sums", "chosen"),
    _population(
        """SELECT k.species, CAST(66 AS DOUBLE) AS n, CAST(55670 AS DOUBLE) AS area, r, var_r,
          COALESCE(total_air, 0) AS total_air, COALESCE(sum_sq_air, 0) AS sum_sq_air FROM chosen k
          LEFT JOIN (SELECT species, sum(t) AS total_air, sum(t * t) AS sum_sq_air
            FROM (SELECT p_species AS species, transect, sum(t) AS t FROM transect_sums GROUP BY ALL) x
            GROUP BY species) c ON c.species = k.species""",
        "species",
        "r",
    ),
)
oracle(
    "annual_totals",
    "by_region",
    f"""SELECT label AS species, {YEAR} AS year, sum(pop_est) AS n FROM by_region
      JOIN (VALUES (1, 'mallard'), (2, 'blue-winged teal'), (3, 'wood duck'), (4, 'canada goose'), (5, 'other ducks'),
        (1, 'total ducks'), (2, 'total ducks'), (3, 'total ducks'), (5, 'total ducks')) AS l(code, label)
      ON species = code GROUP BY label""",
)
oracle(
    "statewide_se",
    "by_region",
    "SELECT species, sqrt(sum(pop_var)) AS pop_se_1 FROM by_region GROUP BY species",
)
oracle(
    "top_region_share",
    "by_region",
    """SELECT species, CASE region WHEN 1 THEN 'SEC' WHEN 2 THEN 'NHI' WHEN 3 THEN 'NLO' ELSE 'SWD' END AS region,
        round_even(freq, 0) AS percent
      FROM (SELECT species, region, pop_est / sum(pop_est) OVER (PARTITION BY species) * 100 AS freq,
              row_number() OVER (PARTITION BY species ORDER BY pop_est DESC, region DESC) AS rn FROM by_region) q
      WHERE rn = 1""",
)

# ------------------------------------------------------------------ F

step(
    "all_estimates",
    ("pop_estimates", "swan_estimates"),
    "SELECT * FROM pop_estimates UNION ALL SELECT * FROM swan_estimates",
)

# The trend's posterior on a fixed grid, Gauss nodes in panels: a filter and a smoother by recursion over
# time, and quantiles of the mixtures by halving.
def _axis(panels: int, nodes: int) -> str:
    x, w = np.polynomial.legendre.leggauss(nodes)
    rows = [((k + (a + 1) / 2) / panels, b) for k in range(panels) for a, b in zip(x.tolist(), w.tolist())]
    values = ", ".join(f"({u!r}::DOUBLE, {b!r}::DOUBLE)" for u, b in rows)
    return f"SELECT u, greatest(2 * u * u * u, 1e-6) AS sd, ln(w) + 2 * ln(u) AS lw FROM (VALUES {values}) AS t(u, w)"


def _even(nodes: int) -> str:
    return f"""SELECT u, greatest(2 * u * u * u, 1e-6) AS sd, 2 * ln(u) AS lw
      FROM (SELECT (i + 0.5::DOUBLE) / {nodes} AS u FROM range({nodes}) AS r(i)) r"""


def _filtered(source: str, first: str, second: str) -> str:
    """``held``: nodes of some weight w, as they are after the last observation (the last k, which has none);
    ``fwd`` has the states before each observation. ``first`` and ``second`` are the nodes of eps and sigma."""
    return f"""WITH RECURSIVE observed AS (
        SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS k, t, log_n AS y FROM {source}
        UNION ALL SELECT series, count(*), NULL, NULL FROM {source} GROUP BY series),
      nodes AS MATERIALIZED (
        SELECT row_number() OVER () AS node, a.sd AS eps, b.sd AS sigma, a.u, b.u AS v, a.lw + b.lw AS lw
        FROM ({first}) a, ({second}) b),
      fwd AS MATERIALIZED (
        SELECT series, node, k, y AS level, 0.0::DOUBLE AS drift, 4.0::DOUBLE AS p, 0.0::DOUBLE AS q, 1.0::DOUBLE AS d,
          0.0::DOUBLE AS ll, y, eps, sigma FROM observed, nodes WHERE k = 0
        UNION ALL
        SELECT f.series, node, o.k, level + drift, drift, p + 2 * q + d + eps * eps, q + d, d, ll, o.y, eps, sigma
        FROM (SELECT series, node, k, eps, sigma,
                CASE WHEN y IS NULL THEN level ELSE level + p / s * (y - level) END AS level,
                CASE WHEN y IS NULL THEN drift ELSE drift + q / s * (y - level) END AS drift,
                CASE WHEN y IS NULL THEN p ELSE p * sigma * sigma / s END AS p,
                CASE WHEN y IS NULL THEN q ELSE q * sigma * sigma / s END AS q,
                CASE WHEN y IS NULL THEN d ELSE greatest(d - q * q / s, 0) END AS d,
                CASE WHEN y IS NULL THEN ll
                  ELSE ll - (ln(2 * pi() * s) + (y - level) * (y - level) / s) / 2 END AS ll
              FROM (SELECT *, p + sigma * sigma AS s FROM fwd) a) f
        JOIN observed o ON o.series = f.series AND o.k = f.k + 1),
      ends AS (SELECT series, max(k) AS k FROM observed GROUP BY series),
      held AS MATERIALIZED (
        SELECT * FROM (
          SELECT *, share / sum(share) OVER (PARTITION BY series) AS w
          FROM (SELECT f.*, n.u, n.v, exp(ll + lw - max(ll + lw) OVER (PARTITION BY f.series)) AS share
                FROM fwd f JOIN ends e ON e.series = f.series AND e.k = f.k JOIN nodes n ON n.node = f.node) a) b
        WHERE w > 1e-13)"""


def _cdf(z: str) -> str:
    k = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2.0::DOUBLE)))"
    poly = f"{k} * (0.254829592 + {k} * (-0.284496736 + {k} * (1.421413741 + {k} * (-1.453152027 + {k} * 1.061405429))))"
    upper = f"0.5 * ({poly}) * exp(-({z}) * ({z}) / 2)"
    return f"CASE WHEN {z} > 0 THEN 1 - {upper} ELSE {upper} END"


def _quantiles(name: str, table: str, keys: str) -> str:
    """CTEs that end in ``name``: lcl, median and ucl of mixtures of normals (w, m, s), a row per keys."""
    same = " AND ".join(f"n.{k} = b.{k}" for k in keys.split(", "))
    own = ", ".join(f"b.{k}" for k in keys.split(", "))
    return f"""{name}_halved AS (
        SELECT {keys}, target::DOUBLE AS target, min(m - 9 * s) AS low, max(m + 9 * s) AS high, 0 AS i
        FROM {table}, (VALUES (0.025), (0.5), (0.975)) AS v(target) GROUP BY ALL
        UNION ALL
        SELECT {keys}, target, CASE WHEN below < target THEN middle ELSE low END,
          CASE WHEN below < target THEN high ELSE middle END, i + 1
        FROM (SELECT {own}, target, low, high, middle, i, sum(w * ({_cdf("z")})) AS below
              FROM (SELECT {own}, target, low, high, middle, i, w, (middle - n.m) / n.s AS z
                    FROM (SELECT *, (low + high) / 2 AS middle FROM {name}_halved WHERE i < 46) b
                    JOIN {table} n ON {same}) b GROUP BY ALL) q),
      {name} AS (
        SELECT {keys}, max(CASE WHEN target < 0.5 THEN (low + high) / 2 END) AS lcl,
          max(CASE WHEN target = 0.5 THEN (low + high) / 2 END) AS median,
          max(CASE WHEN target > 0.5 THEN (low + high) / 2 END) AS ucl
        FROM {name}_halved WHERE i = 46 GROUP BY {keys})"""


def _levels(source: str) -> str:
    """series, t and the statistics of N from (series, t, log_n)."""
    axis = _axis(4, 32)
    return f"""{_filtered(source, axis, axis)},
      past AS MATERIALIZED (
        SELECT series, node, k, level, p, q, y, s, 1 - (p + q) / s AS k1, -q / s AS k2
        FROM (SELECT f.*, f.p + f.sigma * f.sigma AS s
              FROM fwd f JOIN held h ON h.series = f.series AND h.node = f.node) a),
      back AS (
        SELECT series, node, k, 0.0::DOUBLE AS r1, 0.0::DOUBLE AS r2, 0.0::DOUBLE AS n11, 0.0::DOUBLE AS n12,
          0.0::DOUBLE AS n22, w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS s FROM held
        UNION ALL
        SELECT series, node, k, r1, r2, n11, n12, n22, w, level + p * r1 + q * r2,
          sqrt(greatest(p - (p * p * n11 + 2 * p * q * n12 + q * q * n22), 1e-300))
        FROM (SELECT f.series, f.node, f.k, f.level, f.p, f.q, b.w,
                CASE WHEN y IS NULL THEN r1 ELSE (y - level) / f.s + k1 * r1 + k2 * r2 END AS r1, r1 + r2 AS r2,
                CASE WHEN y IS NULL THEN n11
                  ELSE 1 / f.s + k1 * k1 * n11 + 2 * k1 * k2 * n12 + k2 * k2 * n22 END AS n11,
                CASE WHEN y IS NULL THEN n11 + n12 ELSE k1 * (n11 + n12) + k2 * (n12 + n22) END AS n12,
                n11 + 2 * n12 + n22 AS n22
              FROM back b JOIN past f ON f.series = b.series AND f.node = b.node AND f.k = b.k - 1) q),
      levels AS MATERIALIZED (SELECT *, exp(m + s * s / 2) AS value FROM back WHERE s > 0),
      moments AS (
        SELECT l.series, l.k, any_value(a.mean) AS mean,
          sqrt(sum(w * value * value * (exp(s * s) - 1)) + sum(w * (value - a.mean) * (value - a.mean))) AS sd
        FROM levels l JOIN (SELECT series, k, sum(w * value) AS mean FROM levels GROUP BY series, k) a
        ON a.series = l.series AND a.k = l.k GROUP BY l.series, l.k),
      {_quantiles("limits", "levels", "series, k")}
      SELECT m.series, o.t, mean, sd, exp(lcl) AS lcl, exp(ucl) AS ucl, exp(median) AS median
      FROM moments m JOIN limits q ON q.series = m.series AND q.k = m.k
      JOIN observed o ON o.series = m.series AND o.k = m.k"""


def _growth(source: str) -> str:
    axis = _axis(4, 32)
    return f"""{_filtered(source, axis, axis)},
      drifts AS MATERIALIZED (SELECT series, w, drift AS m, sqrt(greatest(d, 1e-300)) AS s FROM held),
      {_quantiles("limits", "drifts", "series")}
      SELECT d.series, 'growth_rate' AS parameter, any_value(a.mean) AS mean,
        sqrt(sum(w * (s * s + (m - a.mean) * (m - a.mean)))) AS sd, any_value(lcl) AS lcl, any_value(ucl) AS ucl,
        any_value(median) AS median
      FROM drifts d JOIN (SELECT series, sum(w * m) AS mean FROM drifts GROUP BY series) a ON a.series = d.series
      JOIN limits q ON q.series = d.series GROUP BY d.series"""


def _sd(source: str, parameter: str, fine: int = 4000) -> str:
    """Moments and limits of one sd: narrow strips of it, Gauss nodes of the other."""
    first, second = _even(fine), _axis(2, 32)
    sd, at = ("eps", "u") if parameter == "process_sd" else ("sigma", "v")
    pair = (first, second) if parameter == "process_sd" else (second, first)
    limit = "max(CASE WHEN before < {p} * total AND upto >= {p} * total THEN (edge + ({p} * total - before) / here) / {n} END)"
    lcl, median, ucl = (
        f"2 * power({limit.format(p=p, n=fine)}, 3)" for p in ("0.025::DOUBLE", "0.5::DOUBLE", "0.975::DOUBLE")
    )
    return f"""{_filtered(source, *pair)},
      strips AS (SELECT series, floor({at} * {fine}) AS edge, any_value({sd}) AS value, sum(w) AS here
        FROM held GROUP BY series, floor({at} * {fine})),
      summed AS (SELECT *, sum(here) OVER (PARTITION BY series) AS total,
          sum(here) OVER (PARTITION BY series ORDER BY edge) AS upto,
          coalesce(sum(here) OVER (PARTITION BY series ORDER BY edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS before FROM strips),
      means AS (SELECT series, sum(here * value) / sum(here) AS mean FROM strips GROUP BY series)
      SELECT s.series, '{parameter}' AS parameter, any_value(mean) AS mean,
        sqrt(sum(here * (value - mean) * (value - mean)) / sum(here)) AS sd, {lcl} AS lcl, {ucl} AS ucl, {median} AS median
      FROM summed s JOIN means m ON m.series = s.series GROUP BY s.series"""


step("log_series", "series", "SELECT series_id AS series, t, ln(n) AS log_n FROM series")
oracle(
    "local_level_trend",
    "log_series",
    f"SELECT series AS series_id, t, mean, sd, lcl, ucl, median, 'ok' AS status FROM ({_levels('log_series')}) q",
)
step(
    "species_series",
    "all_estimates",
    """SELECT g.species AS series, CAST(g.year AS INT) AS t, e.n, ln(e.n) AS log_n
      FROM (SELECT species, unnest(range(min(year), max(year) + 1)) AS year FROM all_estimates
            WHERE year >= CASE species WHEN 'canada goose' THEN 1996 WHEN 'trumpeter swan' THEN 1997 ELSE 1973 END
            GROUP BY species) g
      LEFT JOIN all_estimates e ON g.species = e.species AND g.year = e.year""",
)
oracle("series_prep", "species_series", "SELECT series AS species, t AS year, n, log_n FROM species_series")
oracle(
    "local_level_trend_species",
    "species_series",
    f"""SELECT q.series AS species, q.t AS year, mean, sd, lcl, ucl, median, 'ok' AS status, s.n
      FROM ({_levels('species_series')}) q JOIN species_series s ON s.series = q.series AND s.t = q.t""",
)
oracle(
    "trend_parameters",
    "species_series",
    f"""SELECT series AS species, parameter, mean, sd, lcl, ucl, median, 'ok' AS status FROM (
        {_growth('species_series')}) a
      UNION ALL SELECT series, parameter, mean, sd, lcl, ucl, median, 'ok' FROM ({_sd('species_series', 'process_sd')}) b
      UNION ALL SELECT series, parameter, mean, sd, lcl, ucl, median, 'ok' FROM ({_sd('species_series', 'observation_sd')}) c""",
)
oracle(
    "trend_with_survey",
    ("trend_results", "all_estimates"),
    """SELECT t.species, t.year, mean, sd, lcl, ucl, median, e.n FROM trend_results t
      LEFT JOIN all_estimates e ON t.species = e.species AND t.year = e.year""",
)

# ------------------------------------------------------------------ G


def _each(template: str, columns=CLASSES) -> str:
    return ", ".join(template.format(c=c) + f" AS {c}" for c in columns)


step(
    "recent_wet",
    "wetlands",
    f"""SELECT * FROM wetlands WHERE year >= (SELECT min(year) FROM
      (SELECT DISTINCT year FROM wetlands ORDER BY year DESC LIMIT {RECENT}) y)""",
)
step(
    "change_previous",
    "wetlands",
    f"""SELECT b.region, b.year, {_each("(b.{c} / NULLIF(a.{c}, 0) - 1) * 100")}
      FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY year DESC) AS rn FROM wetlands) a
      JOIN (SELECT *, row_number() OVER (PARTITION BY region ORDER BY year DESC) AS rn FROM wetlands) b
      ON a.region = b.region AND a.rn = 2 AND b.rn = 1""",
)
step(
    "mean_recent",
    "wetlands",
    f"""SELECT region, '{RECENT}-year mean (' || min(year) || '-' || max(year) || ')' AS label, {_each("avg({c})")}
      FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY year DESC) AS rn FROM wetlands) q
      WHERE rn <= {RECENT} GROUP BY region""",
)
step(
    "mean_past",
    "wetlands",
    f"SELECT region, {_each('avg({c})')} FROM wetlands WHERE year < {YEAR} GROUP BY region",
)
step(
    "change_past",
    ("wetlands", "mean_past"),
    f"""SELECT w.region, {_each("(w.{c} / NULLIF(p.{c}, 0) - 1) * 100")} FROM wetlands w
      JOIN mean_past p ON w.region = p.region WHERE w.year = {YEAR}""",
)
oracle("last_n_surveys", "recent_wet", "SELECT * FROM recent_wet")
oracle("pct_change_previous", "change_previous", "SELECT * FROM change_previous")
oracle("recent_mean", "mean_recent", "SELECT * FROM mean_recent")
oracle("long_term_mean", "mean_past", "SELECT * FROM mean_past")
oracle("pct_change_long_term", "change_past", "SELECT * FROM change_past")
_ONE = "printf('%.1f', round_even({c}, 1) + 0)"
_PERCENT = "printf('%.1f', round_even({c}, 1) + 0) || '%'"
oracle(
    "wetland_summary_table",
    ("recent_wet", "change_previous", "mean_past", "change_past", "mean_recent"),
    f"""SELECT region, 1 AS row_order, CAST(year AS VARCHAR) AS label, {_each(_ONE)} FROM recent_wet
      UNION ALL SELECT region, 2, '% Change from previous year', {_each(_PERCENT)} FROM change_previous
      UNION ALL SELECT region, 3, 'Long-term mean (1973--{YEAR - 1})', {_each(_ONE)} FROM mean_past
      UNION ALL SELECT region, 4, '% Change from long-term mean', {_each(_PERCENT)} FROM change_past
      UNION ALL SELECT region, 5, label, {_each(_ONE)} FROM mean_recent""",
)


def _told(table: str, since: str) -> str:
    return ", ".join(
        f"""replace(printf('%.1f', round_even({table}.{m}, 1) + 0), '-', '') || '%' AS percent_change_{since}_{m},
        CASE WHEN printf('%.1f', round_even({table}.{m}, 1) + 0) LIKE '-%' THEN 'down' ELSE 'up' END AS direction_{since}_{m}"""
        for m in ("non_linear", "linear")
    )


oracle(
    "change_narrative",
    ("change_previous", "change_past"),
    f"""SELECT a.region, {_told("a", "previous")}, {_told("b", "long_term")}
      FROM change_previous a JOIN change_past b ON a.region = b.region""",
)


def _comma(column: str) -> str:
    return f"format('{{:,}}', CAST(round_even({column}, 0) AS BIGINT))"


def _moved(new: str, old: str) -> str:
    return f"printf('%.1f', round_even(({new} / {old} - 1) * 100, 1) + 0) || '%'"


oracle(
    "trend_narrative",
    "trend_results",
    f"""SELECT t.species, {_comma("t.mean")} AS mean, {_comma("t.lcl")} AS lower, {_comma("t.ucl")} AS upper,
        replace({_moved("t.mean", "p.mean")}, '-', '') AS deviation_previous_year,
        CASE WHEN {_moved("t.mean", "p.mean")} LIKE '-%' THEN 'lower' ELSE 'higher' END AS direction_previous_year,
        replace({_moved("t.mean", "l.mean")}, '-', '') AS deviation_long_term_mean,
        CASE WHEN {_moved("t.mean", "l.mean")} LIKE '-%' THEN 'lower' ELSE 'higher' END AS direction_long_term_mean,
        {_comma("p.mean")} AS previous_year_mean
      FROM trend_results t JOIN trend_results p ON t.species = p.species AND p.year = {YEAR - 1}
      JOIN (SELECT species, avg(mean) AS mean FROM trend_results WHERE year < {YEAR} GROUP BY species) l
      ON t.species = l.species WHERE t.year = {YEAR}""",
)
TABLE_COLUMNS = {
    f"{kind}_{s.replace('-', '_').replace(' ', '_')}": (s, value)
    for s in ("mallard", "blue-winged teal", "wood duck", "other ducks", "total ducks", "canada goose")
    for kind, value in (("survey_n", "n"), ("ssm_n", "mean"))
}
_WIDE = ", ".join(
    f"sum({value}) FILTER (WHERE species = '{s}') AS {c}" for c, (s, value) in TABLE_COLUMNS.items()
)
step("wide_trend", "trend_results", f"SELECT year, {_WIDE} FROM trend_results GROUP BY year")
_PAST = f"(SELECT avg({{c}}) FROM wide_trend WHERE year < {YEAR})"
_START = YEAR - 3  # the last three rows, and one year before
_COLS = tuple(TABLE_COLUMNS)
oracle(
    "survey_vs_trend_table",
    "wide_trend",
    f"""SELECT 1 AS row_order, CAST(year AS VARCHAR) AS label, {_each(_comma("{c}").replace("{:,}", "{{:,}}"), _COLS)}
        FROM wide_trend
      UNION ALL SELECT 2, 'Long-term mean (1973--{YEAR - 1})',
        {_each(_comma("avg({c})").replace("{:,}", "{{:,}}"), _COLS)} FROM wide_trend WHERE year < {YEAR}
      UNION ALL SELECT 3, '3-year mean ({_START}--{YEAR})',
        {_each(_comma("avg({c})").replace("{:,}", "{{:,}}"), _COLS)} FROM wide_trend WHERE year >= {_START}
      UNION ALL SELECT 4, '% change from previous year', {_each("COALESCE(" + _moved("b.{c}", "a.{c}") + ", '')", _COLS)}
        FROM wide_trend a JOIN wide_trend b ON a.year = {YEAR - 1} AND b.year = {YEAR}
      UNION ALL SELECT 5, '% change from 1973--{YEAR - 1}',
        {_each("COALESCE(" + _moved("b.{c}", _PAST) + ", 'NA%')", _COLS)} FROM wide_trend b WHERE b.year = {YEAR}""",
)
oracle(
    "recent_species_table",
    "trend_results",
    f"""SELECT year, {_comma("n")} AS survey_estimate, {_comma("mean")} AS model_estimate FROM trend_results
      WHERE species = 'trumpeter swan' AND year >= 1997""",
)
_TITLES = """(VALUES (1, 1, 'Mallard'), (2, 2, 'Blue-winged teal'), (3, 3, 'Wood duck'), (5, 4, 'Other duck species'),
      (4, 5, 'Canada goose')) AS l(code, species_order, title)"""
oracle(
    "estimate_table",
    "by_region",
    f"""SELECT species_order, region AS stratum_order, title AS species,
        CASE region WHEN 1 THEN 'SEC' WHEN 2 THEN 'NHI' WHEN 3 THEN 'NLO' ELSE 'SWD' END AS stratum,
        {_comma("area")} AS area, printf('%.3f', round_even(b, 3)) AS density, printf('%.3f', round_even(r, 3)) AS correction,
        {_comma("pop_est")} AS estimate, {_comma("pop_se_1")} AS standard_error
      FROM by_region JOIN {_TITLES} ON species = code
      UNION ALL SELECT species_order, 5, title, 'Statewide total', NULL, NULL, NULL, {_comma("sum(pop_est)")},
        {_comma("sqrt(sum(pop_var))")} FROM by_region JOIN {_TITLES} ON species = code GROUP BY species_order, title""",
)
oracle(
    "figure_series",
    "wetlands",
    """SELECT q.region, name, year, series, value FROM (
        SELECT region, year, 'Non-linear' AS series, non_linear AS value FROM wetlands
        UNION ALL SELECT region, year, 'Linear', linear FROM wetlands
        UNION ALL SELECT DISTINCT region, 2020, s, CAST(NULL AS DOUBLE) FROM wetlands,
          (VALUES ('Linear'), ('Non-linear')) AS k(s)) q
      JOIN (VALUES (1, 'Southeast Central region'), (2, 'Northern High Density region'),
        (3, 'Northern Low Density region'), (4, 'Southwest Driftless region')) AS r(region, name) ON q.region = r.region""",
)
oracle(
    "figure_series_cranes",
    "indexed",
    f"""SELECT year, 'Total' AS series, sum(seen) AS value FROM indexed WHERE {AIR} AND species = 86 GROUP BY year
      UNION ALL SELECT year, 'Excluding groups', sum(seen) FILTER (WHERE groups = 0) FROM indexed
        WHERE {AIR} AND species = 86 GROUP BY year
      UNION ALL SELECT 2020, s, NULL FROM (VALUES ('Total'), ('Excluding groups')) AS k(s)""",
)
step(
    "observer_rows",
    ("clean", "observers"),
    """SELECT year, k.code, substr(full_name, 1, strpos(full_name, ',') - 1) AS last_name,
        substr(full_name, strpos(full_name, ',') + 2) AS first_name,
        substr(full_name, strpos(full_name, ',') + 2) || ' ' || substr(full_name, 1, strpos(full_name, ',') - 1) AS name
      FROM (SELECT year, observer1 AS code FROM clean WHERE grd = 2
            UNION SELECT year, observer2 FROM clean WHERE grd = 2) k
      LEFT JOIN observers o ON k.code = o.code WHERE k.code IS NOT NULL""",
)
oracle("observer_list", "observer_rows", "SELECT * FROM observer_rows")
oracle(
    "observer_text",
    "observer_rows",
    """SELECT year, string_agg(name, ', ' ORDER BY last_name, first_name) AS observers FROM observer_rows
      WHERE last_name IS NOT NULL GROUP BY year""",
)
oracle(
    "survey_year_count",
    "structured",
    """SELECT region, p_species, count(*) AS n_years
      FROM (SELECT DISTINCT region, p_species, year FROM structured WHERE year >= 1997) q GROUP BY ALL""",
)
oracle(
    "survey_year_count_series",
    "trend_results",
    """SELECT species, count(*) AS n_years FROM (SELECT DISTINCT species, year FROM trend_results WHERE n IS NOT NULL) q
      GROUP BY species""",
)

# ------------------------------------------------------------------ H

_LEN = "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"
oracle(
    "dissolve_lines",
    "pieces",
    f"""SELECT line_id, count(*) AS n_pieces, sum({_LEN}) AS length, min(least(x1, x2)) AS xmin,
      max(greatest(x1, x2)) AS xmax, min(least(y1, y2)) AS ymin, max(greatest(y1, y2)) AS ymax
      FROM pieces GROUP BY line_id""",
)
oracle(
    "line_centroid",
    "pieces",
    f"""SELECT line_id, sum((x1 + x2) / 2 * {_LEN}) / sum({_LEN}) AS x, sum((y1 + y2) / 2 * {_LEN}) / sum({_LEN}) AS y
      FROM pieces GROUP BY line_id""",
)
# Pieces run to the right by one column a step, so a straight line is its slope and its height at x = 0.
step(
    "stretches",
    "flown",
    """WITH RECURSIVE p AS (
        SELECT DISTINCT line_id, least(x1, x2) AS a, greatest(x1, x2) AS b, (y2 - y1) / (x2 - x1) AS slope,
          y1 - x1 * (y2 - y1) / (x2 - x1) AS base FROM flown),
      -- a stretch begins where no piece of its straight line ends or goes on
      starts AS (SELECT DISTINCT line_id, slope, base, a FROM p WHERE NOT EXISTS (
        SELECT 1 FROM p q WHERE q.line_id = p.line_id AND q.slope = p.slope AND q.base = p.base AND q.a < p.a AND q.b >= p.a)),
      grown AS (
        SELECT line_id, slope, base, a, a AS b FROM starts
        UNION SELECT g.line_id, g.slope, g.base, g.a, p.b FROM grown g JOIN p
          ON p.line_id = g.line_id AND p.slope = g.slope AND p.base = g.base AND p.a <= g.b AND p.b > g.b),
      whole AS (SELECT line_id, slope, base, a, max(b) AS b FROM grown GROUP BY ALL),
      s AS (SELECT line_id, a AS x1, base + slope * a AS y1, b AS x2, base + slope * b AS y2 FROM whole),
      ends AS (SELECT line_id, x1 AS x, y1 AS y, x2 AS ox, y2 AS oy FROM s UNION SELECT line_id, x2, y2, x1, y1 FROM s),
      reach AS (
        SELECT DISTINCT line_id, x, y, x AS rx, y AS ry FROM ends
        UNION SELECT r.line_id, r.x, r.y, e.ox, e.oy FROM reach r JOIN ends e
          ON e.line_id = r.line_id AND e.x = r.rx AND e.y = r.ry),
      root AS (SELECT line_id, x, y, min([rx, ry]) AS least FROM reach GROUP BY line_id, x, y)
      SELECT s.*, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length,
        CAST(dense_rank() OVER (PARTITION BY s.line_id ORDER BY least) AS INT) AS part
      FROM s JOIN root r ON r.line_id = s.line_id AND r.x = s.x1 AND r.y = s.y1""",
)
oracle("union_lines", "stretches", "SELECT * FROM stretches")
oracle(
    "dissolve_union",
    "stretches",
    """SELECT line_id, count(*) AS n_stretches, max(part) AS n_parts, sum(length) AS length, min(least(x1, x2)) AS xmin,
        max(greatest(x1, x2)) AS xmax, min(least(y1, y2)) AS ymin, max(greatest(y1, y2)) AS ymax,
        sum((x1 + x2) / 2 * length) / sum(length) AS x, sum((y1 + y2) / 2 * length) / sum(length) AS y
      FROM stretches GROUP BY line_id""",
)
# Brute force: every piece against every point near its box, by projection parameter.
step(
    "jointed",
    "pieces",
    """SELECT p.*, b.seq IS NOT NULL AS joint1, a.seq IS NOT NULL AS joint2 FROM pieces p
      LEFT JOIN pieces b ON b.line_id = p.line_id AND b.seq = p.seq - 1
      LEFT JOIN pieces a ON a.line_id = p.line_id AND a.seq = p.seq + 1""",
)


def _near(points: str) -> str:
    d = DIST
    return f"""SELECT DISTINCT line_id, transect, c.* FROM
        (SELECT *, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS l2 FROM jointed) p
      JOIN ({points}) c ON x >= x1 - {d} AND x <= x2 + {d} AND y >= least(y1, y2) - {d} AND y <= greatest(y1, y2) + {d}
      WHERE (((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / l2 BETWEEN 0 AND 1
             AND abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) / sqrt(l2) <= {d})
        OR (joint1 AND sqrt((x - x1) * (x - x1) + (y - y1) * (y - y1)) <= {d})
        OR (joint2 AND sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)) <= {d})"""


step("near_cells", ("jointed", "grid"), _near("SELECT DISTINCT cell_id, x, y FROM grid"))
oracle("within_corridor", "near_cells", "SELECT DISTINCT line_id, cell_id FROM near_cells")
step("zones", "near_cells", "SELECT DISTINCT transect, cell_id FROM near_cells")
oracle(
    "zonal_mean",
    ("zones", "grid"),
    """SELECT transect, year, avg(value) AS value FROM zones z JOIN grid g ON z.cell_id = g.cell_id
      GROUP BY transect, year""",
)
step(
    "near_points",
    ("jointed", "grid"),
    _near(
        """SELECT cell_id, x + ox AS x, y + oy AS y FROM (SELECT DISTINCT cell_id, x, y FROM grid) g,
        (VALUES ((0.5::DOUBLE / 3) - 0.5), ((1.5::DOUBLE / 3) - 0.5), ((2.5::DOUBLE / 3) - 0.5)) AS a(ox),
        (VALUES ((0.5::DOUBLE / 3) - 0.5), ((1.5::DOUBLE / 3) - 0.5), ((2.5::DOUBLE / 3) - 0.5)) AS b(oy)"""
    ),
)
oracle(
    "corridor_coverage",
    "near_points",
    """SELECT line_id, cell_id, CAST(count(*) AS INT) AS points, CAST(count(*) AS DOUBLE) / 9 AS weight FROM near_points
      GROUP BY line_id, cell_id""",
)
oracle(
    "zonal_mean_weighted",
    ("near_points", "grid"),
    """SELECT line_id, sum(total * hits) / sum(n * hits) AS value
      FROM (SELECT line_id, cell_id, CAST(count(*) AS DOUBLE) AS hits FROM near_points GROUP BY line_id, cell_id) w
      JOIN (SELECT cell_id, sum(value) AS total, count(*) AS n FROM grid GROUP BY cell_id) g ON w.cell_id = g.cell_id
      GROUP BY line_id""",
)
# Area by going round the border: shapes (strips and discs, numbered), their straight edges and those of the
# cell, arcs, and the places where any of them may cross; each part between two places is tested on both sides.
_HALF, _THIN = 0.5, THIN
_CORNERS = "(0, -1, 1, -1), (1, -1, 1, 1), (1, 1, 0, 1), (0, 1, 0, -1)"
_SIDES = "(1.0, 0.0, -0.5), (1.0, 0.0, 0.5), (0.0, 1.0, -0.5), (0.0, 1.0, 0.5)"


def _holds(x: str, y: str) -> str:
    dx, dy = f"({x} - s.x)", f"({y} - s.y)"
    return f"""CASE WHEN s.length > 0
        THEN {dx} * s.ux + {dy} * s.uy BETWEEN 0 AND s.length AND abs({dy} * s.ux - {dx} * s.uy) <= {_THIN}
        ELSE {dx} * {dx} + {dy} * {dy} <= {_THIN**2!r}::DOUBLE END"""


def _kept_parts(table: str) -> str:
    """Shares of the parts in ``table`` (k: shape or null for the cell; an inner and an outer point)."""
    inside = " AND ".join(f"abs({c}) < {_HALF}" for c in ("ix", "iy", "ox", "oy"))
    return f"""SELECT e.line_id, e.cell_id, any_value(e.share) AS share FROM {table} e
      JOIN shapes s ON s.line_id = e.line_id AND s.cell_id = e.cell_id
      GROUP BY e.line_id, e.cell_id, e.id, e.k, e.t, e.ix, e.iy, e.ox, e.oy
      HAVING CASE WHEN e.k IS NULL THEN bool_or({_holds("e.ix", "e.iy")})
        ELSE NOT bool_or(s.j <> e.k AND ({_holds("e.ox", "e.oy")} OR s.j < e.k AND {_holds("e.ix", "e.iy")}))
          AND {inside.replace("abs(", "abs(e.")} END"""


step(
    "shapes",
    ("jointed", "grid"),
    f"""SELECT *, row_number() OVER (PARTITION BY line_id, cell_id ORDER BY length = 0, x, y, ux, uy, length) AS j
      FROM (
        WITH near AS (
          SELECT line_id, cell_id, x1 - c.x AS x1, y1 - c.y AS y1, x2 - c.x AS x2, y2 - c.y AS y2, joint1, joint2,
            sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length
          FROM jointed JOIN (SELECT DISTINCT cell_id, x, y FROM grid) c
          ON c.x BETWEEN least(x1, x2) - 1 AND greatest(x1, x2) + 1 AND c.y BETWEEN least(y1, y2) - 1 AND greatest(y1, y2) + 1)
        SELECT line_id, cell_id, x1 AS x, y1 AS y, (x2 - x1) / length AS ux, (y2 - y1) / length AS uy, length FROM near
        UNION SELECT line_id, cell_id, x1, y1, 0, 0, 0 FROM near WHERE joint1
        UNION SELECT line_id, cell_id, x2, y2, 0, 0, 0 FROM near WHERE joint2) q""",
)
step(
    "edge_lines",
    "shapes",
    f"""SELECT line_id, cell_id, j, ux AS nx, uy AS ny, x * ux + y * uy + f * length AS c
        FROM shapes, (VALUES (0), (1)) AS v(f) WHERE length > 0
      UNION ALL SELECT line_id, cell_id, j, -uy, ux, y * ux - x * uy + f * {_THIN} FROM shapes, (VALUES (-1), (1)) AS v(f)
        WHERE length > 0
      UNION ALL SELECT line_id, cell_id, 0, nx, ny, c FROM (SELECT DISTINCT line_id, cell_id FROM shapes) q,
        (VALUES {_SIDES}) AS v(nx, ny, c)""",
)
step(
    "edges",
    "shapes",
    f"""SELECT *, row_number() OVER () AS id FROM (
        SELECT line_id, cell_id, j AS k, x + ux * a1 * length - uy * b1 * {_THIN} AS px,
          y + uy * a1 * length + ux * b1 * {_THIN} AS py, ux * (a2 - a1) * length - uy * (b2 - b1) * {_THIN} AS vx,
          uy * (a2 - a1) * length + ux * (b2 - b1) * {_THIN} AS vy
        FROM shapes, (VALUES {_CORNERS}) AS v(a1, b1, a2, b2) WHERE length > 0
        UNION ALL
        SELECT line_id, cell_id, NULL, a1 - 0.5, b1 / 2.0, CAST(a2 - a1 AS DOUBLE), (b2 - b1) / 2.0
        FROM (SELECT DISTINCT line_id, cell_id FROM shapes) q, (VALUES {_CORNERS}) AS v(a1, b1, a2, b2)) e""",
)
step(
    "edge_parts",
    ("edges", "edge_lines", "shapes"),
    f"""WITH cuts AS (
        SELECT id, 0.0::DOUBLE AS t FROM edges UNION SELECT id, 1 FROM edges
        UNION SELECT id, (c - nx * px - ny * py) / nullif(nx * vx + ny * vy, 0) FROM edges
          JOIN edge_lines USING (line_id, cell_id)
        UNION SELECT id, (-pv + f * sqrt(root)) / v2
          FROM (SELECT *, pv * pv - v2 * (ex * ex + ey * ey - {_THIN**2!r}::DOUBLE) AS root
            FROM (SELECT *, ex * vx + ey * vy AS pv, vx * vx + vy * vy AS v2
              FROM (SELECT e.*, px - x AS ex, py - y AS ey FROM edges e JOIN shapes s USING (line_id, cell_id)
                WHERE length = 0) a) b) c, (VALUES (-1), (1)) AS v(f)
          WHERE root > 0),
      parts AS (SELECT id, t, lead(t) OVER (PARTITION BY id ORDER BY t) AS t2 FROM cuts WHERE t BETWEEN 0 AND 1)
      SELECT line_id, cell_id, k, id, t, (px * vy - py * vx) / 2 * (t2 - t) AS share,
        px + vx * (t + t2) / 2 - vy * nudge AS ix, py + vy * (t + t2) / 2 + vx * nudge AS iy,
        px + vx * (t + t2) / 2 + vy * nudge AS ox, py + vy * (t + t2) / 2 - vx * nudge AS oy
      FROM (SELECT *, {_THIN * 1e-7!r}::DOUBLE / sqrt(vx * vx + vy * vy) AS nudge FROM parts JOIN edges USING (id)) q
      WHERE t2 > t""",
)
step(
    "arc_parts",
    ("shapes", "edge_lines"),
    f"""WITH discs AS (SELECT line_id, cell_id, j AS k, x, y FROM shapes WHERE length = 0),
      turns AS (
        SELECT line_id, cell_id, k, atan2(ny, nx) AS middle, (c - nx * x - ny * y) / {_THIN} AS far
          FROM discs JOIN edge_lines USING (line_id, cell_id)
        UNION SELECT d.line_id, d.cell_id, k, atan2(s.y - d.y, s.x - d.x),
          sqrt((s.x - d.x) * (s.x - d.x) + (s.y - d.y) * (s.y - d.y)) / {2 * _THIN}
          FROM discs d JOIN shapes s ON s.line_id = d.line_id AND s.cell_id = d.cell_id AND s.length = 0 AND s.j <> d.k),
      cuts AS (
        SELECT line_id, cell_id, k, 0.0::DOUBLE AS t FROM discs
        UNION SELECT line_id, cell_id, k, 2 * pi() FROM discs
        UNION SELECT line_id, cell_id, k, a - 2 * pi() * floor(a / (2 * pi()))
          FROM (SELECT line_id, cell_id, k, middle + f * acos(far) AS a FROM turns, (VALUES (-1), (1)) AS v(f)
            WHERE far BETWEEN -1 AND 1) q),
      parts AS (SELECT *, lead(t) OVER (PARTITION BY line_id, cell_id, k ORDER BY t) AS t2 FROM cuts)
      SELECT line_id, cell_id, k, 0 AS id, t,
        ({_THIN**2!r}::DOUBLE * (t2 - t) + {_THIN} * (x * (sin(t2) - sin(t)) - y * (cos(t2) - cos(t)))) / 2 AS share,
        x + cos((t + t2) / 2) * {_THIN * (1 - 1e-7)!r} AS ix, y + sin((t + t2) / 2) * {_THIN * (1 - 1e-7)!r} AS iy,
        x + cos((t + t2) / 2) * {_THIN * (1 + 1e-7)!r} AS ox, y + sin((t + t2) / 2) * {_THIN * (1 + 1e-7)!r} AS oy
      FROM parts JOIN discs USING (line_id, cell_id, k) WHERE t2 > t""",
)
step(
    "cell_areas",
    ("edge_parts", "arc_parts", "shapes"),
    f"""SELECT line_id, cell_id, sum(share) AS area
      FROM ({_kept_parts("edge_parts")} UNION ALL {_kept_parts("arc_parts")}) q
      GROUP BY line_id, cell_id HAVING sum(share) > 1e-9""",
)
oracle("corridor_coverage_area", "cell_areas", "SELECT line_id, cell_id, area, area AS weight FROM cell_areas")
oracle(
    "zonal_mean_area",
    ("cell_areas", "grid"),
    """SELECT line_id, sum(total * area) / sum(n * area) AS value FROM cell_areas a
      JOIN (SELECT cell_id, sum(value) AS total, count(*) AS n FROM grid GROUP BY cell_id) g ON a.cell_id = g.cell_id
      GROUP BY line_id""",
)
step(
    "seasons",
    "climate",
    """SELECT *, CASE WHEN month IN (10, 11, 12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring' END AS season,
      CASE WHEN month >= 10 THEN year + 1 WHEN month <= 5 THEN year END AS season_year FROM climate""",
)
oracle("season_of", "seasons", "SELECT * FROM seasons")
_MONTHS = "CAST(count(DISTINCT month) AS INT)"
_WHOLE = f"HAVING {_MONTHS} = CASE season WHEN 'winter' THEN 5 ELSE 3 END"
for _name, _fun, _having in (
    ("season_stack", "sum", _WHOLE),
    ("season_stack_mean", "avg", _WHOLE),
    ("season_stack_all", "avg", ""),
):
    oracle(
        _name,
        "seasons",
        f"""SELECT cell_id, season, season_year, {_fun}(value) AS value, {_MONTHS} AS n_months FROM seasons
          WHERE season IS NOT NULL GROUP BY cell_id, season, season_year {_having}""",
    )
oracle(
    "season_stack_normals",
    "seasons",
    f"""SELECT cell_id, season, avg(value) AS value, {_MONTHS} AS n_months
      FROM (SELECT cell_id, season, month, avg(value) AS value FROM seasons WHERE season IS NOT NULL GROUP BY ALL) m
      GROUP BY cell_id, season {_WHOLE}""",
)
oracle(
    "mask_polygon",
    ("grid", "ring"),
    """SELECT * FROM grid WHERE cell_id IN (
      SELECT cell_id FROM (SELECT DISTINCT cell_id, x, y FROM grid) c JOIN
        (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM ring a
         JOIN (SELECT ring, max(seq) AS last FROM ring GROUP BY ring) m ON a.ring = m.ring
         JOIN ring b ON b.ring = a.ring AND b.seq = a.seq % m.last + 1) e
      ON (ay > y) <> (b_y > y) AND x < ax + (y - ay) / (b_y - ay) * (bx - ax)
      GROUP BY cell_id HAVING count(*) % 2 = 1)""",
)
step(
    "season_pairs",
    "seasons",
    f"""SELECT c.cell_id, c.season, c.value, n.normal
      FROM (SELECT cell_id, season, sum(value) AS value FROM seasons
            WHERE season IS NOT NULL AND season_year = {YEAR} GROUP BY cell_id, season {_WHOLE}) c
      JOIN (SELECT cell_id, season, avg(value) AS normal
            FROM (SELECT cell_id, season, season_year, sum(value) AS value FROM seasons
                  WHERE season IS NOT NULL AND season_year < {YEAR}
                  GROUP BY cell_id, season, season_year {_WHOLE}) y
            GROUP BY cell_id, season) n ON c.cell_id = n.cell_id AND c.season = n.season""",
)
oracle(
    "cell_anomaly",
    "season_pairs",
    "SELECT cell_id, season, value - normal AS value FROM season_pairs",
)


def _krueger() -> str:
    f = 1 / 298.257222101
    n = f / (2 - f)
    unit = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * n**0.5 / (1 + n)
    east = "eta + " + " + ".join(
        f"{c!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(a, start=1)
    )
    north = "xi + " + " + ".join(
        f"{c!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(a, start=1)
    )
    return f"""SELECT record_id, line, lon, lat, {unit!r}::DOUBLE * ({east}) + 520000 AS x,
        {unit!r}::DOUBLE * ({north}) - 4480000 AS y
      FROM (SELECT *, atan2(t, cos(turn)) AS xi, atanh(sin(turn) / sqrt(1 + t * t)) AS eta
            FROM (SELECT *, radians(lon + 90) AS turn,
                    sinh(atanh(sin(radians(lat))) - {k!r}::DOUBLE * atanh({k!r}::DOUBLE * sin(radians(lat)))) AS t
                  FROM places) q) p"""


oracle("project_points", "places", _krueger())
oracle("unproject_points", "places", "SELECT record_id, line, lon, lat FROM places")


def _albers() -> str:
    """With the zone's term by its own integral in logarithms, and all constants computed in SQL."""
    f = 1 / 298.257222101
    e2 = f * (2 - f)
    e = f"{e2**0.5!r}::DOUBLE"

    def zone(lat: str) -> str:
        s = f"sin(radians({lat}))"
        return f"{1 - e2!r}::DOUBLE * ({s} / (1 - {e} * {e} * {s} * {s}) - ln((1 - {e} * {s}) / (1 + {e} * {s})) / (2 * {e}))"

    def width2(lat: str) -> str:
        return f"(cos(radians({lat})) * cos(radians({lat})) / (1 - {e} * {e} * sin(radians({lat})) * sin(radians({lat}))))"

    return f"""WITH k AS (SELECT ({width2('29.5')} - {width2('45.5')}) / (({zone('45.5')}) - ({zone('29.5')})) AS n),
      c AS (SELECT n, {width2('29.5')} + n * ({zone('29.5')}) AS c FROM k),
      r AS (SELECT n, c, 6378137.0 * sqrt(c - n * ({zone('23.0')})) / n AS rho0 FROM c),
      p AS (SELECT record_id, line, lon, lat, n * radians(lon + 96) AS theta, rho0,
              6378137.0 * sqrt(c - n * ({zone('lat')})) / n AS rho FROM places, r)
      SELECT record_id, line, lon, lat, rho * sin(theta) AS x, rho0 - rho * cos(theta) AS y FROM p"""


oracle("project_albers", "places", _albers())
oracle("unproject_albers", "places", "SELECT record_id, line, lon, lat FROM places")
_F1, _F2 = 1 / 294.978698214, 1 / 298.257222101
_E1, _E2 = _F1 * (2 - _F1), _F2 * (2 - _F2)
_TURN = "radians(0.5 / 3600)"
# The latitude by iteration from the geocentric place, which is another way than the operator's.
oracle(
    "shift_datum",
    "places",
    f"""WITH RECURSIVE g AS (
        SELECT *, 6378206.4 / sqrt(1 - {_E1!r}::DOUBLE * sin(radians(lat)) * sin(radians(lat))) AS v FROM places),
      old AS (SELECT record_id, line, v * cos(radians(lat)) * cos(radians(lon)) AS x0,
          v * cos(radians(lat)) * sin(radians(lon)) AS y0, v * {1 - _E1!r}::DOUBLE * sin(radians(lat)) AS z0 FROM g),
      new AS (SELECT record_id, line, (x0 - y0 * {_TURN}) * (1 - 0.3e-6) - 8 AS x,
          (x0 * {_TURN} + y0) * (1 - 0.3e-6) + 160 AS y, z0 * (1 - 0.3e-6) + 176 AS z FROM old),
      steps AS (
        SELECT record_id, line, x, y, z, atan2(z, sqrt(x * x + y * y) * {1 - _E2!r}::DOUBLE) AS phi, 0 AS i FROM new
        UNION ALL
        SELECT record_id, line, x, y, z,
          atan2(z + {_E2!r}::DOUBLE * sin(phi) * 6378137.0 / sqrt(1 - {_E2!r}::DOUBLE * sin(phi) * sin(phi)),
            sqrt(x * x + y * y)), i + 1
        FROM steps WHERE i < 8)
      SELECT record_id, line, degrees(atan2(y, x)) AS lon, degrees(phi) AS lat FROM steps WHERE i = 8""",
)
oracle(
    "pearson_corr",
    ("zones", "grid", "indexed", "species_codes"),
    f"""SELECT common_name, corr(value, birds) AS corr, count(*) AS n_pairs
      FROM (SELECT transect, avg(value) AS value FROM zones z JOIN grid g ON z.cell_id = g.cell_id GROUP BY transect) m
      JOIN (SELECT transect, common_name, avg(birds) AS birds
            FROM (SELECT transect, species, year, sum(indicated) AS birds FROM indexed
                  WHERE {AIR} AND species IN (50, 32, 40, 44) GROUP BY ALL) y
            LEFT JOIN species_codes c ON y.species = c.species GROUP BY transect, common_name) k
      ON m.transect = k.transect GROUP BY common_name""",
)
oracle(
    "model_r2",
    "season_pairs",
    """SELECT var_samp(4 + 0.75::DOUBLE * normal) /
      (var_samp(4 + 0.75::DOUBLE * normal) + var_samp(value - (4 + 0.75::DOUBLE * normal))) AS r2 FROM season_pairs""",
)


# Student-t fits by expectation-maximisation in a recursion, the degrees of freedom by one Newton step each time.
def _digamma(x: str) -> str:
    shifted = " - ".join(f"1 / ({x} + {i})" for i in range(10))
    z = f"({x} + 10)"
    return f"(ln({z}) - 0.5 / {z} - (1 / 12.0 - (1 / 120.0 - 1 / (252.0 * {z} * {z})) / ({z} * {z})) / ({z} * {z}) - {shifted})"


def _trigamma(x: str) -> str:
    shifted = " + ".join(f"1 / (({x} + {i}) * ({x} + {i}))" for i in range(10))
    z = f"({x} + 10)"
    return (
        f"(1 / {z} + 0.5 / ({z} * {z}) + (1 / 6.0 - (1 / 30.0 - 1 / (42.0 * {z} * {z})) / ({z} * {z}))"
        f" / ({z} * {z} * {z}) + {shifted})"
    )


def _t_fit(pairs: str, dims: int, distance: str, start: str, update: str, nu: str = "10.0", steps: int = 400) -> str:
    """A row per g of ``pairs`` (g, x, y). ``start`` and ``update`` are columns of the state, from moments of
    the pairs and from weighted ones; ``distance`` is the squared distance by the state p."""
    up = f"((nu + {dims}) / 2.0)"
    first = f"(n / 2.0 * ({_digamma(up)} - {_digamma('(nu / 2)')} - {dims} / nu) - log_tail / 2 + {up} * pull / nu)"
    second = f"""(n / 4.0 * ({_trigamma(up)} - {_trigamma('(nu / 2)')} + 2 * {dims} / (nu * nu)) + pull / nu
        - {up} * (pull + nu * bend) / (nu * nu))"""
    bent = f"(nu * nu * {second} + nu * {first})"
    turn = f"CASE WHEN {bent} < 0 THEN -nu * {first} / {bent} ELSE sign({first}) * 0.5 END"
    free = nu == "10.0"
    new_nu = f"least(200, greatest(1, nu * exp(least(0.5, greatest(-0.5, {turn})))))" if free else "nu"
    return f"""WITH RECURSIVE fit AS (
        SELECT g, 0 AS i, count(*) AS n, {nu}::DOUBLE AS nu, {start} FROM {pairs} GROUP BY g
        UNION ALL
        SELECT g, i + 1, n, {new_nu}, {update}
        FROM (SELECT g, i, n, nu, first(p) AS p, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx,
                sum(w * x * y) AS wxy, sum(w * y * y) AS wyy, sum(w * d) AS wd, sum(ln(1 + d / nu)) AS log_tail,
                sum(d / (d + nu)) AS pull, sum(d / ((d + nu) * (d + nu))) AS bend
              FROM (SELECT *, (nu + {dims}) / (nu + d) AS w
                    FROM (SELECT f.g, i, n, nu, p, x, y, {distance} AS d
                          FROM fit f JOIN {pairs} q ON q.g = f.g WHERE i < {steps}) a) b
              GROUP BY g, i, n, nu) c)
      SELECT g, n AS n_pairs, nu, p, nu <= 1 OR nu >= 200 AS nu_at_bound FROM fit WHERE i = {steps}"""


_BIVARIATE = {
    "dims": 2,
    "distance": """((x - p.mx) * (x - p.mx) * p.syy - 2 * (x - p.mx) * (y - p.my) * p.sxy + (y - p.my) * (y - p.my) * p.sxx)
        / (p.sxx * p.syy - p.sxy * p.sxy)""",
    "start": """{'mx': avg(x), 'my': avg(y), 'sxx': var_pop(x), 'sxy': covar_pop(x, y), 'syy': var_pop(y)} AS p""",
    "update": """{'mx': wx / w, 'my': wy / w, 'sxx': (wxx - wx * wx / w) / n, 'sxy': (wxy - wx * wy / w) / n,
        'syy': (wyy - wy * wy / w) / n}""",
}
_SLOPE = "((wxy - wx * wy / w) / (wxx - wx * wx / w))"
_LINE = {
    "dims": 1,
    "distance": "(y - p.a - p.b * x) * (y - p.a - p.b * x) / p.s2",
    "start": "{'a': regr_intercept(y, x), 'b': regr_slope(y, x), 's2': regr_syy(y, x) / count(*)} AS p",
    "update": f"{{'a': (wy - {_SLOPE} * wx) / w, 'b': {_SLOPE}, 's2': wd * p.s2 / n}}",
}
step(
    "species_pairs",
    ("zones", "grid", "indexed", "species_codes"),
    f"""SELECT common_name AS g, value AS x, birds AS y
      FROM (SELECT transect, avg(value) AS value FROM zones z JOIN grid g ON z.cell_id = g.cell_id GROUP BY transect) m
      JOIN (SELECT transect, common_name, avg(birds) AS birds
            FROM (SELECT transect, species, year, sum(indicated) AS birds FROM indexed
                  WHERE {AIR} AND species IN (50, 32, 40, 44) GROUP BY ALL) y
            LEFT JOIN species_codes c ON y.species = c.species GROUP BY transect, common_name) k
      ON m.transect = k.transect""",
)
oracle(
    "robust_bivariate",
    "species_pairs",
    f"""SELECT g AS common_name, p.mx AS mu_x, p.my AS mu_y, sqrt(p.sxx) AS sigma_x, sqrt(p.syy) AS sigma_y,
        p.sxy / sqrt(p.sxx * p.syy) AS rescor, nu, n_pairs, true AS converged, nu_at_bound
      FROM ({_t_fit("species_pairs", **_BIVARIATE)}) f""",
)
step("season_xy", "season_pairs", "SELECT season AS g, normal AS x, value AS y FROM season_pairs")
_SPREAD = "p.b IS NOT NULL AND p.s2 IS NOT NULL"
_LINES = f"""SELECT g AS season, p.a AS intercept, p.b AS slope, sqrt(p.s2) AS sigma,
    CASE WHEN {_SPREAD} THEN nu END AS nu, n_pairs, {_SPREAD} AS converged, {_SPREAD} AND nu_at_bound AS nu_at_bound FROM ({_t_fit("season_xy", **_LINE)}) f"""
oracle("robust_regression", "season_xy", _LINES)
oracle(
    "fitted_r2",
    "season_xy",
    f"""SELECT season, var_samp(intercept + slope * x) /
        (var_samp(intercept + slope * x) + var_samp(y - intercept - slope * x)) AS r2
      FROM ({_LINES}) l JOIN season_xy q ON q.g = l.season GROUP BY season""",
)
