"""The survey design: every constant an operator needs, in one overridable object.

Frames built from a design have a fixed, known size (one row per stratum, label
or species code), which is what makes them safe to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stratum:
    code: int
    label: str
    name: str
    below: int  # transect numbers below this bound, down to the previous stratum's bound
    transects: int
    area: float


# The four strata (code, short name, long name, first transect number
# past the stratum, transects flown, area in square miles).
STRATA = (
    Stratum(1, "SEC", "Southeast Central region", 30, 29, 17949.0),
    Stratum(2, "NHI", "Northern High Density region", 43, 13, 9431.0),
    Stratum(3, "NLO", "Northern Low Density region", 61, 13, 15979.0),
    Stratum(4, "SWD", "Southwest Driftless region", 72, 11, 12311.0),
)

# Priority groups (species code -> group, label of each group).
PRIORITY_GROUPS = {32: 1, 40: 2, 44: 3, 72: 4}
PRIORITY_LABELS = {
    1: "mallard",
    2: "blue-winged teal",
    3: "wood duck",
    4: "canada goose",
    5: "other ducks",
}
PRIORITY_TITLES = {
    1: "Mallard",
    2: "Blue-winged teal",
    3: "Wood duck",
    4: "Canada goose",
    5: "Other duck species",
}
PRIORITY_TITLE_ORDER = (1, 2, 3, 5, 4)

# Species outside the duck groups, and species whose lone and flocked
# males are not doubled in the indicated-bird index.
NON_DUCK_CODES = (45, 49, 53, 63, 66)
NON_DUCK_BELOW = 29
NON_DUCK_FROM = 72
SINGLE_MALE_CODES = (46, 47, 50, 67)
SWAN = 81
WHOOPING_CRANE = 84
SANDHILL_CRANE = 86

# Names reported in the composition table.
COMPOSITION_NAMES = (
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
)

# Wetland types by code, in the order they are reported.
WETLAND_TYPES = {
    1: "typ1",
    2: "typ2",
    3: "typ3",
    4: "typ4",
    5: "typ5",
    6: "typ6",
    7: "typ7",
    8: "typ8",
    9: "stream",
    0: "ditch",
}

# Platform codes.
AIR_OVER_GROUND, GROUND, AIR_ONLY = 1, 2, 4


@dataclass(frozen=True)
class SurveyDesign:
    strata: tuple[Stratum, ...] = STRATA
    transect_area: float = 7.5
    paired_segments: int = 27
    cv_target: float = 0.20
    min_years: int = 2
    group_limit: int = 19
    small_group: int = 5
    first_year: int = 1973
    series_start: tuple[tuple[str, int], ...] = (("canada goose", 1986), ("trumpeter swan", 2005))
    missing_years: tuple[int, ...] = (2020,)
    ratio_groups: tuple[int, ...] = (1, 2, 3, 4, 5)

    @property
    def total_transects(self) -> int:
        return sum(s.transects for s in self.strata)

    @property
    def total_area(self) -> float:
        return sum(s.area for s in self.strata)

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per stratum: region, label, region_name, transects, area."""
        rows = [(s.code, s.label, s.name, float(s.transects), s.area) for s in self.strata]
        return spark.createDataFrame(
            rows, "region int, label string, region_name string, transects double, area double"
        )

    def scaffold(self, spark: SparkSession, groups: tuple[int, ...] | None = None) -> DataFrame:
        """Every species group in every stratum, so that empty cells still get an estimate."""
        rows = [
            (g, s.code, float(s.transects), s.area)
            for g in (groups or self.ratio_groups)
            for s in self.strata
        ]
        return spark.createDataFrame(rows, "species int, region int, transects double, area double")

    def region_label(self, region: Column) -> Column:
        return lookup(region, {s.code: s.label for s in self.strata})

    def region_name(self, region: Column) -> Column:
        return lookup(region, {s.code: s.name for s in self.strata})


def lookup(key: Column, values: dict, default: object = None) -> Column:
    """A code-to-value ``CASE`` for a short fixed dictionary; unknown codes give ``default``."""
    items = iter(values.items())
    first_key, first_value = next(items)
    out = F.when(key == first_key, F.lit(first_value))
    for k, v in items:
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out
