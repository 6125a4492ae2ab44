"""Wetland counts and densities per year and stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcount.design import GROUND, WETLAND_TYPES, SurveyDesign, lookup
from fieldcount.functions.columns import sum0
from fieldcount.operators.structure import band_region

TYPES = tuple(WETLAND_TYPES.values())
RAW_NAMES = {"stream": "str", "ditch": "dit"}


def unoccupied_wetlands(raw: DataFrame, design: SurveyDesign = SurveyDesign()) -> DataFrame:
    """Wetlands without birds by type; missing counts are 0."""
    sums = [sum0(F.col(RAW_NAMES.get(t, t)).cast("double")).alias(t) for t in TYPES]
    return band_region(raw, design).groupBy("year", "region").agg(*sums)


def occupied_wetlands(clean: DataFrame, design: SurveyDesign = SurveyDesign()) -> DataFrame:
    """Wetlands with birds seen from the air, counted by type; field sightings drop out."""
    kept = clean.filter((F.col("sp1") != 0) & (F.col("grd") != GROUND))
    counts = [
        F.count_if(F.col("wetype") == code).cast("double").alias(t)
        for code, t in WETLAND_TYPES.items()
    ]
    return band_region(kept, design).groupBy("year", "region").agg(*counts)


def total_wetlands(unoccupied: DataFrame, occupied: DataFrame, sides: int = 2) -> DataFrame:
    """Unoccupied wetlands, seen from one side of the aircraft only, plus occupied ones."""
    both_sides = unoccupied.select(
        "year", "region", *[(F.col(t) * sides).alias(t) for t in TYPES]
    )
    stacked = both_sides.unionByName(occupied)
    return stacked.groupBy("year", "region").agg(*[sum0(F.col(t)).alias(t) for t in TYPES])


def wetland_density(total: DataFrame, design: SurveyDesign = SurveyDesign()) -> DataFrame:
    """Wetlands per unit area; rows outside the design's strata drop out."""
    flown = lookup(F.col("region"), {s.code: float(s.transects) for s in design.strata})
    known = total.filter(F.col("region").isin(*[s.code for s in design.strata]))
    return known.select(
        "year", "region", *[(F.col(t) / flown / design.transect_area).alias(t) for t in TYPES]
    )


def wetland_classes(density: DataFrame) -> DataFrame:
    """Reporting classes of wetland types."""

    def total(*codes: int):
        names = [WETLAND_TYPES[c] for c in codes]
        out = F.col(names[0])
        for n in names[1:]:
            out = out + F.col(n)
        return out

    return density.select(
        "year",
        "region",
        total(1, 2, 6).alias("i_ii_vi"),
        total(3).alias("iii"),
        total(4, 5).alias("iv_v"),
        total(7, 8).alias("vii_viii"),
        total(*range(1, 9)).alias("non_linear"),
        "stream",
        "ditch",
        total(9, 0).alias("linear"),
    )


def wetland_summaries(
    raw_wetlands: DataFrame, clean_counts: DataFrame, design: SurveyDesign = SurveyDesign()
) -> DataFrame:
    """All wetland steps in a row."""
    total = total_wetlands(
        unoccupied_wetlands(raw_wetlands, design), occupied_wetlands(clean_counts, design)
    )
    return wetland_classes(wetland_density(total, design))
