"""Double-sampling estimators: the ground-to-air ratio and population sizes.

The first aggregate, per species group, year and transect, shrinks the observations to a
few rows per transect; all later steps run on that. No step loops over years, species or
strata: windows and grouped sums stand in for the loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcount.design import (
    AIR_OVER_GROUND,
    GROUND,
    PRIORITY_GROUPS,
    PRIORITY_LABELS,
    SWAN,
    SurveyDesign,
    lookup,
)
from fieldcount.functions.columns import ratio, ratio_birds, sum0
from fieldcount.operators.structure import cap_large_groups, platform_view


def paired_transect_sums(df: DataFrame, design: SurveyDesign = SurveyDesign()) -> DataFrame:
    """Air and ground birds of each species group, year and paired transect, with products."""
    capped = cap_large_groups(platform_view(df, "paired"), design.group_limit)
    air = F.when(F.col("grd") == AIR_OVER_GROUND, ratio_birds())
    ground = F.when(F.col("grd") == GROUND, ratio_birds())
    sums = capped.groupBy(F.col("p_species").alias("species"), "year", "transect").agg(
        sum0(air).alias("air"), sum0(ground).alias("ground")
    )
    return sums.withColumns(
        {
            "sqx": F.col("air") * F.col("air"),
            "sqy": F.col("ground") * F.col("ground"),
            "xy": F.col("air") * F.col("ground"),
        }
    )


# Sums the ratio needs; all are additive over years.
_SUMS = {"sum_sqx": "sqx", "sum_sqy": "sqy", "sum_xy": "xy", "sum_air": "air", "sum_grd": "ground"}


def ratio_windows(sums: DataFrame, design: SurveyDesign = SurveyDesign()) -> DataFrame:
    """The ratio and its variance for every window of the latest 2, 3, ... years.

    Transect sums never span years, so a window's sums are running totals from the latest
    year back. The years are those of the whole paired table: a species absent in a year
    still has a row there, with zero sums. That grid comes from one row per year holding
    the sums of every species, unrolled, so the table is read once and nothing is joined.
    """
    species = F.col("species")
    per_species = [
        F.struct(
            F.lit(g).alias("species"),
            *[sum0(F.when(species == g, F.col(c))).alias(name) for name, c in _SUMS.items()],
            F.max(F.when(species == g, F.col("year"))).alias("seen_year"),
        )
        for g in design.ratio_groups
    ]
    yearly = (
        sums.groupBy("year").agg(F.array(*per_species).alias("rows")).select("year", F.inline("rows"))
    )

    latest = Window.partitionBy("species").orderBy(F.desc("year"))
    back = latest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    windows = yearly.select(
        "species",
        F.row_number().over(latest).alias("n_years"),
        *[F.sum(c).over(back).alias(c) for c in _SUMS],
        F.min("seen_year").over(back).alias("min_year"),
        F.max("seen_year").over(back).alias("max_year"),
    )

    n = (F.col("n_years") * design.paired_segments).cast("double")
    r = F.col("r")
    mean_air = F.col("sum_air") / n
    return (
        windows.filter(F.col("n_years") >= design.min_years)
        .withColumn("r", ratio(F.col("sum_grd"), F.col("sum_air")))
        .withColumn(
            "var_top",
            F.col("sum_sqy") + r * r * F.col("sum_sqx") - r * F.col("sum_xy") * 2,
        )
        .withColumn("var_bottom", mean_air * mean_air * (n * (n - 1)))
        .withColumn("var_r", ratio(F.col("var_top"), F.col("var_bottom")))
        .withColumn("se_r", F.sqrt("var_r"))
        .withColumn("cvr_r", ratio(F.col("se_r"), r))
        .withColumn("year_span", F.col("max_year") - F.col("min_year"))
    )


def ratio_correction(
    sums: DataFrame, design: SurveyDesign = SurveyDesign(), cv_target: float | None = None
) -> DataFrame:
    """Per species group, the shortest window whose CV meets the target, else the widest."""
    target = design.cv_target if cv_target is None else cv_target
    windows = ratio_windows(sums, design)
    met = ~F.isnan("cvr_r") & (F.col("cvr_r") < target)
    names = [c for c in windows.columns if c != "species"]
    whole = F.struct(*names)
    chosen = windows.groupBy("species").agg(
        F.coalesce(
            F.min_by(F.when(met, whole), F.when(met, F.col("n_years"))),
            F.max_by(whole, "n_years"),
        ).alias("w"),
        F.coalesce(F.bool_or(met), F.lit(False)).alias("target_met"),
    )
    return chosen.select("species", "w.*", "target_met")


def transect_totals(
    df: DataFrame, year: int, design: SurveyDesign = SurveyDesign()
) -> DataFrame:
    """Ratio-index birds per species group, stratum and transect from one year's air counts."""
    air = platform_view(df.filter(F.col("year") == year), "air")
    return (
        cap_large_groups(air, design.group_limit)
        .groupBy(F.col("p_species").alias("species"), "region", "transect")
        .agg(F.sum(ratio_birds()).alias("total_transect"))
    )


def _estimate(df: DataFrame, m: float) -> DataFrame:
    """Density, population size and their errors from total_air, sum_sq_air, transects,
    area, r and var_r; ``m`` is the area of one transect."""
    n, b, area = F.col("transects"), F.col("b"), F.col("area")
    r, var_r, var_b = F.col("r"), F.col("var_r"), F.col("var_b")
    spread = F.col("sum_sq_air") + b * b * F.col("sum_sq") - b * F.col("sum_air_xm") * 2
    return (
        df.withColumn("b", F.col("total_air") / n / m)
        .withColumn("sqm", F.lit(m * m))
        .withColumn("sum_sq", F.lit(m * m) * n)
        .withColumn("sum_air_xm", F.col("total_air") * m)
        .withColumn("var_b", ratio(spread, F.col("sqm") * n * (n - 1)))
        .withColumn("se_b", F.sqrt("var_b"))
        .withColumn("cv_b", ratio(F.col("se_b"), b))
        .withColumn("pop_est", F.bround(b * area * r, 0))
        .withColumn("pop_var", area * area * (var_b * (r * r) + var_r * (b * b) - var_b * var_r))
        .withColumn("pop_se_1", F.sqrt("pop_var"))
        .withColumn("pop_se_2", F.sqrt("pop_var") / F.sqrt(n))
    )


# Columns of the estimates, in their order.
_ESTIMATE_COLUMNS = (
    "total_air",
    "sqm",
    "sum_sq_air",
    "sum_sq",
    "sum_air_xm",
    "var_b",
    "se_b",
    "cv_b",
    "b",
    "area",
    "r",
    "pop_est",
    "pop_var",
    "pop_se_1",
    "pop_se_2",
)


def _transect_sums() -> tuple[Column, Column]:
    t = F.col("total_transect")
    return sum0(t).alias("total_air"), sum0(t * t).alias("sum_sq_air")


def population_by_region(
    totals: DataFrame, correction: DataFrame, design: SurveyDesign = SurveyDesign()
) -> DataFrame:
    """Stratum estimates; every species group has a row in every stratum, 0 if never seen."""
    cells = totals.groupBy("species", "region").agg(*_transect_sums())
    filled = (
        design.scaffold(totals.sparkSession)
        .join(cells, ["species", "region"], "left")
        .fillna(0.0, subset=["total_air", "sum_sq_air"])
        .join(correction.select("species", "r", "var_r"), "species", "left")
    )
    return _estimate(filled, design.transect_area).select("species", "region", *_ESTIMATE_COLUMNS)


def population_by_region_uncorrected(
    df: DataFrame, year: int, species: int = SWAN, design: SurveyDesign = SurveyDesign()
) -> DataFrame:
    """Stratum estimates of one species without a ratio: r = 1 and var_r = 0."""
    totals = transect_totals(df.filter(F.col("species") == species), year, design)
    cells = totals.groupBy("region").agg(*_transect_sums())
    filled = (
        design.scaffold(df.sparkSession, (species,))
        .join(cells, "region", "left")
        .fillna(0.0, subset=["total_air", "sum_sq_air"])
        .withColumns({"r": F.lit(1.0), "var_r": F.lit(0.0)})
    )
    columns = [c for c in _ESTIMATE_COLUMNS if c != "r"]
    return _estimate(filled, design.transect_area).select("species", "region", *columns)


def population_statewide(
    totals: DataFrame, correction: DataFrame, design: SurveyDesign = SurveyDesign()
) -> DataFrame:
    """Estimates pooled over strata."""
    by_transect = totals.groupBy("species", "transect").agg(
        F.sum("total_transect").alias("total_transect")
    )
    cells = by_transect.groupBy("species").agg(*_transect_sums())
    groups = totals.sparkSession.createDataFrame(
        [(g, float(design.total_transects), float(design.total_area)) for g in design.ratio_groups],
        "species int, transects double, area double",
    )
    filled = (
        groups.join(cells, "species", "left")
        .fillna(0.0, subset=["total_air", "sum_sq_air"])
        .join(correction.select("species", "r", "var_r"), "species", "left")
    )
    return _estimate(filled, design.transect_area).select("species", *_ESTIMATE_COLUMNS)


def annual_totals(estimates: DataFrame, year: int, total_label: str = "total ducks") -> DataFrame:
    """Statewide sums of the rounded stratum estimates, and all groups but geese together."""
    goose = PRIORITY_GROUPS[72]
    label = lookup(F.col("species"), PRIORITY_LABELS)
    parts = F.array(label, F.when(F.col("species") != goose, F.lit(total_label)))
    exploded = estimates.select(F.explode(parts).alias("name"), "pop_est").filter(
        F.col("name").isNotNull()
    )
    return exploded.groupBy(F.col("name").alias("species")).agg(
        F.lit(year).alias("year"), F.sum("pop_est").alias("n")
    )


def annual_swan_total(
    estimates: DataFrame, year: int, label: str = "trumpeter swan"
) -> DataFrame:
    return estimates.agg(
        F.lit(label).alias("species"), F.lit(year).alias("year"), F.sum("pop_est").alias("n")
    )


def statewide_se(estimates: DataFrame) -> DataFrame:
    return estimates.groupBy("species").agg(F.sqrt(F.sum("pop_var")).alias("pop_se_1"))


def top_region_share(
    estimates: DataFrame, design: SurveyDesign = SurveyDesign()
) -> DataFrame:
    """The stratum with the largest share of each species group, and that share in percent."""
    share = ratio(F.col("pop_est"), F.sum("pop_est").over(Window.partitionBy("species"))) * 100
    label = design.region_label(F.col("region"))
    return (
        estimates.withColumns({"freq": share, "label": label})
        .groupBy("species")
        .agg(
            F.max_by("label", F.struct("freq", "region")).alias("region"),
            F.bround(F.max("freq"), 0).alias("percent"),
        )
    )
