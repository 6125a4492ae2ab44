"""Count summaries by year, stratum and species.

Region columns are conditional sums in one aggregate rather than a pivot, which would
shuffle twice. Every aggregate combines map-side first, so a hot species or year reaches
the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcount.design import (
    AIR_ONLY,
    AIR_OVER_GROUND,
    COMPOSITION_NAMES,
    GROUND,
    SANDHILL_CRANE,
    SWAN,
    WHOOPING_CRANE,
    SurveyDesign,
)
from fieldcount.functions.columns import (
    day_text,
    indicated_birds,
    ratio,
    ratio_birds,
    seen_birds,
    snake_text,
    sum_if,
)
from fieldcount.operators.structure import platform_view


def _by_region(value: Column, design: SurveyDesign, where: Column | None = None) -> list[Column]:
    keep = F.lit(True) if where is None else where
    return [
        sum_if(keep & (F.col("region") == s.code), value).alias(s.label) for s in design.strata
    ]


def groups_by_region(df: DataFrame, design: SurveyDesign = SurveyDesign()) -> DataFrame:
    """Birds in groups seen from the air, per year and species group, one column per stratum."""
    large = platform_view(df, "air").filter(F.col("groups") >= design.small_group)
    return large.groupBy("year", "p_species").agg(*_by_region(F.col("groups"), design))


def birds_by_region(df: DataFrame, design: SurveyDesign = SurveyDesign()) -> DataFrame:
    """Indicated birds seen from the air, laid out like ``groups_by_region``."""
    air = platform_view(df, "air")
    return air.groupBy("year", "p_species").agg(*_by_region(indicated_birds(), design))


def region_totals_of_year(
    table: DataFrame, year: int, design: SurveyDesign = SurveyDesign()
) -> DataFrame:
    """One year of a by-region table with empty strata as 0 and a row total."""
    labels = [s.label for s in design.strata]
    filled = table.filter(F.col("year") == year).fillna(0, subset=labels)
    total = F.col(labels[0])
    for label in labels[1:]:
        total = total + F.col(label)
    return filled.withColumn("total", total)


def grouped_sightings(
    df: DataFrame, year: int, design: SurveyDesign = SurveyDesign()
) -> DataFrame:
    """The single sightings of groups from the air in one year."""
    return platform_view(df, "air").filter(
        (F.col("year") == year) & (F.col("groups") >= design.small_group)
    )


def latest_years(df: DataFrame, n: int, year: str = "year") -> DataFrame:
    """The last ``n`` distinct survey years; at most ``n`` rows."""
    return df.select(year).distinct().orderBy(F.desc(year)).limit(n)


def previous_survey_year(df: DataFrame, year: str = "year") -> DataFrame:
    """The second latest survey year, as one row."""
    return latest_years(df, 2, year).agg(F.min(year).alias("previous_year"))


def group_and_bird_union(df: DataFrame, design: SurveyDesign = SurveyDesign()) -> DataFrame:
    """Group rows and bird rows of every year in one table, told apart by ``measure``.

    Both measures come out of one aggregate over one scan and are stacked afterwards.
    """
    labels = [s.label for s in design.strata]
    large = F.col("groups") >= design.small_group
    wide = (
        platform_view(df, "air")
        .groupBy("year", "p_species")
        .agg(
            F.struct(*_by_region(F.col("groups"), design, large)).alias("groups"),
            F.struct(*_by_region(indicated_birds(), design)).alias("birds"),
            F.count_if(large).alias("n_large"),
        )
    )
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), *[F.col(f"{m}.{c}").alias(c) for c in labels])
            for m in ("groups", "birds")
        ]
    )
    stacked = wide.select("year", "p_species", "n_large", F.inline(rows))
    return stacked.filter((F.col("measure") == "birds") | (F.col("n_large") > 0)).drop("n_large")


def seen_by_platform(df: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """Seen birds from the air and from the ground, per year and species group."""
    kept = df if years is None else df.join(years, "year", "left_semi")
    grd = F.col("grd")
    return (
        kept.filter(grd.isin(AIR_OVER_GROUND, GROUND, AIR_ONLY))
        .groupBy("year", "p_species")
        .agg(
            sum_if(grd.isin(AIR_OVER_GROUND, AIR_ONLY), seen_birds()).alias("air_seen"),
            sum_if(grd == GROUND, seen_birds()).alias("ground_seen"),
        )
    )


def composition_counts(
    df: DataFrame, year: int | None = None, design: SurveyDesign = SurveyDesign()
) -> DataFrame:
    """Indicated other ducks by species, per stratum and statewide (``level``)."""
    kept = platform_view(df, "air").filter(
        (F.col("p_species") == 5) & (F.col("groups") <= design.group_limit)
    )
    if year is not None:
        kept = kept.filter(F.col("year") == year)
    by_region = kept.groupBy("year", "region", "species").agg(
        F.sum(indicated_birds()).alias("birds")
    )
    sets = [["year", "region", "species"], ["year", "species"]]
    level = F.when(F.grouping("region") == 1, "state").otherwise("region").alias("level")
    return by_region.groupingSets(sets, "year", "region", "species").agg(
        level, F.sum("birds").alias("birds")
    )


def composition_share(
    df: DataFrame,
    codes: DataFrame,
    year: int | None = None,
    design: SurveyDesign = SurveyDesign(),
    names: Sequence[str] = COMPOSITION_NAMES,
) -> DataFrame:
    """Percent of each named species among the other ducks; one wide row per level.

    Codes of one name are added up. Every survey year has a row for the state and for each of its
    regions, of ``0%`` throughout where it has no other ducks.
    """
    places = [["year", "region"], ["year"]]
    level = F.when(F.grouping("region") == 1, "state").otherwise("region").alias("level")
    surveyed = platform_view(df, "air")
    if year is not None:
        surveyed = surveyed.filter(F.col("year") == year)
    surveyed = surveyed.groupBy("year", "region").agg(F.count(F.lit(1)).alias("n"))
    scaffold = surveyed.groupingSets(places, "year", "region").agg(level, F.sum("n").alias("n"))
    scaffold = scaffold.select("year", "level", "region", F.lit(None).cast("string").alias("name"), F.lit(0).alias("birds"))
    named = composition_counts(df, year, design).join(
        codes.select("species", snake_text(F.col("common_name")).alias("name")), "species", "left"
    )
    counted = named.select("year", "level", "region", "name", "birds").unionByName(scaffold)
    birds = [F.sum(F.when(F.col("name") == n, F.col("birds"))).alias(n) for n in names]
    wide = counted.groupBy("year", "level", "region").agg(F.sum("birds").alias("whole"), *birds)

    def percent(name: str) -> Column:
        share = F.bround(ratio(F.col(name), F.col("whole")) * 100, 0)
        return F.coalesce(F.concat(share.cast("int").cast("string"), F.lit("%")), F.lit("0%")).alias(name)

    return wide.select("year", "level", "region", *map(percent, names))


def last_n_years_total(
    clean: DataFrame, column: str = "coots", n: int = 5, platform: str = "grd"
) -> DataFrame:
    """Yearly total of a count column, not from the ground, for the last ``n`` years with any."""
    kept = clean.filter((F.col(column) != 0) & (F.col(platform) != GROUND))
    totals = kept.groupBy("year").agg(F.sum(column).alias(column))
    return totals.orderBy(F.desc("year")).limit(n)


def total_vs_ungrouped(df: DataFrame, species: int = SANDHILL_CRANE) -> DataFrame:
    """Seen birds of a species per year, in all and outside groups, in one pass."""
    return (
        platform_view(df, "air")
        .filter(F.col("species") == species)
        .groupBy("year")
        .agg(
            F.sum(seen_birds()).alias("cranes_total"),
            sum_if(F.col("groups") == 0, seen_birds()).alias("cranes_no_groups"),
        )
    )


def species_since(df: DataFrame, species: int = WHOOPING_CRANE, since: int = 2016) -> DataFrame:
    """Air records of a species from a year on."""
    return platform_view(df, "air").filter(
        (F.col("species") == species) & (F.col("year") >= since)
    )


def species_total(df: DataFrame, species: int, year: int) -> DataFrame:
    """Seen birds of a species in one year over all platforms, as one row."""
    kept = df.filter((F.col("species") == species) & (F.col("year") == year))
    return kept.agg(F.sum(seen_birds()).alias("count"))


def swans_small_groups(
    df: DataFrame, since: int = 2016, species: int = SWAN, design: SurveyDesign = SurveyDesign()
) -> DataFrame:
    """Seen swans outside groups per year, from a year on."""
    return (
        platform_view(df, "air")
        .filter(
            (F.col("species") == species)
            & (F.col("groups") < design.small_group)
            & (F.col("year") >= since)
        )
        .groupBy("year")
        .agg(F.sum(seen_birds()).alias("seen"))
    )


def species_by_region_transect(df: DataFrame, year: int, species: int = SWAN) -> DataFrame:
    """Ratio-index birds of a species by stratum and by transect (NULL transect = stratum)."""
    kept = platform_view(df, "air").filter(
        (F.col("species") == species) & (F.col("year") == year)
    )
    by_transect = kept.groupBy("region", "transect").agg(F.sum(ratio_birds()).alias("birds"))
    sets = [["region", "transect"], ["region"]]
    return by_transect.groupingSets(sets, "region", "transect").agg(F.sum("birds").alias("birds"))


def _survey_date() -> Column:
    return F.make_date("year", "month", "day")


def _survey_days(clean: DataFrame, keys: Sequence[str], platforms: Sequence[int]) -> DataFrame:
    """Distinct survey days per unit and platform, each ground-segment day with its lag.

    Within a unit the air-over-ground days come first, then the ground days, then the rest,
    so ``lag`` of a paired day only ever sees another paired day.
    """
    kind = (
        F.when(F.col("grd") == AIR_OVER_GROUND, 1).when(F.col("grd") == GROUND, 2).otherwise(3)
    )
    unit = Window.partitionBy(*keys)
    previous = F.lag("date").over(unit.orderBy("kind", "date"))
    paired = F.col("kind") <= 2
    return (
        clean.filter(F.col("grd").isin(*platforms))
        .select(*keys, _survey_date().alias("date"), "grd", kind.alias("kind"))
        .distinct()
        .withColumn("kinds", F.count_if(paired).over(unit))
        .withColumn("previous", previous)
        .withColumn("first_kind", F.min("kind").over(unit))
        .withColumn(
            "diff", F.when(paired & (F.col("kinds") == 2), F.date_diff("date", "previous"))
        )
    )


def air_ground_lag_days(
    clean: DataFrame, keys: Sequence[str] = ("year", "transect"), strict: bool = False
) -> DataFrame:
    """Days from the air-over-ground count to the ground count of the same transect.

    Only units with exactly two survey days are paired. Two days of one platform count as
    a pair as well unless ``strict``.
    """
    days = _survey_days(clean, keys, (AIR_OVER_GROUND, GROUND)).filter(F.col("diff").isNotNull())
    if strict:
        days = days.filter(F.col("first_kind") != F.col("kind"))
    return days.select(*keys, "date", "grd", "diff")


def survey_timing(clean: DataFrame, year: int | None = None) -> DataFrame:
    """First and last day, number of days and air-to-ground lag of each survey year.

    The end day stays NULL where a platform flew on a single day. The days of all transects
    are worked out once; everything else is one aggregate over them.
    """
    kept = clean if year is None else clean.filter(F.col("year") == year)
    ground = F.col("grd") == GROUND
    date = F.col("date")
    air_date, ground_date = F.when(~ground, date), F.when(ground, date)
    days = (
        _survey_days(kept, ("year", "transect"), (AIR_OVER_GROUND, GROUND, AIR_ONLY))
        .groupBy("year")
        .agg(
            F.min(air_date).alias("air_min"),
            F.max(air_date).alias("air_max"),
            F.count_distinct(air_date).alias("aerial_total_survey_days"),
            F.min(ground_date).alias("ground_min"),
            F.max(ground_date).alias("ground_max"),
            F.count_distinct(ground_date).alias("ground_total_survey_days"),
            F.min(date).alias("any_min"),
            F.max(date).alias("any_max"),
            F.max(F.abs("diff")).alias("air_ground_overlap"),
        )
    )
    aerial_end = F.when(F.col("aerial_total_survey_days") > 1, day_text(F.col("air_max")))
    ground_end = F.when(F.col("ground_total_survey_days") > 1, day_text(F.col("ground_max")))
    return days.select(
        "year",
        day_text(F.col("air_min")).alias("aerial_start_survey_date"),
        aerial_end.alias("aerial_end_survey_date"),
        "aerial_total_survey_days",
        day_text(F.col("ground_min")).alias("ground_start_survey_date"),
        ground_end.alias("ground_end_survey_date"),
        "ground_total_survey_days",
        "air_ground_overlap",
        day_text(F.col("any_min")).alias("min_air_ground_survey_date"),
        day_text(F.col("any_max")).alias("max_air_ground_survey_date"),
    )


# Species of the transect means.
TRANSECT_MEAN_SPECIES = (50, 32, 40, 44)


def mean_count_by_transect(
    df: DataFrame, codes: DataFrame, species: Sequence[int] = TRANSECT_MEAN_SPECIES
) -> DataFrame:
    """Mean yearly indicated birds per transect and named species, over years present."""
    yearly = (
        platform_view(df, "air")
        .filter(F.col("species").isin(*species))
        .groupBy("transect", "species", "year")
        .agg(F.sum(indicated_birds()).alias("count"))
    )
    return (
        yearly.join(codes, "species", "left")
        .groupBy("transect", "common_name")
        .agg(F.avg("count").alias("count"))
    )


def air_vs_ground_series(paired: DataFrame) -> DataFrame:
    """Ratio-index birds per species group, year and count type. Groups are capped before."""
    known = platform_view(paired, "known")
    kind = F.when(F.col("grd") == AIR_OVER_GROUND, "Air").otherwise("Ground")
    return known.groupBy("p_species", "year", kind.alias("count_type")).agg(
        F.sum(ratio_birds()).alias("birds")
    )


def grouped_share(df: DataFrame, design: SurveyDesign = SurveyDesign()) -> DataFrame:
    """Percent of a group's indicated birds that stood in large groups (NULL region = state)."""
    g = F.col("groups")
    by_region = (
        platform_view(df, "air")
        .groupBy("year", "p_species", "region")
        .agg(
            F.sum(F.when(g >= design.small_group, g).otherwise(0.0)).alias("grouped"),
            F.sum(indicated_birds()).alias("indicated"),
        )
    )
    sets = [["year", "p_species", "region"], ["year", "p_species"]]
    level = F.when(F.grouping("region") == 1, "state").otherwise("region").alias("level")
    return (
        by_region.groupingSets(sets, "year", "p_species", "region")
        .agg(level, F.sum("grouped").alias("grouped"), F.sum("indicated").alias("indicated"))
        .withColumn("share", ratio(F.col("grouped"), F.col("indicated")) * 100)
    )
