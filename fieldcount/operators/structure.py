"""From wide sighting records to one row per observed species (row-wise, no shuffle).

Everything here except ``number_within`` is a narrow projection or filter; chained
together they run as one stage of generated code straight off the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcount.design import (
    AIR_ONLY,
    AIR_OVER_GROUND,
    GROUND,
    NON_DUCK_BELOW,
    NON_DUCK_CODES,
    NON_DUCK_FROM,
    PRIORITY_GROUPS,
    SurveyDesign,
    lookup,
)
from fieldcount.functions.columns import (
    indicated_birds,
    indicated_birds_without_groups,
    ratio_birds,
    seen_birds,
)
from fieldcount.session import materialize

# Slot stems and the names they get in the long table.
SLOT_STEMS = {
    "sp": "species",
    "pr": "pairs",
    "lm": "lonedrake",
    "fm": "flockdrake",
    "us": "groups",
}
FIELD_SIGHTING = 10


def normalize_year(df: DataFrame, year: str = "year") -> DataFrame:
    """Two-digit years to four digits; four-digit years pass through, row by row."""
    y = F.col(year)
    fixed = F.when(y >= 1000, y).when(y.between(73, 99), y + 1900).otherwise(y + 2000)
    return df.withColumn(year, fixed)


def default_platform(df: DataFrame, platform: str = "grd") -> DataFrame:
    return df.withColumn(platform, F.coalesce(F.col(platform), F.lit(AIR_ONLY)))


def field_sighting_code(
    df: DataFrame, wetland: str = "wetype", first_species: str = "sp1"
) -> DataFrame:
    """A sighting without a wetland was made in a field. Runs before slots are zero-filled."""
    code = F.when(
        F.col(wetland).isNull() & (F.col(first_species) >= 1), F.lit(FIELD_SIGHTING)
    ).otherwise(F.col(wetland))
    return df.withColumn(wetland, code)


def zero_fill_slots(df: DataFrame, n: int, stems: Sequence[str] = tuple(SLOT_STEMS)) -> DataFrame:
    return df.fillna(0, subset=[f"{s}{i}" for i in range(1, n + 1) for s in stems])


def number_within(
    df: DataFrame, part: str, order: Sequence[str], name: str = "basin_no"
) -> DataFrame:
    """Number the rows of each ``part`` 1, 2, ... in the given order.

    A window over ``part`` would sort all rows of one value in one task. Instead the rows
    are range-partitioned on (part, order), so a hot value spreads over many tasks; each
    row's number is its place within its own (partition, part) run plus the rows of the
    earlier runs. The runs are at most partitions + values, so their offsets are small.
    The row id breaks ties, which keeps copies of one row from piling up in a partition.

    The sorted rows are written to the shared folder: offsets and places must come from one
    and the same partitioning, and a partitioning recomputed after a loss may differ.
    """
    keys = [part, *order, "_row"]
    runs = materialize(
        df.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_run", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
        .drop("_row"),
        "numbered",
    )
    earlier = Window.partitionBy(part).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        runs.groupBy(part, "_run")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_start"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(F.col(part).alias("_part"), F.col("_run").alias("_part_run"), "_start", "_offset")
    )
    joined = runs.join(
        offsets, F.col(part).eqNullSafe(F.col("_part")) & (F.col("_run") == F.col("_part_run"))
    )
    number = (F.col("_offset") + F.col("_place") - F.col("_start") + 1).cast("long")
    return joined.select(*df.columns, number.alias(name))


def slots_to_long(
    df: DataFrame,
    id_cols: Sequence[str],
    n: int,
    stems: Mapping[str, str] = SLOT_STEMS,
    species: str = "species",
) -> DataFrame:
    """Repeated slot columns ``sp1, pr1, ... sp2, pr2, ...`` to one row per slot.

    One struct per slot, unrolled with ``inline``: a single pass over the scan.
    """

    def field(stem: str, i: int):
        name = stems[stem]
        return F.col(f"{stem}{i}").cast("int" if name == species else "double").alias(name)

    slots = [F.struct(*[field(stem, i) for stem in stems]) for i in range(1, n + 1)]
    return df.select(*id_cols, F.inline(F.array(*slots)))


def drop_empty_slots(df: DataFrame, species: str = "species") -> DataFrame:
    return df.filter(F.col(species) != 0)


def attach_region(df: DataFrame, transects: DataFrame, key: str = "transect") -> DataFrame:
    """Left join to the transect table. Its size decides the strategy: Spark broadcasts a
    side it knows to be small and shuffles both otherwise."""
    return df.join(transects, key, "left")


def band_region(
    df: DataFrame,
    design: SurveyDesign,
    transect: str = "transect",
    name: str = "region",
) -> DataFrame:
    """Stratum code from the transect number; past the last band it is NULL."""
    first, *rest = sorted(design.strata, key=lambda s: s.below)
    band = F.when(F.col(transect) < first.below, F.lit(first.code))
    for s in rest:
        band = band.when(F.col(transect) < s.below, F.lit(s.code))
    return df.withColumn(name, band)


def classify_species(
    df: DataFrame, species: str = "species", name: str = "p_species"
) -> DataFrame:
    """Priority group of a species code: 1-4 named, 9 not a duck, 5 any other duck."""
    code = F.col(species)
    other = (
        (code < NON_DUCK_BELOW) | code.isin(*NON_DUCK_CODES) | (code >= NON_DUCK_FROM)
    )
    group = F.coalesce(lookup(code, PRIORITY_GROUPS), F.when(other, 9).otherwise(5))
    return df.withColumn(name, group)


def merge_single_flocked(df: DataFrame) -> DataFrame:
    """A single flocked male counts as a lone male."""
    single = F.col("flockdrake") == 1
    return df.withColumns(
        {
            "lonedrake": F.when(single, F.col("lonedrake") + 1).otherwise(F.col("lonedrake")),
            "flockdrake": F.when(single, F.lit(0.0)).otherwise(F.col("flockdrake")),
        }
    )


def small_groups_to_pairs(df: DataFrame, design: SurveyDesign = SurveyDesign()) -> DataFrame:
    """A group below the size limit becomes pairs plus a lone bird, except for geese."""
    goose = PRIORITY_GROUPS[72]
    g = F.col("groups")
    small = (F.col("p_species") != goose) & (g > 0) & (g < design.small_group)
    couples = F.floor(g / 2).cast("double")
    return df.withColumns(
        {
            "pairs": F.when(small, F.col("pairs") + couples).otherwise(F.col("pairs")),
            "lonedrake": F.when(small, F.col("lonedrake") + g - couples * 2).otherwise(
                F.col("lonedrake")
            ),
            "groups": F.when(small, F.lit(0.0)).otherwise(g),
        }
    )


def cap_large_groups(df: DataFrame, limit: int = SurveyDesign.group_limit) -> DataFrame:
    """Groups above the limit are migrants and count as none."""
    g = F.col("groups")
    return df.withColumn("groups", F.when(g > limit, F.lit(0.0)).otherwise(g))


def bird_indices(df: DataFrame) -> DataFrame:
    """The bird indices as columns: seen, indicated, indicated without groups, ratio."""
    return df.withColumns(
        {
            "indicated": indicated_birds(),
            "seen": seen_birds(),
            "old_indicated": indicated_birds_without_groups(),
            "ratio_birds": ratio_birds(),
        }
    )


# Platform views: which records a summary may use.
PLATFORMS = {
    "air": (AIR_OVER_GROUND, AIR_ONLY),
    "paired": (AIR_OVER_GROUND, GROUND),
    "ground": (GROUND,),
}


def in_view(view: str, platform: str = "grd") -> Column:
    """Whether a record belongs to a view: ``air``, ``paired``, ``ground``, ``known`` (any
    code from 1) or ``all``."""
    if view == "all":
        return F.lit(True)
    if view == "known":
        return F.col(platform) >= 1
    return F.col(platform).isin(*PLATFORMS[view])


def platform_view(df: DataFrame, view: str, platform: str = "grd") -> DataFrame:
    return df.filter(in_view(view, platform))


def platform_views(
    df: DataFrame,
    views: Sequence[str] = ("air", "all", "paired", "ground", "known"),
    platform: str = "grd",
) -> DataFrame:
    """Every record once per view it belongs to, from a single scan."""
    names = F.array(*[F.when(in_view(v, platform), v) for v in views])
    return df.select(F.explode(F.array_compact(names)).alias("view"), "*")


def clean_counts(raw: DataFrame, slots: int = 9) -> DataFrame:
    """The wide raw table after its null rules; the base for wetlands and timing."""
    df = default_platform(normalize_year(raw))
    return zero_fill_slots(field_sighting_code(df), slots)


def structure_counts(
    raw: DataFrame,
    transects: DataFrame | None = None,
    design: SurveyDesign = SurveyDesign(),
    slots: int = 9,
    id_cols: Sequence[str] = ("year", "month", "day", "transect", "grd", "wetype"),
) -> DataFrame:
    """Raw wide records to structured observations.

    ``transects`` gives the region of each transect; without it the region comes from the
    transect number and the whole step needs no join at all.
    """
    df = slots_to_long(clean_counts(raw, slots), id_cols, slots)
    df = drop_empty_slots(df)
    df = attach_region(df, transects) if transects is not None else band_region(df, design)
    df = merge_single_flocked(classify_species(df))
    return small_groups_to_pairs(df, design)
