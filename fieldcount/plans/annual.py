"""The annual analysis: stored raw tables in, one stage table per result out.

The structured observations are written once, partitioned by year, and most later stages read
them back. Coots, survey timing and occupied wetlands need the cleaned wide counts and scan the
raw table again.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcount.design import SANDHILL_CRANE, SWAN, WHOOPING_CRANE, SurveyDesign
from fieldcount.operators import estimate, habitat, report, structure, summaries, trend
from fieldcount.sources import ingest, store

# Names of the stored tables.
RAW_COUNTS = "raw_duck_counts"
RAW_WETLANDS = "raw_wetland_counts"
SPECIES_CODES = "species_codes"
OBSERVERS = "observers"
POP_ESTIMATES = "vcf_corrected_pop_estimates"
SWAN_ESTIMATES = "swan_pop_estimates"


def import_year(
    spark: SparkSession,
    root: str,
    counts: DataFrame,
    wetlands: DataFrame,
    delivery: str,
    design: SurveyDesign = SurveyDesign(),
) -> None:
    """Append a delivery to the raw tables; years that another delivery brought stay as they are.

    Wetland rows without a month are dropped, their ground flag and type counts filled with
    zeros, and their region is attached.
    """
    types = [c for c in wetlands.columns if re.fullmatch(r"ground|typ\d+|str|dit", c)]
    wetlands = ingest.null_policy(structure.normalize_year(wetlands), types, ["month"])
    wetlands = structure.band_region(wetlands.drop("region"), design)
    store.append_to_table(structure.normalize_year(counts), f"{root}/{RAW_COUNTS}", delivery)
    store.append_to_table(wetlands, f"{root}/{RAW_WETLANDS}", delivery)


def import_files(
    spark: SparkSession, root: str, path: str, year: int, delivery: str | None = None, design: SurveyDesign = SurveyDesign()
) -> None:
    """``import_year`` from the CSV deliveries of a year below ``path``."""
    counts, wetlands = (
        ingest.read_year_files(spark, path, kind, year).drop("file_name") for kind in ("waterfowl", "air_wetlands")
    )
    import_year(spark, root, counts, wetlands, delivery or f"files-{year}", design)


def structure_stage(
    spark: SparkSession, root: str, out: str, design: SurveyDesign, slots: int
) -> tuple[DataFrame, DataFrame]:
    """The cleaned wide counts, lazily, and the structured observations, written and read."""
    raw = ingest.load_table(spark, root, RAW_COUNTS)
    structured = structure.structure_counts(raw, design=design, slots=slots)
    store.write_partitioned(structured, f"{out}/structured", "year")
    stored = spark.read.schema(structured.schema).parquet(f"{out}/structured")
    return structure.clean_counts(raw, slots), stored


def analyze_survey(
    spark: SparkSession,
    root: str,
    out: str,
    year: int,
    design: SurveyDesign = SurveyDesign(),
    slots: int = 9,
    cranes_since: int = 2016,
) -> dict[str, DataFrame]:
    """Run every stage for one analysis year. Returns the stage tables by name, read back
    from ``out``. Whooping cranes are listed from ``cranes_since`` on; observers where a table
    of their names is stored."""
    clean, structured = structure_stage(spark, root, out, design, slots)
    codes = ingest.load_table(spark, root, SPECIES_CODES)
    results: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        store.write_output(df, f"{out}/{name}", year)
        results[name] = store.read_output(spark, f"{out}/{name}", year, df.schema)
        return results[name]

    keep("groups_and_birds", summaries.group_and_bird_union(structured, design))
    keep("grouped_share", summaries.grouped_share(structured, design))
    two_years = summaries.latest_years(structured, 2)
    keep("seen_by_platform", summaries.seen_by_platform(structured, two_years))
    keep("composition", summaries.composition_share(structured, codes, year, design))
    keep("coots", summaries.last_n_years_total(clean))
    keep("cranes", summaries.total_vs_ungrouped(structured, SANDHILL_CRANE))
    keep("whooping_crane_rows", summaries.species_since(structured, WHOOPING_CRANE, cranes_since))
    keep("whooping_crane_total", summaries.species_total(structured, WHOOPING_CRANE, year))
    keep("swans", summaries.swans_small_groups(structured, design=design))
    capped = structure.cap_large_groups(structured)
    keep("swans_by_transect", summaries.species_by_region_transect(capped, year, SWAN))
    keep("air_vs_ground", summaries.air_vs_ground_series(structure.platform_view(capped, "paired")))
    observers = store.read_or_none(spark, f"{root}/{OBSERVERS}")
    if observers is not None:
        keep("observers", report.observer_list(clean, observers))
    keep("survey_timing", summaries.survey_timing(clean, year))

    wetlands = ingest.load_table(spark, root, RAW_WETLANDS)
    keep("wetland_summaries", habitat.wetland_summaries(wetlands, clean, design))

    paired = keep("paired_sums", estimate.paired_transect_sums(structured, design))
    ratios = keep("ratio_correction", estimate.ratio_correction(paired, design))
    totals = estimate.transect_totals(structured, year, design)
    regions = keep("population_by_region", estimate.population_by_region(totals, ratios, design))
    keep("population_statewide", estimate.population_statewide(totals, ratios, design))
    swans = keep(
        "swan_population",
        estimate.population_by_region_uncorrected(structured, year, design=design),
    )
    run = f"analysis-{year}"
    store.append_to_table(estimate.annual_totals(regions, year), f"{root}/{POP_ESTIMATES}", run)
    store.append_to_table(estimate.annual_swan_total(swans, year), f"{root}/{SWAN_ESTIMATES}", run)

    columns = ["species", "year", "n"]
    series = keep(
        "series",
        trend.series_prep(
            ingest.load_table(spark, root, POP_ESTIMATES, columns=columns),
            ingest.load_table(spark, root, SWAN_ESTIMATES, columns=columns),
            design,
        ),
    )
    keep("trend", trend.trend_with_survey(trend.local_level_trend(series), series))
    return results


def report_tables(
    results: dict[str, DataFrame], year: int, design: SurveyDesign = SurveyDesign()
) -> dict[str, DataFrame]:
    """The report's value tables from the stage tables of one analysis."""
    wetlands, modelled = results["wetland_summaries"], results["trend"]
    regions = results["population_by_region"]
    lines = {"non_linear": "Non-linear", "linear": "Linear"}
    cranes = {"cranes_total": "Total", "cranes_no_groups": "Excluding groups"}
    named = {"observers": report.observer_text(results["observers"])} if "observers" in results else {}
    return named | {
        "survey_years": report.survey_year_count(modelled, ("species",), value="n"),
        "wetland_summary": report.wetland_summary_table(wetlands, year, design=design),
        "wetland_narrative": report.change_narrative(wetlands, year),
        "wetland_figure": report.figure_series(wetlands, lines, ("region",), design.missing_years),
        "crane_figure": report.figure_series(
            results["cranes"], cranes, missing_years=design.missing_years
        ),
        "estimates": report.estimate_table(regions, design),
        "top_region": estimate.top_region_share(regions, design),
        "survey_vs_trend": report.survey_vs_trend_table(modelled, year, design=design),
        "trend_narrative": report.trend_narrative(modelled, year),
        "swan_table": report.recent_species_table(modelled),
    }
