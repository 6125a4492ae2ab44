"""One registered query per operator: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.adapters import SLOTS, STEMS, view
from fieldcount.design import SANDHILL_CRANE, SWAN, WHOOPING_CRANE, SurveyDesign
from fieldcount.functions.columns import seen_birds
from fieldcount.operators import (
    coverage,
    estimate,
    grid,
    habitat,
    lines,
    projection,
    report,
    robust,
    structure,
    summaries,
    trend,
)
from fieldcount.session import materialize, scratch_path
from fieldcount.sources import ingest, store
from fieldcount.streaming.append import append_stream, batch_writer

DESIGN = SurveyDesign()
YEAR = 2001
SINCE = 1998

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Decimals kept in compared columns: quotients and roots differ in the last bits.
DIGITS: dict[str, dict[str, int]] = {}


def query(name: str, **digits: int):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(c, n) for c, n in digits.items()}) if digits else df

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        DIGITS[name] = digits
        return fn

    return register


# ------------------------------------------------------------------ shared inputs


def raw(spark, sf):
    return view(spark, sf, "raw_counts")


def clean(spark, sf):
    return structure.clean_counts(raw(spark, sf), SLOTS)


def slots(spark, sf):
    ids = ["year", "month", "day", "transect", "grd", "wetype"]
    return structure.slots_to_long(clean(spark, sf), ids, SLOTS)


def classified(spark, sf):
    """Slots with region and species group, before the group rules."""
    df = structure.band_region(structure.drop_empty_slots(slots(spark, sf)), DESIGN)
    return structure.classify_species(df)


def structured(spark, sf):
    return structure.structure_counts(raw(spark, sf), design=DESIGN, slots=SLOTS)


# ------------------------------------------------------------------ A: intake and sinks


@query("read_counts")
def _(spark, sf):
    """Whole raw table through CSV and back; later files order their columns differently and lack one."""
    path = scratch_path(spark, "deliveries")
    df = raw(spark, sf)
    df = df.toDF(*[c.upper() for c in df.columns])
    late = [c for c in reversed(df.columns) if c != "SIDE"]
    for part in (df.filter("YEAR < 1998"), df.filter("YEAR >= 1998").select(*late)):
        part.write.mode("append").option("header", True).csv(path)
    return ingest.read_counts(spark, path)


def deliveries(spark, sf) -> str:
    """A folder of deliveries, one per kind and year, named as they arrive."""
    path = scratch_path(spark, "deliveries")
    for kind, df in (("waterfowl", raw(spark, sf)), ("air_wetlands", view(spark, sf, "raw_wetlands"))):
        named = df.withColumn("delivery", F.concat("year", F.lit(f"_{kind}.csv")))
        for odd in (0, 1):
            part = named.filter(F.col("year") % 2 == odd)
            part = part.select(*(reversed(part.columns) if odd else part.columns))
            part.write.mode("append").partitionBy("delivery").option("header", True).csv(path)
    return path


@query("file_catalog")
def _(spark, sf):
    return ingest.file_catalog(spark, deliveries(spark, sf))


@query("read_year_files")
def _(spark, sf):
    """The rows of one kind and year, found by file name among all deliveries."""
    columns = view(spark, sf, "raw_wetlands").columns
    return ingest.read_year_files(spark, deliveries(spark, sf), "air_wetlands", YEAR, columns)


@query("load_table")
def _(spark, sf):
    """Two stored years with their lookups, pruned by partition."""
    path = scratch_path(spark, "tables")
    store.write_partitioned(raw(spark, sf), f"{path}/raw_duck_counts", "year")
    columns = ["year", "month", "day", "transect", "wetype", "sp1", "pr1"]
    df = ingest.load_table(spark, path, "raw_duck_counts", (2000, 2001), columns)
    df = structure.attach_region(df, view(spark, sf, "transects_regions"))
    codes = view(spark, sf, "species_codes").withColumnRenamed("species", "sp1")
    return df.join(codes, "sp1", "left").join(view(spark, sf, "wetland_codes"), "wetype", "left")


@query("append_year")
def _(spark, sf):
    rows = view(spark, sf, "year_batches")
    return store.append_year(rows.filter(F.col("year") <= 1999), rows)


@query("append_year_stream")
def _(spark, sf):
    """The same append with the deliveries arriving as files of a stream, in two rounds."""
    path = scratch_path(spark, "stream")
    rows = view(spark, sf, "year_batches")
    for top in (1999, 2001):
        rows.filter(F.col("year") <= top).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        append_stream(stream, f"{path}/table", f"{path}/progress").awaitTermination()
    return spark.read.parquet(f"{path}/table").select(*rows.columns)


@query("append_year_rejects")
def _(spark, sf):
    """What a table refused: years that another delivery had brought."""
    path = f"{scratch_path(spark, 'append')}/table"
    rows = view(spark, sf, "year_batches")
    store.append_to_table(rows.filter(F.col("year") <= 1999), path, "early")
    store.append_to_table(rows, path, "all")
    return store.rejected(spark, path)


@query("append_year_deliveries")
def _(spark, sf):
    """One delivery in two batches, then another one that is refused."""
    path = f"{scratch_path(spark, 'append')}/table"
    rows = view(spark, sf, "year_batches").filter(F.col("year") <= 1999)
    write = batch_writer(path, "stream", delivery_col="file")
    named = rows.withColumn("file", F.lit("first"))
    write(named.filter(F.col("transect") < 30), 0)
    write(named.filter(F.col("transect") >= 30), 1)
    write(rows.withColumn("file", F.lit("second")), 2)
    return spark.read.parquet(path).select(*rows.columns)


@query("write_output")
def _(spark, sf):
    """Structured counts of every analysis year written one after the other, one of them twice."""
    path = scratch_path(spark, "output")
    df = materialize(structured(spark, sf), "structured", "year")
    years = sorted(r[0] for r in df.select("year").distinct().collect())
    for year in [*years, years[-1]]:
        store.write_output(df.filter(F.col("year") == year), path, year)
    out = spark.read.parquet(path)
    return out.select(*df.columns, F.col("analysis_year").cast("int").alias("analysis_year"))


@query("null_policy")
def _(spark, sf):
    return ingest.null_policy(
        view(spark, sf, "text_counts"), ["typ1", "typ2"], ["month"], ["n"]
    )


WIDE_LABELS = {
    "mall": "mallard",
    "bwte": "blue-winged teal",
    "wodu": "wood duck",
    "o_ducks": "other ducks",
    "t_ducks": "total ducks",
    "geese": "canada goose",
}


@query("wide_series_to_long")
def _(spark, sf):
    return ingest.wide_series_to_long(
        view(spark, sf, "wide_series"), WIDE_LABELS, exclude_years=(2001,)
    )


# ------------------------------------------------------------------ B: structure


@query("normalize_year")
def _(spark, sf):
    """Two-digit years, as delivered before 2000, mixed with four-digit ones."""
    df = raw(spark, sf)
    short = F.when(F.col("day") > 5, F.col("year") % 100).otherwise(F.col("year"))
    delivered = df.select(F.col("year").alias("true_year"), short.alias("year"), "month", "transect")
    return structure.normalize_year(delivered)


@query("default_platform")
def _(spark, sf):
    df = raw(spark, sf).select("year", "month", "day", "transect", "grd")
    return structure.default_platform(df)


@query("field_sighting_code")
def _(spark, sf):
    df = raw(spark, sf).select("year", "month", "day", "transect", "sp1", "wetype")
    return structure.field_sighting_code(df)


@query("number_within")
def _(spark, sf):
    df = raw(spark, sf)
    order = [c for c in df.columns if c != "transect"]
    return structure.number_within(df, "transect", order)


@query("slots_to_long")
def _(spark, sf):
    return slots(spark, sf)


@query("attach_region")
def _(spark, sf):
    df = raw(spark, sf).select("year", "month", "day", "transect", "sp1", "sp2")
    return structure.attach_region(df, view(spark, sf, "transects_regions"))


@query("band_region")
def _(spark, sf):
    df = raw(spark, sf).select("year", "month", "day", (F.col("transect") + 3).alias("transect"))
    return structure.band_region(df, DESIGN)


@query("classify_species")
def _(spark, sf):
    return structure.classify_species(slots(spark, sf).select("year", "transect", "species", "pairs"))


@query("drop_empty_slots")
def _(spark, sf):
    return structure.drop_empty_slots(slots(spark, sf))


@query("merge_single_flocked")
def _(spark, sf):
    return structure.merge_single_flocked(classified(spark, sf))


@query("small_groups_to_pairs")
def _(spark, sf):
    return structure.small_groups_to_pairs(structure.merge_single_flocked(classified(spark, sf)))


@query("cap_large_groups")
def _(spark, sf):
    return structure.cap_large_groups(structured(spark, sf))


@query("bird_indices")
def _(spark, sf):
    return structure.bird_indices(structured(spark, sf))


@query("platform_views")
def _(spark, sf):
    """Records of each platform view by year: counted by code, then handed to the views."""
    by_code = (
        structured(spark, sf)
        .groupBy("year", "grd")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("species").alias("sum_species"),
            F.sum("transect").alias("sum_transect"),
        )
    )
    sums = [F.sum(c).alias(c) for c in ("n", "sum_species", "sum_transect")]
    return structure.platform_views(by_code).groupBy("view", "year").agg(*sums)


# ------------------------------------------------------------------ C: summaries


@query("groups_by_region")
def _(spark, sf):
    return summaries.groups_by_region(structured(spark, sf), DESIGN)


@query("groups_by_region_year")
def _(spark, sf):
    table = summaries.groups_by_region(structured(spark, sf), DESIGN)
    return summaries.region_totals_of_year(table, YEAR, DESIGN)


@query("grouped_sightings")
def _(spark, sf):
    return summaries.grouped_sightings(structured(spark, sf), YEAR, DESIGN)


@query("birds_by_region")
def _(spark, sf):
    return summaries.birds_by_region(structured(spark, sf), DESIGN)


@query("previous_survey_year")
def _(spark, sf):
    return summaries.previous_survey_year(structured(spark, sf))


@query("group_and_bird_union")
def _(spark, sf):
    return summaries.group_and_bird_union(structured(spark, sf), DESIGN)


@query("seen_by_platform")
def _(spark, sf):
    df = structured(spark, sf)
    return summaries.seen_by_platform(df, summaries.latest_years(df, 2))


@query("composition_counts")
def _(spark, sf):
    return summaries.composition_counts(structured(spark, sf), design=DESIGN)


@query("composition_share")
def _(spark, sf):
    codes = view(spark, sf, "species_codes")
    return summaries.composition_share(structured(spark, sf), codes, design=DESIGN)


@query("last_n_years_total")
def _(spark, sf):
    return summaries.last_n_years_total(clean(spark, sf))


@query("total_vs_ungrouped")
def _(spark, sf):
    return summaries.total_vs_ungrouped(structured(spark, sf), SANDHILL_CRANE)


@query("species_since")
def _(spark, sf):
    return summaries.species_since(structured(spark, sf), WHOOPING_CRANE, SINCE).select(
        "year", "month", "day", "transect", "grd", seen_birds().alias("seen")
    )


@query("species_total")
def _(spark, sf):
    return summaries.species_total(structured(spark, sf), WHOOPING_CRANE, YEAR)


@query("swans_small_groups")
def _(spark, sf):
    return summaries.swans_small_groups(structured(spark, sf), SINCE)


@query("species_by_region_transect")
def _(spark, sf):
    capped = structure.cap_large_groups(structured(spark, sf))
    return summaries.species_by_region_transect(capped, YEAR, SWAN)


@query("survey_timing")
def _(spark, sf):
    return summaries.survey_timing(clean(spark, sf))


@query("air_ground_lag_days")
def _(spark, sf):
    """Pairs within a month and transect: the tables have many survey days per year."""
    return summaries.air_ground_lag_days(clean(spark, sf), ("year", "month", "transect"))


@query("mean_count_by_transect")
def _(spark, sf):
    return summaries.mean_count_by_transect(
        structured(spark, sf), view(spark, sf, "species_codes")
    )


@query("air_vs_ground_series")
def _(spark, sf):
    paired = structure.platform_view(structured(spark, sf), "paired")
    return summaries.air_vs_ground_series(structure.cap_large_groups(paired))


@query("grouped_share", share=6)
def _(spark, sf):
    return summaries.grouped_share(structured(spark, sf), DESIGN)


# ------------------------------------------------------------------ D: wetlands


def _unoccupied(spark, sf):
    return habitat.unoccupied_wetlands(view(spark, sf, "raw_wetlands"), DESIGN)


def _occupied(spark, sf):
    return habitat.occupied_wetlands(clean(spark, sf), DESIGN)


def _total_wetlands(spark, sf):
    return habitat.total_wetlands(_unoccupied(spark, sf), _occupied(spark, sf))


def _density(spark, sf):
    return habitat.wetland_density(_total_wetlands(spark, sf), DESIGN)


def wetlands(spark, sf):
    return habitat.wetland_summaries(view(spark, sf, "raw_wetlands"), clean(spark, sf), DESIGN)


query("unoccupied_wetlands")(_unoccupied)
query("occupied_wetlands")(_occupied)
query("total_wetlands")(_total_wetlands)
query("wetland_density", **{t: 6 for t in habitat.TYPES})(_density)
CLASSES = ("i_ii_vi", "iii", "iv_v", "vii_viii", "non_linear", "stream", "ditch", "linear")
query("wetland_classes", **{c: 6 for c in CLASSES})(wetlands)


# ------------------------------------------------------------------ E: estimators


def sums(spark, sf):
    return estimate.paired_transect_sums(structured(spark, sf), DESIGN)


def correction(spark, sf):
    return estimate.ratio_correction(sums(spark, sf), DESIGN)


def totals(spark, sf):
    return estimate.transect_totals(structured(spark, sf), YEAR, DESIGN)


def by_region(spark, sf):
    return estimate.population_by_region(totals(spark, sf), correction(spark, sf), DESIGN)


RATIO_DIGITS = dict(r=9, var_top=3, var_bottom=3, var_r=12, se_r=9, cvr_r=9)
POP_DIGITS = dict(var_b=9, se_b=9, cv_b=9, b=9, r=9, pop_var=0, pop_se_1=3, pop_se_2=3)
SWAN_DIGITS = {c: n for c, n in POP_DIGITS.items() if c != "r"}

query("paired_transect_sums")(sums)


@query("ratio_windows", **RATIO_DIGITS)
def _(spark, sf):
    return estimate.ratio_windows(sums(spark, sf), DESIGN)


query("ratio_correction", **RATIO_DIGITS)(correction)


@query("ratio_correction_cv08", **RATIO_DIGITS)
def _(spark, sf):
    return estimate.ratio_correction(sums(spark, sf), DESIGN, 0.08)


@query("ratio_correction_cv05", **RATIO_DIGITS)
def _(spark, sf):
    return estimate.ratio_correction(sums(spark, sf), DESIGN, 0.05)


query("population_by_region", **POP_DIGITS)(by_region)


@query("population_by_region_uncorrected", **SWAN_DIGITS)
def _(spark, sf):
    return estimate.population_by_region_uncorrected(structured(spark, sf), YEAR, SWAN, DESIGN)


@query("population_statewide", **POP_DIGITS)
def _(spark, sf):
    return estimate.population_statewide(totals(spark, sf), correction(spark, sf), DESIGN)


@query("annual_totals")
def _(spark, sf):
    return estimate.annual_totals(by_region(spark, sf), YEAR)


@query("statewide_se", pop_se_1=3)
def _(spark, sf):
    return estimate.statewide_se(by_region(spark, sf))


@query("top_region_share")
def _(spark, sf):
    return estimate.top_region_share(by_region(spark, sf), DESIGN)


# ------------------------------------------------------------------ F: trend

# The tables end in 2001, so the later series start earlier than in the default design.
SERIES_DESIGN = SurveyDesign(
    series_start=(("canada goose", 1996), ("trumpeter swan", 1997)), missing_years=(1998,)
)


def prepared(spark, sf):
    return trend.series_prep(
        view(spark, sf, "pop_estimates"), view(spark, sf, "swan_estimates"), SERIES_DESIGN
    )


query("series_prep", log_n=9)(prepared)


@query("local_level_trend", mean=0, sd=0, lcl=0, ucl=0, median=0)
def _(spark, sf):
    """Monthly totals of every flag as series, one month missing."""
    series = view(spark, sf, "series").withColumn("log_n", F.ln("n"))
    return trend.local_level_trend(series, "series_id", "t").drop("error", "nodes")


@query("local_level_trend_species", mean=0, sd=0, lcl=0, ucl=0, median=0, n=1)
def _(spark, sf):
    """Yearly estimates of every species, prepared, smoothed and joined back."""
    series = materialize(prepared(spark, sf), "series")
    return trend.trend_with_survey(trend.local_level_trend(series), series).drop("error", "nodes")


@query("trend_parameters", mean=4, sd=4, lcl=3, ucl=3, median=3)
def _(spark, sf):
    """Growth rate, process sd and observation sd of every species' yearly estimates."""
    return trend.trend_parameters(prepared(spark, sf)).drop("error", "nodes")


@query("trend_with_survey")
def _(spark, sf):
    survey = view(spark, sf, "pop_estimates").unionByName(view(spark, sf, "swan_estimates"))
    return trend.trend_with_survey(view(spark, sf, "trend_results").drop("n"), survey)


# ------------------------------------------------------------------ G: report tables

RECENT = 5
CLASS_DIGITS = {c: 6 for c in CLASSES}


def wetland_stage(spark, sf):
    """The wetland stage table, written once like every stage result and read back."""
    return materialize(wetlands(spark, sf), "wetland_summaries")


def trend_stage(spark, sf):
    return materialize(view(spark, sf, "trend_results"), "trend_results")


@query("last_n_surveys", **CLASS_DIGITS)
def _(spark, sf):
    return report.last_n_surveys(wetland_stage(spark, sf), RECENT)


@query("pct_change_previous", **CLASS_DIGITS)
def _(spark, sf):
    return report.pct_change_previous(wetlands(spark, sf))


@query("recent_mean", **CLASS_DIGITS)
def _(spark, sf):
    return report.recent_mean(wetlands(spark, sf), RECENT)


@query("long_term_mean", **CLASS_DIGITS)
def _(spark, sf):
    return report.long_term_mean(wetlands(spark, sf), YEAR)


@query("pct_change_long_term", **CLASS_DIGITS)
def _(spark, sf):
    return report.pct_change_long_term(wetlands(spark, sf), YEAR)


@query("wetland_summary_table")
def _(spark, sf):
    return report.wetland_summary_table(wetland_stage(spark, sf), YEAR, RECENT, DESIGN)


@query("change_narrative")
def _(spark, sf):
    return report.change_narrative(wetland_stage(spark, sf), YEAR)


@query("trend_narrative")
def _(spark, sf):
    return report.trend_narrative(view(spark, sf, "trend_results"), YEAR)


@query("survey_vs_trend_table")
def _(spark, sf):
    return report.survey_vs_trend_table(trend_stage(spark, sf), YEAR, 3, design=DESIGN)


@query("recent_species_table")
def _(spark, sf):
    return report.recent_species_table(view(spark, sf, "trend_results"), start_year=1997)


@query("estimate_table")
def _(spark, sf):
    return report.estimate_table(by_region(spark, sf), DESIGN)


@query("figure_series", value=6)
def _(spark, sf):
    named = wetland_stage(spark, sf).withColumn("name", DESIGN.region_name(F.col("region")))
    measures = {"non_linear": "Non-linear", "linear": "Linear"}
    return report.figure_series(named, measures, ("region", "name"))


@query("figure_series_cranes")
def _(spark, sf):
    totals = summaries.total_vs_ungrouped(structured(spark, sf), SANDHILL_CRANE)
    measures = {"cranes_total": "Total", "cranes_no_groups": "Excluding groups"}
    return report.figure_series(totals, measures)


def observers(spark, sf):
    return report.observer_list(clean(spark, sf), view(spark, sf, "observers"))


query("observer_list")(observers)


@query("observer_text")
def _(spark, sf):
    return report.observer_text(observers(spark, sf))


@query("survey_year_count")
def _(spark, sf):
    return report.survey_year_count(structured(spark, sf), ("region", "p_species"), 1997)


@query("survey_year_count_series")
def _(spark, sf):
    return report.survey_year_count(view(spark, sf, "trend_results"), ("species",), value="n")


# ------------------------------------------------------------------ H: lines and grids

DIST = 1.2
# A corridor a twentieth as wide as a cell.
THIN = 0.025


def pieces(spark, sf):
    return view(spark, sf, "pieces")


def cells(spark, sf):
    return view(spark, sf, "grid")


@query("dissolve_lines", length=6)
def _(spark, sf):
    return grid.dissolve_lines(pieces(spark, sf), "line_id")


@query("line_centroid", x=6, y=6)
def _(spark, sf):
    return grid.line_centroid(pieces(spark, sf), "line_id")


def stretches(spark, sf):
    return lines.line_parts(lines.union_lines(view(spark, sf, "flown"), ["line_id"]), ["line_id"])


@query("union_lines", x1=4, y1=4, x2=4, y2=4, length=6)
def _(spark, sf):
    """Straight stretches of lines of which some pieces were flown twice or in part, in numbered parts."""
    return stretches(spark, sf)


@query("dissolve_union", length=5, x=5, y=5)
def _(spark, sf):
    return lines.dissolve_union(stretches(spark, sf), ["line_id"])


@query("within_corridor")
def _(spark, sf):
    return grid.within_corridor(cells(spark, sf), pieces(spark, sf), DIST, keys=["line_id"])


def zones(spark, sf):
    """Cells inside the corridors of each transect's lines."""
    keys = ["line_id", "transect"]
    return grid.within_corridor(cells(spark, sf), pieces(spark, sf), DIST, keys=keys, zones=["transect"])


@query("zonal_mean", value=6)
def _(spark, sf):
    return grid.zonal_mean(cells(spark, sf), zones(spark, sf), by=("year",))


@query("corridor_coverage", weight=9)
def _(spark, sf):
    """Share of 3 x 3 points of each cell in the corridor of each line."""
    return grid.corridor_coverage(
        cells(spark, sf), pieces(spark, sf), DIST, 1.0, 3, keys=["line_id"]
    )


@query("zonal_mean_weighted", value=9)
def _(spark, sf):
    weights = grid.corridor_coverage(
        cells(spark, sf), pieces(spark, sf), DIST, 1.0, 3, keys=["line_id"]
    )
    return grid.zonal_mean(cells(spark, sf), weights, ["line_id"], weight="points")


def coverage_area(spark, sf):
    return coverage.corridor_coverage_area(cells(spark, sf), pieces(spark, sf), THIN, 1.0, keys=["line_id"])


@query("corridor_coverage_area", area=9, weight=9)
def _(spark, sf):
    """Share of each cell's area in each line's corridor, which is thin against the cell."""
    return coverage_area(spark, sf)


@query("zonal_mean_area", value=9)
def _(spark, sf):
    return grid.zonal_mean(cells(spark, sf), coverage_area(spark, sf), ["line_id"], weight="area")


@query("season_of")
def _(spark, sf):
    return grid.season_of(view(spark, sf, "climate"))


@query("season_stack")
def _(spark, sf):
    return grid.season_stack(view(spark, sf, "climate"), F.sum)


@query("season_stack_mean", value=6)
def _(spark, sf):
    return grid.season_stack(view(spark, sf, "climate"), F.avg)


@query("season_stack_all", value=6)
def _(spark, sf):
    """With the seasons that lack months."""
    return grid.season_stack(view(spark, sf, "climate"), F.avg, complete=False)


@query("season_stack_normals", value=6)
def _(spark, sf):
    """Monthly normals, which have no year."""
    normals = view(spark, sf, "climate").groupBy("cell_id", "month").agg(F.avg("value").alias("value"))
    return grid.season_stack(normals, F.avg, by=())


@query("mask_polygon")
def _(spark, sf):
    return grid.mask_polygon(cells(spark, sf), view(spark, sf, "ring"), cell_size=1.0)


def current_and_normal(spark, sf):
    """Season totals of the current year, and their mean over the years before."""
    totals = materialize(grid.season_stack(view(spark, sf, "climate"), F.sum), "season_totals")
    current = totals.filter(F.col("season_year") == YEAR)
    past = totals.filter(F.col("season_year") < YEAR)
    normal = past.groupBy("cell_id", "season").agg(F.avg("value").alias("value"))
    return current, normal


@query("cell_anomaly", value=6)
def _(spark, sf):
    return grid.cell_anomaly(*current_and_normal(spark, sf))


@query("project_points", x=2, y=2)
def _(spark, sf):
    return grid.project_points(view(spark, sf, "places"))


@query("unproject_points", lon=6, lat=6)
def _(spark, sf):
    """There and back again: the places as given."""
    plane = grid.project_points(view(spark, sf, "places")).drop("lon", "lat")
    return grid.unproject_points(plane).drop("x", "y")


@query("project_albers", x=2, y=2)
def _(spark, sf):
    return projection.project_albers(view(spark, sf, "places"))


@query("unproject_albers", lon=7, lat=7)
def _(spark, sf):
    """There and back again: the places as given."""
    plane = projection.project_albers(view(spark, sf, "places")).drop("lon", "lat")
    return projection.unproject_albers(plane).drop("x", "y")


# An older datum on another ellipsoid, by three shifts, a rotation and a scale.
OLD_DATUM = projection.DatumShift(
    projection.Ellipsoid(6378206.4, 294.978698214), dx=-8.0, dy=160.0, dz=176.0, rz=0.5, ppm=-0.3
)


@query("shift_datum", lon=6, lat=6)
def _(spark, sf):
    return projection.shift_datum(view(spark, sf, "places"), OLD_DATUM)


def transect_pairs(spark, sf):
    """Per transect and species, corridor mean beside mean count."""
    means = grid.zonal_mean(cells(spark, sf), zones(spark, sf))
    counts = summaries.mean_count_by_transect(
        structured(spark, sf), view(spark, sf, "species_codes")
    )
    return means.join(counts, "transect")


@query("pearson_corr", corr=9)
def _(spark, sf):
    return grid.pearson_corr(transect_pairs(spark, sf), "value", "count", ("common_name",))


FIT_COLUMNS = ["n_pairs", "converged", "nu_at_bound"]


@query("robust_bivariate", mu_x=3, mu_y=3, sigma_x=3, sigma_y=3, rescor=4, nu=1)
def _(spark, sf):
    """Corridor mean and mean count together, for every species."""
    fits = robust.robust_bivariate(transect_pairs(spark, sf), "value", "count", ["common_name"], tol=1e-9, max_iter=300)
    return fits.select("common_name", "mu_x", "mu_y", "sigma_x", "sigma_y", "rescor", "nu", *FIT_COLUMNS)


def season_pairs(spark, sf):
    """Per cell and season, the current total beside the normal."""
    current, normal = current_and_normal(spark, sf)
    named = normal.withColumnRenamed("value", "normal")
    return current.join(named, ["cell_id", "season"])


def season_lines(spark, sf):
    """The current total on the normal, a line for each season."""
    return robust.robust_regression(season_pairs(spark, sf), "normal", "value", ["season"], tol=1e-9, max_iter=300)


@query("robust_regression", intercept=3, slope=4, sigma=3, nu=1)
def _(spark, sf):
    return season_lines(spark, sf).select("season", "intercept", "slope", "sigma", "nu", *FIT_COLUMNS)


@query("robust_limits", rescor=4, rescor_se=4, rescor_lcl=4, rescor_ucl=4)
def _(spark, sf):
    """The correlation of every species with its standard error and limits."""
    fits = robust.robust_bivariate(transect_pairs(spark, sf), "value", "count", ["common_name"], nu=5.0, tol=1e-9, max_iter=300)
    return fits.select("common_name", "rescor", "rescor_se", "rescor_lcl", "rescor_ucl")


@query("fitted_r2", r2=6)
def _(spark, sf):
    """What the fitted lines explain."""
    pairs = season_pairs(spark, sf)
    return robust.fitted_r2(pairs, "normal", "value", season_lines(spark, sf), ["season"]).select("season", "r2")


@query("model_r2", r2=9)
def _(spark, sf):
    return robust.model_r2(season_pairs(spark, sf), "normal", "value", 4.0, 0.75)
