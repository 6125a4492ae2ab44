"""Empty strata, absent species, single days and other corners."""

import datetime

import pytest
from pyspark.sql import functions as F

from fieldcount.design import SurveyDesign
from fieldcount.operators import estimate, habitat, report, structure, summaries, trend

DESIGN = SurveyDesign()
SUMS = (
    "species int, year int, transect int, air double, ground double, sqx double, sqy double, "
    "xy double"
)


def sums(spark, rows):
    full = [(s, y, t, a, g, a * a, g * g, a * g) for s, y, t, a, g in rows]
    return spark.createDataFrame(full, SUMS)


def test_species_missing_in_the_latest_year_still_uses_that_year(spark):
    df = sums(
        spark,
        [(1, 2001, 1, 5.0, 6.0), (2, 2000, 1, 4.0, 8.0), (2, 1999, 1, 2.0, 4.0), (1, 2000, 1, 1.0, 1.0)],
    )
    row = estimate.ratio_correction(df, DESIGN).filter("species = 2").first()
    assert (row.n_years, row.sum_air, row.sum_grd) == (2, 4.0, 8.0)
    assert (row.min_year, row.max_year, row.year_span) == (2000, 2000, 0)


def test_no_air_birds_gives_no_ratio_and_the_widest_window(spark):
    df = sums(spark, [(1, y, 1, 0.0, 3.0) for y in (1999, 2000, 2001)])
    row = estimate.ratio_correction(df, DESIGN).filter("species = 1").first()
    assert (row.n_years, row.r, row.cvr_r, row.target_met) == (3, None, None, False)


def test_absent_species_and_strata_are_zero(spark):
    totals = spark.createDataFrame(
        [(1, 1, 1, 10.0)], "species int, region int, transect int, total_transect double"
    )
    ratio = spark.createDataFrame([(g, 2.0, 0.1) for g in range(1, 6)], "species int, r double, var_r double")
    out = estimate.population_by_region(totals, ratio, DESIGN)
    assert out.count() == 20
    empty = out.filter("species = 3 AND region = 4").first()
    assert (empty.total_air, empty.pop_est, empty.var_b, empty.cv_b) == (0.0, 0.0, 0.0, None)


def clean_days(spark, rows):
    return spark.createDataFrame(rows, "year int, month int, day int, transect int, grd int")


def test_single_survey_day_has_no_end(spark):
    df = clean_days(spark, [(2001, 5, 3, 1, 4), (2001, 5, 3, 2, 4), (2001, 5, 9, 1, 2), (2001, 5, 11, 2, 2)])
    row = summaries.survey_timing(df, 2001).first()
    assert row.aerial_start_survey_date == "May 3"
    assert row.aerial_end_survey_date is None
    assert (row.ground_end_survey_date, row.ground_total_survey_days) == ("May 11", 2)
    assert (row.min_air_ground_survey_date, row.max_air_ground_survey_date) == ("May 3", "May 11")


def test_lag_needs_two_days_and_strict_needs_both_platforms(spark):
    df = clean_days(
        spark,
        [
            (2001, 5, 9, 1, 2), (2001, 5, 4, 1, 1),  # ground five days after air
            (2001, 5, 1, 2, 1), (2001, 5, 2, 2, 1),  # two air days
            (2001, 5, 1, 3, 1),  # one day only
        ],
    )
    loose = summaries.air_ground_lag_days(df).orderBy("transect").collect()
    assert [(r.transect, r["diff"]) for r in loose] == [(1, 5), (2, 1)]
    assert loose[0].date == datetime.date(2001, 5, 9)
    strict = summaries.air_ground_lag_days(df, strict=True).collect()
    assert [(r.transect, r["diff"]) for r in strict] == [(1, 5)]


def test_all_null_wetland_counts_are_zero(spark):
    raw = spark.createDataFrame([(2001, 5, 1)], "year int, month int, transect int")
    for c in [f"typ{i}" for i in range(1, 9)] + ["str", "dit"]:
        raw = raw.withColumn(c, F.lit(None).cast("int"))
    row = habitat.unoccupied_wetlands(raw, DESIGN).first()
    assert [row[t] for t in habitat.TYPES] == [0.0] * 10


def test_field_sighting_needs_a_species(spark):
    df = spark.createDataFrame(
        [(None, 32), (None, 0), (None, None), (3, 32)], "wetype int, sp1 int"
    )
    got = [r.wetype for r in structure.field_sighting_code(df).collect()]
    assert got == [10, None, None, 3]


def test_change_needs_two_surveys(spark):
    rows = [(1, 2000, 2.0), (1, 2001, 3.0), (2, 2001, 5.0), (3, 2000, 0.0), (3, 2001, 1.0)]
    df = spark.createDataFrame(rows, "region int, year int, x double")
    got = {r.region: r.x for r in report.pct_change_previous(df, ["x"]).collect()}
    assert got == {1: pytest.approx(50.0), 3: None}


def test_recent_mean_skips_incomplete_rows(spark):
    rows = [(1, 1999, 9.0), (1, 2000, 2.0), (1, 2001, None), (1, 2002, 4.0)]
    df = spark.createDataFrame(rows, "region int, year int, x double")
    row = report.recent_mean(df, 2, ["x"]).first()
    assert (row.x, row.label) == (3.0, "2-year mean (2000-2002)")


def series(spark, rows):
    return spark.createDataFrame(rows, "species string, year int, n double")


def test_series_gets_a_row_for_a_year_without_a_survey(spark):
    counts = series(spark, [("mallard", 2018, 10.0), ("mallard", 2019, 11.0), ("mallard", 2021, 12.0)])
    swans = series(spark, [("trumpeter swan", 2004, 1.0), ("trumpeter swan", 2005, 2.0)])
    rows = trend.series_prep(counts, swans, DESIGN).orderBy("species", "year").collect()
    assert [(r.species, r.year, r.n) for r in rows] == [
        ("mallard", 2018, 10.0),
        ("mallard", 2019, 11.0),
        ("mallard", 2020, None),
        ("mallard", 2021, 12.0),
        ("trumpeter swan", 2005, 2.0),
    ]
    assert rows[2].log_n is None


def test_zero_count_in_a_series_is_reported(spark):
    counts = series(spark, [("mallard", 2018, 10.0), ("mallard", 2019, 0.0)])
    prepared = trend.series_prep(counts, counts.limit(0), DESIGN)
    assert {r.status for r in trend.local_level_trend(prepared).collect()} == {"count without a logarithm"}


def test_comparison_table_marks_missing_changes(spark):
    rows = [("mallard", y, n, m) for y, n, m in ((2019, 10.0, 11.0), (2020, None, 12.0), (2021, 15.0, 18.0))]
    df = spark.createDataFrame(rows, "species string, year int, n double, mean double")
    table = {r.label: r for r in report.survey_vs_trend_table(df, 2021, 2).collect()}
    assert table["% change from previous year"].survey_n_mallard == ""
    assert table["% change from previous year"].ssm_n_mallard == "50.0%"
    assert table["% change from 1973--2020"].survey_n_mallard == "50.0%"
    assert table["% change from 1973--2020"].survey_n_wood_duck == "NA%"
    assert table["2-year mean (2019--2021)"].ssm_n_mallard == "14"
    assert table["2020"].survey_n_mallard is None


def test_figure_series_breaks_at_the_missing_year(spark):
    df = spark.createDataFrame([(1, 2019, 1.0), (1, 2021, 2.0)], "region int, year int, x double")
    rows = report.figure_series(df, {"x": "X"}, ("region",)).orderBy("year").collect()
    assert [(r.year, r.value) for r in rows] == [(2019, 1.0), (2020, None), (2021, 2.0)]


def test_observers_by_last_name(spark):
    counts = spark.createDataFrame(
        [(2001, 2, "7", None), (2001, 2, "3", "7"), (2001, 4, "9", None), (2001, 2, "8", None)],
        "year int, grd int, observer1 string, observer2 string",
    )
    names = spark.createDataFrame(
        [("7", "Adams, Jo"), ("3", "Baker, Al"), ("9", "Cole, Di")], "code string, full_name string"
    )
    listed = report.observer_list(counts, names)
    assert listed.count() == 3
    assert report.observer_text(listed).first().observers == "Jo Adams, Al Baker"
