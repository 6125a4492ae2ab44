"""The whole annual analysis over stored tables."""

import pytest
from pyspark.sql import functions as F

from checks import queries as q
from checks.adapters import SLOTS, view
from fieldcount.design import SurveyDesign
from fieldcount.plans import annual
from fieldcount.sources import store

DESIGN = SurveyDesign(
    series_start=(("canada goose", 1973), ("trumpeter swan", 1973)), missing_years=(1998,)
)


@pytest.fixture(scope="module")
def analysed(spark, sf, tmp_path_factory):
    root, out = (str(tmp_path_factory.mktemp(n)) for n in ("tables", "output"))
    counts, wetlands = view(spark, sf, "raw_counts"), view(spark, sf, "raw_wetlands")
    for last in (2000, 2001, 2001):
        kept = F.col("year") <= last
        annual.import_year(spark, root, counts.filter(kept), wetlands.filter(kept), f"to-{last}", DESIGN)
    view(spark, sf, "species_codes").write.parquet(f"{root}/{annual.SPECIES_CODES}")
    view(spark, sf, "observers").write.parquet(f"{root}/{annual.OBSERVERS}")
    early = F.col("year") < 2001
    for name, table in (("pop_estimates", annual.POP_ESTIMATES), ("swan_estimates", annual.SWAN_ESTIMATES)):
        store.append_to_table(view(spark, sf, name).filter(early), f"{root}/{table}", "early")
    results = annual.analyze_survey(spark, root, out, 2001, DESIGN, SLOTS, q.SINCE)
    return root, out, results


def rows(df, columns):
    return sorted(map(str, df.select(columns).collect()))


def test_import_holds_every_row_once(spark, sf, analysed):
    root, _, _ = analysed
    stored = spark.read.parquet(f"{root}/{annual.RAW_COUNTS}")
    assert stored.count() == view(spark, sf, "raw_counts").count()


@pytest.mark.parametrize(
    "stage, name",
    [
        ("groups_and_birds", "group_and_bird_union"),
        ("grouped_share", "grouped_share"),
        ("seen_by_platform", "seen_by_platform"),
        ("coots", "last_n_years_total"),
        ("cranes", "total_vs_ungrouped"),
        ("whooping_crane_total", "species_total"),
        ("swans_by_transect", "species_by_region_transect"),
        ("air_vs_ground", "air_vs_ground_series"),
        ("observers", "observer_list"),
        ("paired_sums", "paired_transect_sums"),
        ("wetland_summaries", "wetland_classes"),
        ("ratio_correction", "ratio_correction"),
        ("population_by_region", "population_by_region"),
        ("population_statewide", "population_statewide"),
        ("swan_population", "population_by_region_uncorrected"),
    ],
)
def test_stage_equals_its_query(spark, sf, analysed, stage, name):
    _, _, results = analysed
    wanted = q.QUERIES[name](spark, sf)
    digits = q.DIGITS[name]
    got = results[stage].withColumns({c: F.round(c, n) for c, n in digits.items()})
    assert rows(got, wanted.columns) == rows(wanted, wanted.columns)


def test_whooping_crane_rows(spark, sf, analysed):
    _, _, results = analysed
    wanted = q.QUERIES["species_since"](spark, sf)
    rows_kept = results["whooping_crane_rows"]
    assert rows_kept.count() == wanted.count()
    assert {r.year for r in rows_kept.select("year").distinct().collect()} == {r.year for r in wanted.select("year").distinct().collect()}


def test_estimates_join_the_stored_series(spark, analysed):
    root, _, results = analysed
    stored = spark.read.parquet(f"{root}/{annual.POP_ESTIMATES}")
    new = stored.filter("year = 2001")
    assert new.count() == 6
    assert stored.select("year").distinct().count() == 6
    trend = results["trend"].filter("species = 'mallard'").orderBy("year").collect()
    assert [r.year for r in trend] == list(range(1995, 2002))
    assert [r.n is None for r in trend] == [y == 1998 for y in range(1995, 2002)]
    assert all(r.lcl < r["mean"] < r.ucl for r in trend)


def test_report_tables(spark, analysed):
    _, _, results = analysed
    tables = annual.report_tables(results, 2001, DESIGN)
    counts = {name: df.count() for name, df in tables.items()}
    assert counts["estimates"] == 25
    assert counts["survey_years"] == 7
    assert counts["observers"] == q.QUERIES["observer_text"](spark, "/root/testdata/sf0.001").count()
    assert counts["top_region"] == 5
    assert counts["wetland_narrative"] == 4
    assert counts["trend_narrative"] == 7
    assert counts["survey_vs_trend"] == 7 + 4
    assert counts["wetland_summary"] == 4 * (7 + 4)
    assert counts["wetland_figure"] == 4 * 2 * (7 + 1)
    assert counts["crane_figure"] == 2 * (7 + 1)


def test_running_again_changes_nothing(spark, analysed):
    root, out, results = analysed
    before = rows(results["population_by_region"], ["species", "region", "pop_est"])
    again = annual.analyze_survey(spark, root, out, 2001, DESIGN, SLOTS, q.SINCE)
    assert rows(again["population_by_region"], ["species", "region", "pop_est"]) == before
    assert spark.read.parquet(f"{root}/{annual.POP_ESTIMATES}").filter("year = 2001").count() == 6
