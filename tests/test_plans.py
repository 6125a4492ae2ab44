"""What the plans must look like to hold up on much larger tables."""

import re

import pytest

from checks import queries as q
from fieldcount.operators import grid, summaries
from fieldcount.sources import store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON_STAGES = {
    "local_level_trend",
    "local_level_trend_species",
    "trend_parameters",
    "corridor_coverage_area",
    "zonal_mean_area",
}


@pytest.fixture(scope="module")
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_plans_without_broadcasts(no_broadcast, sf, name):
    """No query depends on a side being small enough to broadcast: all joins have a shuffled
    form, none pairs everything with everything, and Python runs in the trend and the measuring of
    areas only."""
    text = plan(q.QUERIES[name](no_broadcast, sf))
    for bad in ("CartesianProduct", "Broadcast", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text
    assert bool(re.search("MapIn(Pandas|Arrow)", text)) == (name in PYTHON_STAGES)


ROW_WISE = [
    "normalize_year",
    "default_platform",
    "field_sighting_code",
    "slots_to_long",
    "band_region",
    "classify_species",
    "merge_single_flocked",
    "small_groups_to_pairs",
    "cap_large_groups",
    "bird_indices",
]


@pytest.mark.parametrize("name", ROW_WISE)
def test_structuring_is_one_stage(spark, sf, name):
    text = plan(q.QUERIES[name](spark, sf))
    assert "Exchange" not in text
    assert text.count("FileScan") == 1


ONE_SHUFFLE = [
    "groups_by_region",
    "birds_by_region",
    "group_and_bird_union",
    "total_vs_ungrouped",
    "swans_small_groups",
    "air_vs_ground_series",
    "unoccupied_wetlands",
    "occupied_wetlands",
    "paired_transect_sums",
]


@pytest.mark.parametrize("name", ONE_SHUFFLE)
def test_summaries_shuffle_once_after_a_partial_aggregate(spark, sf, name):
    text = plan(q.QUERIES[name](spark, sf))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_" in text
    assert text.count("FileScan") == 1


def test_the_ratio_reads_the_table_once(spark, sf):
    assert plan(q.correction(spark, sf)).count("FileScan") == 1


def test_scan_reads_only_the_columns_it_needs(spark, sf):
    text = plan(q.QUERIES["last_n_years_total"](spark, sf))
    columns = re.search(r"FileScan parquet \[([^\]]*)\]", text).group(1)
    assert {c.split("#")[0] for c in columns.split(",")} == {
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        "l_quantity",
        "l_shipdate",
    }


def test_stored_observations_push_filters_to_the_scan(spark, sf, tmp_path):
    path = f"{tmp_path}/structured"
    store.write_partitioned(q.structured(spark, sf), path, "year")
    df = spark.read.parquet(path)
    text = plan(summaries.grouped_sightings(df, 2001))
    assert re.search(r"PartitionFilters: \[[^\]]*year[^\]]*2001", text)
    assert "GreaterThanOrEqual(groups,5.0)" in text
    assert "In(grd, [1,4])" in text


def test_cells_beside_lines_are_dealt_by_pieces(spark, sf):
    """Cells outnumber pieces: pieces are dealt by line and bucket into many tasks, cells of a line nowhere else."""
    df = q.QUERIES["corridor_coverage"](spark, sf)
    df.collect()
    text = plan(df).split("Initial Plan")[0]
    dealt = [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"hashpartitioning\(([^)]*)\)", text)]
    assert not [keys for keys in dealt if "line_id" in keys and "cell_id" in keys]
    parts = grid.DEALT * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f"line_id, bx, by, {parts}" in dealt
