"""Laws the operators keep on the given tables."""

import math

import pytest
from pyspark.sql import functions as F

from checks import queries as q
from fieldcount.design import SurveyDesign
from fieldcount.functions.columns import seen_birds
from fieldcount.operators import estimate, habitat, structure
from fieldcount.sources import store

DESIGN = SurveyDesign()


def test_group_rules_keep_seen_birds(spark, sf):
    """Merging and pairing move birds between columns but never change their number."""
    before = q.classified(spark, sf).withColumn("before", seen_birds())
    merged = structure.merge_single_flocked(before).withColumn("merged", seen_birds())
    after = structure.small_groups_to_pairs(merged).withColumn("after", seen_birds())
    changed = after.filter((F.col("before") != F.col("merged")) | (F.col("merged") != F.col("after")))
    assert after.count() > 1000
    assert changed.count() == 0


def loop_correction(rows, years, species, target, seg=27):
    """The ratio by growing the window year by year."""
    years = sorted(years, reverse=True)
    for i in range(2, len(years) + 1):
        kept = [r for r in rows if r.species == species and r.year in years[:i]]
        sx, sy = sum(r.air for r in kept), sum(r.ground for r in kept)
        if sx == 0:
            continue
        r, n = sy / sx, seg * i
        top = (
            sum(k.sqy for k in kept)
            + r * r * sum(k.sqx for k in kept)
            - 2 * r * sum(k.xy for k in kept)
        )
        var = top / ((sx / n) ** 2 * n * (n - 1))
        cv = math.sqrt(var) / r
        if cv < target:
            break
    return i, r, var, cv


@pytest.mark.parametrize("target", [0.2, 0.08, 0.05])
def test_window_equals_loop(spark, sf, target):
    sums = q.sums(spark, sf)
    rows = sums.collect()
    years = {r.year for r in rows}
    for got in estimate.ratio_correction(sums, DESIGN, target).collect():
        i, r, var, cv = loop_correction(rows, years, got.species, target)
        assert got.n_years == i
        assert got.r == pytest.approx(r, rel=1e-12)
        assert got.var_r == pytest.approx(var, rel=1e-9)
        assert got.target_met == (cv < target)


def test_estimates_do_not_depend_on_partitions(spark, sf):
    df = q.structured(spark, sf)
    correction = q.correction(spark, sf).select("species", "r", "var_r").collect()
    fixed = spark.createDataFrame(correction)

    def estimates(frame):
        totals = estimate.transect_totals(frame, q.YEAR, DESIGN)
        out = estimate.population_by_region(totals, fixed, DESIGN)
        return sorted(map(tuple, out.collect()))

    assert estimates(df) == estimates(df.repartition(13).sortWithinPartitions("groups"))


def test_uncorrected_is_corrected_with_ratio_one(spark, sf):
    swans = q.structured(spark, sf).filter("species = 81")
    plain = estimate.population_by_region_uncorrected(swans, q.YEAR, design=DESIGN)
    totals = estimate.transect_totals(swans, q.YEAR, DESIGN).withColumn("species", F.lit(1))
    one = spark.createDataFrame([(1, 1.0, 0.0)], "species int, r double, var_r double")
    same = estimate.population_by_region(totals, one, DESIGN).filter("species = 1")
    columns = [c for c in plain.columns if c != "species"]
    assert sorted(map(tuple, plain.select(columns).collect())) == sorted(
        map(tuple, same.select(columns).collect())
    )


def test_density_variance_is_not_negative(spark, sf):
    assert q.by_region(spark, sf).filter("var_b < 0").count() == 0


def test_appending_twice_adds_nothing(spark, sf):
    rows = q.view(spark, sf, "year_batches")
    once = store.append_year(rows.filter("year <= 1998"), rows)
    twice = store.append_year(once, rows)
    assert once.count() == twice.count() == rows.count()


def test_wetland_totals_add_up(spark, sf):
    unoccupied, occupied = q._unoccupied(spark, sf), q._occupied(spark, sf)
    total = habitat.total_wetlands(unoccupied, occupied)

    def birds(df):
        return df.agg(*[F.sum(t) for t in habitat.TYPES]).first()

    for u, o, t in zip(birds(unoccupied), birds(occupied), birds(total)):
        assert t == 2 * u + o


def test_composition_percentages_cover_the_whole(spark, sf):
    from fieldcount.operators.summaries import composition_counts

    counts = composition_counts(q.structured(spark, sf), design=DESIGN)
    by_level = counts.groupBy("year", "level").agg(F.sum("birds").alias("birds"))
    totals = {(r.year, r.level): r.birds for r in by_level.collect()}
    for (year, level), birds in totals.items():
        assert birds == totals[year, "state" if level == "region" else "region"]


def test_numbering_spreads_a_hot_transect(spark):
    """Nearly all rows on one transect, most of them copies of one another."""
    rows = spark.range(5000).select(
        F.when(F.col("id") < 4500, 7).otherwise((F.col("id") % 5).cast("int")).alias("transect"),
        F.when(F.col("id") < 3000, 1).otherwise((F.col("id") % 97).cast("int")).alias("day"),
    )
    numbered = structure.number_within(rows, "transect", ["day"])
    runs = numbered.groupBy("transect").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("basin_no").alias("distinct"),
        F.min("basin_no").alias("first"),
        F.max("basin_no").alias("last"),
    )
    for r in runs.collect():
        assert (r.n, r.first, r.last) == (r.distinct, 1, r.n)
    ordered = numbered.filter("transect = 7").orderBy("basin_no").select("day").collect()
    days = [r.day for r in ordered]
    assert days == sorted(days)
