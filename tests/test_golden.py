"""Values worked out by hand from the formulas."""

import pytest
from pyspark.sql import functions as F

from fieldcount.design import SurveyDesign
from fieldcount.functions.columns import comma_text, day_text, decimal_text, snake_text
from fieldcount.operators import estimate, habitat, structure

DESIGN = SurveyDesign()


def observations(spark, rows):
    schema = (
        "species int, pairs double, lonedrake double, flockdrake double, groups double, "
        "year int, transect int, grd int"
    )
    df = spark.createDataFrame(rows, schema)
    return structure.classify_species(structure.band_region(df, DESIGN))


@pytest.mark.parametrize(
    "species, given, wanted, indicated, seen, ratio",
    [
        (32, (1, 0, 1, 3), (2, 2, 0, 0), 8, 6, 8),
        (46, (1, 2, 1, 7), (1, 3, 0, 7), 12, 12, 12),
        (72, (0, 1, 0, 4), (0, 1, 0, 4), 6, 5, 6),
        (81, (1, 0, 0, 6), (1, 0, 0, 6), 8, 8, 2),
    ],
)
def test_group_rules_and_indices(spark, species, given, wanted, indicated, seen, ratio):
    df = observations(spark, [(species, *map(float, given), 2000, 1, 4)])
    df = structure.small_groups_to_pairs(structure.merge_single_flocked(df))
    row = structure.bird_indices(df).first()
    assert (row.pairs, row.lonedrake, row.flockdrake, row.groups) == wanted
    assert (row.indicated, row.seen, row.ratio_birds) == (indicated, seen, ratio)


def paired_sums(spark, air, ground, year=2000):
    rows = [
        (1, y, t, float(a), float(g), float(a * a), float(g * g), float(a * g))
        for y, (t, (a, g)) in zip([year, year - 1, year], enumerate(zip(air, ground)))
    ]
    schema = (
        "species int, year int, transect int, air double, ground double, sqx double, "
        "sqy double, xy double"
    )
    return spark.createDataFrame(rows, schema)


def test_ratio_of_a_two_year_window(spark):
    sums = paired_sums(spark, (4, 6, 0), (8, 10, 2))
    row = estimate.ratio_correction(sums, DESIGN).filter("species = 1").first()
    assert (row.n_years, row.min_year, row.max_year) == (2, 1999, 2000)
    assert row.r == pytest.approx(2.0)
    assert row.var_top == pytest.approx(8.0)
    assert row.var_bottom == pytest.approx(98.148148, abs=1e-6)
    assert row.var_r == pytest.approx(0.081509434, abs=1e-9)
    assert row.cvr_r == pytest.approx(0.142749285, abs=1e-9)
    assert row.target_met


def transect_totals(spark, species=1):
    rows = [(species, 2, t, float(v)) for t, v in ((30, 10), (31, 20), (32, 30))]
    return spark.createDataFrame(
        rows, "species int, region int, transect int, total_transect double"
    )


def test_population_of_a_stratum(spark):
    correction = spark.createDataFrame([(1, 2.0, 0.01)], "species int, r double, var_r double")
    out = estimate.population_by_region(transect_totals(spark), correction, DESIGN)
    row = out.filter("species = 1 AND region = 2").first()
    assert row.b == pytest.approx(0.615384615, abs=1e-9)
    assert row.var_b == pytest.approx(0.127985974, abs=1e-9)
    assert row.pop_est == 11607
    assert row.pop_var == pytest.approx(45757208.4860, abs=1e-3)
    assert row.pop_se_1 == pytest.approx(6764.407475, abs=1e-6)
    assert row.pop_se_2 == pytest.approx(1876.109077, abs=1e-6)


def test_population_without_correction(spark):
    rows = [(81, float(v / 2), 0.0, 0.0, 0.0, 2000, t, 4) for t, v in ((30, 10), (31, 20), (32, 30))]
    df = observations(spark, rows)
    row = estimate.population_by_region_uncorrected(df, 2000).filter("region = 2").first()
    assert row.pop_est == 5804
    assert row.pop_var == pytest.approx(11383553.8952, abs=1e-3)


def test_years_and_strata(spark):
    years = spark.createDataFrame([(y,) for y in (73, 99, 0, 22, 2023)], "year int")
    got = [r.year for r in structure.normalize_year(years).collect()]
    assert got == [1973, 1999, 2000, 2022, 2023]
    numbers = spark.createDataFrame([(t,) for t in (29, 30, 42, 43, 60, 61, 71, 72)], "transect int")
    got = [r.region for r in structure.band_region(numbers, DESIGN).collect()]
    assert got == [1, 2, 2, 3, 3, 4, 4, None]


def test_wetland_total_and_density(spark):
    zeros = {t: F.lit(0.0) for t in habitat.TYPES}
    one = spark.createDataFrame([(2000, 1)], "year int, region int").withColumns(
        {**zeros, "typ1": F.lit(29.0)}
    )
    total = habitat.total_wetlands(one, one)
    assert total.first().typ1 == 87
    assert habitat.wetland_density(total).first().typ1 == pytest.approx(0.4)


def test_design_adds_up():
    assert DESIGN.total_transects == 66
    assert DESIGN.total_area == 55670


def test_texts(spark):
    df = spark.sql(
        "SELECT double(2.5) a, double(-0.04) b, double(null) c, double(1234567.5) d, "
        "'Ring-necked  Duck' e, date'2021-05-03' f"
    )
    row = df.select(
        decimal_text(F.col("a"), 0),
        decimal_text(F.col("b")),
        decimal_text(F.col("c")),
        comma_text(F.col("d")),
        snake_text(F.col("e")),
        day_text(F.col("f")),
    ).first()
    assert tuple(row) == ("2", "0.0", None, "1,234,568", "ring_necked_duck", "May 3")
