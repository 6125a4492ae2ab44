"""Corridors, polygons and the projection against brute force and known places."""

import math
import random

import numpy as np
import pytest

from fieldcount.operators import coverage, grid


def cells(spark, points):
    return spark.createDataFrame(
        [(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "cell_id int, x double, y double"
    )


def lines(spark, rows):
    return spark.createDataFrame(
        [(k, i, *map(float, r)) for k, i, *r in rows],
        "transect int, seq int, x1 double, y1 double, x2 double, y2 double",
    )


def inside(point, pieces, d):
    """By projection parameter and hypot, with every end shared by two pieces rounded."""
    ends = [p[:2] for p in pieces] + [p[2:] for p in pieces]
    for x1, y1, x2, y2 in pieces:
        length2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
        if length2 > 0:
            t = ((point[0] - x1) * (x2 - x1) + (point[1] - y1) * (y2 - y1)) / length2
            foot = (x1 + t * (x2 - x1), y1 + t * (y2 - y1))
            if 0 <= t <= 1 and math.dist(point, foot) <= d:
                return True
        for end in ((x1, y1), (x2, y2)):
            if ends.count(end) > 1 and math.dist(point, end) <= d:
                return True
    return False


@pytest.mark.parametrize("bucket", [None, 3.0, 50.0])
def test_corridor_equals_brute_force(spark, bucket):
    rng = random.Random(1)
    points = [(rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(600)]
    pieces = {
        1: [(-15, -10, 5, 12), (5, 12, 9, 12), (9, 12, 9, -14)],  # slanting, level, upright
        2: [(-18, 18, 17, -17)],
        3: [(0, 0, 0, 0), (0, 0, 3, 1)],
    }
    rows = [(k, i, *p) for k, ps in pieces.items() for i, p in enumerate(ps)]
    found = grid.within_corridor(cells(spark, points), lines(spark, rows), 1.7, bucket).collect()
    wanted = {
        (k, i)
        for k, ps in pieces.items()
        for i, p in enumerate(points)
        if inside(p, [tuple(map(float, q)) for q in ps], 1.7)
    }
    assert {(r.transect, r.cell_id) for r in found} == wanted
    assert len(found) == len(wanted) > 100


def test_free_ends_are_flat(spark):
    df = cells(spark, [(-0.5, 0), (0.5, 0.9), (10.5, 0), (5, 1.01)])
    found = grid.within_corridor(df, lines(spark, [(1, 1, 0, 0, 10, 0)]), 1.0)
    assert [r.cell_id for r in found.collect()] == [1]


def test_a_piece_flown_back_leaves_the_end_flat(spark):
    df = cells(spark, [(-0.5, 0), (0.5, 0.9), (10.5, 0)])
    there_and_back = [(1, 1, 0, 0, 10, 0), (1, 2, 10, 0, 0, 0), (1, 3, 0, 0, 10, 0)]
    found = grid.within_corridor(df, lines(spark, there_and_back), 1.0)
    assert [r.cell_id for r in found.collect()] == [1]


def test_bucket_must_hold_the_corridor(spark):
    with pytest.raises(ValueError):
        grid.within_corridor(cells(spark, [(0, 0)]), lines(spark, [(1, 1, 0, 0, 1, 0)]), 2.0, 1.0)


@pytest.mark.parametrize("n", [1, 4, 9])
def test_coverage_counts_points(spark, n):
    """n = 9 needs more bits than one number holds."""
    pieces = [(0.0, 0.0, 6.0, 2.0), (6.0, 2.0, 8.0, 7.0)]
    points = [(x, y) for x in range(-1, 10) for y in range(-1, 9)]
    steps = [(i + 0.5) / n - 0.5 for i in range(n)]
    got = grid.corridor_coverage(
        cells(spark, points), lines(spark, [(1, i, *p) for i, p in enumerate(pieces)]), 0.77, 1.0, n
    ).collect()
    wanted = {}
    for i, (x, y) in enumerate(points):
        hits = sum(inside((x + dx, y + dy), pieces, 0.77) for dx in steps for dy in steps)
        if hits:
            wanted[i] = hits
    assert {r.cell_id: r.points for r in got} == wanted
    assert all(r.weight == r.points / n**2 for r in got)


def covered(points, pieces, d, size, n):
    """Shares of cells by very many points."""
    steps = [((i + 0.5) / n - 0.5) * size for i in range(n)]
    return {
        i: sum(inside((x + dx, y + dy), pieces, d) for dx in steps for dy in steps) / n**2
        for i, (x, y) in enumerate(points)
    }


@pytest.mark.parametrize("d", [0.1, 0.77])
def test_covered_area_of_a_line_that_turns_and_crosses_itself(spark, d):
    pieces = [(0.0, 0.0, 2.0, 1.0), (2.0, 1.0, 2.0, -0.5), (2.0, -0.5, 0.5, 1.5), (0.5, 1.5, 0.5, 1.5)]
    points = [(x, y) for x in range(-1, 4) for y in range(-2, 4)]
    got = coverage.corridor_coverage_area(
        cells(spark, points), lines(spark, [(1, i, *p) for i, p in enumerate(pieces)]), d, 1.0
    ).collect()
    found = {r.cell_id: r.weight for r in got}
    wanted = covered(points, pieces, d, 1.0, 60)
    assert all(found.get(i, 0.0) == pytest.approx(w, abs=0.004) for i, w in wanted.items())
    assert all(wanted[i] or w < 0.004 for i, w in found.items())


def test_areas_in_closed_form(spark):
    """A strip far thinner than its cell; strips that share an edge; a joint's wedge; nothing twice."""
    rows = [
        (1, 1, -10, 0.1, 10, 0.1),
        (2, 1, -10, 0, 10, 0), (2, 2, -10, 0, 10, 0), (2, 3, 10, 0, -10, 0),
        (3, 1, -10, 0, 3, 0), (3, 2, -2, 0, 10, 0),  # on each other in part
        (4, 1, -10, 0, 0, 0), (4, 2, 0, 0, 0, 10),  # a right angle
        (5, 1, -1, 0, 1, 0), (5, 2, -1, 0.02, 1, 0.02),  # side by side, ends in line
        (6, 1, 0, 0, 0, 0),  # no length: both ends meet
    ]
    got = coverage.corridor_coverage_area(cells(spark, [(0, 0)]), lines(spark, rows), 0.025, 2.0).collect()
    d = 0.025
    wanted = {
        1: 2 * 2 * d,
        2: 2 * 2 * d,
        3: 2 * 2 * d,
        4: 2 * 2 * d - d * d + math.pi * d * d / 4,
        5: 2 * (2 * d + 0.02),
        6: math.pi * d * d,
    }
    assert {r.transect: r.area for r in got} == pytest.approx(wanted, rel=1e-9)


def test_no_cells_and_no_lines(spark):
    none = coverage.corridor_coverage_area(cells(spark, [(0, 0)]).limit(0), lines(spark, [(1, 1, 0, 0, 1, 0)]), 0.1, 1.0)
    assert none.count() == 0
    assert none.columns == ["transect", "cell_id", "area", "weight"]


def test_weighted_zone_mean(spark):
    values = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 40.0), (3, None)], "cell_id int, value double")
    zones = spark.createDataFrame([(7, 1, 1.0), (7, 2, 0.5), (8, 3, 1.0)], "transect int, cell_id int, weight double")
    got = grid.zonal_mean(values, zones, weight="weight").collect()
    assert [(r.transect, r.value) for r in got] == [(7, pytest.approx((10 + 20 + 20) / 2.5))]


@pytest.mark.parametrize("strip", [0.3, 1.0, 100.0])
def test_polygon_with_hole(spark, strip):
    rings = {1: [(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)], 2: [(2, 2), (4, 2), (4, 4), (2, 4)]}
    ring = spark.createDataFrame(
        [(k, i, float(x), float(y)) for k, ps in rings.items() for i, (x, y) in enumerate(ps)],
        "ring int, seq int, x double, y double",
    )
    rng = random.Random(2)
    points = [(rng.uniform(-2, 12), rng.uniform(-2, 12)) for _ in range(500)]

    def within(p):
        odd = False
        for ps in rings.values():
            for (ax, ay), (bx, by) in zip(ps, ps[1:] + ps[:1]):
                if (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) * (bx - ax) / (by - ay):
                    odd = not odd
        return odd

    got = grid.mask_polygon(cells(spark, points), ring, strip).collect()
    assert {r.cell_id for r in got} == {i for i, p in enumerate(points) if within(p)}


def test_projection_of_a_known_place(spark):
    """A tower whose UTM zone 17 coordinates are published to the metre."""
    utm17 = grid.TransverseMercator(
        inverse_flattening=298.257223563, lon0=-81.0, false_easting=500000.0, false_northing=0.0
    )
    df = spark.createDataFrame([(-79.387139, 43.642567)], "lon double, lat double")
    row = grid.project_points(df, utm17).first()
    assert (row.x, row.y) == (pytest.approx(630084, abs=1), pytest.approx(4833438, abs=1))


def test_projection_origin_and_symmetry(spark):
    df = spark.createDataFrame([(-90.0, 0.0), (-88.0, 45.0), (-92.0, 45.0)], "lon double, lat double")
    origin, east, west = grid.project_points(df).collect()
    assert (origin.x, origin.y) == (pytest.approx(520000), pytest.approx(-4480000))
    assert east.x - 520000 == pytest.approx(520000 - west.x)
    assert east.y == pytest.approx(west.y)


def test_seasons(spark):
    df = spark.createDataFrame([(2020, m) for m in (2, 3, 5, 6, 9, 10, 12)], "year int, month int")
    got = [(r.season, r.season_year) for r in grid.season_of(df).collect()]
    assert got == [
        ("winter", 2020),
        ("spring", 2020),
        ("spring", 2020),
        (None, None),
        (None, None),
        ("winter", 2021),
        ("winter", 2021),
    ]


@pytest.mark.parametrize("seq", [(10, 20, 30, 40), (0, 1, 3, 4), (0, 1, 1, 3), (0, 1, 2, None)])
def test_a_ring_with_gaps_is_refused(spark, seq):
    corners = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    ring = spark.createDataFrame([(1, n, *p) for n, p in zip(seq, corners)], "ring int, seq int, x double, y double")
    with pytest.raises(Exception, match="count up by one"):
        grid.mask_polygon(cells(spark, [(5.0, 5.0)]), ring, 1.0).collect()


def test_cells_with_the_same_shapes_are_measured_once(monkeypatch):
    rng = np.random.default_rng(3)
    kinds, of = rng.uniform(-1, 1, (5, 6)), rng.integers(0, 5, 400)
    strips, discs = kinds[of][:, None, :4], kinds[of][:, None, 4:]
    want, sizes, measure = coverage.cell_areas(strips, discs, 0.1, 1.0), [], coverage.cell_areas
    monkeypatch.setattr(coverage, "cell_areas", lambda s, *rest: sizes.append(len(s)) or measure(s, *rest))
    assert (coverage._areas_of_distinct(strips, discs, 0.1, 1.0) == want).all()
    assert sizes == [5]


def test_zones_are_the_union_of_their_lines(spark):
    spots = cells(spark, [(x, y) for x in range(12) for y in range(6)])
    rows = [(1, 0, 1, 1, 4, 1), (1, 1, 4, 1, 4, 4), (2, 0, 1, 1, 4, 1), (3, 0, 6, 2, 10, 2), (4, 0, 4, 1, 4, 4)]
    pieces = lines(spark, rows).selectExpr("transect AS line", "transect % 2 AS zone", "x1", "y1", "x2", "y2")
    keys = ["line", "zone"]
    each = grid.within_corridor(spots, pieces, 1.2, keys=keys).collect()
    found = grid.within_corridor(spots, pieces, 1.2, keys=keys, zones=["zone"]).collect()
    assert sorted((r.zone, r.cell_id) for r in found) == sorted({(r.zone, r.cell_id) for r in each})
