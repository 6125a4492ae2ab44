"""Equal-area conic and datum shifts at known places."""

import math

import pytest

from fieldcount.operators import projection


def places(spark, rows):
    return spark.createDataFrame([(float(a), float(b)) for a, b in rows], "lon double, lat double")


def test_a_worked_example(spark):
    """Clarke 1866, parallels 29.5 and 45.5, origin 23 N 96 W: 35 N 75 W is at 1885472.7, 1535925.0."""
    conic = projection.AlbersConic(projection.Ellipsoid(6378206.4, 294.978698214))
    r = projection.project_albers(places(spark, [(-75, 35)]), conic).first()
    assert (r.x, r.y) == (pytest.approx(1885472.7, abs=0.1), pytest.approx(1535925.0, abs=0.1))


@pytest.mark.parametrize("lat1, lat2, lat0", [(29.5, 45.5, 23.0), (45.0, 45.0, 40.0), (-20.0, -50.0, -30.0)])
def test_there_and_back(spark, lat1, lat2, lat0):
    conic = projection.AlbersConic(lat1=lat1, lat2=lat2, lat0=lat0, lon0=-90, false_easting=5e5, false_northing=-1e6)
    sign = math.copysign(1, lat1)
    points = [(lon, sign * lat) for lon in (-120, -90.5, -90, -60) for lat in (5, 30, 44.4, 60, 80)]
    got = projection.unproject_albers(projection.project_albers(places(spark, points), conic).drop("lon", "lat"), conic)
    assert [(r.lon, r.lat) for r in got.collect()] == [(pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-7)) for a, b in points]


def test_areas_are_kept(spark):
    """A small cell has its area on the ellipsoid wherever it lies."""
    on = projection.Ellipsoid()
    for lon, lat in ((-96, 30), (-80, 45), (-110, 60)):
        d = 0.01
        corners = [(lon, lat), (lon + d, lat), (lon + d, lat + d), (lon, lat + d)]
        xy = [(r.x, r.y) for r in projection.project_albers(places(spark, corners)).collect()]
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(xy, xy[1:] + xy[:1]))) / 2
        conic = projection.AlbersConic()
        wanted = on.a**2 / 2 * (conic.zone(lat + d) - conic.zone(lat)) * math.radians(d)
        assert area == pytest.approx(wanted, rel=1e-5)


def test_a_datum_shift_moves_as_far_as_its_parameters(spark):
    same = projection.DatumShift(projection.Ellipsoid())
    r = projection.shift_datum(places(spark, [(-90, 44)]), same).first()
    assert (r.lon, r.lat) == (pytest.approx(-90, abs=1e-11), pytest.approx(44, abs=1e-10))
    east = projection.DatumShift(projection.Ellipsoid(), dx=100.0)  # at 90 W, x points east
    r = projection.shift_datum(places(spark, [(-90, 0)]), east).first()
    assert r.lon == pytest.approx(-90 + math.degrees(100 / 6378137), abs=1e-9)
    turned = projection.DatumShift(projection.Ellipsoid(), rz=3.6)
    r = projection.shift_datum(places(spark, [(-90, 44)]), turned).first()
    assert (r.lon, r.lat) == (pytest.approx(-90 + 0.001, abs=1e-9), pytest.approx(44, abs=1e-8))
