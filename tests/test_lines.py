"""Unions of flown pieces and their parts."""

import math

import pytest

from fieldcount.operators import lines


def pieces(spark, rows):
    return spark.createDataFrame(
        [(k, *map(float, r)) for k, *r in rows], "transect string, x1 double, y1 double, x2 double, y2 double"
    )


def test_pieces_flown_twice_back_and_in_part_are_one(spark):
    rows = [
        ("a", 0, 0, 4, 3), ("a", 4, 3, 0, 0), ("a", 0, 0, 4, 3), ("a", 2, 1.5, 8, 6),  # one stretch of 10
        ("b", 0, 0, 1, 0), ("b", 1, 0, 2, 0), ("b", 3, 0, 4, 0),  # goes on, then a gap
        ("c", 0, 0, 0, 0), ("c", 0, 1, 0, 3), ("c", 0, 2, 0, 2.5),  # no length; upright, one in the other
        (None, 0, 0, 1, 1), (None, 0, 1, 1, 2),  # side by side
    ]
    got = lines.union_lines(pieces(spark, rows)).collect()
    found = sorted((r.transect or "", r.x1, r.y1, r.x2, r.y2, round(r.length, 9)) for r in got)
    assert found == [
        ("", 0, 0, 1, 1, round(math.sqrt(2), 9)),
        ("", 0, 1, 1, 2, round(math.sqrt(2), 9)),
        ("a", 0, 0, 8, 6, 10),
        ("b", 0, 0, 2, 0, 2),
        ("b", 3, 0, 4, 0, 1),
        ("c", 0, 1, 0, 3, 2),
    ]


def test_parts_hang_together_by_ends(spark):
    chain = [("long", i, i % 2, i + 1, (i + 1) % 2) for i in range(60)]
    rows = chain + [("two", 0, 0, 1, 1), ("two", 1, 1, 2, 0), ("two", 5, 5, 6, 6), ("two", 6, 6, 5, 7), ("two", 9, 9, 9, 10)]
    rows += [(None, 0, 0, 1, 1)]
    got = lines.line_parts(pieces(spark, rows).transform(lines.union_lines)).collect()
    assert {r.part for r in got if r.transect == "long"} == {1}
    assert sum(r.transect == "long" for r in got) == 60
    assert sorted((r.x1, r.part) for r in got if r.transect == "two") == [(0, 1), (1, 1), (5, 2), (5, 2), (9, 3)]
    assert [r.part for r in got if r.transect is None] == [1]


def test_length_and_centroid_of_a_union(spark):
    rows = [("a", 0, 0, 10, 0), ("a", 10, 0, 0, 0), ("a", 0, 0, 4, 0), ("a", 10, 0, 10, 10)]
    r = lines.dissolve_union(lines.line_parts(lines.union_lines(pieces(spark, rows)))).first()
    assert (r.n_stretches, r.n_parts, r.length) == (2, 1, 20)
    assert (r.x, r.y) == (pytest.approx(7.5), pytest.approx(2.5))


def test_no_pieces(spark):
    none = lines.line_parts(lines.union_lines(pieces(spark, [("a", 0, 0, 0, 0)])))
    assert none.collect() == [] and "part" in none.columns


def test_short_lines_find_their_parts_without_rounds(spark, monkeypatch):
    rows = [(f"l{i}", j, (i + j) % 2, j + 1, (i + j + 1) % 2) for i in range(20) for j in (0, 1, 2, 5, 6)]
    rows += [(None, 3, 3, 4, 4), (None, 3, 3, 2, 4), (None, 0, 9, 1, 9), ("ring", 0, 0, 1, 0), ("ring", 1, 0, 1, 1), ("ring", 1, 1, 0, 0)]
    stretches = lines.union_lines(pieces(spark, rows))
    columns = ["transect", "x1", "y1", "x2", "y2", "length", "part"]
    every = {short: sorted(map(str, lines.line_parts(stretches, short=short).select(*columns).collect())) for short in (0, 3, 256)}
    assert every[0] == every[3] == every[256]
    assert len(every[0]) == stretches.count()
    monkeypatch.setattr(lines, "_stored", None)
    assert lines.line_parts(stretches).agg({"part": "max"}).first()[0] == 2
