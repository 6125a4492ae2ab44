"""Mixing against plain water-filling."""

import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fieldcount.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def targets(sizes, epochs=3):
    """Exact targets, clamping until none is above."""
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    budget, over = sum(sizes.values()), set()
    while True:
        left = budget - sum(epochs * sizes[s] for s in over)
        weights = sum(weight[s] for s in sizes if s not in over)
        share = {s: Fraction(epochs * sizes[s]) if s in over else Fraction(left * weight[s], weights) for s in sizes}
        more = {s for s in sizes if share[s] > epochs * sizes[s]}
        if not more:
            return share
        over |= more


def check(rows, got):
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes = {}
    for _, s, text in rows:
        sizes[s] = sizes.get(s, 0) + size(text)
    share, source = targets(sizes), {i: s for i, s, _ in rows}
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((i, size(t)) for i, _, t in rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(float(share[s]))
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.taken == r.whole * r["size"] + r.part
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - share[s]) <= 1


def corpus():
    rows = [(i, "hot", "word " * (i % 90)) for i in range(400)]
    rows += [(1000 + i, f"small{i % 7}", "a b  c\td" * (i % 4)) for i in range(60)]
    return rows + [(2000, None, "x y z"), (2001, None, None), (2002, "", "one"), (2003, "none", None), (2004, "long", "w " * 9000)]


def test_targets_are_met_and_runs_agree(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.withColumns({c: F.lit("x") for c in ("key", "size", "draw", "total", "target", "n", "place", "before")})
    got = mixing.mix(extra.repartition(7)).collect()
    check(rows, got)
    assert sorted(map(tuple, mixing.mix(df.repartition(3)).collect())) == sorted(map(tuple, got))
    other = mixing.mix(df, seed="other").collect()
    check(rows, other)
    assert sorted(map(tuple, other)) != sorted(map(tuple, got))


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a", "x y z")] * 50 + [(2, "b", "q"), (3, "c", ""), (3, "c", None)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    taken = sum(r.taken for r in got if r.doc_id == 1)
    # b takes three times its word, the rest goes to a: c has no words
    assert (taken, [r.taken for r in got if r.doc_id == 2]) == (148, [3])
    assert all(r.taken == 0 and r.target == 0 for r in got if r.doc_id == 3)
    none = mixing.mix(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and "taken" in none.columns
    silent = mixing.mix(spark.createDataFrame([(1, "a", None), (None, None, " \n")], SCHEMA)).collect()
    assert sorted(r.taken for r in silent) == [0, 0]


def test_no_python_in_the_plan(spark):
    got = mixing.mix(spark.createDataFrame(corpus(), SCHEMA))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
