"""The manifest against plain trees."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fieldcount.llm import manifest, ordered

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([h(*x[i : i + 16]) for i in range(0, len(x), 16)])
    return levels


def path(levels, at):
    out = []
    for x in levels[:-1]:
        run = at - at % 16
        out.append((x[run:at], x[at + 1 : run + 16]))
        at //= 16
    return out


def low(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = own, tree([leaf(r) for r in own])
    top = tree([trees[s][1][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        own, levels = trees[s]
        for i, row in enumerate(own):
            sides = path(levels, i) + path(top, k)
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            x = leaf((*row[:4], low(row[4]))) if bad else leaf(row)
            for before, after in sides:
                x = h(*before, x, *after)
            proof = h(*[d for before, after in sides for d in before + after])
            out.append((row[0], leaf(row), levels[-1][0], top[-1][0], proof, x, x == top[-1][0]))
    return sorted(out, key=str)


def built(df):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = manifest.manifest(df, offered={"text": lower}, where=fifth)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_trees_of_many_sizes(spark):
    """Sources of 1, 16, 17, 256, 257 and 600 rows, null and empty ones, odd values and repeated rows."""
    sizes = {"one": 1, "full": 16, "more": 17, "square": 256, "over": 257, "hot": 600, None: 3, "": 2, "é": 5}
    rows = []
    for s, n in sizes.items():
        rows += [(len(rows) * 7 % 1999, s, "en", k, f"Text {k} of {s}") for k in range(n)]
    rows += [(None, "one", None, None, None), (None, "one", None, None, None), (3, "odd", "", 0, ""), (3, "odd", "", 0, "É x" * 9)]
    rows += [(5, "odd", "de", -4, "A" * 200_000)] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    extra = df.withColumns({c: F.lit(1) for c in ("key", "pos", "n", "digest", "above", "child", "place", "__row")})
    assert built(extra) == plain(rows)


def test_a_single_row_and_a_single_source(spark):
    for rows in ([(1, "a", "en", 3, "Abc")], [(i, "a", "en", 3, f"T{i}") for i in range(40)], [(i, f"s{i}", "en", 3, "t") for i in range(20)]):
        assert built(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty(empty):
    assert built(empty.select(*COLUMNS)) == []


def test_untampered_rows_verify(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(50)]
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.verified for r in got)
    assert len({r.root for r in got}) == 1
    changed = manifest.manifest(spark.createDataFrame([(0, "s0", "en", 0, "Text!"), *rows[1:]], SCHEMA)).first()
    assert changed.root != got[0].root


@pytest.mark.parametrize("copies", [1, 500])
def test_places_and_sums_in_order(spark, copies):
    rows = [("a", i % 40 if i % 9 else None, i % 5) for i in range(300)] + [("b", 1, 2)] * copies
    df = spark.createDataFrame(rows, "g string, o int, v long").repartition(6)
    got = ordered.in_order(df, "g", ["o", "v"], "v").collect()
    for g in ("a", "b"):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        assert [(r.o is not None, r.o or 0, r.v) for r in own] == sorted((r[1] is not None, r[1] or 0, r[2]) for r in rows if r[0] == g)
        assert all(r.n == len(own) and r.total == sum(x.v for x in own) for r in own)
        assert all(r.before == sum(x.v for x in own[: r.place]) for r in own)
