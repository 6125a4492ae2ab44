import random

import brute
import numpy as np
import pytest

from fieldcount.llm import jaccard
from fieldcount.llm.cells import BITS


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_components_equal_brute_force(docs, documents, k, percent):
    assert rows(jaccard.near_duplicates(docs, k, percent)) == brute.components(documents, k, percent)


def test_chains_of_near_copies_in_one_group(spark):
    """Edits add up: ends of a chain are far apart, and some copies link with few others."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(260)]
    made, words = [], list(base)
    for i in range(60):
        if i % 20 == 0:
            words = rng.sample(base, len(base)) if i else list(base)
        words = list(words)
        for _ in range(rng.choice([1, 2, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        made.append((i * 7 % 60, " ".join(words)))
    got = rows(jaccard.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 4, 85))
    assert got == brute.components(made, 4, 85)
    assert len({c for _, _, c in got}) > 1


def test_empty_table_and_rows_without_id(spark, empty):
    assert jaccard.near_duplicates(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (2, "a b c d e"), (5, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(odd).select("doc_id", "component_id").collect()), key=str) == [
        (2, 2),
        (4, 2),
        (5, 5),
        (None, None),
    ]


def links(df):
    return sorted(map(tuple, df.select("doc_id", "n_links").collect()))


def test_links_equal_brute_force(docs, documents):
    assert links(jaccard.near_duplicates(docs, 4, 85)) == brute.links(documents, 4, 85)


@pytest.mark.parametrize("block", [4, 256])
def test_links_within_a_component_are_all_counted(spark, monkeypatch, block):
    """Also over blocks of all sizes, and where an id has several texts."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(5)
    made = [(i, " ".join(f"w{j}" for j in range(60)) + f" x{i}") for i in range(4)]
    for i in range(40):
        words = [f"v{j}" for j in range(100 + rng.randrange(60))]
        for _ in range(rng.choice([0, 1, 2])):
            words[rng.randrange(len(words))] = f"y{i}"
        made.append((10 + i, " ".join(words)))
    made.append((90, made[0][1]))
    got = links(jaccard.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 4, 85))
    assert got == brute.links(made)
    assert [n for _, n in got[:4]] == [3, 3, 3, 3]


def test_links_of_repeated_ids(spark):
    texts = [" ".join(f"w{j}" for j in range(60)) + f" x{i}" for i in range(4)]
    made = list(zip([1, 1, 2, 3, 3], [*texts, texts[3]]))
    got = links(jaccard.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 4, 85))
    assert got == [(1, 2), (1, 2), (2, 3), (3, 3), (3, 3)]


def test_near_copies_below_the_threshold_are_no_pairs(spark):
    """100 texts that share a shingle and half of their words: 4950 pairs, none of which may become a row."""
    rng = random.Random(11)
    made = []
    for i in range(100):
        own = [f"o{i}x{j}" for j in range(100)]
        made.append((i, " ".join([f"b{j}" for j in range(100 + rng.randrange(20))] + own)))
    texts = spark.createDataFrame(made, "doc_id long, text string")
    rank = spark.sparkContext.broadcast(np.zeros(1 << BITS, np.uint8))
    profiles = jaccard._profiles(texts, 4, 85, rank)
    rows = profiles.selectExpr("7L AS token", "doc_id", "n", "one", "doc_id AS component")
    bits = profiles.select("doc_id", "n", "one", "odd")
    assert [jaccard._candidates(rows, bits, 85, every).count() for every in (True, False)] == [0, 0]


def test_parities_lose_no_link_and_hot_shingles_are_dealt_in_blocks(spark, monkeypatch):
    """Sets of few and many parities in one bucket, in blocks of 4 or not: all pairs that link are candidates."""
    rng = random.Random(12)
    made, words = [], [f"w{j}" for j in range(440)]
    for i in range(30):
        own = words[: rng.randrange(360, 440)]
        for _ in range(rng.randrange(8)):
            own[rng.randrange(len(own))] = f"x{i}"
        made.append((i, " ".join(own)))
    texts = spark.createDataFrame(made, "doc_id long, text string")
    rank = spark.sparkContext.broadcast(np.zeros(1 << BITS, np.uint8))
    profiles = jaccard._profiles(texts, 4, 85, rank)
    rows = profiles.selectExpr("7L AS token", "doc_id", "n", "one", "doc_id AS component")
    bits = profiles.select("doc_id", "n", "one", "odd")
    sets = {i: brute_set(t) for i, t in made}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert linked
    for block in (1024, 4):
        monkeypatch.setattr(jaccard, "BUCKET", block)
        got = {tuple(r) for r in jaccard._candidates(rows, bits, 85, True).collect()}
        assert linked <= got


def brute_set(text):
    words = text.split()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def test_groups_of_near_copies_give_fewer_pairs_than_rows(spark):
    """120 texts that all link share two shingles: 7140 pairs, of which 119 of each shingle join them all."""
    words = [f"w{j}" for j in range(200)]
    made = [(i, " ".join([*words, f"x{i}"])) for i in range(120)]
    texts = spark.createDataFrame(made, "doc_id long, text string")
    rank = spark.sparkContext.broadcast(np.zeros(1 << BITS, np.uint8))
    profiles = jaccard._profiles(texts, 4, 85, rank)
    rows = profiles.selectExpr("inline(array(struct(7L AS token), struct(8L AS token)))", "doc_id", "n", "one", "doc_id AS component")
    found = jaccard._candidates(rows, profiles.select("doc_id", "n", "one", "odd"), 85, True, True)
    pairs = [tuple(r) for r in found.select("a", "b").collect()]
    assert len(pairs) <= 2 * 119
    linked = spark.createDataFrame(pairs, "a long, b long")
    assert {tuple(r) for r in jaccard.components(linked).collect()} == {(i, 0) for i in range(120)}


def test_pairs_that_only_may_link_join_no_components(spark, monkeypatch):
    """All documents in one family: components and counts are those of the links."""
    rng = random.Random(13)
    made = []
    for i in range(60):
        words = [f"v{j}" for j in range(60)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"y{i}"
        made.append((i, " ".join(words)))
    texts = spark.createDataFrame(made, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "_may_link", lambda i, j, n, words, percent: np.ones(len(i), bool))
    monkeypatch.setattr(jaccard, "DRAWN", 1)
    got = jaccard.near_duplicates(texts, 4, 85)
    assert rows(got) == brute.components(made, 4, 85)
    assert links(got) == brute.links(made)
    assert len({c for _, _, c in rows(got)}) > 1
