import random

import brute
import numpy as np

from fieldcount.llm import fmindex, sparse_suffix


def woven(seed, docs=60, size=20):
    """Texts that quote passages, each other and themselves, with edits and other surroundings."""
    rng = random.Random(seed)
    pool = [[f"p{j}_{rng.randrange(40)}" for _ in range(rng.choice([size, size + 1, 2 * size, 5 * size]))] for j in range(6)]
    out = []
    for i in range(docs):
        w = []
        for _ in range(rng.randrange(1, 6)):
            w += [f"n{rng.randrange(30)}" for _ in range(rng.randrange(0, 25))]
            p = list(rng.choice(pool))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = f"e{rng.randrange(5)}"
            a = rng.randrange(len(p) // 2)
            w += p[a:] if rng.random() < 0.3 else p
        if rng.random() < 0.2:
            w += w[: len(w) // 2]
        out.append((i * 7 % docs, " ".join(w)))
    return out + [(docs + i, "a b " * 40) for i in range(3)] + [(docs + 9, None), (docs + 10, "a a")]


def expected(rows, size):
    return [
        (key, len(w), len(gone), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
        for key, w, gone in brute.repeats(rows, size)
    ]


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_removed_words_equal_brute_force(docs, documents):
    assert got(fmindex.substring_dedup(docs)) == expected(documents, 20)


def test_woven_passages(spark):
    for seed in range(2):
        rows = woven(seed)
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        assert got(fmindex.substring_dedup(frame)) == expected(rows, 20)


def spans(rows, size):
    out = []
    for key, _, gone in brute.repeats(rows, size):
        runs = []
        for i in sorted(gone):
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        out += [(key, a, b - a) for a, b in runs]
    return sorted(out)


def test_repeated_spans_equal_brute_force(spark, docs, documents):
    for rows, frame in [(documents, docs), *((w, spark.createDataFrame(w, "doc_id long, text string").repartition(7)) for w in (woven(5, size=50), woven(6, size=50)))]:
        found = sparse_suffix.repeated_spans(frame).collect()
        assert sorted((r["doc_id"], r["start"], r["n_words"]) for r in found) == spans(rows, 50)
        words = {key: brute.spaced(text) for key, text in rows}
        for r in found:
            a, b = r["first_start"], r["start"]
            assert words[r["first_id"]][a : a + 50] == words[r["doc_id"]][b : b + 50]
            assert (r["first_id"], a) < (r["doc_id"], b)


def test_empty_repeated_and_without_id(spark, empty):
    assert fmindex.substring_dedup(empty).collect() == []
    assert sparse_suffix.repeated_spans(empty).collect() == []
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(3, text), (3, text), (None, text), (4, "x " + text), (5, "")], "doc_id long, text string")
    assert sorted(map(str, ((r["doc_id"], r["n_removed"]) for r in fmindex.substring_dedup(rows).collect()))) == sorted(
        map(str, [(None, 0), (3, 60), (3, 60), (4, 60), (5, 0)])
    )
    found = {(r["doc_id"], r["start"], r["n_words"], r["first_id"]) for r in sparse_suffix.repeated_spans(rows).collect()}
    assert found == {(3, 0, 60, None), (4, 1, 60, None)}


def test_index_counts_patterns():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 5, 400)
    index = fmindex.FMIndex(np.append(text + 1, 0), 8)
    for n in (1, 2, 5, 8):
        for at in range(0, 390, 13):
            pattern = text[at : at + n] + 1
            low, high = np.zeros(1, np.int64), np.full(1, 401)
            for c in pattern[::-1]:
                low, high = index.extend(np.array([c]), low, high)
            plain = sum((text[i : i + n] + 1 == pattern).all() for i in range(400 - n + 1))
            assert high[0] - low[0] == plain
