"""Held-out quality of the trained operators, and their odd cases."""

import zlib

import numpy as np
import pytest

from fieldcount.llm import pseudolikelihood, quality, toxicity
from fieldcount.llm.labels import training_sample

SF = "/root/testdata/sf0.1"


def auc(good, bad):
    return float(np.mean(np.array(good)[:, None] > np.array(bad)[None]))


@pytest.mark.parametrize(
    ("run", "label", "least"), [(quality.quality, "quality", 0.97), (toxicity.toxicity, "toxic", 0.95)]
)
def test_held_out_rows_are_told_apart(spark, run, label, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in run(docs, labels).collect()}
    assert len(got) == docs.count()
    for key, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(key).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [(got[r["doc_id"]]["score"], r[label]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert auc([s for s, y in held if y == 1], [s for s, y in held if y == 0]) > least


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_odd_texts_and_missing_labels(spark, docs, documents, empty, run):
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0), int(i % 3 == 0), 9) for i in range(200)] + [(None, 1, 1, 9), (3, None, None, 9)],
        "doc_id long, quality int, toxic int, text int",
    )
    got = run(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(documents)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert run(empty, labels).collect() == []
    assert {r["score"] for r in run(docs, labels.limit(0)).collect()} == {0.5}
    twice = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a" * 600_000)], "doc_id long, text string")
    assert run(twice, labels).count() == 4


def test_long_texts_score_like_short_code_paths():
    rng = np.random.default_rng(0)
    net = quality.ByteConvNet.new(seed=3)
    for size in (0, 1, 7, 16, 17, 24, 1000, 4096 + 5):
        buf = rng.integers(0, 256, size).astype(np.uint8)
        whole = net.scores(buf, np.array([0, size]))[0]
        assert net.long_score(buf, block=64) == pytest.approx(whole, abs=1e-6)


def test_unseen_misspellings_share_the_score():
    rng = np.random.default_rng(0)
    clean = [" ".join(f"{rng.choice(list('abcdefgh'))}{rng.integers(99)}lo" for _ in range(30)) for _ in range(300)]
    texts = [f"{t} blockhead {t}" if i % 3 == 0 else t for i, t in enumerate(clean)]
    model = toxicity.train(texts, [int(i % 3 == 0) for i in range(300)])
    import pyarrow as pa

    found = toxicity.scores(pa.array(["a1lo b2lo bblockhead c3lo", "a1lo b2lo c3lo", ""]), *model.folded())
    assert found[0] > 0.5 > found[1]


def test_pseudo_likelihood_learns_from_both_sides(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        pairs = rng.integers(0, 8, 40)
        rows.append((i, " ".join(f"l{p} mid{p} r{p}" for p in pairs)))
    shuffled = [(1000 + i, " ".join(rng.permutation(t.split()))) for i, (_, t) in enumerate(rows[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    both = docs.unionByName(spark.createDataFrame(shuffled, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in pseudolikelihood.pseudo_likelihood(both, rounds=3, stride=2, batch=256).collect()}
    assert all(r["n_tokens"] == 120 for r in got.values())
    ordered = np.mean([got[i]["mean_log_likelihood"] for i in range(20)])
    mixed = np.mean([got[1000 + i]["mean_log_likelihood"] for i in range(20)])
    assert ordered > mixed + 0.5
    assert ordered > -np.log(24)


def test_pseudo_likelihood_is_a_probability():
    net = pseudolikelihood.WindowNet(seed=1)
    around = np.tile(np.array([[1, 2, 3, 4096]], np.int32), (4096, 1))
    total = np.exp(net.log_probabilities(around, np.arange(4096)).astype(float)).sum()
    assert total == pytest.approx(1, abs=1e-3)


def test_pseudo_likelihood_gradient():
    rng = np.random.default_rng(2)
    net = pseudolikelihood.WindowNet(seed=1)
    around, target = rng.integers(0, 4097, (64, 4)).astype(np.int32), rng.integers(0, 4096, 64)
    before = net.log_probabilities(around, target).mean()
    for _ in range(30):
        net.learn(around, target, np.full(len(net.flat), 1e-4, np.float32), 0.05)
    assert net.log_probabilities(around, target).mean() > before + 1


def test_pseudo_likelihood_of_odd_rows(spark, docs, documents, empty):
    got = {r["doc_id"]: r for r in pseudolikelihood.pseudo_likelihood(docs).collect()}
    assert len(got) == len(documents)
    for key, text in documents:
        n = len((text or "").encode().split())
        assert got[key]["n_tokens"] == n
        assert (got[key]["mean_log_likelihood"] is None) == (n == 0)
    assert pseudolikelihood.pseudo_likelihood(empty).collect() == []


def test_pseudo_likelihood_learns_at_every_word(spark, docs):
    """By its defaults, and once each."""
    import inspect

    import pyarrow as pa

    given = inspect.signature(pseudolikelihood.pseudo_likelihood).parameters
    rounds, stride = given["rounds"].default, given["stride"].default
    texts = pa.array(["", "a", "b c", "d e f g h", "a b c d e f g h i j k l m n o p q", " "])
    part = pseudolikelihood.tokenize(texts, pseudolikelihood.SPACED, lower=True)
    seen = np.concatenate([pseudolikelihood.learnt_at(part, stride, i) for i in range(rounds)])
    assert set(seen.tolist()) == set(range(len(part.hash)))
    seen = np.concatenate([pseudolikelihood.learnt_at(part, 7, i) for i in range(7)])
    assert sorted(seen.tolist()) == list(range(len(part.hash)))
    with pytest.raises(ValueError, match="stride"):
        pseudolikelihood.pseudo_likelihood(docs, rounds=2, stride=3)


def test_pseudo_likelihood_spreads_shared_symbols_by_counts(spark):
    """Alone in their documents, words of one symbol differ by the logarithm of their counts."""
    import pyarrow as pa

    names = [f"w{i}" for i in range(6000)]
    rows = [(-1, " ".join(w for i, w in enumerate(names) for _ in range(1 + i % 7))), *enumerate(names)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    known, counted = pseudolikelihood.vocabulary(texts)
    assert counted.count() == len(names)
    hashes = pseudolikelihood.tokenize(pa.array(names), pseudolikelihood.SPACED, lower=True).hash
    symbols = known.symbols(hashes)
    got = {r["doc_id"]: r["log_likelihood"] for r in pseudolikelihood.pseudo_likelihood(texts).collect()}
    compared = 0
    for symbol in np.unique(symbols[symbols >= pseudolikelihood.NAMED]).tolist():
        same = np.flatnonzero(symbols == symbol).tolist()
        n = [2 + i % 7 for i in same]
        assert known.shared[symbol - pseudolikelihood.NAMED] == sum(n)
        for i, k in zip(same[1:], n[1:]):
            assert got[i] - got[same[0]] == pytest.approx(np.log(k / n[0]), abs=1e-4)
            compared += k != n[0]
    assert compared > 100


def test_training_sample_is_bounded_in_bytes(spark):
    """Whole texts in draw order, of each label as many as the bytes allow, and one at least."""
    rows = [(i, chr(97 + i % 2) * (900 + i)) for i in range(60)] + [(100, "é" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows[:-1]], "doc_id long, quality int")
    every, marks = training_sample(docs, labels, "quality", 4000)
    found, kinds = training_sample(docs, labels, "quality", 4000, most_bytes=5000)
    for kind in (0, 1):
        whole = [t for t, y in zip(every, marks) if y == kind]
        few = [t for t, y in zip(found, kinds) if y == kind]
        assert few == whole[: len(few)]
        assert 0 < sum(map(len, few)) <= 5000 < sum(map(len, whole[: len(few) + 1]))
    huge = spark.createDataFrame([(100, 1)], "doc_id long, quality int")
    assert training_sample(docs, huge, "quality", 4000, most_bytes=5000) == (["é" * 5000], [1])


def test_pseudo_likelihood_steps_are_those_of_adagrad():
    """The sums of gradients per symbol, and the squares kept, against a plain version."""
    rng = np.random.default_rng(4)
    net, sums = pseudolikelihood.WindowNet(seed=2), None
    around = rng.integers(0, 9, (300, 2 * pseudolikelihood.SIDE)).astype(np.int32)
    target = rng.integers(0, pseudolikelihood.SYMBOLS, 300).astype(np.int32)
    before, sums = net.flat.copy(), np.full(len(net.flat), 1e-4, np.float32)
    net.learn(around, target, sums, 0.1)
    grad = np.sqrt(np.maximum(sums.astype(np.float64) - 1e-4, 0))
    assert np.allclose(np.abs(net.flat - before), 0.1 * grad / np.sqrt(sums + 1e-8), atol=2e-3)
    touched = (net.parts[0] != pseudolikelihood.WindowNet(before).parts[0]).any(2)
    for place in range(2 * pseudolikelihood.SIDE):
        assert set(np.flatnonzero(touched[place])) == set(around[:, place].tolist())


def test_pseudo_likelihood_of_large_and_small_classes(monkeypatch):
    """Probabilities and a step against plain sums; small classes share their products."""
    rng = np.random.default_rng(6)
    net = pseudolikelihood.WindowNet(seed=3)
    net.flat += rng.normal(0, 0.05, len(net.flat)).astype(np.float32)
    classes, each = pseudolikelihood.CLASSES, pseudolikelihood.PER_CLASS
    target = np.concatenate([rng.integers(0, 2 * each, 200), rng.integers(0, classes * each, 300)]).astype(np.int32)
    around = rng.integers(0, 4097, (len(target), 2 * pseudolikelihood.SIDE)).astype(np.int32)
    before = pseudolikelihood.WindowNet(net.flat.copy())
    vectors, bias, *weights = (x.astype(np.float64) for x in before.parts)
    to_class, to_symbol = weights[0].reshape(-1, classes), weights[-1].reshape(classes, -1, each)
    of_symbol, found = np.zeros_like(to_symbol), []
    for row, t in zip(around, target):
        hidden = np.append(np.tanh(bias + sum(vectors[i, s] for i, s in enumerate(row))), 1)
        first, second = (np.exp(hidden @ w) for w in (to_class, to_symbol[t // each]))
        first, second = first / first.sum(), second / second.sum()
        found.append(np.log(first[t // each] * second[t % each]))
        second[t % each] -= 1
        of_symbol[t // each] += np.outer(hidden, second) / len(target)
    assert net.log_probabilities(around, target) == pytest.approx(np.array(found), abs=1e-4)

    products, plain = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda *args, **given: products.append(1) or plain(*args, **given))
    sums = np.full(len(net.flat), 1e-4, np.float32)
    net.learn(around, target, sums, 0.1)
    moved = net.parts[3] - before.parts[3]
    assert np.allclose(moved, -0.1 * of_symbol / np.sqrt(1e-4 + of_symbol**2), atol=1e-4)
    assert len(products) <= 3 * sum(np.bincount(target // each, minlength=classes) > 16)


def test_pseudo_likelihood_looks_words_up_by_their_leading_bits():
    rng = np.random.default_rng(7)
    hashes = np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2))
    hashes = np.unique(np.concatenate([hashes, hashes[:9] + np.uint64(1), [np.uint64(0), np.uint64(2**64 - 1)]]))
    words = pseudolikelihood.Vocabulary(hashes, np.arange(len(hashes), dtype=np.int32), None)
    assert words.places[1] >= 2
    asked = np.concatenate([hashes, hashes[1:] - np.uint64(1), hashes[:-1] + np.uint64(3)])
    place = {h: i for i, h in enumerate(hashes.tolist())}
    got = words.symbols(asked)
    for h, s in zip(asked.tolist(), got.tolist()):
        assert s == place[h] if h in place else s >= pseudolikelihood.NAMED


def test_pseudo_likelihood_networks_that_were_sent_have_the_plain_type():
    """With another object for the type, steps of the same numbers take several times as long."""
    import pickle

    sent = pickle.loads(pickle.dumps(pseudolikelihood.WindowNet().flat, 5))
    net = pseudolikelihood.WindowNet(sent.copy())
    assert all(x.dtype is np.zeros(0, np.float32).dtype for x in (net.flat, *net.parts))
