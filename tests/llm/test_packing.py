import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fieldcount.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_and_sequences_are_whole(spark, docs, documents):
    more = [(5_000_000, "it's  İX a<|endoftext|>b"), (5_000_001, "ΑΣ ας\x1fb \x85q"), (5_000_002, "é ́a ½ don't!!! ...12")]
    frame = docs.select("doc_id", "text", "key").unionByName(
        spark.createDataFrame([(i, t, "") for i, t in more], "doc_id long, text string, key string")
    )
    got = packing.pack(frame, PATH, bucket=64).collect()
    own = Tokenizer.from_file(PATH)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    total = 0
    for key, text in documents + more:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        pieces = sorted(by_doc.pop(key), key=lambda r: r["piece"])
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            assert (pieces[n]["piece"], pieces[n]["start"], pieces[n]["length"]) == (n, at, len(part))
            assert pieces[n]["ids_crc32"] == zlib.crc32(part.tobytes())
        assert len(pieces) == n + 1
    assert not by_doc
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-total // 4096) + 1


def test_swaps_empty_bins_that_best_fit_leaves():
    rng = random.Random(1)
    for _ in range(20):
        sizes = [rng.randrange(200, 700) for _ in range(150)]
        bins = packing.best_fit(sizes, 1000)
        after = packing.swap_search(bins, sizes, 1000)
        assert sorted(i for b in after for i in b) == list(range(150))
        assert all(sum(sizes[i] for i in b) <= 1000 for b in after)
        assert len(after) <= len(bins)
        squares = [sum(sum(sizes[i] for i in b) ** 2 for b in x) for x in (bins, after)]
        assert squares[1] >= squares[0]
    assert len(packing.swap_search([[0, 1], [2, 3]], [50, 30, 40, 30], 100)) == 2
    assert len(packing.swap_search([[0, 1], [2], [3]], [50, 20, 60, 30], 100)) == 2


def plain_search(bins, sizes, most):
    """Every change between every two bins, tried one by one, until none raises the sum of squares."""
    bins = [list(b) for b in bins]

    def options(b):
        return [()] + [(i,) for i in b] + [(i, k) for n, i in enumerate(b) for k in b[n + 1 :]]

    changed = True
    while changed:
        changed = False
        for low in range(len(bins)):
            for high in range(len(bins)):
                for give in options(bins[low]):
                    for take in options(bins[high]):
                        if low == high or not give or len(give) + len(take) > 3:
                            continue
                        if len(give) == 2 and not take:
                            continue
                        moved = sum(sizes[i] for i in give) - sum(sizes[i] for i in take)
                        a, b = (sum(sizes[i] for i in bins[x]) for x in (low, high))
                        if moved > 0 and a <= b and b + moved <= most and set(give) <= set(bins[low]) and set(take) <= set(bins[high]):
                            bins[low] = [i for i in bins[low] if i not in give] + list(take)
                            bins[high] = [i for i in bins[high] if i not in take] + list(give)
                            changed = True
    return [b for b in bins if b]


def test_the_search_leaves_nothing_that_a_plain_one_finds():
    rng = random.Random(3)
    totals = [0, 0]
    for _ in range(15):
        sizes = [rng.randrange(250, 420) for _ in range(24)]
        bins = packing.best_fit(sizes, 1000)
        after = packing.swap_search(bins, sizes, 1000)
        assert sorted(map(sorted, plain_search(after, sizes, 1000))) == sorted(map(sorted, after))
        totals[0] += len(after)
        totals[1] += len(plain_search(bins, sizes, 1000))
    assert totals[0] <= totals[1]


def test_no_bin_is_kept_from_giving():
    rng = random.Random(1)
    sizes = [rng.randrange(1000, 1700) for _ in range(2000)]
    assert len(packing.swap_search(packing.best_fit(sizes, 4096), sizes, 4096)) <= 685


def test_ids_keep_their_type(spark):
    rows = spark.createDataFrame([("a", "x y"), (None, "z"), ("b", None)], "doc_id string, text string")
    got = packing.pack(rows, PATH)
    assert got.schema["doc_id"].dataType.simpleString() == "string"
    assert sorted((r["doc_id"] or "", r["length"]) for r in got.collect()) == [("", 2), ("a", 3), ("b", 1)]


def test_many_equal_and_repeated_rows(spark, empty):
    rows = spark.createDataFrame([(1, "a")] * 5000 + [(None, None)], "doc_id long, text string")
    got = packing.pack(rows, PATH, bucket=512).collect()
    assert len(got) == 5001
    assert len({r["sequence_id"] for r in got}) == 3
    assert packing.pack(empty, PATH).collect() == []
