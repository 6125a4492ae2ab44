import brute
from pyspark.sql import functions as F

from fieldcount.llm import decontaminate, exact


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


EXACT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
HITS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_exact_equals_brute_force(docs, documents):
    assert rows(exact.deduplicate(docs), *EXACT) == brute.exact(documents)


def test_digests_that_collide_are_told_apart_by_bytes(docs, documents):
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    assert rows(exact.deduplicate(docs, digest=weak), *EXACT) == brute.exact(documents)


def test_state_goes_on_over_several_batches(docs, documents):
    assert rows(exact.deduplicate(docs, batch_bytes=1), *EXACT) == brute.exact(documents)


def test_of_rows_equal_in_all_one_stays(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, None), (None, "")], "doc_id long, text string")
    got = exact.deduplicate(twice)
    assert got.filter("kept").count() == 2
    assert rows(got.filter("text_sha256 != sha2('', 256)"), "group_size") == [(3,)] * 3


def test_exact_of_nothing(empty):
    assert exact.deduplicate(empty).collect() == []


def test_decontamination_equals_brute_force(spark, docs, documents):
    items = [
        (r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    ]
    items += [(900, None), (901, "..."), (902, "one two three four"), (903, "one"), (904, documents[3][1]), (904, "a b c")]
    more = documents + [(2_000_000 + i, f"x y, {t} Z " * 3) for i, t in items[:8]]
    frame = docs.select("doc_id", "text", "key").unionByName(
        spark.createDataFrame([(i, t, "k") for i, t in more[len(documents) :]], "doc_id long, text string, key string")
    )
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.contamination(frame, bench), *HITS)
    assert got == brute.decontaminate(more, items)
    assert sum(r[-1] for r in got) >= 8


def test_decontamination_without_rows(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(empty, bench).collect() == []
    assert not any(r["n_hit"] for r in decontaminate.contamination(docs, none).collect())


def test_decontamination_of_repeated_rows(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "z"), (None, "A B C")], "doc_id long, text string")
    got = [tuple(r) for r in decontaminate.contamination(twice, bench).select("doc_id", "n_hit").collect()]
    assert sorted(got, key=str) == [(1, 0), (1, 3), (1, 3), (None, 3)]
