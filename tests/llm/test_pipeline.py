"""Each stage on what the one before kept, against plain versions."""

from collections import defaultdict

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from fieldcount.llm import quality
from fieldcount.llm.workers import BATCH_BYTES
from fieldcount.session import materialize

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(10**6, None, None, None, None), (10**6 + 1, "", "en", "x", 0), (10**6 + 2, " ", "en", "x", 1)], docs.schema
    )
    out = [docs.unionByName(odd)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), "stage-test"))
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_all_but_the_last_return_the_columns_of_documents(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_classifier_rejects_what_scores_low(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {i for i, _ in texts(stages[1])}
    predicted = {r["doc_id"] for r in quality.quality(stages[0], labels).filter("predicted = 1").collect()}
    assert kept == predicted
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    assert len(good & kept) >= 0.98 * len(good)


def test_exact_copies_go(stages):
    assert {i for i, _ in texts(stages[2])} == {r[0] for r in brute.exact(texts(stages[1])) if r[3]}


def test_one_of_each_group_of_near_copies_stays(stages):
    expected = {i for i, _, c in brute.components(texts(stages[2]), 5, 80) if i == c}
    assert {i for i, _ in texts(stages[3])} == expected


def test_contaminated_documents_go(spark, stages):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = {r[0] for r in brute.decontaminate(texts(stages[3]), items) if not r[-1]}
    assert {i for i, _ in texts(stages[4])} == expected
    assert len(expected) < stages[3].count()


def test_contamination_goes_by_text_not_by_id(spark, stages):
    quoted = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(1, quoted, "en", "s", 1), (1, "a clean text", "en", "s", 1), (None, quoted, "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, stages[0].schema)
    kept = corpus_pipeline.drop_contaminated(spark, docs, SF).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == [("1", "a clean text"), ("None", "None")]


def test_everything_left_is_packed(stages):
    pieces = stages[5]
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {i for i, _ in texts(stages[4])}
    ends = defaultdict(int)
    for r in pieces.orderBy("sequence_id", "offset").collect():
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096
    total = pieces.agg(F.sum("length")).first()[0]
    assert len(ends) <= -(-total // 4096) + 1


def test_empty_table(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "stage-test")
        assert docs.isEmpty()


def test_classifier_takes_texts_in_small_batches(spark, monkeypatch):
    key, seen, write = "spark.sql.execution.arrow.maxBytesPerBatch", [], corpus_pipeline.materialize
    before = spark.conf.get(key)
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda *given: seen.append(spark.conf.get(key)) or write(*given))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert corpus_pipeline.classify(spark, docs, "/root/testdata/sf0.001").count() <= docs.count()
    assert [int(size) for size in seen] == [BATCH_BYTES]
    assert spark.conf.get(key) == before
