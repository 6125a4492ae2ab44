"""Benchmark decontamination by winnowing.

Of every window of ``size`` words the k-gram with the least hash is kept. A passage of ``size`` words
that a document shares with a benchmark item therefore has a kept k-gram at the same place in both,
so joining the kept k-grams finds every shared passage. Hits are then extended: the words around the
k-gram are compared one by one to both sides, and the document's words in a common run of ``size``
or more are marked. Items of fewer words are one window each; for the few lengths that occur, the
documents' grams of that length stand in for the kept ones.

A filter of fixed size, built from the benchmark's fingerprints, drops the documents' fingerprints
that cannot match before they leave their task. The join decides; nothing else about the benchmark
is broadcast, so it can be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcount.llm.bytetext import ALNUM, Words, grams, signed, slices, tokenize, whole, window_argmin
from fieldcount.llm.sketch import bloom
from fieldcount.session import materialize

K = 6

_HIT = pa.list_(
    pa.struct([("key", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("off", pa.int32()), ("words", pa.string())])
)


def kept_grams(words: Words, size: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k-grams that are least in some window, and their hashes."""
    values = grams(words.hash, k, salt=size)
    least = window_argmin(values, size - k + 1)
    at = np.unique(least[whole(words.first, size)])
    return at, values[at]


def _hits(words: Words, row: np.ndarray, at: np.ndarray, keys: np.ndarray, size: int, k: int) -> list[tuple]:
    """(row, key, size, pos, off, words): the gram and the words that a window with it can hold."""
    out = []
    around = size - k
    for place, key in zip(at.tolist(), keys.tolist()):
        r = int(row[place])
        begin, end = int(words.first[r]), int(words.first[r + 1])
        a, b = max(begin, place - around), min(end, place + k + around)
        out.append((r, key, size, place - begin, place - a, words.text(a, b).decode(errors="replace")))
    return out


def _list_array(found: list[tuple], rows: int) -> pa.Array:
    found.sort(key=lambda x: x[0])
    ends = np.searchsorted([x[0] for x in found], np.arange(rows + 1)) if found else np.zeros(rows + 1, int)
    fields = [pa.array([x[i + 1] for x in found], _HIT.value_type[i].type) for i in range(5)]
    values = pa.StructArray.from_arrays(fields, fields=list(_HIT.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _item_prints(items: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"]
            found: list[tuple] = []
            for a, b in slices(texts):
                words = tokenize(texts.slice(a, b - a), ALNUM, lower=True)
                row, n = words.row_of(), np.diff(words.first)
                at, keys = kept_grams(words, size)
                part = _hits(words, row, at, signed(keys), size, K)
                for few in np.unique(n[(n > 0) & (n < size)]).tolist():
                    values = grams(words.hash, few, salt=few)
                    at = words.first[:-1][n == few]
                    part += _hits(words, row, at, signed(values[at]), few, few)
                found += [(r + a, *x) for r, *x in part]
            yield pa.record_batch([batch["item_id"], _list_array(found, len(texts))], names=["item_id", "hits"])

    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, hits array<struct<key: long, size: int, pos: int, off: int, words: string>>"
    return items.mapInArrow(run, schema).select("item_id", F.inline("hits"))


def _doc_prints(docs: DataFrame, size: int, filter_, short: list[int]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch["text"]
            found: list[tuple] = []
            counts = np.zeros(len(texts), np.int64)
            for a, b in slices(texts):
                words = tokenize(texts.slice(a, b - a), ALNUM, lower=True)
                counts[a:b] = np.diff(words.first)
                row = words.row_of()
                at, keys = kept_grams(words, size)
                ok = known.has(keys)
                part = _hits(words, row, at[ok], signed(keys[ok]), size, K)
                for few in short:
                    values = grams(words.hash, few, salt=few)
                    at = np.flatnonzero(whole(words.first, few) & known.has(values))
                    part += _hits(words, row, at, signed(values[at]), few, few)
                found += [(r + a, *x) for r, *x in part]
            columns = [batch["doc_id"], batch["row_key"], pa.array(counts), _list_array(found, len(texts))]
            yield pa.record_batch(columns, names=["doc_id", "row_key", "n_words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, row_key long, n_words long, "
        "hits array<struct<key: long, size: int, pos: int, off: int, words: string>>"
    )
    return docs.mapInArrow(run, schema)


def _agreeing(mine: Column, theirs: Column) -> Column:
    """How many words two arrays have in common from the front on."""
    pairs = F.zip_with(mine, theirs, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(pairs, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(pairs).cast("long"))


def matches(docs: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their word counts, extended hits: doc_id, row_key, begin, end, item_ids)."""
    theirs = materialize(_item_prints(items, size), "bench-prints")
    short = [r[0] for r in theirs.filter(F.col("size") < size).select("size").distinct().collect()]
    prints = materialize(_doc_prints(docs, size, bloom(theirs, "key"), sorted(short)), "doc-prints")
    distinct = theirs.groupBy("key", "size", F.col("off").alias("b_off"), F.col("words").alias("b_words")).agg(
        F.collect_set("item_id").alias("item_ids")
    )
    hits = prints.select("doc_id", "row_key", F.inline("hits")).join(distinct, ["key", "size"])
    a, b = F.split("words", " "), F.split("b_words", " ")
    left = _agreeing(
        F.reverse(F.slice(a, F.lit(1), F.col("off"))), F.reverse(F.slice(b, F.lit(1), F.col("b_off")))
    )
    right = _agreeing(
        F.slice(a, F.col("off") + 1, F.size(a)), F.slice(b, F.col("b_off") + 1, F.size(b))
    )
    extended = hits.select("doc_id", "row_key", "pos", "size", "item_ids", left.alias("left"), right.alias("right"))
    return prints.select("doc_id", "row_key", "n_words"), extended.filter(
        F.col("left") + F.col("right") >= F.col("size")
    ).select(
        "doc_id",
        "row_key",
        (F.col("pos") - F.col("left")).alias("begin"),
        (F.col("pos") + F.col("right")).alias("end"),
        "item_ids",
    )


def _covered(spans: Column) -> Column:
    """The number of words in the union of sorted (begin, end) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(
        spans,
        start,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["begin"], s["to"]))).alias("n"),
            F.greatest(s["to"], x["end"]).alias("to"),
        ),
        lambda s: s["n"],
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int = 13,
    share: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, item_ids, items_sha256, contaminated.

    A window is ``size`` consecutive words of an item, or all words of a shorter item. A document's
    word is hit when it lies in an occurrence of a window; a document is contaminated when one word
    in ``share`` or more is hit. Words are runs of ASCII letters, digits and characters beyond
    ASCII, with A-Z in lower case. Null and empty texts have no words, match nothing and are not
    contaminated; without items nothing is. Rows repeated in full get the same result each; items
    with one id count once. Other columns are not looked at.
    """
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    bench = items.select(
        F.col(item_id_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")
    )
    counted, hits = matches(texts, bench, size)
    per_doc = hits.groupBy("doc_id", "row_key").agg(
        _covered(F.sort_array(F.collect_set(F.struct("begin", "end")))).alias("n_hit"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"),
    ).select(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key"), "n_hit", "item_ids")
    ids = F.sort_array(F.transform(F.coalesce("item_ids", F.array()), lambda x: x.cast("string")))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    joined = counted.join(
        per_doc, counted["doc_id"].eqNullSafe(per_doc["hit_id"]) & (counted["row_key"] == per_doc["hit_key"]), "left"
    )
    return joined.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
