"""Where equal windows of words can be: documents cut at content-selected anchors.

Every window of ``size`` words picks an anchor, the k-gram of least rank in it; rank is the frequency
of the gram, by a count sketch of fixed size over all documents, and then its hash. Equal windows pick
equal anchors, so what two windows share can be found among the segments of one anchor: a segment is
a run of windows of one document that picked the same gram, and holds all their words. Rare grams
come first, so a passage that a third of all documents quote does not gather its surroundings under
one anchor; the segments within it are equal and are told by their hash.

Equal segments are settled by hash before anything is shipped: within a batch only the earliest is
kept. Of anchors with several different segments, the text of one segment each goes to a shard, where
the operators compare windows word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcount.llm.bytetext import SPACED, Words, grams, mix, signed, slices, tokenize, whole, window_argmin
from fieldcount.llm.sketch import COUNT_SCHEMA, Bloom, CellCounts, bloom, cell, gather_counts, ranks
from fieldcount.session import materialize

#: Words of segments in a shard, about.
SHARD_WORDS = 400_000
_NO_ID = -(1 << 63)

REMOVED = "doc long, row_key long, start int, length int, first_doc long, first_start int"


class Segments(NamedTuple):
    """Runs of windows: anchor and content hashes, row, first word in the slice, number of windows."""

    anchor: np.ndarray
    content: np.ndarray
    row: np.ndarray
    word: np.ndarray
    windows: np.ndarray


def cut(words: Words, size: int, k: int, rank: np.ndarray) -> Segments:
    values = grams(words.hash, k)
    order = values >> np.uint64(8) | rank[cell(values)].astype(np.uint64) << np.uint64(56)
    picked = window_argmin(order, size - k + 1)
    starts = np.flatnonzero(whole(words.first, size))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, none)
    anchor = picked[starts]
    row = words.row_of()[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(starts)) - 1
    window = grams(words.hash, size)
    count = b - a + 1
    # first and last window overlap or touch, so they hold all words
    content = mix(window[starts[a]] * np.uint64(3) + mix(window[starts[b]]) + count.astype(np.uint64))
    return Segments(signed(values[anchor[a]]), signed(content), row[a], starts[a], count)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by place in the order of documents: doc (id), row_key (tells rows with one id apart), text."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.xxhash64(text_col).alias("row_key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def _ranks(texts: DataFrame, k: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = CellCounts()
        for batch in batches:
            for a, b in slices(batch["text"]):
                seen.add(grams(tokenize(batch["text"].slice(a, b - a), SPACED).hash, k))
        yield from seen.rows()

    return ranks(gather_counts(texts.select("text").mapInArrow(run, COUNT_SCHEMA)))


def _anchors(texts: DataFrame, size: int, k: int, rank: Broadcast) -> DataFrame:
    """Anchors met more than once, and whether their segments differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [
                cut(tokenize(batch["text"].slice(a, b - a), SPACED), size, k, rank.value)[:2]
                for a, b in slices(batch["text"])
            ]
            if not parts:
                continue
            anchor, content = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((content, anchor))
            anchor, content = anchor[order], content[order]
            new = np.ones(len(anchor), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(anchor)) - 1
            columns = [anchor[at], last - at + 1, content[at], content[last[: len(at)]]]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["anchor", "n", "low", "high"])

    met = texts.select("text").mapInArrow(run, "anchor long, n long, low long, high long")
    return (
        met.groupBy("anchor")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        .filter("n > 1")
        .select("anchor", (F.col("low") != F.col("high")).alias("mixed"))
    )


_CUT = "anchor long, content long, doc long, row_key long, start int, windows int, earlier_doc long, earlier_start int, words binary"


def _cuts(texts: DataFrame, size: int, k: int, rank: Broadcast, repeated: Broadcast, mixed: Broadcast) -> DataFrame:
    """Segments of repeated anchors. Those with an equal, earlier one in their batch say where it is;
    the others have their words if their anchor's segments differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = batch["doc"].to_numpy(), batch["row_key"].to_numpy()
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            text: list[bytes] = []
            for a, b in slices(batch["text"]):
                words = tokenize(batch["text"].slice(a, b - a), SPACED)
                s = cut(words, size, k, rank.value)
                ok = np.flatnonzero(repeated.value.has(s.anchor))
                row = s.row[ok] + a
                start = s.word[ok] - words.first[s.row[ok]]
                for c, x in zip(cols, (s.anchor[ok], s.content[ok], doc[row], key[row], start, s.windows[ok])):
                    c.append(x)
                wanted = mixed.value.has(s.anchor[ok])
                for i, want in zip(ok.tolist(), wanted.tolist()):
                    w = int(s.word[i])
                    text.append(words.text(w, w + int(s.windows[i]) + size - 1) if want else b"")
            if not text:
                continue
            anchor, content, doc, key, start, windows = (np.concatenate(c) for c in cols)
            order = np.lexsort((start, key, doc, content))
            same = content[order][1:] == content[order][:-1]
            lead = np.flatnonzero(np.concatenate([[True], ~same]))
            first = np.empty(len(order), np.int64)
            first[order] = np.repeat(order[lead], np.diff(np.append(lead, len(order))))
            later = (doc != doc[first]) | (key != key[first]) | (start != start[first])
            send = later | (first == np.arange(len(first)))
            at = np.flatnonzero(send)
            columns = [pa.array(x[at]) for x in (anchor, content, doc, key)]
            columns += [pa.array(x[at], pa.int32()) for x in (start, windows)]
            columns += [
                pa.array(doc[first[at]], mask=~later[at]),
                pa.array(start[first[at]], pa.int32(), mask=~later[at]),
                pa.array([b"" if later[i] else text[i] for i in at.tolist()], pa.binary()),
            ]
            names = [c.split()[0] for c in _CUT.split(", ")]
            yield pa.record_batch(columns, names=names)

    return texts.mapInArrow(run, _CUT)


class Shard(NamedTuple):
    """Different segments whose anchors they share with others, by place in the order of documents."""

    buf: Words
    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray


#: Per window of a shard's segments, in order: the segment and the window of the earliest equal one.
Compare = Callable[[Shard, int], tuple[np.ndarray, np.ndarray]]


def _settle(cuts: DataFrame, size: int, compare: Compare) -> DataFrame:
    """Windows that also start earlier, as runs, from the segments that are first in their batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [batch for batch in batches if batch.num_rows]
        if not given:
            return
        table = pa.Table.from_batches(given)
        anchor, content, doc, key, start, windows = (table.column(i).to_numpy() for i in range(6))
        order = np.lexsort((start, key, doc, content))
        same = content[order][1:] == content[order][:-1]
        lead = np.flatnonzero(np.concatenate([[True], ~same]))
        first = np.empty(len(order), np.int64)
        first[order] = np.repeat(order[lead], np.diff(np.append(lead, len(order))))
        later = (doc != doc[first]) | (key != key[first]) | (start != start[first])
        at = np.flatnonzero(later)
        out = [[doc[at], key[at], start[at], windows[at] + size - 1, doc[first[at]], start[first[at]]]]
        words = table.column("words")
        has_text = pc.greater(pc.binary_length(words), 0).to_numpy()
        heads = order[lead]
        heads = heads[has_text[heads]]
        if len(heads):
            heads = heads[np.lexsort((start[heads], key[heads], doc[heads]))]
            text = words.take(pa.array(heads)).combine_chunks().cast(pa.large_binary()).cast(pa.large_string())
            shard = Shard(tokenize(text, SPACED), doc[heads], start[heads], windows[heads].astype(np.int64), anchor[heads])
            segment, window = compare(shard, size)
            own = np.repeat(np.arange(len(heads)), shard.windows)
            within = np.arange(len(own)) - np.repeat(np.cumsum(shard.windows) - shard.windows, shard.windows)
            gone = segment >= 0
            # runs of removed windows of one segment
            edge = np.ones(len(own), bool)
            edge[1:] = (own[1:] != own[:-1]) | (gone[1:] != gone[:-1])
            a = np.flatnonzero(edge)
            b = np.append(a[1:], len(own)) - 1
            keep = gone[a]
            a, b = a[keep], b[keep]
            h = heads[own[a]]
            out.append(
                [
                    doc[h],
                    key[h],
                    start[h] + within[a],
                    b - a + size,
                    shard.doc[segment[a]],
                    shard.start[segment[a]] + window[a],
                ]
            )
        cols = [np.concatenate(c) for c in zip(*out)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        names = [c.split()[0] for c in REMOVED.split(", ")]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return cuts.mapInArrow(run, REMOVED)


def earlier_windows(texts: DataFrame, size: int, k: int, compare: Compare) -> DataFrame:
    """Runs of words whose windows of ``size`` words all also start earlier in the order of
    (doc, row_key, place): doc, row_key, start, length, and where the run's first window was before."""
    context = texts.sparkSession.sparkContext
    rank = context.broadcast(_ranks(texts, k))
    anchors = materialize(_anchors(texts, size, k, rank), "anchors")
    repeated: Bloom = bloom(anchors, "anchor")
    mixed: Bloom = bloom(anchors.filter("mixed"), "anchor")
    cuts = materialize(_cuts(texts, size, k, rank, context.broadcast(repeated), context.broadcast(mixed)), "cuts")
    heads = cuts.filter("earlier_doc IS NULL")
    weight = heads.agg(F.count(F.lit(1)), F.sum(F.length("words"))).first()
    shards = 1 + (weight[0] or 0) // (SHARD_WORDS // 2) + (weight[1] or 0) // (SHARD_WORDS * 7)
    settled = _settle(heads.repartition(int(shards), "anchor"), size, compare)
    told = cuts.filter("earlier_doc IS NOT NULL").select(
        "doc",
        "row_key",
        "start",
        (F.col("windows") + (size - 1)).alias("length"),
        F.col("earlier_doc").alias("first_doc"),
        F.col("earlier_start").alias("first_start"),
    )
    return settled.unionByName(told)
