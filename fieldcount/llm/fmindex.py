"""Substring deduplication with compressed FM-indexes.

Shards of segments (see ``segments``) are indexed one by one: a suffix order of the shard's words, deep
enough for the longest pattern asked for; the Burrows-Wheeler sequence that it makes; and a wavelet tree
of that sequence, a bit per word and level with counts every 64 bits. Segments are then streamed
against the index: a backward search from every place, as many at once as a block holds, extends the
match to the left for as long as there is another occurrence. Its length is the place's matching
statistic; the windows that reach the threshold are reported with the earliest of their occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcount.llm.segments import Shard, earlier_windows, numbered

BLOCK = 1 << 17


class WaveletTree:
    """Rank queries on a sequence of small integers; levels of bits, most significant first."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.words.append(words)
            self.before.append((ones - np.bitwise_count(words)).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        self.base = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            word = at >> 6
            below = self.words[i][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.before[i][word] + np.bitwise_count(below)
            up = (symbol >> (self.levels - 1 - i) & 1).astype(bool)
            at = np.where(up, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.base[symbol]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` or more symbols that follow, by doubling."""
    rank = text.astype(np.int64)
    span, order = 1, np.argsort(rank, kind="stable")
    while span < depth:
        behind = np.zeros(len(rank), np.int64)
        behind[:-span] = rank[span:] + 1
        key = rank * (int(rank.max()) + 2) + behind
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        span *= 2
    return order


class FMIndex:
    """Of a text of symbols from 0 on; patterns of up to ``depth`` symbols can be counted."""

    def __init__(self, text: np.ndarray, depth: int):
        symbols = int(text.max()) + 1
        self.order = suffix_order(text, depth)
        self.tree = WaveletTree(text[self.order - 1], symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one symbol more in front."""
        base = self.first[symbol]
        return base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)

    def matching(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place: how many symbols up to it, ``most`` at most, occur more than once in the
        index; and the interval of that match."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.order), np.int64)
        length = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for step in range(most):
            a, b = self.extend(text[ends[live] - step], low[live], high[live])
            ok = b - a > 1
            live, a, b = live[ok], a[ok], b[ok]
            if not len(live):
                break
            low[live], high[live], length[live] = a, b, step + 1
        return length, low, high


def by_matching_statistics(shard: Shard, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window, the segment and window of its earliest occurrence, or -1 where it is the first.

    Segments come in the order of documents, so windows, one segment after the other, do too.
    """
    words, n = shard.buf, len(shard.doc)
    _, ids = np.unique(words.hash, return_inverse=True)
    count = np.diff(words.first)
    place = np.arange(len(ids)) + np.repeat(np.arange(n), count)
    text = np.zeros(len(ids) + n, np.int64)
    text[place] = ids + 1
    own = np.repeat(np.arange(n), shard.windows)
    within = np.arange(len(own)) - np.repeat(np.cumsum(shard.windows) - shard.windows, shard.windows)
    begin = words.first[own] + own + within
    index = FMIndex(text, size)
    window_at = np.full(len(text) + 1, len(own), np.int64)
    window_at[begin] = np.arange(len(own))
    # of every suffix in order, the window that starts there
    suffix_window = np.append(window_at[index.order], len(own))
    segment, window = np.full(len(own), -1), np.full(len(own), -1)
    for at in range(0, len(own), BLOCK):
        block = slice(at, min(len(own), at + BLOCK))
        length, low, high = index.matching(text, begin[block] + size - 1, size)
        hit = np.flatnonzero(length == size)
        if not len(hit):
            continue
        spans, back = np.unique(low[hit] * (len(text) + 1) + high[hit], return_inverse=True)
        a, b = spans // (len(text) + 1), spans % (len(text) + 1)
        least = np.minimum.reduceat(suffix_window, np.stack([a, b], 1).reshape(-1))[::2][back]
        later = least < at + hit
        source = least[later]
        segment[at + hit[later]], window[at + hit[later]] = own[source], within[source]
    return segment, window


_SPANS = "array<struct<start: int, length: int>>"


def substring_dedup(
    docs: DataFrame, size: int = 20, k: int = 6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_text, kept_sha256, spans.

    A word is removed when a window of ``size`` words of its document covers it whose words also start
    earlier: in a document of smaller id, or earlier in the same one. Windows are judged on the input.
    Words are runs of anything but ASCII white space, unchanged; the kept ones are joined by one
    space. Null and empty texts have no words. A null id comes before all others. Rows with one id and
    one text count as one document, so they do not remove each other; with different texts they are
    ordered by a hash of the text. ``spans`` are the removed runs (start, length). Ids must be integers.
    """
    texts = numbered(docs, id_col, text_col)
    found = earlier_windows(texts, size, k, by_matching_statistics)
    gone = found.groupBy("doc", "row_key").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    given = docs.select(id_col, text_col).withColumns(
        {
            "__doc": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))),
            "__key": F.xxhash64(text_col),
            "__text": F.coalesce(F.col(text_col), F.lit("")),
        }
    )
    joined = given.join(
        gone, (given["__doc"] == gone["doc"]) & (given["__key"] == gone["row_key"]), "left"
    ).select(id_col, F.col("__text").alias("text"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))
    kind = joined.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            spans = batch["spans"]
            ends = spans.offsets.to_numpy()
            start, length = (spans.values.field(i).to_numpy() for i in range(2))
            for i, value in enumerate(batch["text"]):
                words = value.as_buffer().to_pybytes().split()
                n, merged = len(words), []
                for a, b in sorted(zip(start[ends[i] : ends[i + 1]].tolist(), length[ends[i] : ends[i + 1]].tolist())):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], a + b)
                    else:
                        merged.append([a, a + b])
                for a, b in reversed(merged):
                    del words[a:b]
                kept = b" ".join(words)
                rows.append((n, n - len(words), kept, hashlib.sha256(kept).hexdigest(), [{"start": a, "length": b - a} for a, b in merged]))
            n, removed, kept, digest, merged = zip(*rows) if rows else ((),) * 5
            yield pa.record_batch(
                [
                    batch[id_col],
                    pa.array(n, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(digest, pa.string()),
                    pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
                ],
                names=[id_col, "n_words", "n_removed", "kept_text", "kept_sha256", "spans"],
            )

    schema = f"`{id_col}` {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string, spans {_SPANS}"
    return joined.mapInArrow(run, schema)
