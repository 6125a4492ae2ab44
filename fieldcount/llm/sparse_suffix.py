"""Substring deduplication with sparse suffix arrays.

Only suffixes that begin at a content-selected anchor are kept (see ``segments``): equal passages of
``size`` words have an anchor at the same place, so one suffix in twenty or so is enough. Suffixes are
sharded by their first words' hash, sorted, and compared with their neighbours; a match to the right is
extended to the left of the anchor, and every window of ``size`` words within it is a repeat. A suffix
whose windows are all found with its next neighbour is done; for the others the comparison goes on to
farther neighbours for as long as a match could still be long enough, so nothing is missed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcount.llm.bytetext import grams, signed
from fieldcount.llm.segments import Shard, earlier_windows, numbered

#: Pairs of suffixes compared at once.
BLOCK = 1 << 15


def by_neighbours(shard: Shard, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window, the segment and window of an earlier occurrence, or -1 where there is none."""
    words, n = shard.buf, len(shard.doc)
    _, ids = np.unique(words.hash, return_inverse=True)
    count = np.diff(words.first)
    anchor = _anchor_places(shard, size, k)
    left = _context(ids, words.first[:-1] + anchor - 1, anchor, -1, size - k)
    right = _context(ids, words.first[:-1] + anchor, count - anchor, 1, size)
    order = np.lexsort((*right.T[::-1], shard.anchor))
    first = np.cumsum(shard.windows) - shard.windows
    segment, window = np.full(shard.windows.sum(), -1), np.full(shard.windows.sum(), -1)
    missing = shard.windows.copy()
    place, common, distance = np.arange(n - 1), np.full(n - 1, size), 1
    same = shard.anchor[order[1:]] == shard.anchor[order[:-1]]
    adjacent = np.where(same, _agreeing(right, order), 0)
    while len(place):
        # what all suffixes from this one to the neighbour have in common
        common = np.minimum(common, adjacent[place + distance - 1])
        # windows of a settled segment are earlier elsewhere, where others find them too
        go = (common >= k) & (missing[order[place]] > 0)
        place, common = place[go], common[go]
        x, y = order[place], order[place + distance]
        near = np.flatnonzero((common + np.minimum(anchor[x], anchor[y]) >= size) & (missing[y] > 0))
        for at in range(0, len(near), BLOCK):
            part = near[at : at + BLOCK]
            _mark(x[part], y[part], common[part], left, anchor, shard, first, segment, window, missing, size)
        distance += 1
        inside = place + distance < n
        place, common = place[inside], common[inside]
    return segment, window


def _mark(x, y, right, left, anchor, shard, first, segment, window, missing, size) -> None:
    """Note the windows that pairs of segments share, for the later segment of each."""
    near, far = np.minimum(x, y), np.maximum(x, y)
    to_left = _first_difference(left[near] == left[far])
    to_left = np.minimum(to_left, np.minimum(anchor[near], anchor[far]))
    # windows that begin ``back`` words before the anchor: back <= to_left and size - back <= right
    low, high = np.maximum(size - right, 0), to_left
    # and that are windows of both segments
    for side in (near, far):
        low = np.maximum(low, anchor[side] - shard.windows[side] + 1)
        high = np.minimum(high, anchor[side])
    number = np.maximum(high - low + 1, 0)
    pair = np.repeat(np.arange(len(x)), number)
    back = low[pair] + np.arange(len(pair)) - np.repeat(np.cumsum(number) - number, number)
    at = first[far[pair]] + anchor[far[pair]] - back
    found = near[pair]
    order = np.lexsort((found, at))
    at, found, back = at[order], found[order], back[order]
    lead = np.ones(len(at), bool)
    lead[1:] = at[1:] != at[:-1]
    new = lead & (segment[at] < 0)
    segment[at[new]], window[at[new]] = found[new], anchor[found[new]] - back[new]
    missing -= np.bincount(np.searchsorted(first, at[new], side="right") - 1, minlength=len(missing))


def _anchor_places(shard: Shard, size: int, k: int) -> np.ndarray:
    """Where in each segment its anchor is: the first place that all of its windows hold, by hash."""
    values = signed(grams(shard.buf.hash, k))
    row = shard.buf.row_of()[: len(values)]
    hits = np.flatnonzero(values == shard.anchor[row])
    within = hits - shard.buf.first[row[hits]]
    # every window from 0 on holds the anchor: it lies in the last window too
    ok = (within >= shard.windows[row[hits]] - 1) & (within <= size - k)
    place = np.zeros(len(shard.doc), np.int64)
    place[row[hits][ok][::-1]] = within[ok][::-1]
    return place


def _context(ids: np.ndarray, start: np.ndarray, count: np.ndarray, step: int, width: int) -> np.ndarray:
    """Up to ``width`` words from each place on, to one side; -1 - row beyond the segment."""
    at = start[:, None] + step * np.arange(width)
    inside = np.arange(width) < count[:, None]
    return np.where(inside, ids[np.clip(at, 0, len(ids) - 1)], -1 - np.arange(len(start))[:, None]).astype(np.int32)


def _first_difference(same: np.ndarray) -> np.ndarray:
    return np.where(same.all(1), same.shape[1], same.argmin(1))


def _agreeing(right: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Words that each suffix has in common with the next one in order."""
    out = np.empty(len(order) - 1, np.int64)
    for at in range(0, len(out), BLOCK):
        rows = right[order[at : at + BLOCK + 1]]
        out[at : at + BLOCK] = _first_difference(rows[1:] == rows[:-1])
    return out


def repeated_spans(
    docs: DataFrame, size: int = 50, k: int = 12, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per run of repeated words: id, start, n_words, first_id, first_start.

    A run is made of the words of consecutive windows of ``size`` words that all also occur earlier:
    in a document of smaller id, or earlier in the same one; runs that meet are one, and carry where
    the first of their windows was found. Documents without such a run have no row; nor have null
    and empty texts. Words are runs of anything but ASCII white space, unchanged. A null id comes
    before all others. Rows with one id and one text count as one document; with different texts they
    are ordered by a hash of the text. Ids must be integers; other columns are not looked at.
    """
    texts = numbered(docs, id_col, text_col)
    found = earlier_windows(texts, size, k, lambda shard, n: by_neighbours(shard, n, k))
    kind = docs.schema[id_col].dataType

    def named(column: str):
        return F.when(F.col(column) != -(1 << 63), F.col(column)).cast(kind)

    merged = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", "length", "first_doc", "first_start"))),
        F.array().cast("array<struct<start: int, length: int, first_doc: long, first_start: int>>"),
        lambda runs, x: F.when(
            (F.size(runs) > 0) & (x["start"] <= F.element_at(runs, -1)["start"] + F.element_at(runs, -1)["length"]),
            F.concat(
                F.slice(runs, 1, F.size(runs) - 1),
                F.array(
                    F.struct(
                        F.element_at(runs, -1)["start"].alias("start"),
                        (
                            F.greatest(
                                F.element_at(runs, -1)["start"] + F.element_at(runs, -1)["length"],
                                x["start"] + x["length"],
                            )
                            - F.element_at(runs, -1)["start"]
                        ).alias("length"),
                        F.element_at(runs, -1)["first_doc"].alias("first_doc"),
                        F.element_at(runs, -1)["first_start"].alias("first_start"),
                    )
                ),
            ),
        ).otherwise(F.concat(runs, F.array(x))),
    )
    runs = found.groupBy("doc", "row_key").agg(merged.alias("runs"))
    return runs.select("doc", F.inline("runs")).select(
        named("doc").alias(id_col),
        "start",
        F.col("length").alias("n_words"),
        named("first_doc").alias("first_id"),
        "first_start",
    )
