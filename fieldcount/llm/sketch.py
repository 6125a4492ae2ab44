"""Summaries of fixed size of keys of any number: a Bloom filter and a table of counts.

Both are gathered by Spark and end on the driver, where their size depends on a parameter only.
They decide what is shipped or in which order keys are taken, never what a result holds: a false hit
of the filter is dropped by a later join, and any order is as right as another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcount.llm.bytetext import mix

#: 4 MB as a bit array.
BLOOM_BITS = 25
#: 2 MB as 32-bit counts.
COUNT_BITS = 19

_PART = 1 << 13


class Bloom:
    """Keys are 64-bit hashes; two bits each."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        found = np.ones(len(keys), bool)
        for bits in (keys, keys >> np.uint64(32)):
            at = bits & self.mask
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def bloom(keys: DataFrame, key: str, bits: int = BLOOM_BITS) -> Bloom:
    """The filter of a long column of hashes; at most 2 ** (bits - 6) rows of it reach the driver."""
    at = F.explode(F.array(F.col(key), F.shiftrightunsigned(F.col(key), 32))).alias("at")
    place = F.col("at").bitwiseAND((1 << bits) - 1)
    rows = (
        keys.select(at)
        .groupBy(F.shiftright(place, 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set"))
        .toArrow()
    )
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["word"].to_numpy()] = rows["set"].to_numpy().view(np.uint64)
    return Bloom(words)


def cell(hashes: np.ndarray, bits: int = COUNT_BITS) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - bits)).astype(np.int64)


class CellCounts:
    """Counts of one task, cell by cell."""

    def __init__(self, bits: int = COUNT_BITS):
        self.bits, self.counts = bits, np.zeros(1 << bits, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        self.counts += np.bincount(cell(hashes, self.bits), minlength=len(self.counts))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.counts), _PART):
            part = self.counts[at : at + _PART]
            if part.any():
                packed = pa.array([part.astype(np.int64).tobytes()], pa.binary())
                yield pa.record_batch([pa.array([at // _PART], pa.int32()), packed], names=["part", "counts"])


COUNT_SCHEMA = "part int, counts binary"


def gather_counts(rows: DataFrame, bits: int = COUNT_BITS) -> np.ndarray:
    """Sum the rows of all tasks' ``CellCounts``, streaming, and return 2 ** bits counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch["part"].to_pylist(), batch["counts"]):
                more = np.frombuffer(counts.as_buffer(), np.int64)
                sums[part] = sums[part] + more if part in sums else more
        for part, total in sums.items():
            packed = pa.array([total.tobytes()], pa.binary())
            yield pa.record_batch([pa.array([part], pa.int32()), packed], names=["part", "counts"])

    parts = max(1, (1 << bits) // _PART)
    total = np.zeros(1 << bits, np.int64)
    for row in rows.repartition(parts, "part").mapInArrow(add, COUNT_SCHEMA).collect():
        total[row["part"] * _PART : row["part"] * _PART + _PART] = np.frombuffer(row["counts"], np.int64)
    return total


def ranks(counts: np.ndarray) -> np.ndarray:
    """The magnitude of each cell's count above the usual one, 0 for usual cells: rare keys come first."""
    usual = max(1.0, float(np.median(counts)) * 1.5)
    return np.ceil(np.log2(np.maximum(counts / usual, 1.0))).astype(np.uint8)
