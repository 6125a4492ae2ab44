"""Counts of keys of any number in a table of fixed size.

Tasks count in cells that keys hash to; Spark adds the tasks' tables up, and the driver gets one. It
tells common keys from rare ones: a key is taken to be common when its cell holds far more than cells
usually do, which stays so at any size, since the share of documents with a common key does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldcount.llm.bytetext import mix

#: 4 M cells: 16 MB in a task, 4 MB as ranks.
BITS = 22
SCHEMA = "part int, counts binary"
_PART = 1 << 16
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.int64)


def cell(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - bits)).astype(np.int32)


def _pack(counts: np.ndarray) -> bytes:
    """Counts in the narrowest integers that hold them, after a byte that says which."""
    width = next(i for i, t in enumerate(_WIDTHS) if counts.max() <= np.iinfo(t).max)
    return bytes([width]) + counts.astype(_WIDTHS[width]).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, _WIDTHS[packed[0]], offset=1).astype(np.int64)


class CellCounts:
    """Counts of one task."""

    def __init__(self, bits: int = BITS):
        self.bits, self.counts = bits, np.zeros(1 << bits, np.uint32)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(cell(hashes, self.bits))
        self.size += len(hashes)
        if self.size > len(self.counts) // 2:
            self._count()

    def _count(self) -> None:
        if self.waiting:
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=len(self.counts)).astype(np.uint32)
            self.waiting, self.size = [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._count()
        for at in range(0, len(self.counts), _PART):
            part = self.counts[at : at + _PART]
            if part.any():
                yield _row(at // _PART, part)


def _row(part: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([_pack(counts)], pa.binary())], names=["part", "counts"])


def gather(rows: DataFrame, bits: int = BITS) -> np.ndarray:
    """The sum of all tasks' counts: tables are added as they stream in."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch["part"].to_pylist(), batch["counts"].to_pylist()):
                more = _unpack(counts)
                sums[part] = sums[part] + more if part in sums else more
        for part, total in sums.items():
            yield _row(part, total)

    total = np.zeros(1 << bits, np.int64)
    for row in rows.repartition(max(1, (1 << bits) // _PART), "part").mapInArrow(add, SCHEMA).collect():
        counts = _unpack(bytes(row["counts"]))
        total[row["part"] * _PART : row["part"] * _PART + len(counts)] = counts
    return total


def ranks(counts: np.ndarray) -> np.ndarray:
    """How many times doubled the usual count of a cell makes each cell's; 0 for usual cells."""
    usual = max(1.0, float(np.median(counts)) * 1.5)
    return np.ceil(np.log2(np.maximum(counts / usual, 1.0))).astype(np.uint8)
