"""Embedding whitening: vectors projected on the leading components of their covariance, scaled to one.

Entries become integers, so sums and centred products are whole numbers and the covariance is exact to
its last division, however many tasks share the vectors. Tasks hold one matrix of the vectors' length
squared; Spark adds the matrices entry by entry. The components come from ``spectrum``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcount.llm.spectrum import leading_eigenpairs

SCALE = 64
SHIFT = 1_000_000
#: Entries of this size and more have no long after scaling.
TOO_LARGE = float(1 << 57)

_LIMB, _LIMBS = 40, 4
#: Entries handled at a time.
_CHUNK = 1 << 20


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are numbers that can be scaled."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE)
    return F.coalesce(F.forall(vector, number), F.lit(False))


class _Exact:
    """Sums of whole numbers of any size, in limbs that Spark can add as longs."""

    def __init__(self, size: int):
        self.limbs = np.zeros((_LIMBS, size), np.int64)

    def add(self, numbers: np.ndarray) -> None:
        for k in range(_LIMBS - 1):
            self.limbs[k] += (numbers & ((1 << _LIMB) - 1)).astype(np.int64)
            numbers = numbers >> _LIMB
        self.limbs[-1] += numbers.astype(np.int64)

    def batch(self, rows: int) -> pa.RecordBatch:
        size = self.limbs.shape[1]
        columns = [pa.array(np.arange(size)), *map(pa.array, self.limbs), pa.array(np.full(size, rows))]
        return pa.RecordBatch.from_arrays(columns, ["at", *(f"limb{k}" for k in range(_LIMBS)), "rows"])

    SCHEMA = "at long, " + ", ".join(f"limb{k} long" for k in range(_LIMBS)) + ", rows long"


def _chunks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with their vectors as whole numbers, without the shift."""
    step = max(1, _CHUNK // dims)
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        entries = part.column(1).flatten().to_numpy(zero_copy_only=False)
        yield part, np.floor(entries * SCALE).astype(np.int64).reshape(part.num_rows, dims)


def _column_sums(x: np.ndarray) -> np.ndarray:
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return high.astype(object) * (1 << 32) + low


def _products(y: np.ndarray) -> np.ndarray:
    """y'y exactly: in doubles while they hold all whole numbers that can come up."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        y = y.astype(float)
        return (y.T @ y).astype(np.int64)
    y = y.astype(object)
    return y.T @ y


def _total(vectors: DataFrame, dims: int, size: int, of: Callable[[np.ndarray], np.ndarray]) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of ``of`` their whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = _Exact(size), 0
        for batch in batches:
            for _, x in _chunks(batch, dims):
                sums.add(of(x))
                rows += len(x)
        if rows:
            yield sums.batch(rows)

    added = vectors.mapInArrow(run, _Exact.SCHEMA).groupBy("at")
    found = added.agg(*[F.sum(c).alias(c) for c in ("rows", *(f"limb{k}" for k in range(_LIMBS)))]).collect()
    total = [0] * size
    for row in found:
        total[row["at"]] = sum(row[f"limb{k}"] << (_LIMB * k) for k in range(_LIMBS))
    return (found[0]["rows"] if found else 0), total


def _identity_error(vectors: DataFrame, dims: int, used: int, whiten: Callable[[np.ndarray], np.ndarray]) -> float:
    """The largest entry by which the covariance of the whitened values differs from the identity.

    Tasks centre their values before multiplying and merge their parts; the tasks' own means
    come in afterwards.
    """
    pairs = [(i, j) for i in range(used) for j in range(i, used)]
    upper = tuple(np.array(pairs, dtype=int).T) if pairs else ((), ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(used), np.zeros((used, used))
        for batch in batches:
            for _, x in _chunks(batch, dims):
                w = whiten(x)[:, :used]
                m, here = w.mean(axis=0), len(w)
                apart = m - mean
                spread += (w - m).T @ (w - m) + np.outer(apart, apart) * (n * here / (n + here))
                mean += apart * (here / (n + here))
                n += here
        if n:
            first, second = mean[upper[0]], mean[upper[1]]
            columns = [np.arange(len(pairs)), spread[upper], n * first * second, n * first, n * second, np.full(len(pairs), n)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = ["at", "spread", "means", "first", "second", "n"]
    schema = "at long, spread double, means double, first double, second double, n long"
    if not pairs:
        return 0.0
    sums = vectors.mapInArrow(run, schema).groupBy("at").agg(*[F.sum(c).alias(c) for c in names[1:]])
    worst = 0.0
    for r in sums.collect():
        i, j = pairs[r["at"]]
        covariance = (r["spread"] + r["means"] - r["first"] * r["second"] / r["n"]) / r["n"]
        worst = max(worst, abs(covariance - (i == j)))
    return worst


def whiten_embeddings(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32
) -> DataFrame:
    """A row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or has a null, not finite or too large entry (2^57) are left out, and so
    are vectors whose length is not the one that most have (of equally many, the longer one). An entry c
    counts as floor(64 c) + 1000000. All vectors left are fitted: ``n`` of them, with sums S.
    ``deviation`` is the sum of (n x - S)^2 over the entries, exact, null where a long can't hold it.
    Components go by falling eigenvalue from 1; there are as many as entries if these are fewer. Where an
    eigenvalue is zero to double precision (equal vectors, too few of them), ``whitened`` is null and
    ``identity_error`` is taken over the other components. Repeated rows and ids count each time; other
    columns are not looked at. No vector at all, or vectors without entries, give an empty result.
    """
    id_type = embeddings.schema[id_col].dataType.simpleString()
    schema = (
        f"__id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    usable = embeddings.select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).filter(finite(F.col("vector")))
    lengths = usable.groupBy(F.size("vector").alias("dims")).count()
    row = lengths.orderBy(F.desc("count"), F.desc("dims")).first()
    dims = row["dims"] if row else 0
    if not dims:
        none = F.lit(None)
        parts = [c.split() for c in schema.split(", ")[1:]]
        return embeddings.limit(0).select(F.col(id_col), *[none.cast(kind).alias(name) for name, kind in parts])
    vectors = usable.filter(F.size("vector") == dims)

    n, sums = _total(vectors, dims, dims, _column_sums)
    middle = [(2 * s + n) // (2 * n) for s in sums]  # the whole number nearest to the mean
    left = [s - n * m for s, m in zip(sums, middle)]
    centre = np.array(middle, dtype=np.int64)
    _, products = _total(vectors, dims, dims * dims, lambda x: _products(x - centre).ravel())
    square = n * n
    covariance = np.array(
        [[(n * products[i * dims + j] - left[i] * left[j]) / square for j in range(dims)] for i in range(dims)]
    )
    trace = sum(n * products[i * dims + i] - left[i] ** 2 for i in range(dims)) / square
    values, directions = leading_eigenpairs(covariance, components)
    explained = values / trace if trace else np.zeros(len(values))
    used = int((values > dims * np.finfo(float).eps * values[0]).sum())
    scaled = directions[:, :used] / np.sqrt(values[:used])
    offset = np.array([r / n for r in left])

    def whiten(x: np.ndarray) -> np.ndarray:
        out = np.full((len(x), len(values)), np.nan)
        out[:, :used] = ((x - centre) - offset) @ scaled
        return out

    def deviations(x: np.ndarray) -> pa.Array:
        y = x - centre
        most = n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * dims < 1 << 63:
            return pa.array((((n * y) - np.array(left, dtype=np.int64)) ** 2).sum(axis=1))
        rough = (((y - offset) * float(n)) ** 2).sum(axis=1)
        exact = lambda row: sum((n * int(v) - r) ** 2 for v, r in zip(row, left))
        wide = [exact(row) if about < 1.01 * 2.0**63 else None for row, about in zip(y, rough)]
        return pa.array([v if v is not None and v < 1 << 63 else None for v in wide], pa.int64())

    error = _identity_error(vectors, dims, used, whiten)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            for part, x in _chunks(batch, dims):
                rows = len(x)
                each = pa.array(np.repeat(np.arange(rows), k))
                columns = [
                    part.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n)),
                    deviations(x).take(each),
                    pa.array(whiten(x).ravel(), from_pandas=True),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return vectors.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
