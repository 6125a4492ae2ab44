"""The area of grid cells that lies in flight corridors, exactly.

A corridor is the union of a flat-ended strip along each piece of a line and a disc around each joint
of two pieces. What of it lies in a square cell is measured by going round its border: the parts of
the strips' and discs' edges that are inside the cell and in no other strip or disc, and the parts of
the cell's edges inside the corridor. Each part adds its share of the border integral of
(x dy - y dx) / 2, which straight edges and arcs have in closed form. Nothing is sampled, so a corridor
may be as thin against the cell as it likes.

Spark finds the pieces near each cell and brings those of one line and cell together; numpy measures
blocks of cells that have the same numbers of strips and discs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcount.operators.grid import candidate_cells

#: Numbers in the largest array of a block.
_BLOCK = 1 << 22


class _Shapes:
    """Strips, then discs, of a block of cells: (cells, shapes) arrays relative to the cells' centres."""

    def __init__(self, strips: np.ndarray, discs: np.ndarray, dist: float):
        ends = strips[..., 2:] - strips[..., :2]
        length = np.hypot(ends[..., 0], ends[..., 1])
        self.strips, self.dist, self.slack = strips.shape[1], dist, 1e-7 * dist
        self.x = np.concatenate([strips[..., 0], discs[..., 0]], axis=1)
        self.y = np.concatenate([strips[..., 1], discs[..., 1]], axis=1)
        self.length, self.ux, self.uy = length, ends[..., 0] / length, ends[..., 1] / length

    def hold(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of each shape, which of the points (cells, ...) it holds."""
        wide = (slice(None), *[None] * (x.ndim - 1))
        out = []
        for j in range(self.x.shape[1]):
            dx, dy = x - self.x[:, j][wide], y - self.y[:, j][wide]
            if j < self.strips:
                ux, uy = self.ux[:, j][wide], self.uy[:, j][wide]
                along = dx * ux + dy * uy
                out.append((along >= 0) & (along <= self.length[:, j][wide]) & (abs(dy * ux - dx * uy) <= self.dist))
            else:
                out.append(dx * dx + dy * dy <= self.dist**2)
        return out

    def lines(self, j: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The four lines (nx, ny, c) with nx x + ny y = c that bound a strip."""
        ux, uy = self.ux[:, j], self.uy[:, j]
        along, across = self.x[:, j] * ux + self.y[:, j] * uy, self.y[:, j] * ux - self.x[:, j] * uy
        return [
            (ux, uy, along),
            (ux, uy, along + self.length[:, j]),
            (-uy, ux, across - self.dist),
            (-uy, ux, across + self.dist),
        ]

    def corners(self, j: int) -> list[tuple[np.ndarray, np.ndarray]]:
        ux, uy, d = self.ux[:, j], self.uy[:, j], self.dist
        return [
            (self.x[:, j] + ux * along - uy * across, self.y[:, j] + uy * along + ux * across)
            for along, across in ((0, -d), (self.length[:, j], -d), (self.length[:, j], d), (0, d))
        ]


def _segment_breaks(shapes: _Shapes, half: float, x, y, vx, vy) -> np.ndarray:
    """Where the segments (x, y) + t (vx, vy) may enter or leave a shape or the cell, sorted, from 0 to 1."""
    breaks = [np.zeros_like(x), np.ones_like(x)]
    with np.errstate(divide="ignore", invalid="ignore"):
        for side in (-half, half):
            breaks += [(side - x) / vx, (side - y) / vy]
        for j in range(shapes.x.shape[1]):
            if j < shapes.strips:
                breaks += [(c - nx * x - ny * y) / (nx * vx + ny * vy) for nx, ny, c in shapes.lines(j)]
            else:
                px, py = x - shapes.x[:, j], y - shapes.y[:, j]
                v2, pv = vx * vx + vy * vy, px * vx + py * vy
                root = np.sqrt(np.maximum(pv * pv - v2 * (px * px + py * py - shapes.dist**2), 0))
                breaks += [(-pv - root) / v2, (-pv + root) / v2]
    found = np.stack(breaks, axis=1)
    return np.sort(np.clip(np.nan_to_num(found, nan=0.0, posinf=1.0, neginf=0.0), 0, 1), axis=1)


def _arc_breaks(shapes: _Shapes, half: float, k: int) -> np.ndarray:
    """The angles at which disc ``k``'s edge may enter or leave another shape or the cell, sorted."""
    x, y, d = shapes.x[:, k], shapes.y[:, k], shapes.dist
    zero = np.zeros_like(x)
    breaks = [zero, zero + 2 * np.pi]

    def crossing(nx, ny, distance):
        turn = np.arccos(np.clip(distance / d, -1, 1))
        middle = np.arctan2(ny, nx) + zero
        return [(middle - turn) % (2 * np.pi), (middle + turn) % (2 * np.pi)]

    for side in (-half, half):
        breaks += crossing(1.0, 0.0, side - x) + crossing(0.0, 1.0, side - y)
    for j in range(shapes.x.shape[1]):
        if j < shapes.strips:
            for nx, ny, c in shapes.lines(j):
                breaks += crossing(nx, ny, c - nx * x - ny * y)
        elif j != k:
            dx, dy = shapes.x[:, j] - x, shapes.y[:, j] - y
            breaks += crossing(dx, dy, np.hypot(dx, dy) / 2)
    return np.sort(np.stack(breaks, axis=1), axis=1)


def _alone(shapes: _Shapes, half: float, k: int, inner: tuple, outer: tuple) -> np.ndarray:
    """Whether the border parts of shape ``k`` bound the corridor inside the cell. ``inner`` and
    ``outer`` are points just on both sides of each part. Where the edges of several shapes run
    together, the first one has the part."""
    within, beyond = shapes.hold(*inner), shapes.hold(*outer)
    good = np.ones(inner[0].shape, bool)
    for px, py in (inner, outer):
        good &= (abs(px) < half) & (abs(py) < half)
    for j in range(len(within)):
        if j != k:
            good &= ~beyond[j]
            if j < k:
                good &= ~within[j]
    return good


def cell_areas(strips: np.ndarray, discs: np.ndarray, dist: float, size: float) -> np.ndarray:
    """Areas of the union of strips (cells, R, 4) and discs (cells, D, 2) inside squares around 0."""
    shapes, half = _Shapes(strips, discs, dist), size / 2
    area = np.zeros(len(strips))

    def along(x, y, vx, vy, k):
        t = _segment_breaks(shapes, half, x, y, vx, vy)
        middle = (t[:, 1:] + t[:, :-1]) / 2
        px, py = x[:, None] + middle * vx[:, None], y[:, None] + middle * vy[:, None]
        norm = np.hypot(vx, vy)[:, None] / shapes.slack
        ox, oy = vy[:, None] / norm, -vx[:, None] / norm  # outwards: edges go counterclockwise
        if k is None:
            part = np.logical_or.reduce(shapes.hold(px - ox, py - oy))
        else:
            part = _alone(shapes, half, k, (px - ox, py - oy), (px + ox, py + oy))
        return (x * vy - y * vx) / 2 * (np.diff(t, axis=1) * part).sum(axis=1)

    for k in range(shapes.strips):
        corners = shapes.corners(k)
        for (x, y), (x2, y2) in zip(corners, [*corners[1:], corners[0]]):
            area += along(x, y, x2 - x, y2 - y, k)
    for k in range(shapes.strips, shapes.x.shape[1]):
        angle, d = _arc_breaks(shapes, half, k), dist
        x, y = shapes.x[:, k, None], shapes.y[:, k, None]
        middle = (angle[:, 1:] + angle[:, :-1]) / 2
        cos, sin = np.cos(middle), np.sin(middle)
        sides = [(x + r * cos, y + r * sin) for r in (d - shapes.slack, d + shapes.slack)]
        part = _alone(shapes, half, k, *sides)
        swept = d * d * np.diff(angle, axis=1)
        swept += d * (x * np.diff(np.sin(angle), axis=1) - y * np.diff(np.cos(angle), axis=1))
        area += (swept * part).sum(axis=1) / 2
    zero = np.zeros(len(strips))
    for x, y, vx, vy in ((-1, -1, 2, 0), (1, -1, 0, 2), (1, 1, -2, 0), (-1, 1, 0, -2)):
        area += along(zero + x * half, zero + y * half, zero + vx * half, zero + vy * half, None)
    return area


def _gathered(column: pa.Array, width: int, members: np.ndarray) -> np.ndarray:
    """The lists of some rows, all of one length, as (rows, entries of ``width``, width)."""
    values = column.take(pa.array(members)).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(members), -1, width)


def _areas_of_distinct(strips: np.ndarray, discs: np.ndarray, dist: float, size: float) -> np.ndarray:
    """``cell_areas``, with cells measured once that have the same shapes in the same places."""
    rows = np.concatenate([strips.reshape(len(strips), -1), discs.reshape(len(discs), -1)], axis=1) + 0.0
    whole = rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel()
    _, first, of = np.unique(whole, return_index=True, return_inverse=True)
    return cell_areas(strips[first], discs[first], dist, size)[of]


def _measured(dist: float, size: float, kept: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strips, discs = batch.column("strips"), batch.column("discs")
            counts = np.stack([pc.list_value_length(c).to_numpy() for c in (strips, discs)], axis=1)
            area = np.zeros(len(counts))
            for r, d in np.unique(counts, axis=0):
                members = np.flatnonzero((counts == (r, d)).all(axis=1))
                r, d = r // 4, d // 2
                step = max(1, _BLOCK // ((r + d + 1) * (4 * r + 2 * d + 8)))
                for start in range(0, len(members), step):
                    some = members[start : start + step]
                    area[some] = _areas_of_distinct(_gathered(strips, 4, some), _gathered(discs, 2, some), dist, size)
            columns = [*[batch.column(c) for c in kept], pa.array(area)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "area"])

    return run


def _bounds(size: float, dist: float) -> dict[str, Column]:
    """Of a piece, what tells whether its strip comes into a square: they are apart if they are so
    along one of their four directions. Pieces without a length have nulls."""
    half = size / 2
    vx, vy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.sqrt(vx * vx + vy * vy)
    ux, uy = F.try_divide(vx, length), F.try_divide(vy, length)
    spread = (F.abs(ux) + F.abs(uy)) * half
    out = {"ux": ux, "uy": uy, "wide": spread + dist, "early": -spread, "late": length + spread}
    for c, turned in (("x", uy), ("y", ux)):
        far = F.abs(turned) * dist + half
        out |= {f"{c}low": F.least(f"{c}1", f"{c}2") - far, f"{c}high": F.greatest(f"{c}1", f"{c}2") + far}
    return out


def _reaches(size: float, dist: float) -> tuple[Column, list[Column]]:
    """Whether the strip of a piece and the discs of its joints come into the cell's square."""
    half = size / 2
    px, py = F.col("x") - F.col("x1"), F.col("y") - F.col("y1")
    beside = F.abs(py * F.col("ux") - px * F.col("uy")) < F.col("wide")
    beside &= (px * F.col("ux") + py * F.col("uy")).between(F.col("early"), F.col("late"))
    for c in ("x", "y"):
        beside &= F.col(c).between(F.col(f"{c}low"), F.col(f"{c}high"))

    def near(i: int) -> Column:
        gaps = [F.greatest(F.abs(F.col(c) - F.col(f"{c}{i}")) - half, F.lit(0.0)) for c in ("x", "y")]
        return F.col(f"joint{i}") & (gaps[0] * gaps[0] + gaps[1] * gaps[1] < dist * dist)

    return F.coalesce(beside, F.lit(False)), [near(1), near(2)]


def corridor_coverage_area(
    cells: DataFrame,
    pieces: DataFrame,
    dist: float,
    cell_size: float,
    bucket: float | None = None,
    keys: Sequence[str] = ("transect",),
) -> DataFrame:
    """Area and share of each square cell inside each line's corridor; cells with none are left out.

    Cells are given by their centres (cell_id, x, y). Corridors end flat where a line ends; where it
    goes on, the joint is round. Places that several pieces of a line reach count once. Pieces of no length
    have no strip; their ends meet in a joint. Cost grows with the cube of the pieces that one line has in one
    cell; ``union_lines`` joins pieces that lie on each other or go straight on.
    """
    reach = dist + cell_size * 0.5**0.5
    strip, joints = _reaches(cell_size, dist)
    near = candidate_cells(cells, pieces, reach, bucket, keys, _bounds(cell_size, dist)).withColumns(
        {"strip": strip, "near1": joints[0], "near2": joints[1]}
    )

    ends = [[F.col(f"{c}{i}") - F.col(c) for c in ("x", "y")] for i in (1, 2)]
    joined = F.array_compact(F.array(*[F.when(F.col(f"near{i}"), F.struct(*ends[i - 1])) for i in (1, 2)]))
    gathered = (
        near.filter(F.col("strip") | F.col("near1") | F.col("near2"))
        .groupBy(*keys, "cell_id")
        .agg(
            F.flatten(F.collect_list(F.when(F.col("strip"), F.array(*ends[0], *ends[1])))).alias("strips"),
            F.array_distinct(F.flatten(F.collect_list(joined))).alias("discs"),
        )
        .withColumn("discs", F.flatten(F.transform("discs", lambda e: F.array(e["col1"], e["col2"]))))
    )
    kept = [*keys, "cell_id"]
    kinds = ", ".join(f"{c} {gathered.schema[c].dataType.simpleString()}" for c in kept)
    measured = gathered.mapInArrow(_measured(dist, cell_size, kept), f"{kinds}, area double")
    return measured.filter(F.col("area") > 1e-9 * cell_size**2).withColumn("weight", F.col("area") / cell_size**2)
