"""Equal-area conic coordinates and datum shifts, as column expressions.

Grids of other sources come in the systems of their makers: transect lines and cells meet in one of
equal area, and coordinates of an older datum are moved by its seven parameters first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    """Half the long axis in metres, and the inverse flattening; the default is GRS80."""

    a: float = 6378137.0
    inverse_flattening: float = 298.257222101

    @property
    def e2(self) -> float:
        f = 1 / self.inverse_flattening
        return f * (2 - f)


@dataclass(frozen=True)
class AlbersConic:
    """An Albers system by two standard parallels; the default is that of the continental states."""

    ellipsoid: Ellipsoid = Ellipsoid()
    lat1: float = 29.5
    lat2: float = 45.5
    lat0: float = 23.0
    lon0: float = -96.0
    false_easting: float = 0.0
    false_northing: float = 0.0

    def zone(self, lat: float) -> float:
        """The authalic term of a latitude in degrees."""
        s, e2 = math.sin(math.radians(lat)), self.ellipsoid.e2
        e = math.sqrt(e2)
        return (1 - e2) * (s / (1 - e2 * s * s) + math.atanh(e * s) / e)

    def width(self, lat: float) -> float:
        s = math.sin(math.radians(lat))
        return math.cos(math.radians(lat)) / math.sqrt(1 - self.ellipsoid.e2 * s * s)

    @property
    def n(self) -> float:
        if self.lat1 == self.lat2:
            return math.sin(math.radians(self.lat1))
        return (self.width(self.lat1) ** 2 - self.width(self.lat2) ** 2) / (self.zone(self.lat2) - self.zone(self.lat1))

    @property
    def c(self) -> float:
        return self.width(self.lat1) ** 2 + self.n * self.zone(self.lat1)

    @property
    def rho0(self) -> float:
        return self.ellipsoid.a * math.sqrt(self.c - self.n * self.zone(self.lat0)) / self.n

    @property
    def latitude_terms(self) -> tuple[float, ...]:
        e2 = self.ellipsoid.e2
        return (
            e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040,
            23 * e2**2 / 360 + 251 * e2**3 / 3780,
            761 * e2**3 / 45360,
        )


def project_albers(
    df: DataFrame, conic: AlbersConic = AlbersConic(), lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y"
) -> DataFrame:
    """Longitude and latitude in degrees to plane coordinates that keep areas."""
    e2, n = conic.ellipsoid.e2, conic.n
    e = math.sqrt(e2)
    s = F.sin(F.radians(lat))
    zone = (s / (1 - s * s * e2) + F.atanh(s * e) / e) * (1 - e2)
    rho = F.sqrt(conic.c - zone * n) * (conic.ellipsoid.a / n)
    theta = F.radians(F.col(lon) - conic.lon0) * n
    return df.withColumns(
        {
            x: rho * F.sin(theta) + conic.false_easting,
            y: conic.rho0 - rho * F.cos(theta) + conic.false_northing,
        }
    )


def unproject_albers(
    df: DataFrame, conic: AlbersConic = AlbersConic(), x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Plane coordinates back to longitude and latitude in degrees, to about a centimetre."""
    n, side = conic.n, math.copysign(1.0, conic.n)
    east, north = F.col(x) - conic.false_easting, conic.rho0 - (F.col(y) - conic.false_northing)
    zone = (conic.c - (east * east + north * north) * (n / conic.ellipsoid.a) ** 2) / n
    beta = F.asin(zone / conic.zone(90.0))
    latitude = beta
    for j, term in enumerate(conic.latitude_terms, start=1):
        latitude = latitude + F.sin(beta * 2 * j) * term
    turn = F.atan2(east * side, north * side) / n
    return df.withColumns({lon: F.degrees(turn) + conic.lon0, lat: F.degrees(latitude)})


@dataclass(frozen=True)
class DatumShift:
    """Seven parameters of a datum: shifts in metres, rotations in seconds of arc (of the position vector),
    and the scale in parts per million."""

    source: Ellipsoid
    target: Ellipsoid = Ellipsoid()
    dx: float = 0.0
    dy: float = 0.0
    dz: float = 0.0
    rx: float = 0.0
    ry: float = 0.0
    rz: float = 0.0
    ppm: float = 0.0


def _geocentric(lon: Column, lat: Column, on: Ellipsoid) -> tuple[Column, Column, Column]:
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    across = on.a / F.sqrt(1 - s * s * on.e2)
    return across * c * F.cos(F.radians(lon)), across * c * F.sin(F.radians(lon)), across * (1 - on.e2) * s


def shift_datum(df: DataFrame, shift: DatumShift, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Longitude and latitude of points at the ellipsoid's height, moved to another datum."""
    x, y, z = _geocentric(F.col(lon), F.col(lat), shift.source)
    rx, ry, rz = (math.radians(r / 3600) for r in (shift.rx, shift.ry, shift.rz))
    k = 1 + shift.ppm * 1e-6
    moved = df.withColumns(
        {
            "__x": (x - y * rz + z * ry) * k + shift.dx,
            "__y": (x * rz + y - z * rx) * k + shift.dy,
            "__z": (y * rx - x * ry + z) * k + shift.dz,
        }
    )
    # Bowring's formula; one step is exact to far below a millimetre near the ground
    a, e2 = shift.target.a, shift.target.e2
    b = a * math.sqrt(1 - e2)
    flat = F.sqrt(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y"))
    reduced = F.atan2(F.col("__z") * a, flat * b)
    rise = F.col("__z") + F.pow(F.sin(reduced), 3) * (e2 / (1 - e2) * b)
    run = flat - F.pow(F.cos(reduced), 3) * (e2 * a)
    return moved.withColumns(
        {lon: F.degrees(F.atan2("__y", "__x")), lat: F.degrees(F.atan2(rise, run))}
    ).drop("__x", "__y", "__z")
