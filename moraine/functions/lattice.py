"""Areas, map projection and lattices as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import in_ring

# fixed values: named areas of interest as rings and boxes, longitude and latitude
RINGS = {
    "source": [
        (85.46451876449485, 28.345047192655944), (85.46623537826439, 28.277644183693493), (85.48958132553001, 28.247707190492925), (85.53558657455345, 28.245287672353218), (85.55618593978782, 28.260106359331573),
        (85.55069277572532, 28.290342185190823), (85.54931948470970, 28.311199899644855), (85.53558657455345, 28.330240328302096), (85.51018069076439, 28.340212525080158), (85.49644778060814, 28.352903058100104),
    ],
    "langtang": [
        (85.46683434336315, 28.324709534140283), (85.45910958140026, 28.277704299412660), (85.47267083017955, 28.253664665263376), (85.50734379401987, 28.245345485689977), (85.53583958259410, 28.244740597906280), (85.55884220710581, 28.249882034713380),
        (85.56485035529917, 28.272864249930198), (85.56193211189097, 28.289493024692200), (85.55918552985972, 28.307177143980763), (85.54854252448862, 28.316849264798610), (85.52468159309214, 28.328333765691790), (85.50614216438120, 28.329693690212682),
    ],
    "lhende": [(85.44, 28.34), (85.62, 28.34), (85.62, 28.47), (85.44, 28.47)],
}
BOXES = {"source": (85.46452, 28.24529, 85.55619, 28.35290), "langtang": (85.45911, 28.24474, 85.56485, 28.32969), "lhende": (85.44, 28.34, 85.62, 28.47), "blatten": (7.75, 46.38, 7.90, 46.46)}

_A, _FLAT = 6378137.0, 1 / 298.257223563
_N = _FLAT / (2 - _FLAT)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_SCALE, _EAST = 0.9996, 500000.0


def area(name: str) -> list[tuple[float, float]]:
    """The ring of a named area; an unknown name is an error."""
    try:
        return RINGS[name]
    except KeyError:
        raise ValueError(f"unknown area {name!r}: known are {', '.join(sorted(RINGS))}") from None


def in_area(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Inside a ring, the box first: the two comparisons reach the scan, the ray is cast for what passes."""
    xs, ys = zip(*ring, strict=True)
    return lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys)) & in_ring(lon, lat, ring)


def to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Northern-hemisphere transverse Mercator metres on the WGS 84 ellipsoid, by the third-order series in n."""
    n = _N
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum((a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(alpha)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(alpha)), F.lit(0.0))
    return _EAST + _SCALE * _RADIUS * x, _SCALE * _RADIUS * y


def from_utm(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude of transverse Mercator metres."""
    n = _N
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = y / (_SCALE * _RADIUS), (x - _EAST) / (_SCALE * _RADIUS)
    p = xi - sum((b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(beta)), F.lit(0.0))
    q = eta - sum((b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(beta)), F.lit(0.0))
    chi = F.asin(F.sin(p) / F.cosh(q))
    lat = chi + sum((d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(delta)), F.lit(0.0))
    return (6 * zone - 183) + F.degrees(F.atan2(F.sinh(q), F.cos(p))), F.degrees(lat)


def cell_centre(row: Column, col: Column, x0: float, y1: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Map position of a north-up cell's centre."""
    return x0 + (col + 0.5) * dx, y1 - (row + 0.5) * dy


def common_grid(box: tuple[float, float, float, float], width: int, height: int) -> dict[str, float]:
    """Lattice from an area's bounds and a grid's shape, never from a band's own posting."""
    x0, y0, x1, y1 = box
    return {"x0": x0, "y1": y1, "dx": (x1 - x0) / width, "dy": (y1 - y0) / height, "width": width, "height": height}
