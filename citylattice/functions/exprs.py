"""Scalar operators as Column expressions; all of them stay inside whole-stage code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from citylattice.functions import dims


def half_up(x: Column) -> Column:
    """int(x + 0.5) of a value that is not negative; toward zero below."""
    return (x + 0.5).cast("int")


def quantise(v: Column, mesh: float) -> Column:
    return F.floor(v / mesh + 0.5) * F.lit(mesh)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))


def web_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """XYZ tile of a point in Web Mercator."""
    n = float(1 << zoom)
    rad = F.radians(lat)
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / F.lit(3.141592653589793)) / 2.0 * n)
    return x.cast("int"), y.cast("int")


def tile_corner(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """Longitude and latitude of a tile's north-west corner."""
    n = float(1 << zoom)
    return x / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1.0 - y * 2.0 / n))))


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """Bing quadkey of a tile."""
    digit = [F.shiftright(x, b) % 2 + F.shiftright(y, b) % 2 * 2 for b in range(zoom - 1, -1, -1)]
    return F.concat(*[d.cast("int").cast("string") for d in digit])


def axis_vector(azimuth: Column, elevation: Column, rotation: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """(north, east, up) of a direction in a grid that is rotated clockwise."""
    a, e = F.radians(azimuth - rotation), F.radians(elevation)
    return F.cos(e) * F.cos(a), F.cos(e) * F.sin(a), F.sin(e)


def tregenza_index(azimuth: Column, elevation: Column) -> Column:
    """Patch 0..144 of a sun position, -1 below the horizon."""
    out, offset = F.lit(144), 0
    cases = []
    for upper, n, _ in dims.TREGENZA[:-1]:
        place = F.least(F.floor(((azimuth % 360.0) + 360.0) % 360.0 / F.lit(360.0 / n)).cast("int"), F.lit(n - 1))
        cases.append((upper, F.lit(offset) + place))
        offset += n
    for upper, value in reversed(cases):
        out = F.when(elevation < upper, value).otherwise(out)
    return F.when(elevation < 0, F.lit(-1)).otherwise(out).cast("int")


def surface_kind(nx: Column, ny: Column, nz: Column) -> Column:
    return F.when(nz > 0.5, "roof").when(nz < -0.5, "bottom").when((F.abs(nx) > 0.2) | (F.abs(ny) > 0.2), "wall").otherwise("other")


def wall_orientation(nx: Column, ny: Column, nz: Column) -> Column:
    """Compass side of a wall; x is east, y is north."""
    side = F.when(F.abs(ny) >= F.abs(nx), F.when(ny > 0, "N").otherwise("S")).otherwise(F.when(nx > 0, "E").otherwise("W"))
    return F.when(F.abs(nz) <= 0.5, side)


def face_key(building: Column, centroid: tuple, normal: tuple, index: Column) -> Column:
    mm = lambda v: F.bround(v * 1000).cast("long").cast("string")
    return F.concat(F.lit("b"), building.cast("string"), F.lit(":c"), F.concat_ws("_", *map(mm, centroid)), F.lit(":n"), F.concat_ws("_", *map(mm, normal)), F.lit(":i"), index.cast("string"))


def voxel_name(code: Column) -> Column:
    """Name of a voxel code."""
    out = reduce(lambda w, ic: w.when(code == ic[0] + 1, ic[1]), enumerate(dims.STANDARD), F.when(code == dims.AIR, "Air"))
    return out.when(code == dims.GROUND, "Ground").when(code == dims.TREE, "Tree").when(code == dims.BUILDING, "Building").otherwise("Unknown")


def albedo(code: Column) -> Column:
    values = F.array(*[F.lit(a) for a in dims.ALBEDO])
    return F.when(code.between(0, len(dims.ALBEDO) - 1), F.get(values, code)).otherwise(dims.ALBEDO_OTHER)


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Crossing parity of a point against array<struct<x,y>>; the ring need not be closed."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        between = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) * (b["x"] - a["x"])
        return F.when(between & (x < at), 1).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + crosses(i))
    return F.when(n >= 3, total % 2 == 1).otherwise(F.lit(False))


def shoelace(ring: Column) -> Column:
    """Area of array<struct<x,y>>."""

    def area(r: Column) -> Column:
        n = F.size(r)

        def term(i: Column) -> Column:
            a, b = F.get(r, i), F.get(r, (i + 1) % n)
            return a["x"] * b["y"] - b["x"] * a["y"]

        return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + term(i))) / 2

    # a list of one names the ring, which is otherwise made anew wherever it stands
    return F.get(F.transform(F.array(ring), area), 0)


def affine(i: Column, j: Column, origin: tuple[float, float], u: tuple[float, float], v: tuple[float, float], half: float = 0.5) -> tuple[Column, Column]:
    """Longitude and latitude of a cell's centre in a rotated grid with unit steps u and v."""
    a, b = i + half, j + half
    return F.lit(origin[0]) + a * u[0] + b * v[0], F.lit(origin[1]) + a * u[1] + b * v[1]


def cell_of(lon: Column, lat: Column, origin: tuple[float, float], u: tuple[float, float], v: tuple[float, float]) -> tuple[Column, Column]:
    """Cell of a point in the same grid."""
    det = u[0] * v[1] - u[1] * v[0]
    x, y = lon - origin[0], lat - origin[1]
    place = lambda t: F.floor(t + 1e-12).cast("int")
    return place((x * v[1] - y * v[0]) / det), place((y * u[0] - x * u[1]) / det)


def rotation_angle(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Clockwise bearing of a side in Web Mercator, degrees, tiny ones as 0."""
    north = lambda lat: F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))
    angle = F.degrees(F.atan2(F.radians(lon1 - lon0), north(lat1) - north(lat0)))
    return F.when(F.abs(angle) < 1e-6, 0.0).otherwise(F.round(angle, 6))
