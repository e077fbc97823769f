"""Grid geometry and coordinates as Column expressions; the few scalars of an area of interest are plain numbers.

A ring is array<struct<x,y>>; the grid's first axis runs along the rectangle's first side (north if it is not rotated) and
the second along its last side.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Axes of the reference ellipsoid and the radius of the spherical Mercator projection, metres.
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
MINOR = MAJOR * (1 - FLATTENING)
HALF_WORLD = math.pi * MAJOR

# Metres of a model unit.
UNITS = {"m": 1.0, "cm": 0.01, "mm": 0.001, "ft": 0.3048, "in": 0.0254}


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 20) -> Column:
    """Metres between two points on the ellipsoid by Vincenty's inverse formula, in a fixed number of rounds at most; good to
    less than a millimetre but for points that are nearly opposite. Null where a coordinate is. Over Arrow buffers, as built-in
    functions make all rounds for every row and each value of a round anew where it is used."""

    # inside, so that it goes to the workers by value
    def inverse(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
        """Vincenty's inverse formula; rounds end early where none changes any value."""
        f = FLATTENING
        u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
        apart = np.radians(lon2 - lon1)
        s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
        lam = apart
        for left in range(rounds, -1, -1):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s, cos_s = np.sqrt((c2 * sl) ** 2 + (c1 * s2 - s1 * c2 * cl) ** 2), s1 * s2 + c1 * c2 * cl
            sin_a = np.where(sin_s == 0, 0.0, c1 * c2 * sl / sin_s)
            cos2 = 1 - sin_a * sin_a
            mid = np.where(cos2 > 1e-15, cos_s - 2 * s1 * s2 / cos2, 0.0)
            s = np.arctan2(sin_s, cos_s)
            c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = apart + (1 - c) * f * sin_a * (s + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            if not left or np.array_equal(new, lam, equal_nan=True):
                break
            lam = new
        k = cos2 * ((MAJOR**2 - MINOR**2) / MINOR**2)
        a = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
        b = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
        inner = cos_s * (2 * mid**2 - 1) - b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)
        return MINOR * a * (s - b * sin_s * (mid + b / 4 * inner))

    @F.arrow_udf("double")
    def metres(lon1: pa.Array, lat1: pa.Array, lon2: pa.Array, lat2: pa.Array) -> pa.Array:
        given = [lon1, lat1, lon2, lat2]
        lost = np.logical_or.reduce([a.is_null().to_numpy(zero_copy_only=False) for a in given])
        with np.errstate(all="ignore"):
            out = inverse(*[a.to_numpy(zero_copy_only=False).astype(float) for a in given])
        return pa.array(out, mask=lost)

    return metres(*[c.cast("double") for c in (lon1, lat1, lon2, lat2)])


def grid_size(length: Column, mesh: float) -> tuple[Column, Column]:
    """Cells along a side of so many metres, at least one, and their exact size."""
    n = F.greatest(F.lit(1), (length / mesh + 0.5).cast("int"))
    return n, length / n


def with_geometry(areas: DataFrame, mesh: float, ring: str = "ring") -> DataFrame:
    """``areas`` with ni, nj, di, dj (cells and their metres along both axes) and u, v (degrees of a metre along them) of
    rectangles given as rings of at least four corners; others have nulls."""
    at = lambda n: F.get(ring, n)
    side = lambda n: geodesic(at(0)["x"], at(0)["y"], at(n)["x"], at(n)["y"])
    known = F.size(ring) >= 4
    out = areas.withColumns({"__a": F.when(known, side(1)), "__b": F.when(known, side(3))})
    for axis, name, corner in (("i", "__a", 1), ("j", "__b", 3)):
        n, size = grid_size(F.col(name), mesh)
        unit = F.struct(*[((at(corner)[c] - at(0)[c]) / F.col(name)).alias(c) for c in "xy"])
        out = out.withColumns({f"n{axis}": n, f"d{axis}": size, "u" if axis == "i" else "v": F.when(F.col(name) > 0, unit)})
    return out.drop("__a", "__b")


def to_metres(lon: Column, lat: Column, origin: tuple[float, float], u: tuple[float, float], v: tuple[float, float]) -> tuple[Column, Column]:
    """Metres along both axes of a grid whose axes have u and v degrees a metre."""
    det = u[0] * v[1] - u[1] * v[0]
    x, y = lon - origin[0], lat - origin[1]
    return (x * v[1] - y * v[0]) / det, (y * u[0] - x * u[1]) / det


def from_metres(a: Column, b: Column, origin: tuple[float, float], u: tuple[float, float], v: tuple[float, float]) -> tuple[Column, Column]:
    return origin[0] + a * u[0] + b * v[0], origin[1] + a * u[1] + b * v[1]


def cell_ring(i: Column, j: Column, origin: tuple[float, float], u: tuple[float, float], v: tuple[float, float], size: tuple[float, float]) -> Column:
    """The four corners of a cell."""
    corner = lambda a, b: point(*from_metres((i + a) * size[0], (j + b) * size[1], origin, u, v))
    return F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))


def bounds(ring: Column) -> Column:
    """struct(w, s, e, n) of a ring."""
    of = lambda c: F.transform(ring, lambda p: p[c])
    return F.struct(F.array_min(of("x")).alias("w"), F.array_min(of("y")).alias("s"), F.array_max(of("x")).alias("e"), F.array_max(of("y")).alias("n"))


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two bounds touch or overlap."""
    return (a["w"] <= b["e"]) & (b["w"] <= a["e"]) & (a["s"] <= b["n"]) & (b["s"] <= a["n"])


def closed(ring: Column) -> Column:
    """The ring with its first point at the end; null with fewer than three different ends, as no polygon."""
    whole = F.when(F.get(ring, 0) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(F.get(ring, 0))))
    return F.when(F.size(whole) >= 4, whole)


def swapped(ring: Column) -> Column:
    """x and y exchanged, always."""
    return F.transform(ring, lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y")))


def canonical_rectangles(areas: DataFrame, ring: str = "ring") -> DataFrame:
    """``areas`` with the corners of their rectangle from the start of its most northward side (Mercator bearing in
    [-90, 90)), the last corner to the right of that side; a fifth corner that closes the ring goes. Null unless there are
    four corners of valid degrees."""
    r, four = F.col(ring), F.array(*map(F.lit, range(4)))
    near = lambda a, b: F.abs(a - b) < 1e-9
    shut = (F.size(r) == 5) & near(F.get(r, 0)["x"], F.get(r, 4)["x"]) & near(F.get(r, 0)["y"], F.get(r, 4)["y"])
    out = areas.withColumn("__r", F.when(shut, F.slice(r, 1, 4)).otherwise(r))
    out = out.withColumn("__r", F.when((F.size("__r") == 4) & F.forall("__r", lambda p: (F.abs(p["x"]) <= 180) & (F.abs(p["y"]) <= 90)), F.col("__r")))
    out = out.withColumn("__m", F.transform("__r", lambda p: F.struct(*[c.alias(n) for c, n in zip(mercator(p["x"], p["y"]), "xy")])))
    angle = F.transform(four, lambda i: F.degrees(F.atan2(F.get("__m", (i + 1) % 4)["x"] - F.get("__m", i)["x"], F.get("__m", (i + 1) % 4)["y"] - F.get("__m", i)["y"])))
    ranked = F.transform(angle, lambda a, i: F.struct(F.when((a >= -90) & (a < 90), F.abs(a)).otherwise(F.lit(1e9)).alias("a"), i.alias("i")))
    out = out.withColumn("__first", F.array_min(ranked)["i"])
    turned = lambda n: F.transform(four, lambda k: F.get(n, (F.col("__first") + k) % 4))
    out = out.withColumns({n: turned(n) for n in ("__r", "__m")})
    away = lambda n, c: F.get("__m", n)[c] - F.get("__m", 0)[c]
    left = away(1, "x") * away(3, "y") - away(1, "y") * away(3, "x") > 0
    return out.withColumn(ring, F.when(F.get("__r", 0).isNotNull(), F.when(left, F.reverse("__r")).otherwise(F.col("__r")))).drop("__r", "__m", "__first")


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres."""
    return F.radians(lon) * MAJOR, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MAJOR


def tile_box(x: Column, y: Column, zoom: int) -> Column:
    """struct(w, s, e, n) of a map tile in spherical Mercator metres."""
    size = 2 * HALF_WORLD / (1 << zoom)
    return F.struct((x * size - HALF_WORLD).alias("w"), (HALF_WORLD - (y + 1) * size).alias("s"), ((x + 1) * size - HALF_WORLD).alias("e"), (HALF_WORLD - y * size).alias("n"))


def tiles_of(box: Column, size: float) -> Column:
    """South-west corners (x, y) of all tiles of so many degrees that a box meets, ends included."""
    run = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(run(box["w"], box["e"]), lambda a: F.transform(run(box["s"], box["n"]), lambda b: point(a * size, b * size))))


def tile_of_quadkey(key: Column) -> Column:
    """struct(x, y, level) of a quadkey; other signs than 0 to 3 set no bit."""
    zero = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))

    def step(a: Column, c: Column) -> Column:
        return F.struct((a["x"] * 2 + c.isin("1", "3").cast("long")).alias("x"), (a["y"] * 2 + c.isin("2", "3").cast("long")).alias("y"))

    return F.aggregate(F.filter(F.split(key, ""), lambda c: c != ""), zero, step, lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y"), F.length(key).alias("level")))


def mesh_box(code: Column) -> Column:
    """struct(w, s, e, n) of a standard grid code of 6 digits (cells of 5' by 7.5') or 8 (a tenth of those); null else."""
    digit = lambda a, n: F.substring(code, a, n).cast("int")
    tenth = F.length(code) == 8
    s = digit(1, 2) * 40.0 / 60 + digit(5, 1) / 12.0 + F.when(tenth, digit(7, 1) / 120.0).otherwise(0.0)
    w = 100.0 + digit(3, 2) + digit(6, 1) / 8.0 + F.when(tenth, digit(8, 1) / 80.0).otherwise(0.0)
    high, wide = F.when(tenth, 1 / 120).otherwise(1 / 12), F.when(tenth, 1 / 80).otherwise(1 / 8)
    return F.when(code.rlike("^([0-9]{6}|[0-9]{8})$"), F.struct(w.alias("w"), s.alias("s"), (w + wide).alias("e"), (s + high).alias("n")))


def box_ring(box: Column) -> Column:
    """Closed ring of a box, from the south-west corner eastward."""
    return F.array(point(box["w"], box["s"]), point(box["e"], box["s"]), point(box["e"], box["n"]), point(box["w"], box["n"]), point(box["w"], box["s"]))


def utc_hours(lon: Column) -> Column:
    """Hours from Greenwich by longitude alone, halves to even."""
    return F.bround(lon / 15.0)


def unit_scale(units: Column) -> Column:
    """Metres of a model unit in any case; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.lower(units))


# --- layouts ----------------------------------------------------------------------------------------------------------


def flipped(rows: DataFrame, ni: int) -> DataFrame:
    """Rows counted from the other end of the first axis: north-up to south-up and back."""
    return rows.withColumn("i", F.lit(ni - 1) - F.col("i"))


def transposed(rows: DataFrame) -> DataFrame:
    """Both axes exchanged, as raster files count them."""
    return rows.withColumns({"i": F.col("j"), "j": F.col("i")})


def rotated_raster(rows: DataFrame, nj: int) -> DataFrame:
    """Both axes exchanged and the first one then counted from its other end."""
    return rows.withColumns({"i": F.lit(nj - 1) - F.col("j"), "j": F.col("i")})


def north_up(rows: DataFrame, ni: int) -> DataFrame:
    """(row, col) of a raster whose first row is the northernmost."""
    return rows.withColumns({"row": F.lit(ni - 1) - F.col("i"), "col": F.col("j")})


def editor_axes(rows: DataFrame, nk: int) -> DataFrame:
    """Voxel axes of block editors: (j, k from the top, i)."""
    return rows.withColumns({"i": F.col("j"), "j": F.lit(nk - 1) - F.col("k"), "k": F.col("i")})


def scene(u: Column, v: Column, z: Column) -> Column:
    """Scene coordinates (east, north, up) of domain metres (north, east, up), and the other way round."""
    return F.struct(v.alias("x"), u.alias("y"), z.alias("z"))


def placed(x: Column, y: Column, z: Column, anchor: tuple[float, float, float], at: tuple[float, float, float], rotation: float, bearing: float, move: tuple[float, float, float], scale: float, mesh: float) -> tuple[Column, Column, Column]:
    """Grid indices of a model's point: from its anchor, in metres, turned counter-clockwise by ``rotation`` and into a grid
    whose first axis has a ``bearing`` clockwise from north; ``at`` is the anchor's place in grid metres and height."""
    t, p = math.radians(rotation), math.radians(bearing)
    a, b, c = (v - o for v, o in zip((x, y, z), anchor))
    east = (a * math.cos(t) - b * math.sin(t)) * scale + move[0]
    north = (a * math.sin(t) + b * math.cos(t)) * scale + move[1]
    first, second = east * math.sin(p) + north * math.cos(p), east * math.cos(p) - north * math.sin(p)
    return (at[0] + first) / mesh, (at[1] + second) / mesh, (at[2] + c * scale + move[2]) / mesh
