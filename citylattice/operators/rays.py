"""Rays through the voxel relation: crossings of grid planes as arrays, voxels by look-up, transmission by aggregation.

A ray is cut at every plane it crosses inside the model. The crossing list of a ray is one sorted array, so that no state
passes between rows; each piece is looked up in the packed column under its middle. Observers may be any number: only the
directions, whose number is a parameter, are broadcast.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citylattice.functions import dims
from citylattice.session import parts

CUTOFF = 0.01


def directions(spark: SparkSession, n_azimuth: int, n_elevation: int, low: float, high: float) -> DataFrame:
    """(ray, dx, dy, dz): azimuths times elevations, both bounds included."""
    step = (high - low) / (n_elevation - 1) if n_elevation > 1 else 0.0
    az, el = F.radians(F.floor(F.col("id") / n_elevation) * (360.0 / n_azimuth)), F.radians(F.lit(low) + F.col("id") % n_elevation * step)
    return spark.range(n_azimuth * n_elevation).select(F.col("id").cast("int").alias("ray"), (F.cos(el) * F.cos(az)).alias("dx"), (F.cos(el) * F.sin(az)).alias("dy"), F.sin(el).alias("dz"))


def fibonacci(spark: SparkSession, n: int, low: float, high: float) -> DataFrame:
    """(ray, dx, dy, dz): golden-angle spiral between two elevations."""
    s0, s1 = math.sin(math.radians(low)), math.sin(math.radians(high))
    golden = math.pi * (3.0 - math.sqrt(5.0))
    z = F.lit(s0) + (F.col("id") + 0.5) / n * (s1 - s0)
    r, a = F.sqrt(F.greatest(F.lit(0.0), 1.0 - z * z)), F.col("id") * golden
    return spark.range(n).select(F.col("id").cast("int").alias("ray"), (r * F.cos(a)).alias("dx"), (r * F.sin(a)).alias("dy"), z.alias("dz"))


def _planes(o: Column, d: Column, n: Column) -> Column:
    """Distances at which a ray from a voxel centre crosses the planes between voxels, and the model's edge."""
    ahead = F.when(d > 1e-9, F.transform(F.sequence(F.lit(0), F.floor(n - 0.5 - o).cast("int")), lambda s: (s + 0.5) / d))
    back = F.when(d < -1e-9, F.transform(F.sequence(F.lit(0), F.floor(o).cast("int")), lambda s: (s + 0.5) / -d))
    return F.coalesce(ahead, back, F.array().cast("array<double>"))


def pieces(observers: DataFrame, rays: DataFrame, shape: tuple[int, int, int], carry: tuple = ()) -> DataFrame:
    """(i, j, ray, n, vi, vj, vk, length): the voxels of each ray in order, from observers (i, j, k)."""
    ni, nj, nk = shape
    out = F.least(*[F.when(F.col(d) > 1e-9, (n - 0.5 - F.col(o)) / F.col(d)).when(F.col(d) < -1e-9, (F.col(o) + 0.5) / -F.col(d)).otherwise(F.lit(1e18)) for o, d, n in (("i", "dx", ni), ("j", "dy", nj), ("k", "dz", nk))])
    cast = observers.where("k is not null").join(F.broadcast(rays))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), *[_planes(F.col(o), F.col(d), F.lit(n)) for o, d, n in (("i", "dx", ni), ("j", "dy", nj), ("k", "dz", nk))])))
    bounded = cast.withColumn("far", out).withColumn("cuts", cuts).withColumn("cuts", F.filter("cuts", lambda t: t <= F.col("far") + 1e-9))
    each = bounded.select(*carry, "i", "j", "k", "ray", "dx", "dy", "dz", "cuts", F.posexplode(F.slice("cuts", F.lit(1), F.size("cuts") - 1)).alias("n", "t"))
    nxt = F.get("cuts", F.col("n") + 1)
    mid = (F.col("t") + nxt) / 2
    at = [F.floor(F.col(o) + 0.5 + F.col(d) * mid).cast("int").alias(v) for o, d, v in (("i", "dx", "vi"), ("j", "dy", "vj"), ("k", "dz", "vk"))]
    return each.select(*carry, "i", "j", "ray", "n", *at, (nxt - F.col("t")).alias("length"))


def view(observers: DataFrame, rays: DataFrame, columns: DataFrame, shape: tuple[int, int, int], targets: tuple = (0,), inclusion: bool = False, tree_k: float = 0.6, lad: float = 1.0, mesh: float = 1.0) -> DataFrame:
    """(i, j, value): mean contribution of the rays of each observer.

    Without ``inclusion`` a ray counts by its transmission through trees unless it meets a voxel that is neither a target
    nor tree (targets are what may be passed). With it, a ray counts once it meets a target before anything else solid; if
    trees are targets too, it counts by what the first tree voxel takes of it, and other targets count nothing.
    Rays whose transmission falls below the cut-off count nothing.
    """
    side = columns.select(F.col("i").alias("vi"), F.col("j").alias("vj"), "codes")
    steps = pieces(observers, rays, shape).join(side, ["vi", "vj"]).withColumn("code", F.coalesce(F.get("codes", F.col("vk")), F.lit(dims.AIR)))
    code = F.col("code")
    if inclusion:
        goal, stop = code.isin(*targets), (code != dims.AIR) & (code != dims.TREE) & ~code.isin(*targets)
        if dims.TREE in targets:
            met = steps.groupBy("i", "j", "ray").agg(F.min(F.when(goal, F.struct("n", "code", "length"))).alias("hit"), F.min(F.when(stop, F.col("n"))).alias("end"))
            first = met.where("hit is not null and (end is null or hit.n < end)").select("i", "j", "ray", "hit.code", F.exp(-tree_k * lad * mesh * F.col("hit.length")).alias("t"))
            taken = met.select("i", "j", "ray").join(first, ["i", "j", "ray"], "left")
            return taken.groupBy("i", "j").agg(F.avg(F.when((F.col("code") == dims.TREE) & (F.col("t") >= CUTOFF), 1.0 - F.col("t")).otherwise(0.0)).alias("value"))
    else:
        goal, stop = F.lit(False), ~code.isin(*targets) & (code != dims.TREE)
    first = steps.groupBy("i", "j", "ray").agg(F.min(F.when(goal, F.col("n"))).alias("hit"), F.min(F.when(stop, F.col("n"))).alias("end"), F.collect_list(F.when((code == dims.TREE), F.struct("n", "length"))).alias("trees"))
    last = F.least("hit", "end")
    depth = F.aggregate(F.array_sort("trees"), F.lit(0.0), lambda a, x: a + F.when(last.isNull() | (x["n"] < last), x["length"]).otherwise(0.0))
    through = F.exp(-tree_k * lad * mesh * depth)
    passed = F.when(through < CUTOFF, 0.0).otherwise(through)
    if inclusion:
        worth = F.when(F.col("hit").isNotNull() & (F.col("end").isNull() | (F.col("hit") < F.col("end"))), F.when(passed > 0, 1.0).otherwise(0.0)).otherwise(0.0)
    else:
        worth = F.when(F.col("end").isNull(), passed).otherwise(0.0)
    return first.select("i", "j", worth.alias("w")).groupBy("i", "j").agg(F.avg("w").alias("value"))


def landmark_visible(observers: DataFrame, landmarks: DataFrame, columns: DataFrame) -> DataFrame:
    """(i, j, visible): whether an observer sees the centre of any landmark voxel (i, j, k), all else but air being opaque.
    Landmarks go out in slices of a checked size, and whoever sees one of any slice sees one."""
    found = [_seen(observers, part, columns) for part in parts(landmarks.select("i", "j", "k"))]
    seen = reduce(DataFrame.union, found).distinct().withColumn("visible", F.lit(1))
    return observers.select("i", "j", "k").join(seen, ["i", "j"], "left").select("i", "j", F.when(F.col("k").isNotNull(), F.coalesce("visible", F.lit(0))).alias("visible"))


def _seen(observers: DataFrame, landmarks: DataFrame, columns: DataFrame) -> DataFrame:
    to = F.broadcast(landmarks.select(F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("k").alias("tk")))
    pairs = observers.where("k is not null").join(to).where("i <> ti or j <> tj or k <> tk")
    length = F.greatest(F.abs(F.col("ti") - F.col("i")), F.abs(F.col("tj") - F.col("j")), F.abs(F.col("tk") - F.col("k")))
    # one sample in every layer of the longest axis between the two ends
    steps = pairs.withColumn("long", length).withColumn("s", F.explode(F.filter(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), lambda s: s < length)))
    at = [F.floor(F.col(o) + 0.5 + (F.col(t) - F.col(o)) * F.col("s") / F.col("long")).cast("int").alias(v) for o, t, v in (("i", "ti", "vi"), ("j", "tj", "vj"), ("k", "tk", "vk"))]
    side = columns.select(F.col("i").alias("vi"), F.col("j").alias("vj"), "codes")
    target = ["ti", "tj", "tk"]
    blocked = steps.select("i", "j", *target, *at).join(side, ["vi", "vj"]).where(F.coalesce(F.get("codes", F.col("vk")), F.lit(0)) != 0).select("i", "j", *target).distinct()
    return pairs.select("i", "j", *target).join(blocked, ["i", "j", *target], "left_anti").select("i", "j").distinct()


def transmissions(observers: DataFrame, rays: DataFrame, columns: DataFrame, shape: tuple[int, int, int], tree_k: float = 0.6, lad: float = 1.0, mesh: float = 1.0) -> DataFrame:
    """(i, j, ray, through): what trees let through of each ray to the sky, 0 where something solid stands in the way."""
    side = columns.select(F.col("i").alias("vi"), F.col("j").alias("vj"), "codes")
    code = F.coalesce(F.get("codes", F.col("vk")), F.lit(dims.AIR))
    steps = pieces(observers, rays, shape).join(side, ["vi", "vj"]).withColumn("code", code)
    got = steps.groupBy("i", "j", "ray").agg(F.bool_or(~F.col("code").isin(dims.AIR, dims.TREE)).alias("stop"), F.coalesce(F.sum(F.when(F.col("code") == dims.TREE, F.col("length"))), F.lit(0.0)).alias("depth"))
    through = F.exp(-tree_k * lad * mesh * F.col("depth"))
    return got.select("i", "j", "ray", F.when(F.col("stop") | (through < CUTOFF), 0.0).otherwise(through).alias("through"))


def face_openness(faces: DataFrame, rays: DataFrame, columns: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(i, j, k, di, dj, dk, value): cosine-weighted share of the sky that each face (as of ``voxels.faces``) sees, from the
    voxel before it; rays from behind the face count nothing."""
    key = ["i", "j", "k", "di", "dj", "dk"]
    front = faces.select(*[F.col(c).alias(f"f_{c}") for c in key], *[(F.col(a) + F.col(b)).alias(a) for a, b in (("i", "di"), ("j", "dj"), ("k", "dk"))])
    ni, nj, nk = shape
    inner = front.where(F.col("i").between(0, ni - 1) & F.col("j").between(0, nj - 1) & F.col("k").between(0, nk - 1))
    places = inner.select("i", "j", "k").distinct()
    side = columns.select(F.col("i").alias("vi"), F.col("j").alias("vj"), "codes")
    # a place is named by one number in the ray operator's first key
    named = places.select((F.col("i") * nk + F.col("k")).alias("slot"), "i", "j", "k")
    cast = pieces_from(named, rays, shape).join(side, ["vi", "vj"]).withColumn("code", F.coalesce(F.get("codes", F.col("vk")), F.lit(dims.AIR)))
    seen = cast.groupBy("slot", "j", "ray").agg(F.bool_or(~F.col("code").isin(dims.AIR, dims.TREE)).alias("stop"))
    cosine = F.col("f_di") * F.col("dx") + F.col("f_dj") * F.col("dy") + F.col("f_dk") * F.col("dz")
    lit = inner.withColumn("slot", F.col("i") * nk + F.col("k")).join(seen, ["slot", "j"]).join(F.broadcast(rays), "ray").where((cosine > 1e-9) & (F.col("dz") > 0))
    return lit.groupBy(*[f"f_{c}" for c in key]).agg((F.sum(F.when(~F.col("stop"), cosine)) / F.sum(cosine)).alias("value")).select(*[F.col(f"f_{c}").alias(c) for c in key], F.coalesce("value", F.lit(0.0)).alias("value"))


def pieces_from(places: DataFrame, rays: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """``pieces`` for places (slot, i, j, k), of which several may stand in one column; slot takes the place of i."""
    got = pieces(places.select("i", "j", "k", "slot"), rays, shape, carry=("slot",))
    return got.select("slot", "j", "ray", "n", "vi", "vj", "vk", "length")


def reflect(direct: DataFrame, links: DataFrame, bounces: int = 3) -> DataFrame:
    """(surface, total): direct (surface, flux, albedo) and what comes over links (source, target, share) in a few bounces;
    links of a share of 0.01 or less count nothing. Each bounce is one join and one sum, and cuts its lineage."""
    from citylattice.session import cut

    out = direct.select("surface", F.col("flux").alias("total"), (F.col("flux") * F.col("albedo")).alias("leaving"), "albedo")
    strong = links.where("share > 0.01")
    for _ in range(bounces):
        gain = out.select(F.col("surface").alias("source"), "leaving").where("leaving > 0.01").join(strong, "source").groupBy(F.col("target").alias("surface")).agg(F.sum(F.col("leaving") * F.col("share")).alias("gain"))
        out = cut(out.join(gain, "surface", "left").select("surface", (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total"), (F.coalesce("gain", F.lit(0.0)) * F.col("albedo")).alias("leaving"), "albedo"))
    return out.select("surface", "total")


def face_transmissions(faces: DataFrame, rays: DataFrame, columns: DataFrame, shape: tuple[int, int, int], tree_k: float = 0.6, lad: float = 1.0, mesh: float = 1.0) -> DataFrame:
    """(i, j, k, di, dj, dk, ray, angle, through): of each face and each ray before it the cosine between both and what trees
    let through from the voxel before the face, 0 where something solid stands in the way."""
    key = ["i", "j", "k", "di", "dj", "dk"]
    ni, nj, nk = shape
    front = faces.select(*[F.col(c).alias(f"f_{c}") for c in key], *[(F.col(a) + F.col(b)).alias(a) for a, b in (("i", "di"), ("j", "dj"), ("k", "dk"))])
    inner = front.where(F.col("i").between(0, ni - 1) & F.col("j").between(0, nj - 1) & F.col("k").between(0, nk - 1)).withColumn("slot", F.col("i") * nk + F.col("k"))
    side = columns.select(F.col("i").alias("vi"), F.col("j").alias("vj"), "codes")
    steps = pieces_from(inner.select("slot", "i", "j", "k").distinct(), rays, shape).join(side, ["vi", "vj"]).withColumn("code", F.coalesce(F.get("codes", F.col("vk")), F.lit(dims.AIR)))
    got = steps.groupBy("slot", "j", "ray").agg(F.bool_or(~F.col("code").isin(dims.AIR, dims.TREE)).alias("stop"), F.coalesce(F.sum(F.when(F.col("code") == dims.TREE, F.col("length"))), F.lit(0.0)).alias("depth"))
    through = F.exp(-tree_k * lad * mesh * F.col("depth"))
    angle = F.col("f_di") * F.col("dx") + F.col("f_dj") * F.col("dy") + F.col("f_dk") * F.col("dz")
    seen = inner.join(got, ["slot", "j"]).join(F.broadcast(rays), "ray").withColumn("angle", angle).where("angle > 1e-9")
    return seen.select(*[F.col(f"f_{c}").alias(c) for c in key], "ray", "angle", F.when(F.col("stop") | (through < CUTOFF), 0.0).otherwise(through).alias("through"))


def face_landmarks(faces: DataFrame, landmarks: DataFrame, columns: DataFrame) -> DataFrame:
    """(i, j, k, di, dj, dk, visible): whether a face sees the centre of a landmark voxel that lies before it, from the voxel
    in front of the face. Landmarks go out in slices of a checked size."""
    key = ["i", "j", "k", "di", "dj", "dk"]
    front = faces.select(*key, *[(F.col(a) + F.col(b)).alias(f"o{a}") for a, b in (("i", "di"), ("j", "dj"), ("k", "dk"))])
    side = columns.select(F.col("i").alias("vi"), F.col("j").alias("vj"), "codes")
    found = []
    for part in parts(landmarks.select("i", "j", "k")):
        to = F.broadcast(part.select(F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("k").alias("tk")))
        gap = {a: F.col(f"t{a}") - F.col(f"o{a}") for a in "ijk"}
        pairs = front.join(to).where(gap["i"] * F.col("di") + gap["j"] * F.col("dj") + gap["k"] * F.col("dk") + 0.5 > 0)
        long = F.greatest(*[F.abs(gap[a]) for a in "ijk"])
        between = F.when(long > 1, F.sequence(F.lit(1), long - 1)).otherwise(F.array().cast("array<int>"))
        steps = pairs.withColumn("long", long).withColumn("s", F.explode(between))
        at = [F.floor(F.col(f"o{a}") + 0.5 + gap[a] * F.col("s") / F.col("long")).cast("int").alias(f"v{a}") for a in "ijk"]
        target = ["ti", "tj", "tk"]
        blocked = steps.select(*key, *target, *at).join(side, ["vi", "vj"]).where(F.coalesce(F.get("codes", F.col("vk")), F.lit(0)) != 0).select(*key, *target).distinct()
        found.append(pairs.select(*key, *target).join(blocked, [*key, *target], "left_anti").select(*key))
    seen = reduce(DataFrame.union, found).distinct().withColumn("visible", F.lit(1))
    return faces.select(*key).join(seen, key, "left").withColumn("visible", F.coalesce("visible", F.lit(0)))


def rotated(vector: tuple, axis: tuple, angle: Column) -> tuple[Column, Column, Column]:
    """A vector turned about an axis by radians; an axis without length turns nothing."""
    n = F.sqrt(axis[0] * axis[0] + axis[1] * axis[1] + axis[2] * axis[2])
    u = [a / n for a in axis]
    dot = vector[0] * u[0] + vector[1] * u[1] + vector[2] * u[2]
    cross = (u[1] * vector[2] - u[2] * vector[1], u[2] * vector[0] - u[0] * vector[2], u[0] * vector[1] - u[1] * vector[0])
    return tuple(F.when(n < 1e-12, v).otherwise(v * F.cos(angle) + c * F.sin(angle) + a * dot * (1 - F.cos(angle))) for v, c, a in zip(vector, cross, u))


def face_basis(nx: Column, ny: Column, nz: Column) -> tuple[tuple, tuple, tuple]:
    """Two directions in a face's plane and its unit normal."""
    size = F.sqrt(nx * nx + ny * ny + nz * nz)
    n = [c / size for c in (nx, ny, nz)]
    flat = F.abs(n[2]) >= 0.999
    # the upright axis crossed with the normal; for level faces the first axis
    raw = (F.when(flat, F.lit(0.0)).otherwise(-n[1]), F.when(flat, -n[2]).otherwise(n[0]), F.when(flat, n[1]).otherwise(F.lit(0.0)))
    long = F.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2])
    u = tuple(c / long for c in raw)
    v = (n[1] * u[2] - n[2] * u[1], n[2] * u[0] - n[0] * u[2], n[0] * u[1] - n[1] * u[0])
    return u, v, tuple(n)


def box_hit(origin: tuple, direction: tuple, low: tuple, high: tuple, nearest: float = 0.0, farthest: float = 1e30) -> Column:
    """struct(hit, enter, leave) of rays and boxes by slabs."""
    enter, leave, hit = F.lit(nearest), F.lit(farthest), F.lit(True)
    for o, d, a, b in zip(origin, direction, low, high):
        level = F.abs(d) < 1e-10
        s, t = (a - o) / F.when(~level, d), (b - o) / F.when(~level, d)
        enter, leave = F.when(level, enter).otherwise(F.greatest(enter, F.least(s, t))), F.when(level, leave).otherwise(F.least(leave, F.greatest(s, t)))
        hit = hit & ~(level & ((o < a) | (o > b)))
    return F.struct((hit & (enter <= leave)).alias("hit"), enter.alias("enter"), leave.alias("leave"))


def first_hit(observers: DataFrame, rays: DataFrame, columns: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(i, j, ray, vi, vj, vk, code): the first voxel on each ray that is neither air nor tree, null where there is none."""
    side = columns.select(F.col("i").alias("vi"), F.col("j").alias("vj"), "codes")
    steps = pieces(observers, rays, shape).join(side, ["vi", "vj"]).withColumn("code", F.coalesce(F.get("codes", F.col("vk")), F.lit(dims.AIR)))
    met = steps.groupBy("i", "j", "ray").agg(F.min(F.when(~F.col("code").isin(dims.AIR, dims.TREE), F.struct("n", "vi", "vj", "vk", "code"))).alias("h"))
    return met.select("i", "j", "ray", "h.vi", "h.vj", "h.vk", "h.code")


def between(pairs: DataFrame, columns: DataFrame, tree_k: float = 0.6, lad: float = 1.0, mesh: float = 1.0) -> DataFrame:
    """(pair, through): what is let through between two voxel centres (pair, i, j, k, ti, tj, tk), by one sample in each layer
    of the longest axis; solid voxels between them let nothing through."""
    gap = {a: F.col(f"t{a}") - F.col(a) for a in "ijk"}
    long = F.greatest(*[F.abs(gap[a]) for a in "ijk"])
    size = F.sqrt(sum((gap[a] * gap[a] for a in "ijk"), F.lit(0.0)))
    inner = F.when(long > 1, F.sequence(F.lit(1), long - 1)).otherwise(F.array().cast("array<int>"))
    steps = pairs.select("pair", *"ijk", "ti", "tj", "tk", (size / long).alias("step"), long.alias("long"), F.explode(inner).alias("s"))
    at = [F.floor(F.col(a) + 0.5 + gap[a] * F.col("s") / F.col("long")).cast("int").alias(f"v{a}") for a in "ijk"]
    side = columns.select(F.col("i").alias("vi"), F.col("j").alias("vj"), "codes")
    met = steps.select("pair", "step", *at).join(side, ["vi", "vj"]).withColumn("code", F.coalesce(F.get("codes", F.col("vk")), F.lit(dims.AIR)))
    got = met.groupBy("pair").agg(F.bool_or(~F.col("code").isin(dims.AIR, dims.TREE)).alias("stop"), F.sum(F.when(F.col("code") == dims.TREE, F.col("step")).otherwise(0.0)).alias("depth"))
    through = F.when(F.coalesce("stop", F.lit(False)), 0.0).otherwise(F.exp(-tree_k * lad * mesh * F.coalesce("depth", F.lit(0.0))))
    return pairs.select("pair").join(got, "pair", "left").select("pair", through.alias("through"))
