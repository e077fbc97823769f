"""Sun positions, sky patches, binned irradiance and sunlight hours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citylattice.functions import dims
from citylattice.functions.exprs import tregenza_index


def position(day: Column, second: Column, lat: float, lon: float) -> tuple[Column, Column, Column]:
    """Declination, hour angle (radians) and cosine of the zenith, at least 0, by the closed form."""
    decl = F.asin(F.sin(F.lit(math.radians(23.45))) * F.sin(F.lit(2 * math.pi) * (day + 284.0) / 365.0))
    hour = F.radians((second / 3600.0 + lon / 15.0 - 12.0) * 15.0)
    cos_z = F.lit(math.sin(math.radians(lat))) * F.sin(decl) + F.lit(math.cos(math.radians(lat))) * F.cos(decl) * F.cos(hour)
    return decl, hour, F.greatest(cos_z, F.lit(0.0))


def patches(spark: SparkSession) -> DataFrame:
    """(patch, az, el, dx, dy, dz, solid): the 145 Tregenza patches; solid angles by band."""
    rows, number, low = [], 0, 0.0
    for upper, n, middle in dims.TREGENZA:
        solid = 2 * math.pi * (math.sin(math.radians(upper)) - math.sin(math.radians(low))) / n
        for p in range(n):
            az = (p + 0.5) * 360.0 / n if n > 1 else 0.0
            rows.append((number, az, middle, solid))
            number += 1
        low = upper
    table = spark.createDataFrame(rows, "patch int, az double, el double, solid double")
    a, e = F.radians("az"), F.radians("el")
    return table.select("patch", "az", "el", (F.cos(e) * F.cos(a)).alias("dx"), (F.cos(e) * F.sin(a)).alias("dy"), F.sin(e).alias("dz"), "solid")


def binned(suns: DataFrame, need_dni: bool = True) -> DataFrame:
    """(patch, dni, hours): sums by patch of suns above the horizon; without ``need_dni`` hours of no DNI count too."""
    up = suns.where((F.col("el") > 0) & (F.col("dni") > 0 if need_dni else F.lit(True)))
    return up.groupBy(tregenza_index(F.col("az"), F.col("el")).alias("patch")).agg(F.sum("dni").alias("dni"), F.count(F.lit(1)).alias("hours"))


def sunlight_hours(suns: DataFrame, threshold: float = 120.0, minimum_elevation: float = 0.0) -> DataFrame:
    """(patch, hours): probable sunlight hours, DNI of the threshold or more."""
    return suns.where((F.col("dni") >= threshold) & (F.col("el") > minimum_elevation)).groupBy(tregenza_index(F.col("az"), F.col("el")).alias("patch")).agg(F.count(F.lit(1)).alias("hours"))


def in_period(ts: Column, first: tuple[int, int], last: tuple[int, int], daily: tuple[int, int] | None = None) -> Column:
    """Hour-of-year window from (day of year, hour) to the same, which may pass the turn of the year, and an optional daily
    window of hours, which may pass midnight."""
    at = (F.dayofyear(ts) - 1) * 24 + F.hour(ts)
    a, b = (first[0] - 1) * 24 + first[1], (last[0] - 1) * 24 + last[1]
    inside = at.between(a, b) if a <= b else (at >= a) | (at <= b)
    if daily:
        h = F.hour(ts)
        inside &= h.between(*daily) if daily[0] <= daily[1] else (h >= daily[0]) | (h <= daily[1])
    return inside


def cumulative(hits: DataFrame, bins: DataFrame) -> DataFrame:
    """(i, j, energy): direct energy of each cell from transmissions (i, j, patch, through) and patch sums."""
    return hits.join(F.broadcast(bins), "patch").groupBy("i", "j").agg(F.sum(F.col("through") * F.col("dni") * F.col("dz")).alias("energy"))


def annual(weather: DataFrame) -> DataFrame:
    """Totals in kWh, peaks and bright hours (DNI above 120, strictly)."""
    return weather.agg((F.sum("dni") / 1000).alias("dni_kwh"), (F.sum("dhi") / 1000).alias("dhi_kwh"), F.max("dni").alias("peak_dni"), F.count_if(F.col("dni") > 120).alias("bright_hours"))


def sky(spark: SparkSession, method: str = "tregenza", factor: int = 4, n_azimuth: int = 36, n_elevation: int = 9, n: int = 145) -> DataFrame:
    """(patch, az, el, dx, dy, dz, solid) of a division of the sky: the 145 patches, these divided further (``reinhart``), a
    grid of equal angles (``uniform``) or a golden spiral (``fibonacci``)."""
    if method == "tregenza":
        return patches(spark)
    if method == "fibonacci":
        z, golden = (F.col("id") + 0.5) / n, F.col("id") * (math.pi * (3.0 - math.sqrt(5.0)))
        r = F.sqrt(1.0 - z * z)
        return spark.range(n).select(F.col("id").cast("int").alias("patch"), (F.degrees(golden) % 360.0).alias("az"), F.degrees(F.asin(z)).alias("el"), (r * F.cos(golden)).alias("dx"), (r * F.sin(golden)).alias("dy"), z.alias("dz"), F.lit(2 * math.pi / n).alias("solid"))
    if method == "uniform":
        bands = [(90.0 * b / n_elevation, 90.0 * (b + 1) / n_elevation, n_azimuth) for b in range(n_elevation)]
    elif method == "reinhart":
        factor, bands, low = max(1, factor), [], 0.0
        for upper, count, _ in dims.TREGENZA:
            ring = lambda s, count=count: max(1, count * factor * (s + 1) // factor) if upper == 90.0 else count * factor  # noqa: E731, B023
            bands += [(low + s * (upper - low) / factor, low + (s + 1) * (upper - low) / factor, ring(s)) for s in range(factor)]
            low = upper
    else:
        raise ValueError(f"unknown method {method}")
    rows, first = [], 0
    for low, high, count in bands:
        rows.append((first, low, high, count))
        first += count
    table = spark.createDataFrame(rows, "first int, low double, high double, n int").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    az, el = (F.col("p") + 0.5) * 360.0 / F.col("n"), (F.col("low") + F.col("high")) / 2
    solid = 2 * math.pi * (F.sin(F.radians("high")) - F.sin(F.radians("low"))) / F.col("n")
    cut_ = table.select((F.col("first") + F.col("p")).alias("patch"), az.alias("az"), el.alias("el"), solid.alias("solid"))
    a, e = F.radians("az"), F.radians("el")
    return cut_.select("patch", "az", "el", (F.cos(e) * F.cos(a)).alias("dx"), (F.cos(e) * F.sin(a)).alias("dy"), F.sin(e).alias("dz"), "solid")


def hemisphere(spark: SparkSession, n_azimuth: int = 80, n_elevation: int = 40) -> DataFrame:
    """(ray, dx, dy, dz, solid): the middles of equal angles from the zenith down to the horizon, x east and y north."""
    half = n_elevation // 2
    band = F.floor(F.col("id") / n_azimuth)
    low, high = band * (math.pi / n_elevation), (band + 1) * (math.pi / n_elevation)
    mid, az = (low + high) / 2, (F.col("id") % n_azimuth + 0.5) * (2 * math.pi / n_azimuth)
    return spark.range(half * n_azimuth).select(F.col("id").cast("int").alias("ray"), (F.sin(mid) * F.sin(az)).alias("dx"), (F.sin(mid) * F.cos(az)).alias("dy"), F.cos(mid).alias("dz"), ((2 * math.pi / n_azimuth) * (F.cos(low) - F.cos(high))).alias("solid"))


def sun_vector(azimuth: Column, elevation: Column, rotation: float = 0.0) -> tuple[Column, Column, Column, Column]:
    """Direction to the sun in a rotated grid, and the cosine of its zenith."""
    from citylattice.functions.exprs import axis_vector

    north, east, up = axis_vector(azimuth, elevation, rotation)
    return north, east, up, up


def patch_weights(bins: DataFrame, sky_: DataFrame, diffuse: float) -> DataFrame:
    """(patch, direct, diffuse): direct sums by patch, and a total of diffuse light dealt by solid angle."""
    whole = F.broadcast(sky_.agg(F.sum("solid").alias("__all")))
    return sky_.crossJoin(whole).join(bins.select("patch", "dni"), "patch", "left").select("patch", F.coalesce("dni", F.lit(0.0)).alias("direct"), (F.lit(diffuse) * F.col("solid") / F.col("__all")).alias("diffuse"))


def diffuse(openness: DataFrame, dhi: float) -> DataFrame:
    """(i, j, diffuse): diffuse light by the sky view factor (value)."""
    return openness.select("i", "j", (F.col("value") * dhi).alias("diffuse"))


def both(direct: DataFrame, diffuse_: DataFrame) -> DataFrame:
    """(i, j, total): direct and diffuse light; where there is no direct value, the diffuse one alone."""
    return diffuse_.join(direct, ["i", "j"], "left").select("i", "j", (F.col("diffuse") + F.coalesce("direct", F.lit(0.0))).alias("total"))


def cumulative_both(hits: DataFrame, bins: DataFrame, openness: DataFrame, dhi: float) -> DataFrame:
    """(i, j, energy): a period's direct energy through the patches and its diffuse energy by the sky view factor."""
    direct = cumulative(hits, bins).withColumnRenamed("energy", "__direct")
    return openness.join(direct, ["i", "j"], "left").select("i", "j", (F.coalesce("__direct", F.lit(0.0)) + F.col("value") * dhi).alias("energy"))


def hours_seen(hits: DataFrame, hours: DataFrame, least: float = 0.0) -> DataFrame:
    """(i, j, hours): hours of sun of each cell, from transmissions (i, j, patch, through) and hours by patch."""
    return hits.join(F.broadcast(hours), "patch", "left").groupBy("i", "j").agg(F.coalesce(F.sum(F.when(F.col("through") > least, F.col("hours"))), F.lit(0)).alias("hours"))


def face_light(faces: DataFrame, sun: tuple[float, float, float], dni: float, dhi: float) -> DataFrame:
    """Faces (di, dj, dk, svf, through, border) with direct, diffuse and total light: the sun's by its angle and what is let
    through, the sky's by the view factor, at most all of it; null for upright faces on the border or without a factor."""
    angle = F.col("di") * sun[0] + F.col("dj") * sun[1] + F.col("dk") * sun[2]
    known = ~F.col("border") & F.col("svf").isNotNull()
    beam = F.when((angle > 0) & (F.lit(dni) > 0), dni * angle * F.coalesce("through", F.lit(0.0))).otherwise(0.0)
    sky_ = F.least(F.col("svf") * dhi, F.lit(dhi))
    return faces.withColumns({"direct": F.when(known, beam), "diffuse": F.when(known, sky_), "total": F.when(known, beam + sky_)})


def face_energy(seen: DataFrame, bins: DataFrame, svf: DataFrame, dhi: float, keys: list[str]) -> DataFrame:
    """(keys, energy): a period's light on faces, from transmissions (keys, patch, angle, through), patch sums and sky view
    factors."""
    beam = seen.where("angle > 0").join(F.broadcast(bins.select("patch", "dni")), "patch").groupBy(*keys).agg(F.sum(F.col("dni") * F.col("angle") * F.col("through")).alias("__beam"))
    return svf.join(beam, keys, "left").select(*keys, (F.coalesce("__beam", F.lit(0.0)) + F.least("svf", F.lit(1.0)) * dhi).alias("energy"))


def absorbed(surfaces: DataFrame) -> DataFrame:
    """Surfaces (incoming, albedo, area) with what leaves, what stays and the net flux of the area."""
    return surfaces.withColumns({"outgoing": F.col("incoming") * F.col("albedo"), "absorbed": F.col("incoming") * (1 - F.col("albedo")), "net": F.col("incoming") * (1 - F.col("albedo")) * F.col("area")})
