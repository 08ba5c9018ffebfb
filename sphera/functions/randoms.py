"""Repeatable random points, caps, cells and fractal loops as columns of a number: equal numbers and seeds give equal results.

Uniform numbers come from a hash of (seed, key), so they need no state and do not depend on partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphera.functions import cells
from sphera.functions.points import Vec, frame, from_frame
from sphera.functions.regions import Cap

PI = math.pi


def uniform(key: Column, seed: int) -> Column:
    """In [0, 1), of 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / float(1 << 53)


def uniform_int(key: Column, seed: int, below: int) -> Column:
    return F.floor(uniform(key, seed) * below).cast("bigint")


def log_uniform(key: Column, seed: int, low: float, high: float) -> Column:
    """Of which the logarithm is uniform."""
    return F.exp(math.log(low) + uniform(key, seed) * (math.log(high) - math.log(low)))


def skewed_int(key: Column, seed: int, max_log: int) -> Column:
    """A uniform number of bits up to max_log, then a uniform number of so many bits: small ones are the most likely."""
    bits = uniform_int(key, seed, max_log + 1)
    return F.floor(uniform(key, seed + 1) * F.pow(F.lit(2.0), bits)).cast("bigint")


def point(key: Column, seed: int) -> Vec:
    """Uniform on the sphere: a uniform height and longitude."""
    z, lng = 2 * uniform(key, seed) - 1, 2 * PI * uniform(key, seed + 1)
    flat = F.sqrt(1 - z * z)
    return Vec(flat * F.cos(lng), flat * F.sin(lng), z)


def frame_at(z: Vec, key: Column, seed: int) -> tuple[Vec, Vec, Vec]:
    """A right-handed frame with a given third axis, turned at random about it."""
    x, y, z = frame(z)
    a = 2 * PI * uniform(key, seed)
    return x.times(F.cos(a)).plus(y.times(F.sin(a))), y.times(F.cos(a)).minus(x.times(F.sin(a))), z


def frame_of(key: Column, seed: int) -> tuple[Vec, Vec, Vec]:
    return frame_at(point(key, seed), key, seed + 2)


def cap(key: Column, seed: int, min_area: float, max_area: float) -> Cap:
    """A random centre, and an area whose logarithm is uniform."""
    return Cap.from_area(point(key, seed), log_uniform(key, seed + 2, min_area, max_area))


def sample_cap(c: Cap, key: Column, seed: int) -> Vec:
    """Uniform in a cap: a uniform height below its centre, and a direction."""
    h, lng = uniform(key, seed) * c.height(), 2 * PI * uniform(key, seed + 1)
    flat = F.sqrt(h * (2 - h))
    return from_frame(frame(c.center), Vec(F.cos(lng) * flat, F.sin(lng) * flat, 1 - h))


def sample_rect(lat_lo: Column, lat_hi: Column, lng_lo: Column, lng_size: Column, key: Column, seed: int) -> Vec:
    """Uniform in a rectangle: a uniform height between its latitudes, a uniform longitude."""
    z = F.sin(lat_lo) + uniform(key, seed) * (F.sin(lat_hi) - F.sin(lat_lo))
    lng = lng_lo + uniform(key, seed + 1) * lng_size
    flat = F.sqrt(1 - z * z)
    return Vec(flat * F.cos(lng), flat * F.sin(lng), z)


def cell_of_level(key: Column, seed: int, level: int) -> Column:
    """A uniform cell of a level."""
    face = uniform_int(key, seed, 6)
    pos = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed + 1)), 3)
    return cells.parent(cells.from_face_pos_level(face, pos.bitwiseOR(F.lit(1)), 30), level)


def fractal_loops(df: DataFrame, key: str, radius: float, level: int, dimension: float = math.log(4) / math.log(3), seed: int = 1, out: str = "vertices") -> DataFrame:
    """df with `out`: the vertices (x, y, z) of a closed fractal curve about a random centre of each key.

    A triangle's edges are replaced `level` times by four edges with a tooth to the outside, whose size gives the curve its
    dimension (about 1.26 is the snowflake); the radius is that of the triangle's corners.
    """
    ratio = 4 ** (-1 / dimension)  # length of each of the four edges
    offset = math.sqrt(max(0.0, ratio * ratio - (0.5 - ratio) ** 2))
    point_type = "array<struct<a:double,b:double>>"
    flat = F.array(*[F.struct(F.lit(math.cos(2 * PI * k / 3)).alias("a"), F.lit(math.sin(2 * PI * k / 3)).alias("b")) for k in range(3)]).cast(point_type)
    df = df.withColumn("__p", flat)
    for _ in range(level):
        # each edge p q: p, p + r (q - p), the tooth, q - r (q - p)
        n = F.size("__p")

        def teeth(p: Column, i: Column) -> Column:
            q = F.get("__p", (i + 1) % n)  # noqa: B023
            da, db = q["a"] - p["a"], q["b"] - p["b"]
            at = lambda s, t: F.struct((p["a"] + s * da + t * db).alias("a"), (p["b"] + s * db - t * da).alias("b"))
            return F.array(F.struct(p["a"].alias("a"), p["b"].alias("b")), at(ratio, 0.0), at(0.5, offset), at(1 - ratio, 0.0))

        df = df.withColumn("__p", F.flatten(F.transform("__p", teeth)).cast(point_type))
    axes = frame_of(F.col(key), seed)
    df = cells.fenced(df, {f"__{n}": a.struct() for n, a in zip("xyz", axes, strict=True)})
    tan = math.tan(radius)
    vertex = lambda p: from_frame((Vec.of("__x"), Vec.of("__y"), Vec.of("__z")), Vec(p["a"] * tan, p["b"] * tan, F.lit(1.0))).normalized().struct()
    return df.withColumn(out, F.transform("__p", vertex)).drop("__p", "__x", "__y", "__z")
