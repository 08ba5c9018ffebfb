"""Points on the unit sphere, angles and Earth units as Column expressions.

A point is a `Vec` of three double Columns; `Vec.of` reads one from a struct column and `struct()`
makes one. Latitudes and longitudes are in degrees at the edges of this module and in radians inside.

A Column is a tree, so a result that refers to its argument n times holds n copies of it: put results
into columns (`withColumns`, or `cells.fenced`) before building several of these on each other.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371010.0
EARTH_LOWEST_M = -10898.0
EARTH_HIGHEST_M = 8848.0
EARTH_LOWEST_M = -10898.0
EPSILON = 2.220446049250313e-16
MAX_LENGTH2 = 4.0


def let(value: Column, f) -> Column:
    """f(value) with the value's expression in the tree once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    @classmethod
    def of(cls, column: Column | str) -> Vec:
        c = F.col(column) if isinstance(column, str) else column
        return cls(c["x"], c["y"], c["z"])

    @classmethod
    def named(cls, prefix: str = "") -> Vec:
        """The columns prefix + x, y, z."""
        return cls(*[F.col(f"{prefix}{a}") for a in "xyz"])

    @classmethod
    def lit(cls, x: float, y: float, z: float) -> Vec:
        return cls(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))

    def plus(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def minus(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def times(self, f: Column | float) -> Vec:
        return Vec(self.x * f, self.y * f, self.z * f)

    def mul_components(self, o: Vec) -> Vec:
        return Vec(self.x * o.x, self.y * o.y, self.z * o.z)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm2(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm2())

    def normalized(self) -> Vec:
        """The zero vector stays."""
        return self.times(F.coalesce(1.0 / F.nullif(self.norm(), F.lit(0.0)), F.lit(1.0)))


# --- latitude and longitude ---------------------------------------------------------------------


def from_degrees(lat: Column, lng: Column) -> Vec:
    phi, theta = F.radians(lat), F.radians(lng)
    return Vec(F.cos(theta) * F.cos(phi), F.sin(theta) * F.cos(phi), F.sin(phi))


def latitude(p: Vec) -> Column:
    """Degrees."""
    return F.degrees(F.atan2(p.z, F.sqrt(p.x * p.x + p.y * p.y)))


def longitude(p: Vec) -> Column:
    """Degrees."""
    return F.degrees(F.atan2(p.y, p.x))


def from_fixed(value: Column, digits: int) -> Column:
    """Degrees of an integer of 10**-digits degrees (E5, E6, E7)."""
    return value * float(10.0**-digits)


def to_fixed(degrees: Column, digits: int) -> Column:
    return F.rint(degrees * float(10**digits)).cast("int")


def from_unsigned_fixed(value: Column, digits: int) -> Column:
    """As from_fixed, of a 32-bit pattern kept as an unsigned number."""
    return from_fixed(F.when(value >= 2**31, value - 2**32).otherwise(value), digits)


def is_valid(lat: Column, lng: Column) -> Column:
    return (F.abs(lat) <= 90) & (F.abs(lng) <= 180)


def wrapped_degrees(angle: Column, whole: float = 360.0) -> Column:
    """The IEEE remainder: half-way cases go to the even multiple."""
    return angle - whole * F.rint(angle / whole)


def normalized(lat: Column, lng: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat)), wrapped_degrees(lng)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Angle in radians of two positions in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    dlat, dlng = F.sin(0.5 * (b - a)), F.sin(0.5 * (F.radians(lng2) - F.radians(lng1)))
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), dlat * dlat + dlng * dlng * F.cos(a) * F.cos(b))))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing in radians from north, clockwise, in (-pi, pi]."""
    a, b = F.radians(lat1), F.radians(lat2)
    d = F.radians(lng2) - F.radians(lng1)
    return F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))


def latlng_text(lat: Column, lng: Column) -> Column:
    return F.format_string("%f,%f", lat, lng)


# --- angles and chords --------------------------------------------------------------------------


def angle(a: Vec, b: Vec) -> Column:
    return F.atan2(a.cross(b).norm(), a.dot(b))


def chord2(a: Vec, b: Vec) -> Column:
    """Squared chord length, at most 4."""
    return F.least(F.lit(MAX_LENGTH2), a.minus(b).norm2())


def chord2_of_angle(radians: Column) -> Column:
    """-1 for negative angles, infinity for infinite ones, else the squared chord of at most pi."""
    half = 2 * F.sin(0.5 * F.least(F.lit(math.pi), radians))
    return F.when(radians < 0, -1.0).when(radians == float("inf"), float("inf")).otherwise(half * half)


def angle_of_chord2(length2: Column) -> Column:
    return F.when(length2 < 0, -1.0).when(length2 > MAX_LENGTH2, float("inf")).otherwise(2 * F.asin(0.5 * F.sqrt(length2)))


def chord2_sum(a: Column, b: Column) -> Column:
    """Chord of the sum of two angles, capped at pi."""
    x, y = a * (1 - 0.25 * b), b * (1 - 0.25 * a)
    return F.when(b == 0, a).when(a + b >= MAX_LENGTH2, MAX_LENGTH2).otherwise(F.least(F.lit(MAX_LENGTH2), x + y + 2 * F.sqrt(x * y)))


def chord2_difference(a: Column, b: Column) -> Column:
    x, y = a * (1 - 0.25 * b), b * (1 - 0.25 * a)
    part = F.greatest(F.lit(0.0), F.sqrt(x) - F.sqrt(y))
    return F.when(b == 0, a).when(a <= b, 0.0).otherwise(part * part)


def chord2_is_special(length2: Column) -> Column:
    return (length2 < 0) | (length2 == float("inf"))


def chord2_plus_error(length2: Column, error: Column | float) -> Column:
    return F.when(chord2_is_special(length2), length2).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(MAX_LENGTH2), length2 + error)))


def chord2_successor(length2: Column) -> Column:
    """The next larger chord: of a negative one 0, beyond half a turn infinity."""
    up = F.java_method(F.lit("java.lang.Math"), F.lit("nextUp"), length2).cast("double")
    return F.when(length2 < 0, 0.0).when(length2 >= 4, float("inf")).otherwise(up)


def chord2_predecessor(length2: Column) -> Column:
    """The next smaller chord: of infinity half a turn, below 0 negative."""
    down = F.java_method(F.lit("java.lang.Math"), F.lit("nextDown"), length2).cast("double")
    return F.when(length2 <= 0, -1.0).when(length2 > 4, 4.0).otherwise(down)


def chord2_point_error(length2: Column) -> Column:
    """Largest error of chord2 for points that are unit length to within rounding."""
    return 4.5 * EPSILON * length2 + 16 * EPSILON * EPSILON


def chord2_fast_upper_bound(radians: Column) -> Column:
    return radians * radians


# --- Earth --------------------------------------------------------------------------------------


def km_to_angle(km: Column | float):
    return km * (1000.0 / EARTH_RADIUS_M)


def angle_to_km(radians: Column) -> Column:
    return radians * (EARTH_RADIUS_M / 1000.0)


def meters_to_angle(m: Column | float):
    return m * (1.0 / EARTH_RADIUS_M)


def angle_to_meters(radians: Column) -> Column:
    return radians * EARTH_RADIUS_M


def km2_to_steradians(km2: Column) -> Column:
    return km2 / (EARTH_RADIUS_M / 1000.0) ** 2


def steradians_to_km2(steradians: Column) -> Column:
    return steradians * (EARTH_RADIUS_M / 1000.0) ** 2


def meters_to_longitude_radians(m: Column, lat: Column) -> Column:
    """A whole turn where a circle of latitude is too short."""
    scale = F.cos(F.radians(lat))
    return F.when(scale == 0, 2 * math.pi).otherwise(F.least(F.lit(2 * math.pi), meters_to_angle(m) / F.when(scale != 0, scale)))


# --- frames and rotations -----------------------------------------------------------------------

#: A fixed value: the reference point that is not on any likely edge.
ORIGIN = (-0.0099994664350250197, 0.0025924542609324121, 0.99994664350250195)


def is_unit_length(p: Vec) -> Column:
    return F.abs(p.norm2() - 1) <= 5 * EPSILON


def approx_equals(a: Vec, b: Vec, error: float = 1e-15) -> Column:
    return angle(a, b) <= error


def ortho(a: Vec) -> Vec:
    """A unit vector at a right angle to a, so that ortho(-a) == -ortho(a)."""
    x, y, z = F.abs(a.x), F.abs(a.y), F.abs(a.z)
    # the axis before (cyclically) that of the largest component
    axis = F.when((x > y) & (x > z), 2).when((y > z) & ~(x > y), 0).when(y > z, 0).otherwise(1)
    small = (0.012, 0.0053, 0.00457)  # fixed values
    temp = Vec(*[F.when(axis == i, 1.0).otherwise(small[i]) for i in range(3)])
    return a.cross(temp).normalized()


def ref_dir(a: Vec) -> Vec:
    return ortho(a)


def rotate(p: Vec, axis: Vec, radians: Column) -> Vec:
    """p turned about a unit axis, counterclockwise (Rodrigues' formula)."""
    cos = F.cos(radians)
    along = axis.times(axis.dot(p) * (1 - cos))
    return p.times(cos).plus(axis.cross(p).times(F.sin(radians))).plus(along).normalized()


def frame(z: Vec) -> tuple[Vec, Vec, Vec]:
    """A right-handed orthonormal frame whose third axis is z."""
    y = ortho(z)
    return y.cross(z), y, z


def to_frame(axes: tuple[Vec, Vec, Vec], p: Vec) -> Vec:
    return Vec(*[a.dot(p) for a in axes])


def from_frame(axes: tuple[Vec, Vec, Vec], q: Vec) -> Vec:
    return axes[0].times(q.x).plus(axes[1].times(q.y)).plus(axes[2].times(q.z))


# --- along a great circle -----------------------------------------------------------------------


def point_on_ray(origin: Vec, direction: Vec, radians: Column) -> Vec:
    """direction: unit tangent at origin."""
    return origin.times(F.cos(radians)).plus(direction.times(F.sin(radians))).normalized()


def point_on_line(a: Vec, b: Vec, radians: Column) -> Vec:
    """The point at an angle from a towards b."""
    return point_on_ray(a, a.cross(b).cross(a).normalized(), radians)


def interpolate(a: Vec, b: Vec, fraction: Column | float) -> Vec:
    return point_on_line(a, b, angle(a, b) * fraction)


def point_to_left(a: Vec, b: Vec, radians: Column) -> Vec:
    return point_on_ray(a, a.cross(b).normalized(), radians)


def point_to_right(a: Vec, b: Vec, radians: Column) -> Vec:
    return point_on_ray(a, b.cross(a).normalized(), radians)


# --- projections --------------------------------------------------------------------------------


def plate_carree(lat: Column, lng: Column, x_scale: float = 180.0) -> tuple[Column, Column]:
    return lng * (x_scale / 180.0), lat * (x_scale / 180.0)


def mercator(lat: Column, lng: Column, max_x: float = 180.0) -> tuple[Column, Column]:
    s = F.sin(F.radians(lat))
    return lng * (max_x / 180.0), 0.5 * F.log((1 + s) / (1 - s)) * (max_x / math.pi)


def mercator_inverse(x: Column, y: Column, max_x: float = 180.0) -> tuple[Column, Column]:
    k = F.exp(2 * y * (math.pi / max_x))
    return F.degrees(F.asin((k - 1) / (k + 1))), wrapped_degrees(x * (180.0 / max_x))


def wrap_destination(a: Column, b: Column, whole: float) -> Column:
    """b moved by whole turns to be within half a turn of a."""
    return F.when(F.abs(b - a) > 0.5 * whole, a + (b - a) - whole * F.rint((b - a) / whole)).otherwise(b)
