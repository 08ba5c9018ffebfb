"""Text of points and shapes as Column expressions: `lat:lng` in degrees, points separated by commas, loops by semicolons, shapes by
bars, and the three dimensions of an index by `#`. `empty` and `full` stand for loops without vertices. What can't be read is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sphera.functions import cells


def format_latlng(lat: Column, lng: Column, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f:%.{digits}f", lat, lng)


def _parts(text: Column, mark: str) -> Column:
    """Pieces between marks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, mark), lambda t: F.trim(t)), lambda t: t != "")


def parse_latlng(text: Column) -> Column:
    """struct<lat,lng> of one point."""
    number = lambda c: c.try_cast("double")
    lat, lng = number(F.split_part(text, F.lit(":"), F.lit(1))), number(F.split_part(text, F.lit(":"), F.lit(2)))
    return F.when(lat.isNotNull() & lng.isNotNull() & (F.size(F.split(text, ":")) == 2), F.struct(lat.alias("lat"), lng.alias("lng")))


def parse_latlngs(text: Column) -> Column:
    """array<struct<lat,lng>>; parts that are no point are null."""
    return F.transform(_parts(text, ","), parse_latlng)


def to_point(at: Column) -> Column:
    """struct<x,y,z> of a struct<lat,lng>."""
    lat, lng = F.radians(at["lat"]), F.radians(at["lng"])
    return F.when(at.isNotNull(), F.struct((F.cos(lng) * F.cos(lat)).alias("x"), (F.sin(lng) * F.cos(lat)).alias("y"), F.sin(lat).alias("z")))


def parse_point(text: Column) -> Column:
    """struct<x,y,z> of one point."""
    return to_point(parse_latlng(text))


def parse_points(text: Column) -> Column:
    """array<struct<x,y,z>>: points, or the vertices of a polyline."""
    return F.transform(parse_latlngs(text), to_point)


parse_polyline = parse_points
parse_lax_polyline = parse_points


def parse_rect(text: Column) -> Column:
    """struct<lat_lo,lat_hi,lng_lo,lng_hi> in degrees: the bounds of the points (those of longitude not across the far side)."""
    p = parse_latlngs(text)
    pick = lambda f, n: f(F.transform(p, lambda t: t[n]))
    found = F.struct(pick(F.array_min, "lat").alias("lat_lo"), pick(F.array_max, "lat").alias("lat_hi"), pick(F.array_min, "lng").alias("lng_lo"), pick(F.array_max, "lng").alias("lng_hi"))
    return F.when(F.size(p) > 0, found)


def parse_cell(text: Column) -> Column:
    """The cell of a face and child positions such as `3/0132`."""
    return cells.from_debug_string(F.trim(text))


def parse_cell_union(text: Column) -> Column:
    """array<bigint> of cells separated by commas, in curve order, each once."""
    return F.array_sort(F.array_distinct(F.transform(_parts(text, ","), cells.from_debug_string)))


def parse_loop(text: Column) -> Column:
    """Vertices of one loop; `empty` and `full` have none."""
    return F.when(F.trim(text).isin("empty", "full"), F.array().cast("array<struct<x:double,y:double,z:double>>")).otherwise(parse_points(text))


def parse_loops(text: Column) -> Column:
    """array of arrays of struct<lat,lng>, one for each `;`; the words `empty` and `full` give none."""
    loops = F.filter(_parts(text, ";"), lambda t: ~t.isin("empty", "full"))
    return F.transform(loops, parse_latlngs)


def parse_polygon(text: Column) -> Column:
    """array of loops of vertices; `full` is one loop without vertices, `empty` is no loop."""
    return F.transform(F.filter(_parts(text, ";"), lambda t: t != "empty"), parse_loop)


parse_lax_polygon = parse_polygon
#: Loops as they are written: nothing is turned round.
parse_verbatim_polygon = parse_polygon


def parse_index(text: Column) -> Column:
    """struct<points, polylines, polygons> of `points # polylines # polygons`, shapes of a dimension separated by `|`."""
    part = lambda k: F.coalesce(F.get(F.split(text, "#"), F.lit(k)), F.lit(""))
    return F.struct(
        F.transform(_parts(part(0), r"\|"), parse_point).alias("points"),
        F.transform(_parts(part(1), r"\|"), parse_points).alias("polylines"),
        F.transform(_parts(part(2), r"\|"), parse_polygon).alias("polygons"),
    )


# --- to text ----------------------------------------------------------------------------------------


def point_text(p: Column, digits: int = 6) -> Column:
    """A struct<x,y,z> as `lat:lng`."""
    return format_latlng(F.degrees(F.atan2(p["z"], F.hypot(p["x"], p["y"]))), F.degrees(F.atan2(p["y"], p["x"])), digits)


def points_text(points: Column, digits: int = 6) -> Column:
    return F.array_join(F.transform(points, lambda p: point_text(p, digits)), ", ")


polyline_text = points_text


def loop_text(loop: Column, digits: int = 6) -> Column:
    """A loop without vertices is `full`."""
    return F.when(F.size(loop) == 0, "full").otherwise(points_text(loop, digits))


def polygon_text(loops: Column, digits: int = 6) -> Column:
    """Loops separated by `; `; no loops are `empty`."""
    return F.when(F.size(loops) == 0, "empty").otherwise(F.array_join(F.transform(loops, lambda x: loop_text(x, digits)), "; "))


def rect_text(rect: Column, digits: int = 6) -> Column:
    return F.concat_ws(", ", format_latlng(rect["lat_lo"], rect["lng_lo"], digits), format_latlng(rect["lat_hi"], rect["lng_hi"], digits))


def cell_union_text(union: Column) -> Column:
    return F.array_join(F.transform(union, cells.debug_string), ", ")


def index_text(index: Column, digits: int = 6) -> Column:
    """The three dimensions of a struct<points, polylines, polygons>, as parse_index reads them."""
    points = F.array_join(F.transform(index["points"], lambda p: point_text(p, digits)), " | ")
    lines = F.array_join(F.transform(index["polylines"], lambda c: points_text(c, digits)), " | ")
    polygons = F.array_join(F.transform(index["polygons"], lambda x: polygon_text(x, digits)), " | ")
    return F.trim(F.concat(points, F.lit(" # "), lines, F.lit(" # "), polygons))
