"""Areas of polygons, of their overlaps, and the shares of raster cells that they cover, as joins and sums over edges.

A polygon table has a key and ``rings``: array<array<struct<x,y>>> (or one ``ring``), closed or not, of either direction.  Rings that lie in an odd number of the
polygon's other rings are holes; rings may touch but not cross.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mean radius of the earth in km.
RADIUS_KM = 6371.0088
#: Overlaps and shares up to this are the rounding of sums, not areas.
TINY = 1e-9


def _edges_of(ring: Column) -> Column:
    """Pairs of a ring's vertices, the last one with the first."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def _signed(ring: Column) -> Column:
    return F.aggregate(_edges_of(ring), F.lit(0.0), lambda t, e: t + (e["x1"] - e["x2"]) * (e["y1"] + e["y2"]) / 2)


def _holds(ring: Column, point: Column) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times."""
    across = lambda e: (e["y1"] > point["y"]) != (e["y2"] > point["y"])
    right = lambda e: point["x"] < (e["x2"] - e["x1"]) * (point["y"] - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
    return F.size(F.filter(_edges_of(ring), lambda e: across(e) & right(e))) % 2 == 1


def polygon_edges(polygons: DataFrame, key: str) -> DataFrame:
    """``key, x1, y1, x2, y2, sign`` with x1 < x2: the polygon is the sum of the signed areas under its edges.

    Upright edges have no area under them and are left out, so are rings of fewer than three vertices; a null or empty polygon has no edges.
    """
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    df = polygons.select(key, F.filter(rings, lambda r: F.size(r) > 2).alias("rings"))
    depth = lambda r: F.size(F.filter("rings", lambda other: (other != r) & _holds(other, F.element_at(r, 1))))
    turned = F.transform("rings", lambda r: F.struct(_edges_of(r).alias("edges"), (F.signum(_signed(r)) * F.when(depth(r) % 2 == 0, 1.0).otherwise(-1.0)).alias("turn")))
    df = df.select(key, F.explode(turned).alias("r")).select(key, "r.turn", F.explode("r.edges").alias("e")).where("e.x1 <> e.x2")
    left = F.col("e.x1") < F.col("e.x2")
    pick = lambda a, b: F.when(left, F.col(f"e.{a}")).otherwise(F.col(f"e.{b}")).cast("double")
    return df.select(key, pick("x1", "x2").alias("x1"), pick("y1", "y2").alias("y1"), pick("x2", "x1").alias("x2"), pick("y2", "y1").alias("y2"), (F.when(left, -1.0).otherwise(1.0) * F.col("turn")).alias("sign"))


def equal_area(polygons: DataFrame, key: str) -> DataFrame:
    """Polygons in degrees (x longitude, y latitude) in km on the cylindrical projection that keeps areas."""
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    move = lambda p: F.struct((F.radians(p["x"]) * RADIUS_KM).alias("x"), (F.sin(F.radians(p["y"])) * RADIUS_KM).alias("y"))
    return polygons.select(key, F.transform(rings, lambda r: F.transform(r, move)).alias("rings"))


def polygon_areas(polygons: DataFrame, key: str) -> DataFrame:
    """``key, area`` in the square of the coordinates' unit; polygons without an area have no row."""
    return polygon_edges(polygons, key).groupBy(key).agg(F.sum((F.col("x2") - F.col("x1")) * (F.col("y1") + F.col("y2")) / 2 * F.col("sign")).alias("area"))


def _at(x: Column, side: str = "") -> Column:
    """Height of an edge at x."""
    x1, y1, x2, y2 = (F.col(f"{side}{c}") for c in ("x1", "y1", "x2", "y2"))
    return y1 + (y2 - y1) * (x - x1) / (x2 - x1)


def _slabs(edges: DataFrame, key: str, cell: float, side: str) -> DataFrame:
    """The edges cut at the borders of upright slabs of width ``cell``."""
    df = edges.withColumn("slab", F.explode(F.sequence(F.floor(F.col("x1") / cell), F.greatest(F.floor(F.col("x1") / cell), F.ceil(F.col("x2") / cell) - 1))))
    a, b = F.greatest(F.col("x1"), F.col("slab") * cell), F.least(F.col("x2"), (F.col("slab") + 1) * cell)
    df = df.select(key, "slab", a.alias("a"), b.alias("b"), _at(a).alias("ya"), _at(b).alias("yb"), "sign").where("a < b")
    return df.select(F.col(key).alias(f"{side}key"), "slab", *[F.col(c).alias(f"{side}{n}") for c, n in (("a", "x1"), ("ya", "y1"), ("b", "x2"), ("yb", "y2"), ("sign", "sign"))])


def _boxes(edges: DataFrame, key: str, side: str) -> DataFrame:
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    return edges.groupBy(F.col(key).alias(f"{side}key")).agg(F.min("x1").alias(f"{side}lox"), F.max("x2").alias(f"{side}hix"), F.min(low).alias(f"{side}loy"), F.max(high).alias(f"{side}hiy"))


def overlaps(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cell: float = 1.0) -> DataFrame:
    """``left_key, right_key, area`` of every two polygons that overlap; concave ones and ones with holes too.

    Polygons meet where their boxes share a cell of width ``cell``; a pair counts in the cell of its boxes' common lower left corner alone, so that it comes
    up once.  The area is the sum over both polygons' edges of the signed areas under the lower of the two: a product of two sums of
    signed trapezoids.  Edges are cut at slabs of width ``cell`` first and meet within a slab of the boxes' overlap, so that the work follows the
    edges that are above one another, and no polygon is held whole by a task.  Choose ``cell`` near the size of the smaller polygons.
    """
    own, other = polygon_edges(left, left_key), polygon_edges(right, right_key)
    cells = lambda b, s: b.withColumn("cx", F.explode(F.sequence(F.floor(F.col(f"{s}lox") / cell), F.floor(F.col(f"{s}hix") / cell)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col(f"{s}loy") / cell), F.floor(F.col(f"{s}hiy") / cell))))
    pairs = cells(_boxes(own, left_key, "l"), "l").join(cells(_boxes(other, right_key, "r"), "r"), ["cx", "cy"])
    lox, loy, hix, hiy = F.greatest("llox", "rlox"), F.greatest("lloy", "rloy"), F.least("lhix", "rhix"), F.least("lhiy", "rhiy")
    pairs = pairs.where((lox < hix) & (loy < hiy) & (F.floor(lox / cell) == F.col("cx")) & (F.floor(loy / cell) == F.col("cy")))
    pairs = pairs.select("lkey", "rkey", loy.alias("base"), F.explode(F.sequence(F.floor(lox / cell), F.floor(hix / cell))).alias("slab"))
    terms = pairs.join(_slabs(own, left_key, cell, "l"), ["lkey", "slab"]).join(_slabs(other, right_key, cell, "r"), ["rkey", "slab"])
    a, b = F.greatest("lx1", "rx1"), F.least("lx2", "rx2")
    terms = terms.where(a < b).select("lkey", "rkey", "base", (F.col("lsign") * F.col("rsign")).alias("sign"), (b - a).alias("w"), *[(_at(x, s) - F.col("base")).alias(f"{s}{n}") for s in "lr" for n, x in (("a", a), ("b", b))])
    da, db = F.col("la") - F.col("ra"), F.col("lb") - F.col("rb")
    t = da / (da - db)
    lo_a, lo_b, cross = F.least("la", "ra"), F.least("lb", "rb"), F.col("la") + (F.col("lb") - F.col("la")) * t
    under = F.when(da * db >= 0, (lo_a + lo_b) / 2).otherwise((t * (lo_a + cross) + (1 - t) * (cross + lo_b)) / 2)
    areas = terms.groupBy(F.col("lkey").alias(left_key), F.col("rkey").alias(right_key)).agg(F.sum(F.col("sign") * F.col("w") * under).alias("area"), F.sum(F.abs(F.col("w") * under)).alias("scale"))
    return areas.where(F.col("area") > TINY * F.col("scale")).drop("scale")


def cell_shares(polygons: DataFrame, key: str, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """``key, col, row, share``: of each raster cell the share that a polygon covers, cells without any left out.

    Cell (col, row) spans x0 + col * dx to x0 + (col + 1) * dx, and likewise in y.  Edges are cut at the cells' borders; a piece gives its cell the area under
    it, and every cell below it its width.  A sum down each column adds these up, so that no cell polygon is made and cells wholly inside
    cost a row each.  A polygon's shares times dx * dy add up to its area.
    """
    grid = polygon_edges(polygons, key).select(key, "sign", *[((F.col(f"{c}{n}") - o) / d).alias(f"{c}{n}") for c, o, d in (("x", x0, dx), ("y", y0, dy)) for n in (1, 2)])
    if dx * dy <= 0 or dx < 0:
        raise ValueError("cells have positive sides")
    first = F.floor("x1")
    df = grid.withColumn("col", F.explode(F.sequence(first, F.greatest(first, F.ceil("x2") - 1))))
    a, b = F.greatest(F.col("x1"), F.col("col")), F.least(F.col("x2"), F.col("col") + 1)
    df = df.select(key, "sign", "col", a.alias("x1"), _at(a).alias("y1"), b.alias("x2"), _at(b).alias("y2")).where("x1 < x2")
    low = F.floor(F.least("y1", "y2"))
    df = df.withColumn("row", F.explode(F.sequence(low, F.greatest(low, F.ceil(F.greatest("y1", "y2")) - 1))))
    # where the piece enters and leaves the row, as shares of its width
    level = F.col("y1") == F.col("y2")
    enter = F.when(level, 0.0).otherwise((F.col("row") - F.col("y1")) / (F.col("y2") - F.col("y1")))
    leave = F.when(level, 1.0).otherwise((F.col("row") + 1 - F.col("y1")) / (F.col("y2") - F.col("y1")))
    s, e = F.greatest(F.lit(0.0), F.least(enter, leave)), F.least(F.lit(1.0), F.greatest(enter, leave))
    width = (F.col("x2") - F.col("x1")) * (e - s) * F.col("sign")
    height = F.col("y1") + (F.col("y2") - F.col("y1")) * (s + e) / 2 - F.col("row")
    pieces = df.groupBy(key, "col", "row").agg(F.sum(width * height).alias("part"), F.sum(width).alias("width"))
    down = Window.partitionBy(key, "col").orderBy(F.desc("row"))
    pieces = pieces.withColumns({"above": F.sum("width").over(down), "below": F.lead("row").over(down)})
    own = F.array(F.struct(F.col("row"), (F.col("part") + F.col("above") - F.col("width")).alias("share")))
    inside = F.when((F.col("below") + 1 < F.col("row")) & (F.abs("above") > TINY), F.transform(F.sequence(F.col("below") + 1, F.col("row") - 1), lambda r: F.struct(r.alias("row"), F.col("above").alias("share"))))
    out = pieces.select(key, "col", F.explode(F.concat(own, F.coalesce(inside, F.slice(own, 1, 0)))).alias("c"))
    return out.select(key, "col", "c.row", F.least(F.lit(1.0), F.col("c.share")).alias("share")).where(F.col("share") > TINY)


def raster_zonal_mean(cells: DataFrame, polygons: DataFrame, key: str, value: str, by: list[str], x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Mean of ``value`` of raster cells (``col, row``) per polygon, by their covered shares, and ``covered``: the share of the polygon's area that the cells with a value have."""
    shares = cell_shares(polygons, key, x0, y0, dx, dy)
    whole = shares.groupBy(key).agg(F.sum("share").alias("whole"))
    known = cells.where(F.col(value).isNotNull()).join(shares, ["col", "row"])
    out = known.groupBy(key, *by).agg((F.sum(F.col("share") * F.col(value)) / F.sum("share")).alias(value), F.sum("share").alias("seen"))
    return out.join(whole, key).withColumn("covered", F.col("seen") / F.col("whole")).drop("seen", "whole")


def cleared_overlaps(cleared: DataFrame, places: DataFrame, place: str, cell: float = 0.5, degrees: bool = True) -> DataFrame:
    """``place, year, biome, uid, km2`` of cleared polygons (``uid, year, biome`` and rings) within places: what ``grids.cleared_area`` adds up."""
    shape = equal_area if degrees else (lambda p, key: p.select(key, *[c for c in ("rings", "ring") if c in p.columns]))
    width = math.radians(cell) * RADIUS_KM if degrees else cell
    found = overlaps(shape(cleared, "uid"), shape(places, place), "uid", place, width)
    return found.join(cleared.select("uid", "year", "biome"), "uid").select(place, "year", "biome", "uid", F.col("area").alias("km2"))


def point_on_surface(polygons: DataFrame, key: str) -> DataFrame:
    """``key, x, y``: a point inside each polygon: the middle of the widest part of a level line that lies in it (of equal ones, the leftmost).

    The line runs halfway between the vertices' heights next above and next below (or at) the middle of the polygon's box, so that it meets no vertex.  Vertices and edges are rows: heights are
    found by two sums, and only the edges that cross the line are sorted.  Rings of fewer than three vertices count for nothing; a polygon without height or area on the line has no row; repeated keys are
    one polygon.
    """
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    edges = polygons.select(key, F.explode(F.filter(rings, lambda r: F.size(r) > 2)).alias("r")).select(key, F.explode(_edges_of(F.col("r"))).alias("e")).select(key, *[F.col(f"e.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    box = edges.groupBy(key).agg(((F.min("y1") + F.max("y1")) / 2).alias("mid"))
    line = edges.join(box, key).groupBy(key).agg(F.max(F.when(F.col("y1") <= F.col("mid"), F.col("y1"))).alias("low"), F.min(F.when(F.col("y1") > F.col("mid"), F.col("y1"))).alias("high"))
    line = line.select(key, ((F.col("low") + F.col("high")) / 2).alias("y"))
    met = edges.join(line, key).where((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    met = met.select(key, "y", (F.col("x1") + (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    order = Window.partitionBy(key).orderBy("x")
    parts = met.select(key, "y", "x", F.row_number().over(order).alias("n"), F.lead("x").over(order).alias("end")).where((F.col("n") % 2 == 1) & (F.col("end") > F.col("x")))
    best = parts.groupBy(key, "y").agg(F.max_by(F.struct("x", "end"), F.struct(F.col("end") - F.col("x"), -F.col("x"))).alias("p"))
    return best.select(key, ((F.col("p.x") + F.col("p.end")) / 2).alias("x"), "y")
