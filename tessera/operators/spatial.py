"""Joins by place: boxes that overlap, and points within circles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measure import haversine

# The least overlap of a match, how long its text must be, what a match adds to the confidence.
OVERLAP, LENGTH, SURER = 0.3, 0.8, 0.1
#: Metres of a degree of latitude, rounded down.
DEGREE = 111_000.0


def _span(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def best_overlaps(a: DataFrame, b: DataFrame, keys: list[str], cell: float = 0.25) -> DataFrame:
    """(keys, a, b, iou): for each box of a the box of b with the largest overlap, ties to the smaller id of b.

    a, b: (keys, id, x, y, width, height). Boxes are dealt to the grid cells that they touch,
    so only boxes of one cell meet, and a pair counts in the cell where its intersection
    begins. `cell` should be about the size of a box: a box goes to width * height / cell**2
    cells. Boxes without area or with a null overlap nothing.
    """

    def dealt(df: DataFrame, name: str) -> DataFrame:
        x2, y2 = F.col("x") + F.col("width"), F.col("y") + F.col("height")
        box = df.where("width > 0 and height > 0 and x is not null and y is not null")
        box = box.select(*keys, F.col("id").alias(name), *[c.alias(f"{name}_{n}") for n, c in (("x1", F.col("x")), ("y1", F.col("y")), ("x2", x2), ("y2", y2))])
        return box.withColumn("cx", F.explode(_span(F.col(f"{name}_x1"), F.col(f"{name}_x2"), cell))).withColumn("cy", F.explode(_span(F.col(f"{name}_y1"), F.col(f"{name}_y2"), cell)))

    c = {n: (F.col(f"a_{n}"), F.col(f"b_{n}")) for n in ("x1", "y1", "x2", "y2")}
    x1, y1, x2, y2 = F.greatest(*c["x1"]), F.greatest(*c["y1"]), F.least(*c["x2"]), F.least(*c["y2"])
    pairs = dealt(a, "a").join(dealt(b, "b"), [*keys, "cx", "cy"])
    mine = (F.col("cx") == F.floor(x1 / cell)) & (F.col("cy") == F.floor(y1 / cell))
    both = (x2 - x1) * (y2 - y1)
    area = lambda i: (c["x2"][i] - c["x1"][i]) * (c["y2"][i] - c["y1"][i])
    scored = pairs.where((x1 < x2) & (y1 < y2) & mine).select(*keys, "a", "b", (both / (area(0) + area(1) - both)).alias("iou"))
    best = F.max_by(F.struct("b", "iou"), F.struct("iou", (-F.col("b")).alias("first")))
    return scored.groupBy(*keys, "a").agg(best.alias("m")).select(*keys, "a", "m.b", "m.iou")


def merged_extractions(layout: DataFrame, exact: DataFrame, keys: list[str], cell: float = 0.25) -> DataFrame:
    """Blocks of `layout` with the text of the `exact` block at their place; pages that only one side has come from that side.

    Both: (keys, id long, type, x, y, width, height, text, confidence). A block takes the text
    of its best overlap above 0.3 if that is longer than 0.8 of its own, and its confidence
    rises by 0.1, to 1 at most (a null stays). Annotations and images keep theirs.
    """
    found = best_overlaps(layout.where(~F.coalesce("type", F.lit("")).isin("annotation", "image")), exact, keys, cell).where(F.col("iou") > OVERLAP)
    other = exact.select(*keys, F.col("id").alias("b"), F.coalesce("text", F.lit("")).alias("other"))
    text = found.join(other, [*keys, "b"]).select(*keys, F.col("a").alias("id"), "other")
    out = layout.join(text, [*keys, "id"], "left")
    takes = F.col("other").isNotNull() & (F.length("other") > F.length(F.coalesce("text", F.lit(""))) * LENGTH)
    values = {"text": F.when(takes, F.col("other")).otherwise(F.col("text")), "confidence": F.when(takes, F.least(F.lit(1.0), F.col("confidence") + SURER)).otherwise(F.col("confidence"))}
    # least() skips nulls: a block without a confidence stays without.
    values["confidence"] = F.when(F.col("confidence").isNotNull(), values["confidence"])
    merged = out.select(*[values.get(c, F.col(c)).alias(c) for c in layout.columns])
    alone = exact.join(layout.select(*keys).distinct(), keys, "left_anti")
    return merged.unionByName(alone.select(layout.columns))


def inside_any(points: DataFrame, fences: DataFrame, keys: list[str], cell: float = 0.05) -> DataFrame:
    """(keys, id): points within the radius of a fence that has the same keys.

    points: (keys, id, lat, lon); fences: (keys, lat, lon, radius in metres). A fence is
    dealt to the cells of `cell` degrees that its circle's bounding box touches, so that a
    point meets only fences of its own cell; one beyond a pole's or the date line's edge is
    dealt to all longitudes.
    """
    reach = F.col("radius") / DEGREE
    widest = F.greatest(F.cos(F.radians(F.least(F.lit(90.0), F.abs("lat") + reach))), F.lit(1e-9))
    east = F.least(reach / widest, F.lit(180.0))
    low, high = F.col("lon") - east, F.col("lon") + east
    wraps = (low < -180) | (high > 180)
    f = fences.where("radius >= 0").select(*keys, F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"), "radius", F.explode(_span(F.col("lat") - reach, F.col("lat") + reach, cell)).alias("cy"), F.when(wraps, -180.0).otherwise(low).alias("low"), F.when(wraps, 180.0).otherwise(high).alias("high"))
    f = f.withColumn("cx", F.explode(_span(F.col("low"), F.col("high"), cell)))
    p = points.withColumns({"cy": F.floor(F.col("lat") / cell), "cx": F.floor(F.col("lon") / cell)})
    near = p.join(f, [*keys, "cx", "cy"]).where(haversine(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon")) <= F.col("radius"))
    return near.select(*keys, "id").distinct()


def fence_status(points: DataFrame, fences: DataFrame, places: DataFrame, cell: float = 0.05) -> DataFrame:
    """(id, status): INSIDE_GEOFENCE, OUTSIDE_GEOFENCE or NO_LOCATION.

    points: (id, lat, lon, fence_id, place_id); fences: (fence_id, place_id, lat, lon, radius,
    active); places: (place_id, lat, lon, radius, enabled). The point's own fence decides if
    it is active; else any of the place's active fences; else the place's own circle, if it
    is enabled and has a centre other than 0.
    """
    live = fences.where("active")
    own = points.join(live.select("fence_id", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"), F.col("radius").alias("f_radius")), "fence_id", "left")
    of = lambda a, b, r: haversine(F.col("lat"), F.col("lon"), F.col(a), F.col(b)) <= F.col(r)
    several = live.where("place_id is not null").select("place_id").distinct().withColumn("has_fences", F.lit(True))
    own = own.join(several, "place_id", "left")
    hits = inside_any(points.where("place_id is not null").select("place_id", "id", "lat", "lon"), live.select("place_id", "lat", "lon", "radius"), ["place_id"], cell)
    own = own.join(hits.select("id", F.lit(True).alias("hit")), "id", "left")
    old = places.where("enabled and lat <> 0 and lon <> 0").select("place_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.col("radius").alias("p_radius"))
    x = own.join(old, "place_id", "left")
    inside = F.when(F.col("f_radius").isNotNull(), of("f_lat", "f_lon", "f_radius")).when(F.col("has_fences"), F.coalesce("hit", F.lit(False))).when(F.col("p_radius").isNotNull(), of("p_lat", "p_lon", "p_radius"))
    return x.select("id", F.when(inside, "INSIDE_GEOFENCE").when(~inside, "OUTSIDE_GEOFENCE").otherwise("NO_LOCATION").alias("status"))
