"""A stored index of the sky, and searches that meet it by cells: many cones, nearest stars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquad.functions import cells
from skyquad.functions.vectors import Vec, unit_vector
from skyquad.operators.catalog import with_vectors
from skyquad.sources.store import forget, written

#: Levels of the cells that an index is joined by, and of the zones that it is stored by: 22.5 degrees, 86 zones.
LEVEL, ZONE_LEVEL = 6, 3
#: Cones, or places to search around, that may be broadcast.
SMALL = 200_000


def indexed(stars: DataFrame, level: int = LEVEL, zone_level: int = ZONE_LEVEL) -> DataFrame:
    """stars (id, ra_deg, dec_deg, mag) with unit vectors, cell and zone; a zone holds whole cells."""
    return with_vectors(stars).withColumns({"cell": cells.cell(level, "ra_deg", "dec_deg"), "zone": cells.cell(zone_level, "ra_deg", "dec_deg").cast("int")})


def write_index(stars: DataFrame, path: str, level: int = LEVEL, zone_level: int = ZONE_LEVEL) -> None:
    """Stores stars by zone, in the order of cells. Rows are dealt by range of (zone, cell), so that a crowded zone is several files and none is a task's alone."""
    at = indexed(stars, level, zone_level).repartitionByRange("zone", "cell").sortWithinPartitions("zone", "cell")
    at.write.partitionBy("zone").parquet(path)


def read_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def in_cones(cones: DataFrame, index: DataFrame, level: int = LEVEL, zone_level: int = ZONE_LEVEL, small: int = SMALL) -> DataFrame:
    """(cone_id, separation_deg and the index's columns but for cell and zone) of the stars in each cone (cone_id, ra0, dec0, radius_deg), edges included.

    Cones are spread over the cells that they may touch and joined by equality.
    On a stored index only the zones that some cone may touch are read: their
    numbers, 86 at the default level whatever the cones, become a filter on the
    partitions. Up to small cones are broadcast; beyond, both sides are
    shuffled by cell. A cone of an unknown place or radius has no stars.
    """
    known = cones.filter("ra0 is not null and dec0 is not null and radius_deg >= 0")
    spread = written(known.select("cone_id", "ra0", "dec0", "radius_deg", F.explode(cells.cover(level, "ra0", "dec0", "radius_deg")).alias("cell")), "cone_cells")
    if "zone" in index.columns:
        zones = known.select(F.explode(cells.cover(zone_level, "ra0", "dec0", "radius_deg")).alias("zone")).distinct()
        index = index.filter(F.col("zone").isin([r["zone"] for r in zones.collect()]))
    side = F.broadcast(spread) if spread.limit(small + 1).count() <= small else spread
    met = index.join(side, "cell")
    apart = Vec.of("x", "y", "z").separation_deg(unit_vector("ra0", "dec0"))
    found = met.withColumn("separation_deg", apart).filter(F.col("separation_deg") <= F.col("radius_deg"))
    return found.select("cone_id", "separation_deg", *[c for c in index.columns if c not in ("cell", "zone")])


def around(places: DataFrame, radius_deg: float, level: int) -> DataFrame:
    """(cell, near) where near lists the rows of places (key, x, y, z) that may be within radius_deg of a place in the cell."""
    ra, dec = Vec.of("x", "y", "z").ra_deg(), Vec.of("x", "y", "z").dec_deg()
    spread = places.select(F.struct("key", "x", "y", "z").alias("p"), F.explode(cells.cover(level, ra, dec, F.lit(radius_deg))).alias("cell"))
    return spread.groupBy("cell").agg(F.collect_list("p").alias("near"))


def nearest(places: DataFrame, near: int) -> DataFrame:
    """(key, n): the keys of the near nearest other places of each of places (key, x, y, z: unit vectors), nearest first, the lesser key of equally near ones.

    Circles of one radius are searched by cells of about its size; places with
    enough others inside are done, the rest go on with twice the radius. The
    first radius holds about half of what is looked for where places are spread
    evenly, so that crowded regions end early and are never compared as a whole.
    """
    places = written(places.select("key", *[F.col(k).cast("double").alias(k) for k in "xyz"]), "places")
    n, done = places.count(), []
    radius = min(180.0, math.degrees(math.sqrt(2.0 * near / max(n, 1)))) if n > near + 1 else 180.0
    todo = places
    while True:
        level = cells.level_for(radius)
        ra, dec = Vec.of("x", "y", "z").ra_deg(), Vec.of("x", "y", "z").dec_deg()
        other = places.select(F.col("key").alias("other"), *[F.col(k).alias(f"o{k}") for k in "xyz"], cells.cell(level, ra, dec).alias("cell"))
        spread = todo.withColumn("cell", F.explode(cells.cover(level, ra, dec, F.lit(radius))))
        dx, dy, dz = (F.col(k) - F.col(f"o{k}") for k in "xyz")
        met = spread.join(other, "cell").filter("key <> other").withColumn("d2", dx * dx + dy * dy + dz * dz)
        last = radius >= 180.0
        inside = met if last else met.filter(F.col("d2") <= (2 * math.sin(math.radians(radius) / 2)) ** 2)
        lists = inside.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "other"))), 1, near).alias("m"))
        lists = written(lists.select("key", F.col("m.other").alias("n")), "nearest")
        done.append(lists if last else lists.filter(F.size("n") >= near))
        if last:
            break
        rest = written(todo.join(done[-1].select("key"), "key", "left_anti"), "places_left")
        if todo is not places:
            forget(todo)
        todo, radius = rest, min(180.0, radius * 2)
        if not todo.limit(1).count():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # a place that has no other at all
    return out if n > 1 else places.select("key", F.array().cast(dict(lists.dtypes)["n"]).alias("n"))
