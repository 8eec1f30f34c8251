"""Cells of the sky, the stored index, many cones, nearest stars and numbering, against plain versions."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquad.functions import cells
from skyquad.operators import sky, synthetic
from skyquad.plans import registry
from skyquad.sources import store
from tests.oracle import same


def directions(n, seed=1):
    r = random.Random(seed)
    out = [(r.uniform(0, 360), math.degrees(math.asin(r.uniform(-1, 1)))) for _ in range(n)]
    return out + [(0.0, 90.0), (0.0, -90.0), (359.9999999, 0.0), (0.0, 0.0), (180.0, 89.99), (10.0, -89.999), (360.0, 22.5), (-5.0, 45.0)]


def unit(ra, dec):
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=-1)


@pytest.mark.parametrize("level", [0, 1, 3, 6, 9, 12])
def test_a_cover_has_every_cell_that_a_circle_touches(spark, level):
    r = random.Random(level)
    rows = []
    for ra, dec in directions(120, level):
        radius = r.choice([0.001, 0.3, 4.0, 30.0, 100.0]) * min(1.0, 40 / (1 << level))
        for _ in range(30):  # places inside the circle
            t, s = r.uniform(0, 2 * math.pi), radius * math.sqrt(r.random())
            v = unit(ra, dec)
            e1 = np.cross(v, [0, 0, 1.0] if abs(v[2]) < 0.9 else [1.0, 0, 0])
            e1 /= np.linalg.norm(e1)
            w = v * math.cos(math.radians(s)) + (e1 * math.cos(t) + np.cross(v, e1) * math.sin(t)) * math.sin(math.radians(s))
            rows.append((ra, dec, radius, math.degrees(math.atan2(w[1], w[0])) % 360, math.degrees(math.asin(max(-1, min(1, w[2]))))))
    got = spark.createDataFrame(rows, "ra double, dec double, radius double, ra1 double, dec1 double")
    got = got.select(cells.cover(level, "ra", "dec", "radius").alias("c"), cells.cell(level, "ra1", "dec1").alias("k"), cells.cell(max(level - 1, 0), "ra1", "dec1").alias("up"), cells.cell(level, "ra", "dec").alias("own")).collect()
    assert all(x["k"] in x["c"] and x["own"] in x["c"] and len(set(x["c"])) == len(x["c"]) for x in got)
    if level:  # nested: a cell has one parent
        parents = {}
        assert all(parents.setdefault(x["k"], x["up"]) == x["up"] for x in got)
    assert spark.range(1).select(cells.cell(level, F.lit(None).cast("double"), F.lit(1.0))).first()[0] is None


def stars_of(spark, n, seed=3):
    return spark.createDataFrame([(i, ra, dec, None if i % 9 == 0 else i % 70 / 10) for i, (ra, dec) in enumerate(directions(n, seed))], "id long, ra_deg double, dec_deg double, mag double")


def test_cones_on_a_stored_index_read_only_their_zones(spark, tmp_path):
    stars = stars_of(spark, 3000)
    path = str(tmp_path / "sky")
    sky.write_index(stars, path)
    cones = [(1, 10.0, 20.0, 5.0), (2, 359.0, -1.0, 3.0), (3, 100.0, 88.0, 6.0), (4, 200.0, -90.0, 2.0), (5, None, 1.0, 1.0), (6, 50.0, 0.0, 0.0)]
    table = spark.createDataFrame(cones, "cone_id long, ra0 double, dec0 double, radius_deg double")
    rows = [r for r in stars.collect()]
    v = unit(np.array([r["ra_deg"] for r in rows]), np.array([r["dec_deg"] for r in rows]))
    want = {(c, r["id"]) for c, ra, dec, radius in cones if ra is not None for r, s in zip(rows, np.degrees(np.arccos(np.clip(v @ unit(ra, dec), -1, 1))), strict=True) if s <= radius}
    index = sky.read_index(spark, path)
    for small in (sky.SMALL, 0):  # by broadcast and by shuffle
        found = sky.in_cones(table, index, small=small)
        assert {(r["cone_id"], r["id"]) for r in found.collect()} == want and set(found.columns) == {"cone_id", "separation_deg", "id", "ra_deg", "dec_deg", "mag", "x", "y", "z"}
    one = sky.in_cones(table.filter("cone_id = 1"), index)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [zone" in plan
    assert sky.in_cones(table.limit(0), index).collect() == []


@pytest.mark.parametrize("n", [1, 2, 4, 40, 900])
def test_nearest_of_each(spark, n):
    places = directions(n - 1, n)[: n - 1] + [(10.0, 10.0)]
    if n == 900:  # a crowd, and equal places
        places[:300] = [(50 + (i % 20) / 100, 50 + i // 20 / 100) for i in range(300)]
        places[300:310] = [(50.0, 50.0)] * 10
    v = unit(np.array([p[0] for p in places]), np.array([p[1] for p in places]))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], "key int, x double, y double, z double")
    got = {r["key"]: r["n"] for r in sky.nearest(df, 5).collect()}
    d2 = sum((v[:, None, k] - v[None, :, k]) ** 2 for k in range(3))
    d2[np.arange(n), np.arange(n)] = np.inf
    assert got == {i: np.lexsort((np.arange(n), d2[i]))[: min(5, n - 1)].tolist() for i in range(n)}


def test_numbers_follow_the_order(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, i long").repartition(5)
    got = store.numbered(df, "nr", "k").collect()
    assert {r["k"]: r["nr"] for r in got} == {k: n for n, k in enumerate(sorted(k for k, _ in rows))}
    assert store.numbered(df.limit(0), "nr", "k").collect() == []


def test_patterns_of_more_stars_than_sixteen_bits(spark):
    n = 70_000
    k = F.col("id")
    catalog = spark.range(n).select("id", (k * 7919 % 360_000 / 1000).alias("ra_deg"), F.degrees(F.asin((k * 104_729 % 200_001 - 100_000) / 100_000)).alias("dec_deg"), (k % 60 / 10).alias("mag"))
    stars = store.written(synthetic.solver_stars(catalog), "many_stars")
    patterns = store.written(synthetic.nearest_patterns(stars), "many_patterns")
    top = patterns.agg(F.count(F.lit(1)).alias("n"), F.max("pattern_index").alias("top"), F.max("s3").alias("s"), F.count_distinct("pattern_index").alias("d")).first()
    assert top["n"] == top["top"] + 1 == top["d"] > n and top["s"] == n - 1


def test_stars_on_the_edge_of_a_cone(spark, tmp_path):
    """The pole is 70 degrees from the cone's centre; of the stars there, SQL takes those whose cosine is not rounded down."""
    first = next(k for k in range(20001) if k * 104729 % 20001 == 20000)
    duckdb.execute(f"copy (select ({first} + 20001 * range)::bigint as c_custkey from range(36000)) to '{tmp_path}/customer.parquet'")
    found = registry.QUERIES["tangent_plane"](spark, str(tmp_path))
    assert 0 < found.count() < 36000
    same(found, registry.SQL["tangent_plane"], tmp_path)
