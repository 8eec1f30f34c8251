"""Verification by zones: nearest stars against all pairs, and the joins by cells."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from skyquad.functions import cells
from skyquad.operators import verify


def test_nearest_of_rows():
    """Crowds, gaps, equal stars and rows without stars, on places in and far outside of them."""
    g = np.random.default_rng(5)
    sx, sy, star_of = np.concatenate([g.normal(0, 1e-4, 900), g.uniform(-1, 1, 700), [0.5] * 4]), np.concatenate([g.normal(0, 1e-4, 900), g.uniform(-1, 1, 700), [0.5] * 4]), np.concatenate([g.integers(0, 3, 1600), [1] * 4])
    star_of[star_of == 2] = 3  # row 2 has none
    order = np.argsort(star_of, kind="stable")
    sx, sy, star_of = sx[order], sy[order], star_of[order]
    x, y, of = np.concatenate([g.uniform(-1.5, 1.5, 3000), [0.5, 1e30, -1e30]]), np.concatenate([g.uniform(-1.5, 1.5, 3000), [0.5, 0.0, 1e30]]), np.concatenate([g.integers(0, 4, 3000), [1, 0, 3]])
    radius = np.array([0.02, 0.3, 0.3, 3.0])
    at, d2 = verify.nearest_of(x, y, of, sx, sy, star_of, radius)
    for i in range(len(x)):
        all_ = np.where(star_of == of[i], (sx - x[i]) ** 2 + (sy - y[i]) ** 2, np.inf)
        want = int(all_.argmin()) if all_.min() < radius[of[i]] ** 2 else -1
        assert at[i] == want and (want < 0 or d2[i] == all_[want])


def test_work_does_not_grow_with_the_crowd():
    """Ten times the stars and places: ten times the pairs that are looked at, not a hundred times."""
    g, looked, real = np.random.default_rng(7), [], np.repeat
    for n in (2000, 20_000):
        seen = [0]
        try:
            np.repeat = lambda a, m: (seen.__setitem__(0, seen[0] + int(np.sum(m))), real(a, m))[1]
            at, _ = verify.nearest_of(g.random(n), g.random(n), np.zeros(n, dtype=int), g.random(n), g.random(n), np.zeros(n, dtype=int), np.array([0.3]))
        finally:
            np.repeat = real
        looked.append(seen[0])
        assert (at >= 0).all()
    assert looked[1] < 13 * looked[0]


def test_zones_give_the_pairs_of_cells(spark, monkeypatch):
    """Over edges of zones, at 0 hours and at a pole, mirrored or not, with rows dealt and sources in chunks."""
    monkeypatch.setattr(verify, "A_DEAL", 3)
    monkeypatch.setattr(verify, "A_CHUNK", 70)
    r, rows, sky = random.Random(3), [], []
    for k, (ra, dec) in enumerate(((0.01, 22.5), (89.99, -22.49), (200.0, 5.0), (10.0, 89.9))):
        for _ in range(600):
            d = dec + r.uniform(-1.5, 1.5)
            a = ra + r.uniform(-1.5, 1.5) / max(math.cos(math.radians(min(abs(d), 89.0))), 0.02)
            sky.append((math.cos(math.radians(d)) * math.cos(math.radians(a)), math.cos(math.radians(d)) * math.sin(math.radians(a)), math.sin(math.radians(d))))
        for rank in range(8):
            s, t, flip = math.radians(r.choice([0.2, 2.0, 3.0])) / 1000, r.uniform(0, 6.3), r.choice([-1.0, 1.0])
            o = (math.cos(math.radians(dec)) * math.cos(math.radians(ra)), math.cos(math.radians(dec)) * math.sin(math.radians(ra)), math.sin(math.radians(dec)))
            rows.append((k % 2, rank + 10 * k, rank, flip, 500.0, 500.0, *o, s * math.cos(t), -s * math.sin(t), 1e-4, 1e-9, s * math.sin(t), s * math.cos(t), -2e-4, -1e-9, False, rank % 6))
    state = spark.createDataFrame(rows, "frame_id long, rank int, variant int, turn double, cx double, cy double, ox double, oy double, oz double, a double, b double, c double, d double, e double, f double, g double, h double, frozen boolean, step int")
    state = verify._with_plane(state).select(*verify.KEY, *verify._STATE)
    stars = spark.createDataFrame([(i, *v) for i, v in enumerate(sky + sky[:20])], "star_index int, x_unit double, y_unit double, z_unit double")
    sources = spark.createDataFrame([(f, i, r.uniform(0, 1000), r.uniform(0, 1000)) for f in (0, 1) for i in range(150)], "frame_id long, source_idx int, x_px double, y_px double")
    take = lambda df: {(x["frame_id"], x["rank"], x["variant"], x["star"]): (x["m"]["source_idx"], x["m"]["d2"], x["m"]["xi"]) for x in df.collect()}
    want = take(verify.pairs(state, sources, verify.lookup(stars)))
    level = 3
    assert state.select(F.size(cells.cover(level, F.degrees(F.atan2("oy", "ox")), F.degrees(F.asin("oz")), F.lit(1.0))).alias("n")).agg(F.max("n")).first()[0] > 1
    found = verify.zone_pairs(state, sources, verify.zoned(stars, level), level, 8)
    got = take(found)
    assert found.schema == verify.pairs(state, sources, verify.lookup(stars)).schema
    assert len(want) > 1000 and set(got) == set(want)
    assert all(got[k][0] == want[k][0] and all(math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-18) for p, q in zip(got[k][1:], want[k][1:], strict=True)) for k in want)
