"""Fixed cases: boundaries, round trips, invariance."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquad.functions import hashes
from skyquad.functions.camera import from_gnomonic, gnomonic
from skyquad.operators import catalog, detect, fits, matching, points
from skyquad.sources import binary, catalog_csv, encoded


def stars(spark, rows):
    return spark.createDataFrame(rows, "id long, ra_deg double, dec_deg double, mag double")


SIX = [(201, 0.0, 90.0, 2.0), (202, 0.0, 0.0, 3.0), (203, 90.0, 0.0, 4.0), (204, 180.0, 0.0, 5.0), (205, 270.0, 0.0, 6.0), (206, 45.0, 45.0, 7.0)]


def keys(spark, quads):
    df = spark.createDataFrame([(i, *[float(v) for p in q for v in p]) for i, q in enumerate(quads)], "n int, " + ", ".join(f"x{k} double, y{k} double" for k in range(4)))
    d = hashes.pixel_distances([(F.col(f"x{k}"), F.col(f"y{k}")) for k in range(4)])
    return {r["n"]: tuple(r["key"]) for r in hashes.with_key(df, d, 0.02).select("n", "key").collect()}


def test_one_key_for_all_orders_and_moves(spark):
    quad = [(12, 5), (88, 10), (40, 72), (55, 28)]
    turn = lambda p, a=0.6458, k=2.5: (k * (p[0] * math.cos(a) - p[1] * math.sin(a)) + 7, k * (p[0] * math.sin(a) + p[1] * math.cos(a)) - 3)
    found = keys(spark, [*itertools.permutations(quad), [turn(p) for p in quad]])
    assert len(found) == 25 and len(set(found.values())) == 1


def test_points_on_a_line_or_in_one_place_have_no_key(spark):
    assert keys(spark, [[(0, 0), (1, 0), (2, 0), (3, 0)], [(5, 5)] * 4]) == {}


def test_keys_are_held_to_16_bits(spark):
    f = F.struct(*[F.lit(v).alias(k) for k, v in zip(hashes.KEY, (1e6, -1e6, 0.05, -0.05), strict=True)])
    assert tuple(spark.range(1).select(hashes.quantised(f, 0.02).alias("k")).first()["k"]) == (32767, -32768, 3, -3)


def test_cones_and_statistics(spark):
    six = catalog.sky_index(stars(spark, SIX))
    assert [catalog.cone(six, *c).count() for c in ((0, 90, 1), (0, 0, 180), (0, 0, 0))] == [1, 6, 1]
    s = catalog.stats(stars(spark, [(1, 10.0, 20.0, 3.0), (2, 50.0, 60.0, 5.0), (3, 100.0, -80.0, None)])).first()
    assert (s["count"], s["with_mag"], s["mag_min"], s["mag_max"], s["mag_mean"]) == (3, 2, 3, 5, 4)
    assert catalog.stats(stars(spark, [])).first()["count"] == 0


def test_unknown_magnitudes(spark):
    s = stars(spark, [(1, 0.0, 0.0, 5.0), (2, 0.0, 0.0, 9.0), (3, 0.0, 0.0, None), (4, 0.0, 0.0, 7.5)])
    assert {r["id"] for r in catalog.brighter_than(s, 8).collect()} == {1, 4}
    assert {r["id"] for r in catalog.visible(s, 0, 0, 5, 5, 8).collect()} == {1, 3, 4}


@pytest.mark.parametrize("centre,star", [((60, 30), (61.5, 31.2)), ((359.5, 0), (0.5, 0)), ((10, 89.999), (200, 89.5))])
def test_projection_and_back(spark, centre, star):
    x, y = gnomonic(*centre, *star)
    r = spark.range(1).select(*from_gnomonic(*centre, x, y)).first()
    assert r[0] == pytest.approx(star[0], abs=1e-6) and r[1] == pytest.approx(star[1], abs=1e-6)


def test_affine_is_recovered(spark):
    a, k = math.radians(30), 2.0
    rows = [(0, float(x), float(y), k * (x * math.cos(a) - y * math.sin(a)) + 5, k * (x * math.sin(a) + y * math.cos(a)) + 3) for x, y in ((0, 0), (10, 0), (0, 10), (7, 9))]
    f = fits.fit_affine(spark.createDataFrame([*rows, (1, 0.0, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0, 1.0), (2, 2.0, 2.0, 1.0, 1.0), (2, 3.0, 3.0, 1.0, 1.0)], "g int, px double, py double, xi double, eta double"), ["g"])
    t = {c: F.col(c) for c in ("a", "b", "tx", "c", "d", "ty")}
    r = {x["g"]: x for x in f.withColumns({"s": fits.affine_scale(t), "r": fits.rotation_deg(t)}).collect()}
    assert r[0]["s"] == pytest.approx(2) and r[0]["r"] == pytest.approx(30) and r[0]["tx"] == pytest.approx(5)
    assert r[1]["a"] is None and r[2]["a"] is None


def test_radial_fit_agrees_with_numpy(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 1000, (30, 2))
    rows = np.column_stack([p, np.ones(30), ((p - [500, 400]) ** 2).sum(axis=1)])
    want = rng.normal(size=(4, 2)) * [[1e-3], [1e-3], [1], [1e-7]]
    sky = rows @ want
    f = fits.fit_radial(spark.createDataFrame([(0, *map(float, (*a, *b)), 500.0, 400.0) for a, b in zip(p, sky, strict=True)], "k int, px double, py double, xi double, eta double, cx double, cy double"), ["k"]).first()
    assert [f[c] for c in "abcd"] == pytest.approx(want[:, 0].tolist(), rel=1e-6) and [f[c] for c in "efgh"] == pytest.approx(want[:, 1].tolist(), rel=1e-6)


def test_greedy_distance_filter(spark):
    s = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0), (0, 1, 3.0, 0.0, 2.0), (0, 2, 6.0, 0.0, 3.0), (1, 0, 1.0, 1.0, None)], "frame_id long, source_idx int, x_px double, y_px double, flux double")
    assert {(r["frame_id"], r["source_idx"]) for r in points.apart(s, 5.0).collect()} == {(0, 0), (0, 2), (1, 0)}


def test_first_wide_combinations():
    rng = np.random.default_rng(3)
    for n, spread in itertools.product((0, 3, 4, 7, 11), (0.0, 3.0, 6.0, 40.0)):
        xs, ys = rng.normal(0, spread + 1e-9, n), rng.normal(0, spread, n)
        if n > 6:
            xs[rng.integers(n)] += 30 * (spread == 3.0)
        d = np.hypot(np.subtract.outer(xs, xs), np.subtract.outer(ys, ys))
        want = [c for c in itertools.combinations(range(n), 4) if max(d[a, b] for a, b in itertools.combinations(c, 2)) >= 5.0]
        for most in (1, 5, 1000):
            assert list(points.first_wide(xs, ys, most, 5.0)) == want[:most]


def test_early_quads_of_crowded_frames(spark):
    # frame 0 is wide, in frame 1 only the last source is far from the others, in frame 2 none is
    place = "case frame_id when 0 then cast(id * 7 % 100 as double) when 1 then if(id = 2999, 50D, 0D) else 0D end x_px"
    s = spark.range(3).withColumnRenamed("id", "frame_id").crossJoin(spark.range(3000)).selectExpr("frame_id", "id as source_idx", place, "0D as y_px", "1D as flux")
    got = {(r["frame_id"], r["i"], r["j"], r["k"], r["l"]) for r in points.early_quads(s, 20).select("frame_id", "i", "j", "k", "l").collect()}
    assert got == {(0, 0, 1, 2, n) for n in range(3, 23)} | {(1, 0, 1, k, 2999) for k in range(2, 22)}


def test_crowded_frame_needs_little_memory():
    import tracemalloc

    xs = np.arange(20_000) % 977.0
    tracemalloc.start()
    assert len(list(points.first_wide(xs, xs, 200, 5.0))) == 200
    assert tracemalloc.get_traced_memory()[1] < 20_000_000  # all distances would be 3.2 GB
    tracemalloc.stop()


def test_one_star_keeps_one_source(spark):
    right = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0)], "frame_id int, other int, ox double, oy double")
    crowd = spark.createDataFrame([(0, 0, 0.01, 0.0), (0, 1, 0.03, 0.0)], "frame_id int, id int, x double, y double")
    apart = spark.createDataFrame([(0, 0, 0.55, 0.0), (0, 1, 0.45, 0.0)], "frame_id int, id int, x double, y double")
    assert matching.one_to_one(crowd, right, 0.2).count() == 1
    assert matching.one_to_one(apart, right, 0.6).count() == 2


def test_binary_catalog_round_trip(spark, tmp_path):
    path = str(tmp_path / "c.bin")
    binary.write_astr(stars(spark, [(1, 0.0, 0.0, 1.0), (2, 180.0, 45.0, 3.5), (3, 90.0, -30.0, None)]), path)
    back = {r["id"]: r for r in binary.read_astr(spark, path).collect()}
    assert back[3]["mag"] is None and back[2]["mag"] == 3.5 and back[2]["dec_deg"] == 45 and back[1]["x"] == 1
    assert (tmp_path / "c.bin").stat().st_size == 20 + 28 * 3
    with pytest.raises(binary.FormatError):
        binary.head(path, binary.ADB_HEAD, binary.ADB_MAGIC)


def test_solver_database_round_trip(spark, tmp_path):
    path = str(tmp_path / "c.adb")
    s = spark.createDataFrame([(i, 1001 + i, 0.1, 0.2, 0.9, 0.1, 0.2, 3.5) for i in range(5)], binary.SCHEMAS["stars"])
    p = spark.createDataFrame([(0, 0, 1, 2, 3), (1, 1, 2, 3, 4), (2, 0, 2, 4, 1)], binary.SCHEMAS["patterns"])
    assert binary.write_adb(s, p, path, 10, 30) == 5
    h = binary.read_adb(spark, path, "header").first()
    assert (h["n_stars"], h["n_patterns"], h["min_fov_deg"], h["pattern_bins"]) == (5, 3, 10, 50)
    assert sorted(r["catalog_id"] for r in binary.read_adb(spark, path).collect()) == [1001, 1002, 1003, 1004, 1005]
    assert tuple(binary.read_adb(spark, path, "patterns").filter("pattern_index = 2").first()) == (2, 0, 2, 4, 1)
    assert binary.read_adb(spark, path).filter("star_index = 9").count() == 0


def test_database_of_more_stars_than_16_bits(spark, tmp_path):
    path, n = str(tmp_path / "w.adb"), binary.MAX_STARS + 1
    s = spark.range(n).selectExpr("cast(id as int) star_index", "id + 7 catalog_id", *[f"cast(id as float) {c}" for c in ("ra_rad", "dec_rad", "x_unit", "y_unit", "z_unit", "mag")])
    p = spark.createDataFrame([(0, 0, 1, 2, 65_536), (1, 65_533, 65_534, 65_535, 65_536)], binary.SCHEMAS["patterns"])
    assert binary.write_adb(s, p, path, 10, 30) == n
    h = binary.read_adb(spark, path, "header").first()
    assert (h["version"], h["n_stars"], h["n_patterns"]) == (1, n, 2)
    assert [tuple(r) for r in binary.read_adb(spark, path, "patterns").orderBy("pattern_index").collect()] == [tuple(r) for r in p.collect()]
    assert binary.read_adb(spark, path).filter("star_index = 65536").first()["catalog_id"] == 65_543
    held = spark.read.format("binaryFile").load(path).selectExpr("1L as db_id", "content")
    assert [tuple(r)[2:] for r in encoded.decoded(held, "patterns").collect()] == [tuple(r) for r in p.collect()]
    # one star less, and the file is the 16-bit one
    small = str(tmp_path / "s.adb")
    binary.write_adb(s.limit(binary.MAX_STARS), p.limit(0), small)
    assert open(path, "rb").read(4) == binary.WIDE_MAGIC and open(small, "rb").read(4) == binary.ADB_MAGIC


def test_hipparcos_rows(spark, tmp_path):
    f = tmp_path / "h.csv"
    f.write_text("HIP,Vmag,RA_ICRS_deg,DE_ICRS_deg\n1,9.1,0.5,1.5\nx,1,2,3\n3,,10,20\n4,bad,10,-20\n5,1,2,95\n6,1,,3\n")
    got = {r["id"]: r["mag"] for r in catalog_csv.read_hipparcos(spark, str(f)).collect()}
    assert got == {1: 9.1, 3: None, 4: None}
    assert {r["id"] for r in catalog_csv.read_hipparcos(spark, str(f), "skip").collect()} == {1, 3, 4}


def test_empty_image_has_no_stars(spark):
    frames = spark.createDataFrame([(0, 60, 50, 10)], "frame_id long, width int, height int, background int")
    none = spark.createDataFrame([], "frame_id long, x double, y double, flux double, sigma double")
    assert detect.detect(detect.render(frames, none, 2.0, 7)).count() == 0
