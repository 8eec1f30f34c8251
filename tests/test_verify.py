"""The relational verification against a plain version, row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquad.operators import matching, points, verify
from skyquad.plans import solve_queries
from skyquad.sources.store import written
from tests import plain_verify

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def candidates(spark):
    catalog, stars, index = solve_queries.database(spark, SF)
    sources = written(solve_queries.fields(catalog), "sources")
    found = matching.candidates(written(points.quads(sources), "quads"), index)
    return written(found.filter("rank <= 60 or rank % 40 = 0"), "some_candidates"), sources, stars


def plain(candidates, sources, stars):
    table = stars.orderBy("star_index").toPandas()
    sky, out = table[["x_unit", "y_unit", "z_unit"]].to_numpy(float), {}
    for frame, group in candidates.toPandas().groupby("frame_id"):
        xy = sources.filter(F.col("frame_id") == frame).orderBy("source_idx").select("x_px", "y_px").toPandas().to_numpy(float)
        rows = [(r["rank"], v, r) for _, r in group.iterrows() for v in range(8)]
        for at in range(0, len(rows), 128):
            part = rows[at : at + 128]
            image = np.array([[(p["x"], p["y"]) for p in r["image"]] for *_, r in part])
            vectors = np.array([[(p["x"], p["y"], p["z"]) for p in r["vectors"]] for *_, r in part])
            order = np.array([([1, 0] if v & 4 else [0, 1]) + ([3, 2] if v & 2 else [2, 3]) for _, v, _ in part])
            mirrored = np.array([v % 2 == 1 for _, v, _ in part])
            for (rank, v, _), one in zip(part, plain_verify.verify_many(image, vectors[np.arange(len(part))[:, None], order], mirrored, xy, sky), strict=True):
                if one:
                    out[frame, rank, v] = one
    return out


@pytest.mark.parametrize("limits", [(verify.FEW_SOURCES, verify.FEW_STARS), (0, 0)])
def test_against_the_plain_version(spark, candidates, limits):
    """By broadcast, and by shuffles of sources and stars."""
    found, sources, stars = candidates
    got = {(r["frame_id"], r["rank"], r["variant"]): r for r in verify.verified(found, sources, stars, *limits).collect()}
    want = plain(found, sources, stars)
    assert len(want) > 100 and set(got) == set(want)
    for key, w in want.items():
        g = got[key]
        assert g["matched"] == w["matched"] and g["mirrored"] == (key[2] % 2 == 1)
        assert [(m["source_idx"], m["star_index"]) for m in g["matches"]] == list(zip(w["src"].tolist(), w["star"].tolist(), strict=True))
        assert abs(g["rms_arcsec"] - w["rms_arcsec"]) < 1e-5
        assert all(abs(g[c] - w[c]) <= 1e-7 * abs(w[c]) + 1e-13 for c in "abef") and all(abs(g[c] - w[c]) < 1e-8 for c in "cg") and all(abs(g[c] - w[c]) < 1e-13 for c in "dh") and all(abs(g[c] - w[c]) < 1e-11 for c in "xyz")


def test_no_candidates(spark, candidates):
    found, sources, stars = candidates
    assert verify.verified(found.limit(0), sources, stars).collect() == []
