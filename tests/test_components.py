"""Components of lit pixels against a plain flood fill, on images drawn and made by noise, spirals and combs; resizing and random stars."""

import random

import pytest

from skyquad.operators import components, detect
from skyquad.plans import tables

SF = "/root/testdata/sf0.001"


def flood(pixels):
    """(y, x) -> the first pixel of its component by lines."""
    left, out = set(pixels), {}
    for start in sorted(pixels):
        if start not in left:
            continue
        todo = [start]
        left.discard(start)
        while todo:
            y, x = todo.pop()
            out[y, x] = start
            for q in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                if q in left:
                    left.discard(q)
                    todo.append(q)
    return out


def spiral(n):
    out, y, x, dy, dx, side, turn = set(), n, n, 0, 1, 2, 0
    while side < 2 * n - 2:
        for _ in range(side):
            out.add((y, x))
            y, x = y + dy, x + dx
        dy, dx, turn = dx, -dy, turn + 1
        side += 2 if turn % 2 == 0 else 0
    return out


def images():
    r = random.Random(7)
    yield from ({(y, x) for y in range(40) for x in range(200) if r.random() < p} for p in (0.05, 0.3, 0.42, 0.6))
    yield spiral(20)
    yield {(y, x) for y in range(60) for x in range(0, 300, 2) if y == 59 or x % 4 == 0}  # a comb: many runs in each line
    yield {(i, i) for i in range(80)} | {(i, 200 - i) for i in range(80)}
    yield {(0, 0)}


def same_components(got, lit):
    assert len(got) == len(lit)
    want, seen = flood(lit), {}
    for (y, x), label in got.items():
        assert seen.setdefault(label, want[y, x]) == want[y, x]
    assert len(seen) == len(set(want.values()))
    assert [seen[k] for k in sorted(seen)] == sorted(seen.values())  # labels are in the order of the first pixels


def test_against_a_flood_fill(spark):
    pictures = list(images())
    rows = [(f, y, x, 1.0) for f, lit in enumerate(pictures) for y, x in lit]
    out = components.labelled(spark.createDataFrame(rows, "frame_id long, y int, x int, sub float")).collect()
    for f, lit in enumerate(pictures):
        same_components({(r["y"], r["x"]): r["label"] for r in out if r["frame_id"] == f}, lit)


def test_on_frames_of_a_given_table(spark):
    rows = detect.lit(detect.above_background(tables.raster(spark, SF)), 1.0)
    found = {}
    for r in components.labelled(rows).collect():
        found.setdefault(r["frame_id"], {})[r["y"], r["x"]] = r["label"]
    assert len(found) == 10
    for got in found.values():
        same_components(got, set(got))


def test_a_long_path_and_a_star_of_edges(spark):
    edges = [(1, i, i + 1) for i in range(300)] + [(1, 1000, k) for k in range(1001, 1400)] + [(2, 5, 4), (2, 4, 5), (2, 9, 9)]
    got = {(r["g"], r["node"]): r["label"] for r in components.connected(spark.createDataFrame(edges, "g long, a long, b long"), "g").collect()}
    assert got == {(1, i): 0 for i in range(301)} | {(1, k): 1000 for k in range(1000, 1400)} | {(2, 4): 4, (2, 5): 4}
    assert components.connected(spark.createDataFrame([], "g long, a long, b long"), "g").collect() == []


@pytest.mark.parametrize(("width", "height", "to"), [(7, 5, 3), (4, 4, 4), (3, 2, 9), (50, 1, 8)])
def test_resizing_against_plain_means(spark, width, height, to):
    r = random.Random(width)
    image = {(y, x): tuple(r.randrange(256) for _ in range(3)) for y in range(height) for x in range(width)}
    got = {(p["y"], p["x"]): (p["r"], p["g"], p["b"]) for p in detect.resized(spark.createDataFrame([(1, y, x, *v) for (y, x), v in image.items()], "frame_id long, y int, x int, r int, g int, b int"), to).collect()}
    high = max(1, int(height * to / width + 0.5))
    sx, sy = width / to, height / high
    for v in range(high):
        for u in range(to):
            for k in range(3):
                want = sum(image[y, x][k] * max(0, min(x + 1, (u + 1) * sx) - max(x, u * sx)) * max(0, min(y + 1, (v + 1) * sy) - max(y, v * sy)) for y in range(height) for x in range(width)) / sx / sy
                assert abs(got[v, u][k] - want) <= 0.5 + 1e-9
    assert len(got) == to * high
