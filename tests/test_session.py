"""The solver's life, a request as JSON, and a stream of requests."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from skyquad import session
from skyquad.operators import synthetic
from skyquad.operators.watch import Watch
from skyquad.plans import solve_queries, tables
from skyquad.errors import AlreadyLoaded, Cancelled, NoDatabase, PatternOutOfRange, StarOutOfRange
from skyquad.session import Solver, remaining_ms
from skyquad.sources import binary, encoded
from skyquad.sources.store import written
from skyquad.streaming import requests

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def solver(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "patch.adb")
    stars = synthetic.solver_stars(tables.patch(spark, SF))
    binary.write_adb(stars, synthetic.nearest_patterns(stars), path, 1, 60)
    s = Solver(spark)
    with pytest.raises(NoDatabase):
        s.solve(spark.range(1), spark.range(1))
    s.load(path)
    with pytest.raises(AlreadyLoaded):
        s.load(path)
    yield s
    s.unload()


@pytest.fixture(scope="module")
def body(spark):
    rows = solve_queries.fields(tables.patch(spark, SF)).filter("frame_id = 0").collect()
    return json.dumps({"sources": [{"x_px": r["x_px"], "y_px": r["y_px"], "flux": r["flux"]} for r in rows], "fov_estimate_deg": 8})


def test_json_request(spark, solver, body):
    r = json.loads(solver.solve_json(body.replace('"fov_estimate_deg"', '"solve_timeout_ms": 0, "fov_estimate_deg"'), 1200, 1200))
    assert r["success"] and r["ra_deg"] == pytest.approx(5, abs=0.05) and r["dec_deg"] == pytest.approx(25, abs=0.05)
    asked = json.loads(body)["sources"]
    assert [(s["x_px"], s["y_px"]) for s in r["detected_stars"]] == [(s["x_px"], s["y_px"]) for s in asked]
    assert r["log"][2].startswith("Database: 150 stars")
    assert len(r["matched_star_positions"]) == r["matched_stars"] and r["solve_time_ms"] > 0 and r["log"][0] == f"Sources: {len(asked)}"
    known = {x["id"]: x for x in tables.patch(spark, SF).collect()}
    for m in r["matched_star_positions"]:
        assert abs(known[m["catalog_id"]]["ra_deg"] - m["ra_deg"]) < 1e-3 and abs(known[m["catalog_id"]]["dec_deg"] - m["dec_deg"]) < 1e-3
    assert json.loads(solver.solve_json("{", 10, 10)) == {"success": False, "error": "the request cannot be read"}
    assert not json.loads(solver.solve_json("[]", 10, 10))["success"]


def test_failures_say_why(spark, solver, body):
    few = json.loads(solver.solve_json(json.dumps({"sources": json.loads(body)["sources"][:3], "solve_timeout_ms": 0}), 1200, 1200))
    assert not few["success"] and len(few["detected_stars"]) == 3 and "fewer than 4" in few["log"][-1] and few["matched_star_positions"] == []
    late = json.loads(solver.solve_json(body.replace('"fov_estimate_deg"', '"solve_timeout_ms": 1, "fov_estimate_deg"'), 1200, 1200))
    assert not late["success"] and "within 1" in late["log"][0]
    assert json.loads(Solver(spark).solve_json(body, 10, 10))["error"] == "the database is not ready"


class Told:
    """Stands for a solver: tells which requests it was given."""

    def __init__(self, spark):
        self.spark = spark

    def plan(self, sources, wanted):
        n = sources.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
        return wanted.join(n, "frame_id", "left").select("frame_id", "width", F.coalesce("n", F.lit(0)).alias("n"))


def test_the_latest_request_of_a_frame_wins(spark, tmp_path):
    """Two requests in one batch, in two batches, one that comes late, and after a restart."""
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    line = lambda frame, generation, n, body=None: json.dumps({"frame_id": frame, "generation": generation, "width": generation, "height": 9, "body": body or json.dumps({"sources": [{"x_px": 1, "y_px": i} for i in range(n)]})})

    def send(name, *lines):
        (folder / name).write_text("\n".join(lines))
        requests.solve_stream(requests.read(spark, str(folder)), Told(spark), out, state, once=True).awaitTermination()  # each time a new query from the checkpoint
        return sorted((r["frame_id"], r["generation"], r["n"]) for r in requests.results(spark, out).collect())

    assert send("a.json", line(5, 1, 3), line(5, 2, 4), line(6, 7, 1), line(7, 1, 0, "{")) == [(5, 2, 4), (6, 7, 1)]
    assert send("b.json", line(5, 3, 6), line(6, 6, 9)) == [(5, 3, 6), (6, 7, 1)]  # 6 comes late and is dropped
    assert send("c.json", line(5, 3, 8), line(6, 8, 2), line(8, 0, 1)) == [(5, 3, 6), (6, 8, 2), (8, 0, 1)]
    batches = spark.read.parquet(out).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in batches) == [1, 2, 2]


def test_stream_of_requests(spark, solver, body, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"frame_id": 5, "width": 1200, "height": 1200, "body": body}) + "\n" + json.dumps({"frame_id": 6, "width": 9, "height": 9, "body": "{"}) + "\n")
    requests.solve_stream(requests.read(spark, str(tmp_path / "in")), solver, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["frame_id"], r["success"]) for r in rows] == [(5, True)]


def test_equal_content_is_prepared_once(spark, solver, tmp_path, monkeypatch):
    """The same bytes under another path are found again; a changed magnitude is another content."""
    stars = synthetic.solver_stars(tables.patch(spark, SF).limit(30))
    patterns = written(synthetic.nearest_patterns(stars), "few_patterns")
    one, two, cache = str(tmp_path / "one.adb"), str(tmp_path / "two.adb"), str(tmp_path / "cache")
    binary.write_adb(stars, patterns, one, 1, 60)
    binary.write_adb(stars, patterns, two, 1, 60)
    assert open(one, "rb").read() == open(two, "rb").read() and binary.fingerprint(spark, one) == binary.fingerprint(spark, two)
    first = Solver(spark)
    first.load(one, cache)
    want = first.loaded[2].count()

    def built(*args, **kw):
        raise AssertionError("built again")

    monkeypatch.setattr(session.matching, "pattern_index", built)
    again = Solver(spark)
    again.load(two, cache)
    assert again.loaded[2].count() == want > 0
    binary.write_adb(stars.withColumn("mag", F.col("mag") + 1), patterns, two, 1, 60)
    with pytest.raises(AssertionError, match="built again"):
        Solver(spark).load(two, cache)


def test_a_cancel_leaves_no_task_and_no_result(spark, solver, body):
    rows = [(0, i, s["x_px"], s["y_px"], s["flux"]) for i, s in enumerate(json.loads(body)["sources"])]
    sources = spark.createDataFrame(rows, "frame_id long, source_idx int, x_px double, y_px double, flux double")
    wanted = spark.createDataFrame([(0, 1200, 1200, 8.0, None)], "frame_id long, width int, height int, fov_estimate_deg double, fov_max_error_deg double")
    threading.Timer(4.0, solver.cancel).start()
    with pytest.raises(Cancelled):
        solver.solve(sources, wanted)
    tracker, until = spark.sparkContext.statusTracker(), time.monotonic() + 20
    while tracker.getActiveStageIds() and time.monotonic() < until:
        time.sleep(0.2)
    assert not tracker.getActiveStageIds() and not tracker.getActiveJobsIds()
    assert len(solver.solve(sources, wanted)) == 1  # the next one is not disturbed


def test_a_deadline_is_looked_at_in_tasks(spark):
    past, ahead = Watch(int(time.time() * 1000) - 1), Watch(int(time.time() * 1000) + 600_000)
    with pytest.raises(Exception, match="deadline"):
        past.guarded(spark.range(1000)).count()
    assert ahead.guarded(spark.range(1000)).count() == 1000
    soon = Watch(int(time.time() * 1000) + 1500)
    slow = spark.range(8).repartition(2).select(F.reflect(F.lit("java.lang.Thread"), F.lit("activeCount")).alias("x"), "id").withColumn("y", F.expr("aggregate(sequence(1, 3000000), 0L, (a, i) -> a + i)"))
    with pytest.raises(Exception, match="deadline"):
        soon.guarded(slow.unionByName(slow).unionByName(slow).unionByName(slow)).write.format("noop").mode("overwrite").save()
        soon.check()
    with pytest.raises(TimeoutError):
        past.check()


def test_databases_as_bytes_in_a_column(spark, tmp_path):
    stars = written(synthetic.solver_stars(tables.patch(spark, SF).limit(40)), "some_stars")
    patterns = written(synthetic.nearest_patterns(stars), "some_patterns")
    path = str(tmp_path / "a.adb")
    binary.write_adb(stars, patterns, path, 1, 60)
    whole = open(path, "rb").read()
    rows = [("whole", whole), ("patterns cut", whole[:-3]), ("stars cut", whole[: 64 + 28 * 40 - 1]), ("short", whole[:63]), ("magic", b"XDB\0" + whole[4:]), ("version", whole[:4] + b"\2" + whole[5:]), ("null", None), ("longer", whole + b"more")]
    df = spark.createDataFrame(rows, "db_id string, content binary")
    told = {s: {} for s in ("header", "stars", "patterns")}
    for section, found in told.items():
        for r in encoded.decoded(df, section).collect():
            found.setdefault(r["db_id"], []).append(r)
        assert set(found) == {k for k, _ in rows}
    first = lambda section, k: told[section][k][0]["error"]
    assert [first("stars", k) is None for k, _ in rows] == [True, True, False, False, False, False, False, True]
    assert [first("patterns", k) is None for k, _ in rows] == [True, False, False, False, False, False, False, True]
    assert first("stars", "stars cut").startswith("Truncated: stars: 39 of 40") and first("header", "magic").startswith("BadMagic") and first("header", "version").startswith("UnsupportedVersion") and first("stars", "null").startswith("Truncated")
    want = {s: [tuple(r) for r in binary.read_adb(spark, path, s).collect()] for s in told}
    for section, found in told.items():
        got = sorted(tuple(r)[2:] for r in found["whole"])
        assert repr(got) == repr(sorted(want[section]))
    with pytest.raises(StarOutOfRange):
        binary.record(spark, path, "stars", 40)
    with pytest.raises(PatternOutOfRange):
        binary.record(spark, path, "patterns", -1)
    assert binary.record(spark, path, "stars", 39).count() == 1
    with pytest.raises(Exception, match="does not fit"):
        binary.write_adb(stars, patterns.withColumn("s3", F.lit(70_000)), str(tmp_path / "b.adb"))


def test_time_left():
    assert remaining_ms(0) == 30_000 and remaining_ms(29_900) == 1_000
