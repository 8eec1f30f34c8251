"""A stored pattern index: what its plans do not do, and that it is found again."""

import duckdb
import pytest
from pyspark.sql import functions as F

from skyquad.functions import hashes
from skyquad.operators import matching, points
from skyquad.plans import registry, solve_queries, tables
from skyquad.sources.store import written

SF = "/root/testdata/sf0.001"


def scans_without_exchange(df, table):
    """Whether each scan of the table in the plan that runs has neither an exchange nor a sort above it before its join."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    found = 0
    for i, line in enumerate(lines):
        if "FileScan" in line and "Bucketed: true" in line and table in line:
            found += 1
            depth = len(line) - len(line.lstrip(" :+-"))
            for above in reversed(lines[:i]):
                d = len(above) - len(above.lstrip(" :+-"))
                if d < depth:
                    depth = d
                    assert "Exchange" not in above, above
                    if "Join" in above:
                        break
    return found


def test_searches_of_a_stored_index_shuffle_only_the_quads(spark, tmp_path):
    catalog, _, index = solve_queries.database(spark, SF)
    quads = written(points.quads(solve_queries.fields(catalog)), "quads")
    stored = matching.write_pattern_index(index, "patterns_of_a_test", str(tmp_path / "index"), 4)
    assert stored.count() == index.count()
    want = sorted((r["frame_id"], r["rank"], r["pattern_index"], r["i"], r["l"]) for r in matching.candidates(quads, index).collect())
    spark.sql("DROP TABLE patterns_of_a_test")  # the files stay
    again = matching.open_pattern_index(spark, "patterns_of_a_test", str(tmp_path / "index"), 4)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = matching.candidates(quads, again, small=0)
        assert scans_without_exchange(found, "patterns_of_a_test") == 2
        assert scans_without_exchange(matching.exact_matches(quads, again), "patterns_of_a_test") == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["frame_id"], r["rank"], r["pattern_index"], r["i"], r["l"]) for r in found.collect()) == want
    key = again.select("key").first()["key"]
    one = spark.range(1).select(F.struct(*[F.lit(key[k]).alias(k) for k in hashes.KEY]).alias("key"))
    assert matching.exact_matches(one, again).count() == index.filter(F.struct(*[F.col(f"key.{k}") for k in hashes.KEY]) == F.struct(*[F.lit(key[k]) for k in hashes.KEY])).count() > 0


def test_pairs_are_dealt_before_they_are_counted(spark):
    """No table of pairs is made where quads and patterns meet, and more tasks for a larger index change no result."""
    _, _, index = solve_queries.database(spark, SF)
    quads = written(points.quads(solve_queries.fields(written(tables.patch(spark, SF), "catalog"))), "quads")
    few, many = (matching.candidates(quads, index, per_frame=50, a_part=n) for n in (1 << 30, 20))
    columns = ["frame_id", "i", "j", "k", "l", "pattern_index", "rank"]
    assert sorted(map(tuple, few.select(columns).collect())) == sorted(map(tuple, many.select(columns).collect()))
    plan = many.select(columns)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Aggregate [frame_id" in line)
    assert "RepartitionByExpression" in plan[at + 1] and plan[at + 1].rstrip().endswith(str(-(-index.count() // 20)))


@pytest.mark.parametrize("name", ["key_lookup", "key_band_join", "stored_index_join"])
def test_pairs_of_equal_keys_are_made_by_all_tasks(spark, name):
    """The tables are one file each and have 23 keys; no task makes more than its share of the pairs."""
    counts = [r["count"] for r in registry.QUERIES[name](spark, "/root/testdata/sf0.01").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == duckdb.sql("select count(*) from '/root/testdata/sf0.01/supplier.parquet' join '/root/testdata/sf0.01/part.parquet' on s_suppkey % 23 = p_partkey % 23").fetchall()[0][0]
    assert len(counts) == 8 and max(counts) <= 0.25 * sum(counts)


def test_lists_of_equal_keys(spark):
    """Lists are bounded, lose no null and no repeated row, and give each pair once."""
    key = F.struct(*[(F.col("n") % m).cast("int").alias(k) for k, m in zip(hashes.KEY, (3, 1, 1, 1), strict=True)]).alias("key")
    rows = spark.range(300).select(F.col("id").alias("n")).repartition(4)
    left, right = rows.filter("n < 40").select(key, F.when(F.col("n") % 7 != 0, F.floor(F.col("n") / 2)).alias("a")), rows.select(key, F.col("n").alias("b"))
    lists = matching.listed(left, "a", 8)
    assert max(r["n"] for r in lists.select(F.size("a").alias("n")).collect()) <= 8
    found = matching.expanded(matching.exact_matches(lists, matching.listed(right, "b", 64).withColumnRenamed("b", "pattern_index")), "a", "pattern_index", run=5)
    plain = left.join(right, "key").select("a", "b")
    assert sorted(map(repr, map(tuple, found.select("a", "pattern_index").collect()))) == sorted(map(repr, map(tuple, plain.collect())))
