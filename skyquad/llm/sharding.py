"""Operator 8: sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyquad.llm.common import documents, row_of, text_hash, written

_RING = 1 << 32


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(point, shard) of each virtual node, in ring order; a key belongs to the first node at or after it."""
    points = {(int.from_bytes(hashlib.md5(f"shard {s} node {v}".encode()).digest()[:4], "big"), s) for s in range(shards) for v in range(nodes)}
    return sorted(points)


def place(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the keys of each arc go: (arc, first rank, end rank, shard, first slot).

    Each arc's keys go to its owner while that has room; what does not fit goes
    on clockwise, to the next node whose shard has room. Works on one count for
    each arc, whose number is shards * nodes whatever the number of keys.
    """
    left, used, out, over = list(room), [0] * len(room), [], []

    def put(arc: int, lo: int, n: int, shard: int) -> int:
        take = min(n, left[shard])
        if take:
            out.append((arc, lo, lo + take, shard, used[shard]))
            left[shard] -= take
            used[shard] += take
        return take

    for arc, n in enumerate(counts):
        if (took := put(arc, 0, n, owners[arc])) < n:
            over.append((arc, took))
    for arc, lo in over:
        at = arc
        while lo < counts[arc]:
            at = (at + 1) % len(owners)
            lo += put(arc, lo, counts[arc] - lo, owners[at])
    return out


def shard(docs: DataFrame, shards: int = 16, nodes: int = 64, cells: int = 16, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    A document's place on the ring is a hash of its key columns. Each shard has
    room for rows / shards rows, rounded so that the rooms add up to all rows:
    shards differ by one row at most, and only what overflows a full shard moves
    on clockwise. Ranks along an arc come from counts of its cells (shards *
    nodes * cells rows in all) and a row number within each cell, so no task
    holds a shard.

    Rows with equal keys share one place, in any order among themselves: give
    the hash of the text as part of the key where ids repeat or are null, so
    that such rows spread over the ring and only rows that are equal throughout
    (ties) are interchangeable. Texts, null, empty or long, are not looked at.
    An empty table gives an empty result. Columns of docs named shard or slot
    are replaced, all others stay as they are.
    """
    spark, nodes_at = docs.sparkSession, ring(shards, nodes)
    docs = docs.drop("shard", "slot")
    rows = docs.select(row_of(docs), *[F.col(c).alias(f"key{i}") for i, c in enumerate(key)])
    keys = [f"key{i}" for i in range(len(key))]
    starts = F.array(*[F.lit(p) for p, _ in nodes_at])
    at = F.pmod(F.xxhash64(F.lit("ring"), *keys), F.lit(_RING))
    #: the arc ends at the first node at or after the place; places after the last node belong to the first
    arcs = spark.range(1).select(F.posexplode(starts).alias("arc", "point"))
    low = F.coalesce(F.lag("point").over(Window.orderBy("point", "arc")), F.lit(-1))
    arcs = arcs.select("arc", low.alias("low"), F.col("point").alias("high"))
    arcs = arcs.union(arcs.groupBy().agg(F.lit(0).alias("arc"), F.max("high").alias("low"), F.lit(_RING).alias("high")))
    #: an arc can span several of the 65,536 equal slices of the ring; each slice knows the few arcs that touch it
    slices = arcs.filter("high > low").withColumn("slice", F.explode(F.sequence(F.expr("(low + 1) div 65536"), F.least(F.expr("high div 65536"), F.lit(65535)))))
    keyed = rows.withColumn("at", at).withColumn("slice", F.expr("at div 65536"))
    keyed = keyed.join(F.broadcast(slices), "slice").filter("at > low and at <= high").drop("slice")
    keyed = keyed.withColumn("cell", F.expr(f"least((at - low - 1) * {cells} div (high - low), {cells - 1})")).withColumn("turn", (F.col("low") >= nodes_at[-1][0]).cast("int")).drop("low", "high")
    per = written(keyed.groupBy("arc", "turn", "cell").count(), "ring_cells")
    by_cell = Window.partitionBy("arc").orderBy("turn", "cell").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("arc", "turn", "cell", F.coalesce(F.sum("count").over(by_cell), F.lit(0)).alias("base"))
    found = {r["arc"]: r["n"] for r in per.groupBy("arc").agg(F.sum("count").alias("n")).collect()}  # at most shards * nodes rows
    total = sum(found.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    spans = place([found.get(a, 0) for a in range(len(nodes_at))], [s for _, s in nodes_at], room) or [(-1, 0, 0, 0, 0)]
    values = ", ".join(f"named_struct('arc', {a}, 'lo', {lo}L, 'hi', {hi}L, 'shard', {s}, 'start', {k}L)" for a, lo, hi, s, k in spans)
    table = spark.range(1).select(F.expr(f"inline(array({values}))"))
    in_cell = Window.partitionBy("arc", "turn", "cell").orderBy("at", *keys)
    ranked = keyed.join(F.broadcast(base), ["arc", "turn", "cell"]).withColumn("rank", F.col("base") + F.row_number().over(in_cell) - 1)
    out = ranked.join(F.broadcast(table), "arc").filter("rank >= lo and rank < hi")
    return out.select("row.*", "shard", (F.col("start") + F.col("rank") - F.col("lo")).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *text_hash(F.col("text")))
    out = shard(docs, key=("doc_id", "th", "th2"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
