"""Operator 8 against a plain ring that places keys one by one."""

import bisect
import hashlib

import xxhash

from skyquad.llm import sharding


def plain(keys, shards, nodes=64):
    """key -> (shard, slot)"""
    ring = sorted({(int.from_bytes(hashlib.md5(f"shard {s} node {v}".encode()).digest()[:4], "big"), s) for s in range(shards) for v in range(nodes)})
    points = [p for p, _ in ring]
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    arcs = [[] for _ in ring]
    for k in keys:
        seed = xxhash.xxh64(b"ring", seed=42).intdigest()
        at = xxhash.xxh64(k.to_bytes(8, "little", signed=True), seed=seed).intdigest() % (1 << 32)
        i = bisect.bisect_left(points, at)
        arcs[i % len(ring)].append((i == len(ring), at, k))
    used, out, over = [0] * shards, {}, []

    def put(k, s):
        out[k] = s, used[s]
        used[s] += 1

    for i, arc in enumerate(arcs):
        for *_, k in sorted(arc):
            put(k, ring[i][1]) if used[ring[i][1]] < room[ring[i][1]] else over.append((i, k))
    for i, k in over:
        j = (i + 1) % len(ring)
        while used[ring[j][1]] >= room[ring[j][1]]:
            j = (j + 1) % len(ring)
        put(k, ring[j][1])
    return out


def test_against_a_plain_ring(spark):
    for n, shards in ((5003, 16), (700, 5), (3, 16)):
        docs = spark.createDataFrame([(k * 7919 - 50_000,) for k in range(n)], "doc_id long")
        got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs, shards).collect()}
        assert got == plain([k * 7919 - 50_000 for k in range(n)], shards)


def test_one_more_shard_moves_little():
    keys = [k * 104_729 for k in range(20_000)]
    before, after = plain(keys, 16), plain(keys, 17)
    assert sum(before[k][0] != after[k][0] for k in keys) < 0.12 * len(keys)  # 1 of 17 has to move
