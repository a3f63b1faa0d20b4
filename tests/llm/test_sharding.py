import math
import zlib

import xxhash

from quarry.llm.sharding import plain_layout, shard, shard_digest, slots


def draw(name, key, weight):
    h = xxhash.xxh64(name.encode(), seed=42).intdigest()
    if key is not None:
        h = xxhash.xxh64(key.to_bytes(8, "little", signed=True), seed=h).intdigest()
    return -math.log(((h >> 11) + 0.5) / 2**53) / weight


def expected(key, layout):
    """Descend the tree by plain loops."""
    weights = {}
    for region, rack, s, w in layout:
        for node in (region, f"{region}/{rack}", f"{region}/{rack}/{s}"):
            weights[node] = weights.get(node, 0) + w
    node = ""
    for depth in range(3):
        kids = [n for n in weights if n.count("/") == depth and (not node or n.startswith(node + "/"))]
        node = min(kids, key=lambda n: draw(n, key, weights[n]))
    return int(node.rsplit("/", 1)[1])


def test_shards_match_plain_descent_and_move_only_into_changed_subtrees(spark):
    ids = [(i,) for i in range(600)] + [(None,), (None,)]
    df = spark.createDataFrame(ids, "doc_id long")
    layout = [("g0", "r0", 0, 1.0), ("g0", "r0", 1, 3.0), ("g0", "r1", 2, 1.0), ("g1", "r2", 3, 2.5)]
    got = [(r[0], r[1]) for r in shard(df, ["doc_id"], layout).collect()]
    assert got == [(i, expected(i, layout)) for i, in ids]
    heavier = layout[:3] + [("g1", "r2", 3, 5.0)]
    for (key, old), row in zip(got, shard(df, ["doc_id"], heavier).collect()):
        assert row[1] == old or row[1] == 3


def test_digest_law_slots_and_edges(spark):
    rows = [(i, "é" * (i % 7), "x") for i in range(500)] + [(1000, None, "x"), (None, "a", None), (3, "ééé", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = shard_digest(df).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"key"}
    assert all(r.grown_shard in (r.shard, 8) for r in out) and any(r.grown_shard == 8 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        if r.doc_id == 1000:
            assert r["size"] == 1 and r.text_crc32 == 0
        if r.doc_id == 6:
            assert r["size"] == 13 and r.text_crc32 == zlib.crc32("éééééé".encode())
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {tuple(r) for r in out} == {tuple(r) for r in shard_digest(df.repartition(5)).collect()}
    assert shard_digest(df.limit(0)).count() == 0


def test_slots_with_many_blocks(spark):
    df = spark.range(1000).selectExpr("id as doc_id", "cast(id % 3 as int) as shard")
    out = slots(df, ["doc_id"], block_rows=10).collect()
    for k in range(3):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(len([r for r in out if r.shard == k])))
    assert len(plain_layout(9)) == 9 and plain_layout(9)[8][0] == "g2"
