"""Sharding against a ring on which keys are placed one by one."""

import collections
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from auditlake.llm.sharding import Ring, read_shard, shard_digests, shard_rows, write_shards


def one_by_one(ring, loads, slack=0.0):
    """Keys in clockwise order, each with a load of 1: own shard while it has room, then node after node."""
    keys = [p for p, n in enumerate(loads) for _ in range(n)]
    total = -(-len(keys) * round((1 + slack) * 1_000_000) // 1_000_000)
    room = [total // ring.shards + (s < total % ring.shards) for s in range(ring.shards)]
    home = [next(i for i, at in enumerate(ring.places.tolist()) if at >= p) for p in keys]
    out = [None] * len(keys)
    for walk in (False, True):
        for i, node in enumerate(home):
            if out[i] is None:
                for step in range(len(ring.places) if walk else 1):
                    shard = int(ring.owners[(node + step) % len(ring.places)])
                    if room[shard]:
                        room[shard] -= 1
                        out[i] = shard
                        break
    assert None not in out
    return out


def by_interval(ring, loads, slack=0.0):
    begins, owners = ring.intervals(np.array(loads), slack)
    return [int(owners[np.searchsorted(begins, i, side="right") - 1]) for i in range(sum(loads))]


def test_stretches_equal_keys_placed_one_by_one():
    rng = random.Random(2)
    for shards, nodes in ((1, 1), (2, 3), (5, 4), (7, 9)):
        ring = Ring.of(shards, nodes, bits=8)
        for slack in (0.0, 0.1, 1.0):
            for hot in (0, 90):
                loads = [rng.randrange(3) for _ in range(256)]
                loads[rng.randrange(256)] += hot
                placed = by_interval(ring, loads, slack)
                assert placed == one_by_one(ring, loads, slack)
                if not slack:
                    counts = collections.Counter(placed)
                    assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1


def test_few_keys_move():
    rng = random.Random(3)
    keys = [rng.randrange(1 << 16) for _ in range(40000)]

    def placed(keys, shards, slack):
        ring = Ring.of(shards)
        order = sorted(range(len(keys)), key=lambda i: ((keys[i] - ring.shift) % (1 << 16), i))
        loads = np.bincount([(k - ring.shift) % (1 << 16) for k in keys], minlength=1 << 16)
        begins, owners = ring.intervals(loads, slack)
        return {i: int(owners[np.searchsorted(begins, n, side="right") - 1]) for n, i in enumerate(order)}

    for slack, grown, more in ((0.0, 0.25, 0.05), (0.25, 0.06, 0.01)):
        before, after = placed(keys, 24, slack), placed(keys, 25, slack)
        assert sum(before[i] != after[i] for i in before) / len(keys) < grown
        longer = placed(keys + [rng.randrange(1 << 16) for _ in range(100)], 24, slack)
        assert sum(before[i] != longer[i] for i in before) / len(keys) < more


def test_rows_of_every_kind(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "é", "same", "same", "x" * 5000] * 20)] + [(None, "no id")] * 300 + [(None, None), (7, "other"), (7, "other")]
    docs = spark.createDataFrame([(t, i, 1, "a") for i, t in rows], "text string, doc_id long, Shard int, slot string").repartition(5)
    got = shard_digests(docs).collect()
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        assert (r.law, r.grown_shard) == ("rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {tuple(r) for r in got} == {tuple(r) for r in shard_digests(docs.repartition(2)).collect()}
    assert shard_digests(docs.limit(0)).count() == 0


def test_fewer_rows_than_shards(spark):
    got = shard_digests(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
    assert {r.slot for r in got} == {0} and len({r.shard for r in got}) == 2


def test_loads_are_near_equal_and_shards_read_back(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"), F.lit(5).alias("shard"))
    placed = shard_rows(docs, F.col("doc_id"), 6, load=F.length("text"), nodes=16)
    sums = [r[1] for r in placed.groupBy("shard").agg(F.sum(F.length("text"))).collect()]
    assert len(sums) == 6 and max(sums) - min(sums) < 97 * 20 < min(sums) / 10
    path = write_shards(placed)
    back = [r for s in range(6) for r in read_shard(spark, path, s).orderBy("slot").collect()]
    assert sorted((r.doc_id, r.text, r.shard, r.slot) for r in back) == sorted((r.doc_id, r.text, r.shard, r.slot) for r in placed.collect())
    no_load = shard_rows(docs, F.col("doc_id"), 6, load=F.lit(0)).groupBy("shard").count().collect()
    assert [tuple(r) for r in no_load] == [(0, 3000)]
