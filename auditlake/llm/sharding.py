"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import mix, staged, text_of, without
from auditlake.operators.scratch import scratch_root

#: Places on the ring, 2^RING_BITS: what the driver holds is a load for each place, whatever the number of rows.
RING_BITS = 16
#: Virtual nodes of a shard.
VIRTUAL_NODES = 128


@dataclasses.dataclass(frozen=True)
class Ring:
    """Virtual nodes in clockwise order: their places, counted from the place after the last one, and their shards."""

    places: np.ndarray
    owners: np.ndarray
    shift: int
    shards: int

    @staticmethod
    def of(shards: int, nodes: int = VIRTUAL_NODES, bits: int = RING_BITS) -> Ring:
        """A shard's nodes depend on its number alone, so one more shard adds nodes and moves none. Of two nodes
        on one place the lower shard's counts."""
        if shards < 1 or shards * nodes > 1 << bits:
            raise ValueError("shards * nodes must be from 1 to the number of places")
        found: dict[int, int] = {}
        for shard in range(shards):
            at = mix(np.arange(nodes, dtype=np.uint64) + np.uint64(shard << 32), 23) >> np.uint64(64 - bits)
            for place in at.tolist():
                found.setdefault(place, shard)
        places = np.array(sorted(found), np.int64)
        shift = int(places[-1]) + 1
        return Ring((places - shift) % (1 << bits), np.array([found[x] for x in places.tolist()], np.int64), shift, shards)

    def intervals(self, loads: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Begins of the stretches of load, in clockwise order, and the shard of each.

        A shard takes the load of its own arcs in clockwise order until it holds its capacity: (1 + slack) times the
        mean, all capacities one unit apart at most. What is left of an arc goes on clockwise, node by node, to the
        next shards with room. As the capacities add up to the load at least, everything finds a place.
        """
        total = int(loads.sum())
        base, more = divmod(-(-total * round((1 + slack) * 1_000_000) // 1_000_000), self.shards)
        room = [base + (s < more) for s in range(self.shards)]
        ends = np.searchsorted(self.places, np.arange(len(loads)))
        arcs = np.zeros(len(self.places), np.int64)
        np.add.at(arcs, ends, loads)
        begins = np.cumsum(arcs) - arcs
        owners = self.owners.tolist()
        pieces: list[tuple[int, int]] = []
        left: list[tuple[int, int, int]] = []
        for node, (begin, load) in enumerate(zip(begins.tolist(), arcs.tolist(), strict=True)):
            fits = min(load, room[owners[node]])
            if fits:
                pieces.append((begin, owners[node]))
                room[owners[node]] -= fits
            if fits < load:
                left.append((begin + fits, load - fits, node))
        for begin, load, node in left:
            while load:
                node = (node + 1) % len(owners)
                fits = min(load, room[owners[node]])
                if fits:
                    pieces.append((begin, owners[node]))
                    room[owners[node]] -= fits
                    begin, load = begin + fits, load - fits
        pieces.sort()
        return np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)


def shard_rows(docs: DataFrame, key: Column, shards: int, load: Column | None = None, slack: float = 0.0, nodes: int = VIRTUAL_NODES, bits: int = RING_BITS) -> DataFrame:
    """All columns of docs with shard (int, from 0) and slot (long, gapless from 0 in each shard).

    key names a row's point on the ring; load is its weight (a non-negative whole number; null: 0), 1 where none is
    given. With loads of 1 and no slack the shards' row counts differ by one at most. With other loads a row
    goes where its first unit of load goes, so a shard is above its capacity by less than one row for each stretch
    of the ring that it holds. Rows are put on the ring by key, then by all their columns; equal rows stand
    in any order among themselves, and a null key is a key. One key may hold any share of the rows. Empty in, empty
    out. Columns of docs named shard or slot in any case give way to the new ones.

    The rows are sorted by place on the ring once. The driver sees the loads of 2^bits places, the totals of the
    sorted parts, and the stretches (their number is bounded by nodes and shards), never rows.
    """
    spark = docs.sparkSession
    ring = Ring.of(shards, nodes, bits)
    docs = without(docs, "shard", "slot")
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(names, inner, strict=True)), F.xxhash64(key).alias("_point"), F.coalesce((F.lit(1) if load is None else load).cast("long"), F.lit(0)).alias("_load"))
    place = F.pmod(F.shiftrightunsigned("_point", 64 - bits) - ring.shift, F.lit(1 << bits)).cast("int")
    rows = rows.select("*", place.alias("_place"), F.xxhash64(*inner).alias("_content"), F.monotonically_increasing_id().alias("_tie"))
    order = ["_place", "_point", "_content", "_tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).drop("_point", "_content", "_tie")
    added = T.StructType([*rows.schema.fields, T.StructField("_nth", T.LongType()), T.StructField("_before", T.LongType())])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, before = 0, 0
        for batch in batches:
            loads = batch.column(batch.schema.get_field_index("_load")).to_numpy()
            sums = before + np.cumsum(loads)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth + np.arange(len(loads))), pa.array(sums - loads)], [*batch.schema.names, "_nth", "_before"])
            nth, before = nth + len(loads), int(sums[-1]) if len(sums) else before

    rows = staged(rows.mapInArrow(running, added), "ring-order")
    parts = rows.groupBy("_part").agg(F.count("*").alias("n"), F.sum("_load").alias("load")).toPandas().sort_values("_part")
    counts, sums = parts["n"].to_numpy(np.int64), parts["load"].to_numpy(np.int64)
    ahead = dict(zip(parts["_part"].tolist(), zip((np.cumsum(counts) - counts).tolist(), (np.cumsum(sums) - sums).tolist(), strict=True), strict=True))
    at = rows.groupBy("_place").agg(F.sum("_load").alias("load")).toPandas()
    loads = np.zeros(1 << bits, np.int64)
    loads[at["_place"].to_numpy(np.int64)] = at["load"].to_numpy(np.int64)
    begins, owners = ring.intervals(loads, slack)
    if not len(begins):  # no load at all: every row stands at the beginning
        begins, owners = np.zeros(1, np.int64), np.zeros(1, np.int64)
    sent = spark.sparkContext.broadcast((ahead, begins))
    fields = [f for f in rows.schema.fields if f.name in inner]
    dealt_schema = T.StructType([*fields, T.StructField("_rank", T.LongType()), T.StructField("_stretch", T.IntegerType())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, begins = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name, b=batch: b.column(b.schema.get_field_index(name)).to_numpy()
            base = np.array([ahead[p] for p in column("_part").tolist()], np.int64)
            rank, first = base[:, 0] + column("_nth"), base[:, 1] + column("_before")
            # A row without load at the very end stands after the last unit and belongs to the last stretch.
            stretch = np.searchsorted(begins, first, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in fields), pa.array(rank), pa.array(stretch.astype(np.int32))], [*(f.name for f in fields), "_rank", "_stretch"])

    out = rows.mapInArrow(dealt, dealt_schema)
    held = out.groupBy("_stretch").agg(F.min("_rank").alias("first"), F.count("*").alias("n")).toPandas().sort_values("_stretch")
    held["shard"] = owners[held["_stretch"].to_numpy(np.int64)]
    held["_base"] = held.groupby("shard")["n"].cumsum() - held["n"] - held["first"]
    table = spark.createDataFrame(held[["_stretch", "shard", "_base"]].values.tolist(), "_stretch int, shard int, _base long")
    out = out.join(F.broadcast(table), "_stretch").withColumn("slot", F.col("_base") + F.col("_rank"))
    return out.select(*(F.col(n).alias(c) for c, n in zip(names, inner, strict=True)), "shard", "slot")


def write_shards(placed: DataFrame, path: str | None = None) -> str:
    """Write the rows of shard_rows to one folder a shard, each file in slot order; the path of the folders.

    A shard is written by as many tasks as the sort of (shard, slot) deals it to, so it may be of any size.
    """
    where = path or f"{scratch_root(placed.sparkSession)}/shards-{uuid.uuid4().hex}"
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(where)
    return where


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """One shard's rows; its folder alone is read."""
    return spark.read.parquet(path).where(F.col("shard") == shard)


def shard_digests(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size (bytes of the text and 8), unsigned crc32 of the text, the law `rows`, shard, slot.

    The key is the id; rows without id are put on the ring by their text's crc32. Null texts are empty.
    """
    text = text_of(text_col).cast("binary")
    slim = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + F.lit(8).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("text "), F.col("text_crc32").cast("string")))
    placed = shard_rows(slim, key, shards)
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
