"""Token ids in a binary file format: canonical length-limited Huffman codes in independent blocks."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

from auditlake.llm.bpe import SliceCoder, load, printable
from auditlake.llm.common import binaries, slices, staged
from auditlake.operators.scratch import scratch_root

#: Longest code in bits, ids between two bit-offset checkpoints, ids of a block at most.
MAX_BITS, CHECKPOINT_IDS, BLOCK_IDS = 16, 512, 1 << 18
_HEAD = struct.Struct("<4sIIQ")
_MAGIC = b"HUF1"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code length of each id (0: not used), optimal under the limit, by merging packages of coins."""
    used = np.flatnonzero(counts > 0)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    while len(used) > 1 << limit:
        limit += 1
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    # Each level's list holds the coins and the packages of two from the level below, by weight.
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weight))
        merged = both[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, depth = 2 * (len(order) - 1), np.zeros(len(order), np.int64)
    for is_coin in reversed(levels):
        coins = int(is_coin[:take].sum())
        depth[:coins] += 1
        take = 2 * (take - coins)
    lengths[order] = depth
    return lengths


class Huffman:
    """Canonical codes from lengths alone: shorter codes first, equal lengths by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.bits = max(1, int(lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        span = np.left_shift(1, self.bits - self.lengths[order])
        start = np.r_[0, np.cumsum(span)[:-1]] if len(order) else np.zeros(0, np.int64)
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = start >> (self.bits - self.lengths[order])
        self.table = np.zeros(1 << self.bits, np.int64)  # next bits -> id
        self.table[: int(span.sum())] = np.repeat(order, span)
        self.steps = self.lengths[self.table]

    def encode(self, ids: np.ndarray) -> bytes:
        """A block: head, bit offset of every CHECKPOINT_IDS-th id, code bits."""
        length = self.lengths[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ids) else 0
        starts = ends - length
        # A code covers bits of one 32-bit word or of two; bits of different codes never meet, so sums join them.
        word, place = starts >> 5, starts & 31
        wide = self.codes[ids] << (64 - length - place)
        words = np.bincount(word, wide >> 32 & 0xFFFFFFFF, minlength=(total >> 5) + 2)
        over = np.flatnonzero(place + length > 32)
        words += np.bincount(word[over] + 1, wide[over] & 0xFFFFFFFF, minlength=len(words))
        bits = words.astype(">u4").tobytes()[: -(-total // 8)]
        marks = starts[::CHECKPOINT_IDS].astype("<u8")
        return _HEAD.pack(_MAGIC, len(ids), CHECKPOINT_IDS, total) + marks.tobytes() + bits

    def decode(self, block: bytes) -> np.ndarray:
        """All ids of a block: every checkpoint's run is read in step with the others, by table."""
        magic, n, every, total = _HEAD.unpack_from(block)
        if magic != _MAGIC:
            raise ValueError("not a block of token ids")
        runs = -(-n // every)
        at = np.frombuffer(block, "<u8", runs, _HEAD.size).astype(np.int64)
        data = np.frombuffer(block, np.uint8, offset=_HEAD.size + 8 * runs)
        data = np.r_[data, np.zeros(8, np.uint8)].astype(np.int64)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        out = np.zeros((every, runs), np.int64)
        mask, top = (1 << self.bits) - 1, 32 - self.bits
        last = len(window) - 1
        for i in range(every):
            code = (window[np.minimum(at >> 3, last)] >> (top - (at & 7))) & mask
            out[i] = self.table[code]
            at = at + self.steps[code]
        return out.T.reshape(-1)[:n]


@lru_cache(maxsize=2)
def library_coder(path: str) -> SliceCoder:
    """Merges by the tokenizers library's model of the file, which gets the pieces as words of its own alphabet, one a line."""
    model = load(path)
    library = Tokenizer(Tokenizer.from_file(path).model)
    library.pre_tokenizer = Split("\n", "removed")
    alphabet = {b: c for c, b in printable().items()}
    plain = re.compile(r"[!-~ \n]*").fullmatch

    def merge(pieces: list[str]) -> np.ndarray:
        if "\n" in pieces or any("\n" in x for x in pieces if x.isspace()):
            words = "\n".join(x.encode().decode("latin-1").translate(alphabet) for x in pieces)
        else:
            words = "\n".join(pieces)
            words = words.replace(" ", alphabet[32]) if plain(words) else words.encode().decode("latin-1").translate(alphabet | {10: "\n"})
        return np.asarray(library.encode_batch_fast([words], add_special_tokens=False)[0].ids, np.int64)

    return SliceCoder(model, merge)


def encode_table(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _ids, _counts): each text's ids with the end id, as little-endian bytes of the coder's kind; and a
    task's counts of all ids, in rows of their own."""
    size = max(load(vocabulary).words) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_coder(vocabulary)
        end, total = np.array([end_id], coder.kind).tobytes(), np.zeros(size, np.int64)
        names = ["_id", "_ids", "_counts"]
        for batch in slices(batches, "_text"):
            ids, at = coder(batch.column(1))
            total += np.bincount(ids, minlength=size)
            total[end_id] += batch.num_rows
            own = [ids[a:b].tobytes() + end for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), pa.nulls(len(own), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, "_id long, _ids binary, _counts binary")


def write_token_store(encoded: DataFrame, path: str, kind: str, size: int, block_ids: int = BLOCK_IDS) -> None:
    """Write encode_table's rows in ascending id order: path/blocks (file images of blocks) and path/codes.

    Counts of ids are summed in the tasks first, so that the driver sees size numbers at most. The
    range partitions are in id order; each writes blocks of up to block_ids ids (a longer text
    has one of its own), and their running totals give each block the number of ids before it.
    """
    spark = encoded.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in binaries(batch.column(0)):
                total += np.frombuffer(x, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["token", "n"])

    sums = encoded.where("_counts IS NOT NULL").select("_counts").mapInArrow(count, "token int, n long")
    counted = sums.groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[counted["token"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codes")
    sent = spark.sparkContext.broadcast(lengths)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, held_n, block = Huffman(sent.value), [], 0, 0
        names = ["part", "block", "doc_ids", "doc_sizes", "n_ids", "payload"]

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x[2] for x in held]).astype(np.int64)
            row = [[part], [block], [[x[0] for x in held]], [[x[1] for x in held]], [len(ids)], [coder.encode(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        part = TaskContext.get().partitionId()
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), strict=True):
                ids = np.frombuffer(data, kind)
                if held and held_n + len(ids) > block_ids:
                    yield flush()
                    held, held_n, block = [], 0, block + 1
                held.append((i, len(ids), ids))
                held_n += len(ids)
        if held:
            yield flush()

    parts = max(1, encoded.rdd.getNumPartitions())
    ordered = encoded.where("_counts IS NULL").select("_id", "_ids").repartitionByRange(parts, F.col("_id").asc_nulls_last()).sortWithinPartitions(F.col("_id").asc_nulls_last())
    ordered.mapInArrow(pack, "part int, block int, doc_ids array<long>, doc_sizes array<long>, n_ids long, payload binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files alone; start counts the ids of all documents before.

    Blocks are decoded independently; each block's start comes from the totals of blocks and parts.
    """
    blocks = spark.read.schema("part int, block int, doc_ids array<long>, doc_sizes array<long>, n_ids long, payload binary").parquet(f"{path}/blocks")
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codes").first()[0]), np.uint8)
    sent = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Huffman(sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(row["payload"]).astype("<u4")
                sizes = np.asarray(row["doc_sizes"], np.int64)
                starts = np.cumsum(sizes) - sizes
                pieces = [ids[a : a + n].tobytes() for a, n in zip(starts, sizes, strict=True)]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in pieces], pa.int64())],
                    ["part", "block", "place", "doc_id", "inside", "n", "crc"],
                )

    totals = blocks.groupBy("part", "block").agg(F.sum("n_ids").alias("n_ids"))
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("ahead", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)))
    sums = totals.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    # As many rows as there are files: the one place where the order of parts is summed up.
    heads = sums.withColumn("before", F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    rows = blocks.mapInArrow(run, "part int, block int, place int, doc_id long, inside long, n long, crc long")
    rows = rows.join(offsets.join(heads, "part").select("part", "block", (F.col("before") + F.col("ahead")).alias("base")), ["part", "block"])
    return rows.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def token_store(docs: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every text, append end_id, write the ids in ascending id order, read them back from the files.

    Returns id, start, n_tokens, ids_crc32 (unsigned, of the little-endian 32-bit ids). Null or empty
    text is the end id alone. Null ids come last. Rows that repeat an id are written one after the
    other and each has its own row, in no stated order among themselves. Empty in, empty out.
    """
    spark = docs.sparkSession
    where = path or f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    model = load(vocabulary)
    encoded = staged(encode_table(docs, vocabulary, end_id, id_col, text_col), "token-ids")
    write_token_store(encoded, where, library_coder(vocabulary).kind, max(model.words) + 1, block_ids)
    return read_token_store(spark, where).withColumnRenamed("doc_id", id_col)
