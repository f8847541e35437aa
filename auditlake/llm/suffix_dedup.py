"""Suffix-array dedup: remove every byte covered by a long string that also starts somewhere else."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import _powers, binaries, mix, slices, span_hashes, staged, without
from auditlake.llm.jaccard_join import bounded_filter, filter_place

#: Bytes of a gram; cores with more distinct surroundings than this are compared row by row in a shuffle.
GRAM, WIDE_CORE = 8, 2000
_OTHER_BYTE = mix(np.arange(1, 257, dtype=np.uint64), 991)


def reach(length: int) -> int:
    """Half the window in which an anchor is the least: an anchor's surroundings fit a string several times."""
    return max(2, length // 8 - 2)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(x[i : i + width])."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def anchors(raw: np.ndarray, w: int) -> np.ndarray:
    """Positions whose 8-byte gram hashes below all of w grams before and none of w grams after: a
    choice made by the bytes from w before to w + 8 after alone, so equal strings choose alike."""
    n = len(raw) - GRAM + 1
    if n < 2 * w + 1:
        return np.zeros(0, np.int64)
    gram, padded = np.empty(n, np.uint64), np.r_[raw, np.zeros(GRAM, np.uint8)]
    for o in range(min(GRAM, n)):
        own = len(range(o, n, GRAM))
        gram[o::GRAM] = np.frombuffer(padded.data, "<u8", own, o)
    h = mix(gram, 5)
    least = _sliding_min(h, w)
    at = h[w : n - w]
    return np.flatnonzero((at < least[: len(at)]) & (at <= least[w + 1 : w + 1 + len(at)])) + w


def classes(n: int, at: np.ndarray, w: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, first, last): intervals of string starts that hold the same anchors with their surroundings."""
    if n < length:
        return (np.zeros(0, np.int64),) * 4
    top = n - length
    cuts = np.unique(np.r_[0, at - w + 1, at + w + GRAM - length, top + 1])
    cuts = cuts[(cuts >= 0) & (cuts <= top + 1)]
    lo, hi = cuts[:-1], cuts[1:] - 1
    return lo, hi, np.searchsorted(at, lo + w), np.searchsorted(at, lo + length - w - GRAM, side="right") - 1


def digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each byte string."""
    up, down = _powers(1 << max(12, int(len(raw) + 1).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_OTHER_BYTE[raw] * down[: len(raw)], out=sums[1:])
    return span_hashes(raw, starts, ends), mix((sums[ends] - sums[starts]) * up[starts], 17)


def _level(m: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(m, 1)).astype(np.int64)


def _first_ranks(rows: DataFrame, w: int, length: int) -> DataFrame:
    """(_id, _tag, t, j, rank, m); _id and _tag: a text's 128-bit name, m: rows. t 0: the phrase from anchor j to the
    next; t 8: anchor j alone, where a string holds no other; t 9: the text has strings without anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for row, data in enumerate(binaries(batch.column(2))):
                if len(data) < length:
                    continue
                raw = np.frombuffer(data, np.uint8)
                at = anchors(raw, w)
                _, _, first, last = classes(len(raw), at, w, length)
                lone = np.unique(first[first == last])
                bare = int((first > last).any())
                names = span_hashes(raw, np.r_[at[:-1], at[lone]] - w, np.r_[at[1:], at[lone]] + w + GRAM)
                rank = np.r_[names, np.zeros(bare, np.uint64)]
                n = max(0, len(at) - 1)
                for column, value in zip(out, (np.full(len(rank), row), np.repeat([0, 8, 9], [n, len(lone), bare]), np.r_[np.arange(n), lone, np.zeros(bare, np.int64)], rank), strict=True):
                    column.append(value)
            row, t, j, rank = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(t, pa.int32()), pa.array(j, pa.int32()), pa.array(rank.astype(np.uint64).view(np.int64))],
                ["_id", "_tag", "t", "j", "rank"],
            )

    return rows.mapInArrow(run, "_id long, _tag long, t int, j int, rank long").withColumn("m", F.lit(1).cast("long"))


def _reranked(pairs: DataFrame, label: str) -> DataFrame:
    """(_id, _tag, t, j, rank, m) of the positions whose (t, a, b) occurs again: the repeated pairs are sorted by range
    and numbered in that order, which is their new rank; unique ones drop out. Equal pairs are counted before they
    are sorted, so that a pair found everywhere is one row; a position of equal texts is one row, m of them."""
    key = ["t", "a", "b"]
    again = pairs.groupBy(*key).agg(F.sum("m").alias("n")).where("n > 1").select(*key)
    ordered = again.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("rank", F.monotonically_increasing_id())
    joined = pairs.join(staged(ordered, f"{label}-order"), key)
    return staged(joined.groupBy("_id", "_tag", "t", "j", "rank").agg(F.sum("m").alias("m")), label)


def _doubled(rows: DataFrame, w: int, length: int) -> DataFrame:
    """Surviving (_id, _tag, t, j): the 2^t phrases from anchor j on occur again as a whole.

    Prefix doubling over the sampled suffixes: positions are ranked by their phrase (by its 64-bit hash), then by
    the pair of ranks 1, 2, 4 and more phrases apart, until a rank is unique or its run of phrases is past the
    length of a string.
    """
    first = staged(_first_ranks(rows, w, length), "phrases")
    bare = first.where("t = 9").select("_id", "_tag", "t", "j").distinct()
    alive = _reranked(first.where("t < 9").select("_id", "_tag", "t", "j", F.col("rank").alias("a"), F.lit(0).cast("long").alias("b"), "m"), "ranks")
    out, t = [bare, alive.select("_id", "_tag", "t", "j")], 0
    alive = alive.where("t = 0")
    longest = (length - 2 * w - GRAM) // (w + 1)
    while 2 << t <= longest:
        ahead = alive.select("_id", "_tag", (F.col("j") - (1 << t)).alias("j"), F.col("rank").alias("b"))
        paired = alive.join(ahead, ["_id", "_tag", "j"]).select("_id", "_tag", F.lit(t + 1).alias("t"), "j", F.col("rank").alias("a"), "b", "m")
        alive = _reranked(paired, f"ranks-{t + 1}")
        out.append(alive.select("_id", "_tag", "t", "j"))
        t += 1
    return reduce(DataFrame.unionByName, out)


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_id, _tag, _z, m) of the texts whose name may be in wanted (a bounded bit filter): each once, packed for a join,
    with the number of rows that hold it."""
    bits = bounded_filter(wanted, "_id")
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in slices(batches, "_text"):
            at = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.filter(pa.array((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0))
            packed = [len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True) for x in binaries(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["_id", "_tag", "_z"])

    packed = rows.withColumn("_at", filter_place("_id", bits)).mapInArrow(run, "_id long, _tag long, _z binary")
    return packed.groupBy("_id", "_tag").agg(F.first("_z").alias("_z"), F.count(F.lit(1)).alias("m"))


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The numbers of each list; none for a null list."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)


def _candidates(rows: DataFrame, alive: DataFrame, w: int, length: int) -> DataFrame:
    """(_id, _tag, m, lo, hi, a, z, core, h1, h2) of each class whose anchors' phrases all occur again.

    core names the bytes from a to z: the anchors with their surroundings, the same in equal strings
    wherever they stand; h1, h2 name the bytes that any string of the class covers.
    Strings without anchors come with a null core, one class each.
    """
    lists = alive.groupBy("_id", "_tag").agg(F.collect_list((F.col("t").cast("long") * (1 << 40)) + F.col("j")).alias("alive"))
    lists = staged(lists, "alive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, tag, z, m_rows, keys in zip(*(batch.column(c).to_pylist() for c in range(4)), _lists(batch.column(4)), strict=True):
                raw = _unpacked(z)
                at = anchors(raw, w)
                lo, hi, first, last = classes(len(raw), at, w, length)
                m = last - first
                t = np.where(m > 0, _level(m), 8)
                keys = np.sort(keys)
                has = lambda k: keys[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k  # noqa: E731, B023
                ok = (m >= 0) & has((t << 40) + first) & ((m <= 0) | has((t << 40) + last - (1 << np.minimum(t, 40))))
                bare = m < 0
                a, z = at[first[ok]] - w, at[last[ok]] + w + GRAM
                core = span_hashes(raw, a, z)
                none = np.concatenate([np.arange(x, y + 1) for x, y in zip(lo[bare], hi[bare], strict=True)]) if bare.any() else np.zeros(0, np.int64)
                lo, hi, a, z = np.r_[lo[ok], none], np.r_[hi[ok], none], np.r_[a, none], np.r_[z, none]
                h1, h2 = digests(raw, lo, hi + length)
                n = len(lo)
                if n:
                    cores = pa.array(np.r_[core, np.zeros(len(none), np.uint64)].view(np.int64), mask=np.r_[np.zeros(len(core), bool), np.ones(len(none), bool)])
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([x] * n, pa.int64()) for x in (i, tag, m_rows)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(a, pa.int32()), pa.array(z, pa.int32()), cores, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                        ["_id", "_tag", "m", "lo", "hi", "a", "z", "core", "h1", "h2"],
                    )

    joined = _texts(rows, lists).join(lists, ["_id", "_tag"]).select("_id", "_tag", "_z", "m", "alive")
    return staged(joined.mapInArrow(run, "_id long, _tag long, m long, lo int, hi int, a int, z int, core long, h1 long, h2 long"), "classes")


def _surroundings(rows: DataFrame, tests: DataFrame, length: int) -> DataFrame:
    """tests with the bytes before and after the core that the class's strings reach; each string has room of them."""
    lists = tests.groupBy("_id", "_tag").agg(F.collect_list(F.struct("core", "n", "lo", "hi", "a", "z", "wide")).alias("tests"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], [], [], []]
            for i, tag, z, rows_ in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                raw = _unpacked(z).tobytes()
                for r in rows_:
                    values = (i, tag, r["core"], r["n"], r["wide"], r["lo"], raw[r["lo"] : r["a"]], raw[r["z"] : r["hi"] + length], length - (r["z"] - r["a"]))
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["_id", "_tag", "core", "n", "wide", "lo", "left", "right", "room"])

    lists = staged(lists, "tests")
    joined = _texts(rows, lists).join(lists, ["_id", "_tag"]).select("_id", "_tag", "_z", "tests")
    return staged(joined.mapInArrow(run, "_id long, _tag long, core long, n long, wide boolean, lo int, left binary, right binary, room int"), "surroundings")


_SPANS = "_id long, _tag long, lo int, hi int"


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by core: the starts, in classes found once, whose string another class of the core holds."""
    held: list[tuple] = []

    def settle(group: list[tuple]) -> list[tuple]:
        count: dict[tuple, int] = {}
        keys = []
        for *_, n, _, left, right, room in group:
            own = [(left[k:], right[: room - len(left) + k]) for k in range(len(left) + len(right) - room + 1)]
            keys.append(own)
            for key in own:
                count[key] = count.get(key, 0) + n
        out = []
        for (i, tag, _, n, lo, *_), own in zip(group, keys, strict=True):
            if n == 1:
                for k, key in enumerate(own):
                    if count[key] > 1:
                        if out and out[-1][:2] == (i, tag) and out[-1][3] == lo + k - 1:
                            out[-1] = (i, tag, out[-1][2], lo + k)
                        else:
                            out.append((i, tag, lo + k, lo + k))
        return out

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        columns = zip(*found, strict=True) if found else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["_id", "_tag", "lo", "hi"])

    for batch in batches:
        found: list[tuple] = []
        for row in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
            if held and held[-1][2] != row[2]:
                found += settle(held)
                held = []
            held.append(row)
        yield batch_of(found)
    if held:
        yield batch_of(settle(held))


def _one_by_one(wide: DataFrame) -> DataFrame:
    """As _narrow, for cores in very many surroundings: every string is a row, counted by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, tag, core, n, lo, left, right, room in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                m = len(left) + len(right) - room + 1
                raw = np.frombuffer(left + right, np.uint8)
                starts = np.arange(m)
                h1, h2 = digests(raw, starts, starts + room)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * m, pa.int64()), pa.array([tag] * m, pa.int64()), pa.array([core] * m, pa.int64()), pa.array([n] * m, pa.int64()), pa.array(starts + lo, pa.int32()), pa.array(len(left) - starts, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                    ["_id", "_tag", "core", "n", "lo", "d", "h1", "h2"],
                )

    rows = wide.mapInArrow(run, "_id long, _tag long, core long, n long, lo int, d int, h1 long, h2 long")
    key = ["core", "d", "h1", "h2"]
    again = staged(rows.groupBy(*key).agg(F.sum("n").alias("m")).where("m > 1").select(*key), "wide-names")
    return rows.where("n = 1").join(again, key, "left_semi").select("_id", "_tag", "lo", F.col("lo").alias("hi"))


def repeated_starts(rows: DataFrame, length: int) -> DataFrame:
    """(_id, _tag, lo, hi): by text, intervals of starts of length-byte strings that also start elsewhere: in another
    row, be its text the same or not, or again in this one."""
    w = reach(length)
    found = _candidates(rows, _doubled(rows, w, length), w, length)
    hull = ["core", "h1", "h2"]
    hulls = found.groupBy(*hull).agg(F.sum("m").alias("n"), F.min(F.struct("_id", "_tag", "lo", "hi", "a", "z")).alias("one"))
    hulls = staged(hulls, "hulls")
    many = hulls.where("n > 1").select(*hull)
    whole = found.join(many, [found[c].eqNullSafe(many[c]) for c in hull], "left_semi").select("_id", "_tag", "lo", "hi")
    cores = hulls.where("core IS NOT NULL").groupBy("core").agg(F.count(F.lit(1)).alias("hulls"), F.min("n").alias("least")).where("hulls > 1 AND least = 1")
    cores = staged(cores.select("core", (F.col("hulls") > WIDE_CORE).alias("wide")), "open-cores")
    tests = hulls.join(cores, "core").select("one._id", "one._tag", "one.lo", "one.hi", "one.a", "one.z", "core", "n", "wide")
    around = _surroundings(rows, tests, length)
    columns = ["_id", "_tag", "core", "n", "lo", "left", "right", "room"]
    narrow = around.where("NOT wide").select(*columns).repartition("core").sortWithinPartitions("core").mapInArrow(_narrow, _SPANS)
    return whole.unionByName(narrow).unionByName(_one_by_one(around.where("wide").select(*columns)))


def suffix_dedup(docs: DataFrame, length: int = 400, text_col: str = "text") -> DataFrame:
    """Cut from every text the bytes covered by a length-byte string that also starts anywhere else.

    Texts are UTF-8 bytes, matches stay inside a document, overlapping starts count, and all strings are
    judged on the input. Suffixes are sampled at anchors that the bytes themselves choose; prefix
    doubling over the phrases between them (see _doubled) leaves the places where a string can be
    repeated. There, neighbouring starts with the same anchors form a class: one whose covered bytes
    occur again is repeated as a whole; at the edges of matches the bytes around the common core are
    compared start by start. Names of 128 bits decide, so no text is compared with another's group.

    Returns every input column with text replaced by what is left (less the bytes of a character that
    was cut through), and n_bytes, n_removed, n_spans, kept (the exact bytes), in place of columns so
    named. Null and empty texts, and
    all shorter than length, come back whole. Work goes by distinct text, named by the 128 bits of its md5, with the
    number of rows that hold it: a text of several rows repeats as a whole. Ids take no part, so rows may share an
    id or have none, and repeated rows cost no more than one of them, but for being read and cut.
    """
    docs = without(docs, "n_bytes", "n_removed", "n_spans", "kept")
    text = F.coalesce(F.col(text_col), F.lit(""))
    half = lambda at: F.conv(F.substring(F.md5(text), at, 16), 16, -10).cast("long")
    own = [F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(docs.columns) if c != text_col]
    whole = docs.select(*own, half(1).alias("_id"), half(17).alias("_tag"), text.alias("_text"))
    rows = whole.select("_id", "_tag", "_text")
    spans = repeated_starts(rows, length)
    lists = staged(spans.groupBy("_id", "_tag").agg(F.collect_list(F.shiftleft(F.col("lo").cast("long"), 32) + F.col("hi")).alias("starts")), "spans")
    names = [*docs.columns, "n_bytes", "n_removed", "n_spans", "kept"]
    text_at, own_columns = docs.columns.index(text_col), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            kept, removed, runs, sizes = [], [], [], []
            for data, own in zip(binaries(batch.column(batch.num_columns - 2)), _lists(batch.column(batch.num_columns - 1)), strict=True):
                sizes.append(len(data))
                if not len(own):
                    kept.append(data)
                    removed.append(0)
                    runs.append(0)
                    continue
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, own >> 32, 1)
                np.add.at(edge, (own & 0xFFFFFFFF) + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()))
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            texts = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
            columns = [texts if k == text_at else batch.column(k - (k > text_at)) for k in range(own_columns)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(kept, pa.binary())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    own = [F.col(f"own_{k}") for k in range(own_columns) if k != text_at]
    words = bounded_filter(lists, "_id")
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def split(keep: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = sent.value
            for batch in slices(batches, "_text"):
                at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield batch.filter(pa.array(((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0) == keep))

        return run

    marked = whole.withColumn("_at", filter_place("_id", words))
    schema = marked.schema
    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split(False)(batches):
            columns = [*(batch.column(k) for k in range(own_columns - 1)), batch.column(batch.num_columns - 2), pa.nulls(batch.num_rows, pa.list_(pa.int64()))]
            yield from cut(iter([pa.RecordBatch.from_arrays(columns, [*map(str, range(own_columns - 1)), "_text", "starts"])]))

    out = f"{kinds}, n_bytes long, n_removed long, n_spans long, kept binary"
    # Texts that surely keep all their bytes need no join. Either side runs one Python worker a task.
    hit = marked.mapInArrow(split(True), schema).join(lists, ["_id", "_tag"], "left").select(*own, "_text", "starts")
    return marked.mapInArrow(clear, out).unionByName(hit.mapInArrow(cut, out))
