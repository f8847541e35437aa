"""N-gram Jaccard join: prefix filters under several global token orders, intersected before verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm.common import binaries, mix, shingle_table, shingled, slices, staged
from auditlake.llm.components import connected_components

#: Parity bits of a document, orders, min-hashes, rounds of the first links and picks of a bucket in each.
PARITY_WORDS, ORDERS, MIN_HASHES, STAR_ROUNDS, PICKS = 16, 2, 8, 2, 3
#: Counters of the frequency sketch (as powers of two, by the size of the input), counters of a row of it.
SKETCH_BITS, SKETCH_BLOCK = (20, 22), 1 << 14
#: A token's rows are spread over all parts from this sketched count on, and where it is so many times the mean counter.
HOT_TOKEN, HOT_MEAN = 1 << 20, 64
#: Bits of the filter of ids (as powers of two), prefix tokens of one part, and bytes of text that are shingled at a time.
FILTER_BITS, PART_TOKENS, BLOCK_BYTES = (20, 26), 1 << 21, 1 << 20
#: Nodes whose components tasks are told, and rows up to which a token's pairs are made where its rows first meet.
TOLD_NODES, FEW_ROWS = 1 << 21, 64


_MIN_SALTS = mix(np.arange(1, MIN_HASHES + 1, dtype=np.uint64), 13)
_MIN_ODDS = mix(np.arange(1, MIN_HASHES + 1, dtype=np.uint64), 19) | np.uint64(1)


def _each(values: np.ndarray, bounds: np.ndarray, reduce_: np.ufunc, none: int) -> np.ndarray:
    """values of each row reduced, none for an empty row."""
    out = np.full(len(bounds) - 1, none, values.dtype)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = reduce_.reduceat(values, bounds[some])
    return out


def _nodes(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each set's name: a 64-bit hash of its tokens, signed; 0 for the empty set."""
    n = np.diff(bounds)
    sums = mix(_each(mix(tokens, 101), bounds, np.add, 0) + n.astype(np.uint64))
    return np.where(n > 0, mix(sums ^ mix(_each(mix(tokens, 103), bounds, np.add, 0), 107)).view(np.int64), 0)


def _parities(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bit i of a set: how many tokens hash to i, mod 2. Two sets' bits differ in no more places than the sets do."""
    rows, width = len(bounds) - 1, 64 * PARITY_WORDS
    at = np.repeat(np.arange(rows) * width, np.diff(bounds)) + (mix(tokens, 211) >> np.uint64(54)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=rows * width) & 1).astype(np.uint8)).view("<i8").reshape(rows, PARITY_WORDS)


def _sketch_bits(docs: DataFrame) -> int:
    """log2 of the counters: about one for each two bytes of the input's files, within SKETCH_BITS."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(SKETCH_BITS[1], max(SKETCH_BITS[0], (size >> 1).bit_length()))


def _levels(counts: DataFrame, bits: int) -> np.ndarray:
    """log2 of the token counts by hash, from the tasks' (part, counts), of 1, 2 or 4 bytes each: a byte for each counter. They
    only shape the orders, so collisions cost no result. Counts are added as they come."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(data, f"<u{len(data) // SKETCH_BLOCK}").astype(np.int64)
        levels = [np.log2(np.maximum(x, 1)).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])

    parts = (1 << bits) // SKETCH_BLOCK
    out = np.zeros((parts, SKETCH_BLOCK), np.uint8)
    tasks = min(parts, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for row in counts.repartition(tasks, "part").mapInArrow(add, "part int, levels binary").collect():
        out[row["part"]] = np.frombuffer(row["levels"], np.uint8)
    return out.reshape(-1)


def _prefix(key: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Places of the tokens that come first by key: one of them is in any set whose Jaccard similarity reaches numerator / denominator."""
    n = len(key)
    take = n - -(-n * numerator // denominator) + 1
    some = np.argpartition(key, take - 1)[:take] if take < n else np.arange(n)
    return some[np.argsort(key[some])]


def _bit_words(ids: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(word, bits): a bit for the hash of each of a column's values, about eight for each value, and log2 of all bits."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (8 * ids.count()).bit_length()))
    at = f"shiftrightunsigned(xxhash64({column}), {64 - bits})"
    return ids.groupBy(F.expr(f"cast(shiftright({at}, 6) as int)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({at} % 64 as int))")).alias("bits")), bits


def _may_be_of(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """docs whose _id may be one of a column's values, by bits that are broadcast (2^FILTER_BITS[1] of them at most):
    false positives only. Others' texts never leave the JVM."""
    words, bits = _bit_words(ids, column)
    at = F.shiftrightunsigned(F.xxhash64("_id"), 64 - bits)
    hit = (F.shiftright(at, 6).cast("int") == F.col("word")) & (F.expr(f"shiftright(bits, cast(shiftrightunsigned(xxhash64(_id), {64 - bits}) % 64 as int))").bitwiseAND(F.lit(1)) == 1)
    return docs.join(F.broadcast(words), hit, "left_semi")


def bounded_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for the hash of each of a column's values, about eight for each value and 2^FILTER_BITS[1] (8 MB) at
    most: false positives only."""
    words, bits = _bit_words(ids, column)
    rows = words.toPandas()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def filter_place(column: str, words: np.ndarray) -> Column:
    """The bit of bounded_filter that stands for a value."""
    return F.shiftrightunsigned(F.xxhash64(column), 64 - (64 * len(words)).bit_length() + 1)


def _ceil_overlap(n: Column, m: Column, numerator: int, denominator: int) -> Column:
    """Fewest shared tokens at which sizes n and m reach the similarity."""
    return F.ceil((n + m) * numerator / (numerator + denominator))


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """Links among candidate pairs (a, b) of nodes: parity filter on stored bits, then the sets themselves."""
    stored = lambda side: reps.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("parity").alias(f"p{side}"), F.col("rep").alias(f"r{side}")).hint("shuffle_hash")
    near = pairs.join(stored("a"), "a").join(stored("b"), "b")
    differ = reduce(Column.__add__, (F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(PARITY_WORDS)))
    least = _ceil_overlap(F.col("na"), F.col("nb"), numerator, denominator)
    near = near.where((F.least("na", "nb") >= least) & (differ <= F.col("na") + F.col("nb") - 2 * least))
    near = staged(near.select("a", "b", "na", "nb", "ra", "rb"), "near-pairs")
    wanted = near.select(F.col("ra").alias("rep"), F.col("a").alias("node")).union(near.select("rb", "b")).distinct()
    wanted = staged(wanted, "wanted-sets")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", BLOCK_BYTES):
            tokens, bounds = shingle_table(batch.column(1), width)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(tokens, bounds)), lists], ["node", "tokens"])

    some = _may_be_of(docs, wanted, "rep").mapInArrow(sets, "node long, tokens array<long>")
    some = some.join(wanted.select("node").distinct().hint("shuffle_hash"), "node", "left_semi")
    some = staged(some.groupBy("node").agg(F.first("tokens").alias("tokens")), "sets", "lz4")
    side = lambda s: some.select(F.col("node").alias(s), F.col("tokens").alias(f"t{s}")).hint("shuffle_hash")
    shared = F.size(F.array_intersect("ta", "tb"))
    both = near.join(side("a"), "a").join(side("b"), "b")
    # Named once, as a condition works an expression out wherever it stands.
    return both.where(shared * (numerator + denominator) >= (F.col("na") + F.col("nb")) * numerator).select("a", "b")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, numerator: int = 4, denominator: int = 5, keep: tuple[str, ...] = (), words: str | None = None) -> DataFrame:
    """Group documents linked by word-shingle Jaccard similarity of numerator / denominator and more.

    1. Documents with the same shingle set are one node (named by a 64-bit hash of the set).
    2. In STAR_ROUNDS rounds, nodes that share one of MIN_HASHES min-hashes are compared with PICKS such
       nodes only, in later rounds some with many links; verified links join most copies of a text into components at linear cost.
    3. For exactness, every node lists its prefix tokens under ORDERS global orders, rarer tokens
       first by a sketch of all counts, ties by an order's own hash. Any two nodes of different
       components that share a prefix token under each order, and pass the size, position and
       parity filters, are verified on their whole sets. Only pairs inside one component are spared.
    Lists travel packed, by token; tokens seen once drop out at once, tokens of one component next.

    Returns id, n_shingles, component_id, the columns in keep and, under the name words, the number of words. Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a text of
    fewer than width words has its whole sequence as one shingle; null, empty and blank texts have an
    empty set, linked with nothing. A row without id is linked with nothing and has a null component.
    Rows that repeat an id are one document with several texts: linked by any. Empty in, empty out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    own = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(keep)]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]

    bits = _sketch_bits(rows)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "n", "n_words", "node", "mins", "parity", *(f"own_{i}" for i in range(len(keep))), "part", "counts"]
        own_kinds = []
        counts = np.zeros(1 << bits, np.int32)
        for batch in slices(batches, "_text", BLOCK_BYTES):
            tokens, bounds, n_words = shingled(batch.column(1), width)
            own_kinds = [c.type for c in batch.columns[2:]]
            np.add.at(counts, (tokens >> np.uint64(64 - bits)).astype(np.int64), np.int32(1))
            n = np.diff(bounds)
            mins = np.stack([_each((tokens ^ _MIN_SALTS[k]) * _MIN_ODDS[k], bounds, np.minimum, 0) for k in range(MIN_HASHES)], 1)[n > 0].reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((n > 0) * MIN_HASHES)].astype(np.int32)), pa.array(mins))
            parity = pa.ListArray.from_arrays(pa.array((np.arange(len(n) + 1) * PARITY_WORDS).astype(np.int32)), pa.array(_parities(tokens, bounds).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(n_words.astype(np.int64)), pa.array(_nodes(tokens, bounds)), lists, parity, *batch.columns[2:], pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        m = len(counts) // SKETCH_BLOCK
        if keep and not own_kinds:
            return
        nulls = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *own_kinds]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(m, k) for k in nulls), pa.array(range(m), pa.int32()), pa.array([x.astype(np.min_scalar_type(x.max())).tobytes() for x in counts.reshape(m, -1)], pa.binary())], names)

    told = "".join(f", own_{i} {kind}" for i, kind in enumerate(kinds))
    profiled = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *own)
    both = staged(profiled.mapInArrow(profile, f"_id long, n long, n_words long, node long, mins array<long>, parity array<long>{told}, part int, counts binary"), "profiles", "lz4")
    profiles = both.where("part IS NULL").drop("part", "counts")
    levels = _levels(both.where("part IS NOT NULL").select("part", "counts"), bits)
    usable = profiles.where("n > 0 AND _id IS NOT NULL")
    reps = staged(usable.groupBy("node").agg(F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("mins").alias("mins")), "nodes", "lz4")

    # Only buckets of two nodes and more can link any.
    met = F.count(F.lit(1)).over(Window.partitionBy("m", "k"))
    keyed = reps.select("node", "n", F.posexplode("mins").alias("k", "m")).withColumn("met", met).where("met > 1")
    keyed = staged(keyed, "min-hashes")
    placed = keyed.select("*", F.col("node").alias("comp"), F.lit(0).cast("long").alias("degree"))
    links: DataFrame | None = None
    for salt in range(STAR_ROUNDS):
        found = _verified(rows, reps, _stars(placed, salt, numerator, denominator), width, numerator, denominator)
        links = staged(found if links is None else links.union(found), "links")
        degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        linked = connected_components(links)
        comps = linked.join(degrees, "node")
        comps = reps.select("node").join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.coalesce("degree", F.lit(0)).alias("degree"))
        comps = staged(comps, "comps")
        # Picks have compared nearly all nodes of a small bucket.
        placed = keyed.where(F.col("met") > PICKS + 1).join(comps.hint("shuffle_hash"), "node")

    total = profiles.agg(F.sum("n")).first()[0] or 0
    met = _shared_prefixes(rows, levels, total, *_told_components(linked), width, numerator, denominator)
    near = met.where("c IS NOT NULL").select(F.col("node").alias("a"), "b", "k", "c", "rest", "least")
    listed = met.where("token IS NOT NULL").select("k", "token", "node", "pos")
    listed = staged(listed.join(comps.select("node", "comp").hint("shuffle_hash"), "node"), "placed-prefixes")
    several = listed.groupBy("token", "k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("k", "token")
    listed = staged(listed.join(several, ["token", "k"], "left_semi"), "mixed-prefixes")
    counts = listed.groupBy("token", "k", "comp").agg(F.count(F.lit(1)).alias("c"))
    hubs = counts.groupBy("token", "k").agg(F.max_by("comp", F.struct("c", "comp")).alias("hub"))
    # own: how many tokens before this one no other component lists; no node of another component has them.
    few = met.where("token IS NULL AND c IS NULL").select("k", "node", "pos")
    few = few.join(listed.select("k", "node").distinct().hint("shuffle_hash"), ["node", "k"], "left_semi")
    ahead = F.count(F.lit(1)).over(Window.partitionBy("node", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    ranked = listed.unionByName(few, allowMissingColumns=True).withColumn("own", F.col("pos") - ahead).where("token IS NOT NULL")
    folded = F.array(*(F.col("parity")[i].bitwiseXOR(F.col("parity")[i + PARITY_WORDS // 2]) for i in range(PARITY_WORDS // 2)))
    ranked = ranked.join(reps.select("node", "n", folded.alias("parity")).hint("shuffle_hash"), "node")
    mixed = staged(ranked.join(hubs, ["token", "k"]), "mixed-lists")
    pairs = _near_prefixes(mixed, near, numerator, denominator)
    second = _verified(rows, reps, pairs, width, numerator, denominator)

    # Texts of one id are one document.
    twins = usable.groupBy("_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select("_id", "a")
    twins = usable.select("_id", F.col("node").alias("b")).join(twins, "_id").where("a != b").select("a", "b").distinct()
    grouped = connected_components(links.union(second).union(twins))
    label = reps.join(grouped.hint("shuffle_hash"), "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    smallest = label.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_node = staged(label.join(smallest, "comp").select("node", "component_id"), "components")
    out = profiles.withColumn("node", F.expr("CASE WHEN n > 0 THEN node END")).join(by_node.hint("shuffle_hash"), "node", "left")
    told = [*(F.col(f"own_{i}").alias(c) for i, c in enumerate(keep)), *([F.col("n_words").alias(words)] if words else [])]
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id"), *told)


def _told_components(linked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, sorted, and their components, of whole components, TOLD_NODES or about so many; others count as alone."""
    share = -(-linked.count() // TOLD_NODES)
    some = linked if share < 2 else linked.where(F.pmod(F.xxhash64("comp"), F.lit(share)) == 0)
    rows = some.select("node", "comp").toArrow().sort_by("node")
    return rows["node"].to_numpy(), rows["comp"].to_numpy()


def _near_prefixes(mixed: DataFrame, near: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Candidate pairs (a, b) of different components, from rows (k, token, node, n, comp, hub, pos, own, parity) and
    from pairs that were made before (near), which tell how many tokens they share.

    Two sets share at most: the tokens before a shared one that other components list, itself, and the
    tokens after it. Two nodes that both have many tokens of their own before it cannot reach the
    similarity, so such heavy rows meet light rows only. Half the parity bits (folded, still a lower
    bound of the difference) are compared where rows meet. A token's largest component is never paired
    with itself: the others meet all rows of the token. For each order the last shared prefix token
    then bounds the overlap, and every order's bound must hold.
    """
    heavy = 2 * numerator * F.col("own") > (denominator - numerator) * (F.col("n") - F.col("own"))
    named = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "comp", "pos", "own", "parity")]
    wants = F.explode(F.when(heavy, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("heavy")
    minor = mixed.where("comp != hub").select("k", "token", wants, *named("x"))
    other = mixed.select("k", "token", heavy.alias("heavy"), (F.col("comp") == F.col("hub")).alias("in_hub"), *named("y"))
    least = _ceil_overlap(F.col("n_x"), F.col("n_y"), numerator, denominator)
    rest = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) - 1
    before = F.least(F.col("pos_x") - F.col("own_x"), F.col("pos_y") - F.col("own_y"))
    apart = (F.col("comp_x") != F.col("comp_y")) & (F.col("in_hub") | (F.col("node_x") < F.col("node_y")))
    differ = reduce(Column.__add__, (F.bit_count(F.col("parity_x")[i].bitwiseXOR(F.col("parity_y")[i])) for i in range(PARITY_WORDS // 2)))
    close = (F.least("n_x", "n_y") >= least) & (before + 1 + rest >= least) & (differ <= F.col("n_x") + F.col("n_y") - 2 * least)
    met = minor.join(other, ["token", "k", "heavy"]).where(apart & close)
    met = met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"), "k", F.lit(1).alias("c"), rest.alias("rest"), least.alias("least")).unionByName(near)
    bounds = [(F.sum(F.when(F.col("k") == k, F.col("c"))) + F.min(F.when(F.col("k") == k, F.col("rest")))).alias(f"bound{k}") for k in range(ORDERS)]
    pairs = met.groupBy("a", "b", "least").agg(*bounds)
    return pairs.where(reduce(Column.__and__, (F.col(f"bound{k}") >= F.col("least") for k in range(ORDERS)))).select("a", "b")


def _stars(placed: DataFrame, salt: int, numerator: int, denominator: int) -> DataFrame:
    """Candidate pairs (a, b): in each min-hash bucket PICKS nodes with the nodes of other components.
    Linear in the bucket, whatever its size. Picks follow a hash of their own for every min-hash and
    round; after the first round some prefer nodes that several earlier picks linked, which lie near a
    group's centre. A node with more links was itself picked before and has no preference."""
    linked = F.when(F.col("degree") <= MIN_HASHES * PICKS * salt, F.col("degree")).otherwise(0)
    picks = [F.min_by(F.struct("node", "comp", "n"), F.struct(-F.least(linked, F.lit(4 * i)), F.xxhash64(F.col("node"), F.col("k"), F.lit(salt * PICKS + i)))) for i in range(PICKS)]
    pivots = placed.groupBy("m", "k").agg(F.array_distinct(F.array(*picks)).alias("picks"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    pivots = pivots.select("k", "m", F.explode("picks").alias("pivot"))
    pivots = staged(pivots.select("k", "m", F.col("pivot.node").alias("p"), F.col("pivot.comp").alias("pc"), F.col("pivot.n").alias("pn")), "pivots")
    met = placed.join(pivots, ["m", "k"]).where((F.col("comp") != F.col("pc")) & (F.least("n", "pn") >= _ceil_overlap(F.col("n"), F.col("pn"), numerator, denominator)))
    return met.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct()


def _shared_prefixes(rows: DataFrame, levels: np.ndarray, total: int, told: np.ndarray, comps: np.ndarray, width: int, numerator: int, denominator: int) -> DataFrame:
    """The prefix tokens, under each order, that more than one node lists, as far as is known of different components.

    A token of FEW_ROWS rows and less gives its pairs (k, node, b, c, rest, least) within the size and position
    bounds: c shared tokens, rest after the last one; and its rows as (k, node, pos). The others give
    (k, token, node, pos). levels: log2 of the tokens' counts by the first bits of their hash; total: how many
    tokens all sets hold; told, comps: nodes, sorted, and their components.
    """
    spark = rows.sparkSession
    sent, sent_comps = spark.sparkContext.broadcast(levels), spark.sparkContext.broadcast((told, comps))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ORDERS * total * (denominator - numerator) // denominator // PART_TOKENS)
    shift = np.uint64(64 - (len(levels).bit_length() - 1))
    hot_level = int(np.log2(max(HOT_TOKEN, HOT_MEAN * total // len(levels))))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = sent.value
        for batch in slices(batches, "_text", 16 << 20):
            held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for block in slices(iter([batch]), "_text", BLOCK_BYTES):
                tokens, bounds = shingle_table(block.column(1), width)
                level = level_of[(tokens >> shift).astype(np.int64)]
                node, at = _nodes(tokens, bounds), bounds.tolist()
                sizes = np.diff(bounds)
                some = np.flatnonzero(sizes)
                for k in range(ORDERS):
                    # Rarer levels first, then by a hash of the order's own.
                    key = level.astype(np.uint64) << np.uint64(58) | mix(tokens, 301 + k) >> np.uint64(6)
                    first = [_prefix(key[at[d] : at[d + 1]], numerator, denominator) for d in some]
                    n = np.array([len(x) for x in first], np.int64)
                    place = np.concatenate(first or [np.zeros(0, np.int64)]) + np.repeat(bounds[some], n)
                    own, names = tokens[place], np.repeat(node[some], n)
                    by = np.where(level[place] >= hot_level, mix(own ^ names.view(np.uint64), 401), mix(own, 401))
                    held.append((k, own, names, (by % np.uint64(parts)).astype(np.int32), np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n), np.repeat(sizes[some], n)))
            for k in range(ORDERS):
                own = [h for h in held if h[0] == k]
                if not any(len(h[1]) for h in own):
                    continue
                token, node, part, pos, size = (np.concatenate([h[i] for h in own]) for i in (1, 2, 3, 4, 5))
                order = np.argsort(part, kind="stable")
                token, node, part, pos, size = token[order], node[order], part[order], pos[order], size[order]
                cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
                at, tokens, nodes, places = part[cuts[:-1]], [], [], []
                small = "<u2" if pos.max() < 1 << 16 else "<u4"
                for a, b in zip(cuts, cuts[1:], strict=False):
                    heads = np.flatnonzero(np.r_[True, node[a + 1 : b] != node[a : b - 1]])
                    runs = np.diff(np.r_[heads, b - a]).astype("<u4")
                    tokens.append(token[a:b].astype("<u8").tobytes())
                    places.append(pos[a:b].astype(small).tobytes())
                    nodes.append(len(heads).to_bytes(4, "little") + node[a:b][heads].astype("<i8").tobytes() + runs.tobytes() + size[a:b][heads].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([k] * len(at), pa.int32()), pa.array(tokens, pa.binary()), pa.array(nodes, pa.binary()), pa.array(places, pa.binary())], ["part", "k", "tokens", "nodes", "places"])

    columns = {"k": pa.int32(), "token": pa.int64(), "node": pa.int64(), "pos": pa.int32(), "b": pa.int64(), "c": pa.int32(), "rest": pa.int64(), "least": pa.int64()}

    def rows_of(k: int, **own: np.ndarray) -> Iterator[pa.RecordBatch]:
        own["k"] = np.full(len(own["node"]), k)
        for a in range(0, len(own["node"]), 100_000):
            some = {c: v[a : a + 100_000] for c, v in own.items()}
            yield pa.RecordBatch.from_arrays([pa.array(some[c], kind) if c in some else pa.nulls(len(some["k"]), kind) for c, kind in columns.items()], list(columns))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of, (told, comps) = sent.value, sent_comps.value
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for k, tokens, nodes, places in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                n = int.from_bytes(nodes[:4], "little")
                pos = np.frombuffer(places, f"<u{8 * len(places) // len(tokens)}").astype(np.int32)
                runs = np.frombuffer(nodes, "<u4", n, 4 + 8 * n)
                held.setdefault(k, []).append((np.frombuffer(tokens, "<u8"), np.repeat(np.frombuffer(nodes, "<i8", n, 4), runs), pos, np.repeat(np.frombuffer(nodes, "<u4", n, 4 + 12 * n), runs)))
        for k in list(held):
            own = held.pop(k)
            token, node, pos, size = (np.concatenate([x[i] for x in own]) for i in (0, 1, 2, 3))
            del own
            order = np.argsort(token, kind="stable")
            alike = token[order[1:]] == token[order[:-1]]
            hot = level_of[(token[order] >> shift).astype(np.int64)] >= hot_level
            order = order[np.r_[False, alike] | np.r_[alike, False] | hot]
            order = order[np.lexsort((node[order], token[order]))]
            token, node, pos, size = token[order], node[order], pos[order], size[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, pos, size = token[new], node[new], pos[new], size[new].astype(np.int64)
            if not len(token):
                continue
            comp = node.copy()
            if len(told):
                at = np.minimum(np.searchsorted(told, node), len(told) - 1)
                comp = np.where(told[at] == node, comps[at], node)
            heads = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            rows_ = np.diff(np.r_[heads, len(token)])
            hot = level_of[(token[heads] >> shift).astype(np.int64)] >= hot_level
            mixed = np.minimum.reduceat(comp, heads) < np.maximum.reduceat(comp, heads)
            few = mixed & ~hot & (rows_ <= FEW_ROWS)
            many = np.repeat((mixed | hot) & ~few, rows_)
            yield from rows_of(k, token=token[many].view(np.int64), node=node[many], pos=pos[many])
            ends, few = np.repeat(heads + rows_, rows_), np.repeat(few, rows_)
            yield from rows_of(k, node=node[few], pos=pos[few])
            x, found = np.flatnonzero(few), []
            for d in range(1, FEW_ROWS):
                x = x[x + d < ends[x]]
                y = x + d
                least = -(-(size[x] + size[y]) * numerator // (numerator + denominator))
                rest = np.minimum(size[x] - pos[x], size[y] - pos[y]) - 1
                near = (comp[x] != comp[y]) & (np.minimum(size[x], size[y]) >= least) & (np.minimum(pos[x], pos[y]) + 1 + rest >= least)
                found.append((node[x[near]], node[y[near]], rest[near], least[near]))
            a, b, rest, least = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(a):
                order = np.lexsort((b, a))  # nodes of a token ascend, so a < b
                a, b, rest, least = a[order], b[order], rest[order], least[order]
                heads = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                yield from rows_of(k, node=a[heads], b=b[heads], c=np.diff(np.r_[heads, len(a)]), rest=np.minimum.reduceat(rest, heads), least=least[heads])

    packed = rows.mapInArrow(emit, "part int, k int, tokens binary, nodes binary, places binary")
    return staged(packed.repartition(parts, "part").mapInArrow(meet, "k int, token long, node long, pos int, b long, c int, rest long, least long"), "shared-prefixes", "lz4")
