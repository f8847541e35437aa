"""Phrase collocations: n-gram counts as weighted acyclic automata, united by prefix and composed for part lookups."""

from __future__ import annotations

import dataclasses
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm.common import WHITE, binaries, flat_bytes, mix, slices, span_hashes, staged, text_of

#: Bytes that end a word; those that also end a piece.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True
ENDS = WHITE | BREAKS
#: Longest phrase, in words.
WIDEST = 5
#: Bytes of text whose n-grams are counted at a time; distinct n-grams that a task holds before it sends them.
COUNT_BYTES, HELD = 1 << 20, 1 << 20
#: Words of the corpus for each prefix range, and ranges at least.
RANGE_WORDS, RANGES = 4_000_000, 16
#: Bits of the filter on n-grams that may be frequent: 8 MB at most; false positives only.
FILTER_BITS = (12, 26)
_PLACES = mix(np.arange(1, WIDEST + 1, dtype=np.uint64), 31) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

Columns = list[np.ndarray]


def _united(columns: Columns, weights: np.ndarray, how: np.ufunc = np.add) -> tuple[Columns, np.ndarray]:
    """Sorted distinct tuples and their summed (or otherwise joined) weights."""
    if not len(weights):
        return columns, weights
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    return [c[new] for c in columns], how.reduceat(weights[order], new)


def _narrow(x: np.ndarray) -> bytes:
    """The numbers in as few bytes each as the largest takes, after that width and how many they are."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
    return struct.pack("<BQ", width, len(x)) + x.astype(f"<u{width}").tobytes()


def _widened(data: bytes, at: int) -> tuple[np.ndarray, int]:
    width, n = struct.unpack_from("<BQ", data, at)
    at += 9
    return np.frombuffer(data, f"<u{width}", n, at), at + n * width


@dataclasses.dataclass
class Transducer:
    """An acyclic automaton whose paths are n-grams of word symbols; an arc's weight is the count of the n-gram that
    ends with it (0: none). By depth: arcs in the order of their states, sorted by symbol in a state, and each
    state's first arc. Equal states are one."""

    symbols: list[np.ndarray]
    weights: list[np.ndarray]
    targets: list[np.ndarray]
    firsts: list[np.ndarray]

    @staticmethod
    def of(orders: dict[int, tuple[Columns, np.ndarray]]) -> Transducer:
        """From sorted distinct n-grams and weights by number of words. Walks the sorted n-grams from the longest to
        the shortest prefix; a state whose arcs are in the register already is not built again."""
        depth = max(orders, default=0)
        paths: list[tuple[Columns, np.ndarray]] = []
        for d in range(1, depth + 1):
            prefixes = [(c[:d], w if n == d else np.zeros(len(w), np.uint64)) for n, (c, w) in orders.items() if n >= d]
            columns = [np.concatenate([p[0][i] for p in prefixes]) for i in range(d)]
            paths.append(_united(columns, np.concatenate([p[1] for p in prefixes])))
        out = Transducer([], [], [], [])
        states = np.zeros(len(paths[-1][1]) if paths else 0, np.uint64)
        for d in range(depth - 1, -1, -1):
            columns, weights = paths[d]
            parents = len(paths[d - 1][1]) if d else 1
            of = _path_index(paths[d - 1][0], columns[:d]) if d else np.zeros(len(weights), np.int64)
            ends = np.searchsorted(of, np.arange(parents + 1))
            arcs = np.column_stack([columns[d], weights.astype(np.uint64), states])
            raw, at = arcs.tobytes(), (24 * ends).tolist()
            register: dict[bytes, int] = {}
            states = np.fromiter((register.setdefault(raw[a:b], len(register)) for a, b in zip(at, at[1:], strict=False)), np.uint64, parents)
            kept = np.frombuffer(b"".join(register), np.uint64).reshape(-1, 3)
            out.symbols.insert(0, kept[:, 0].copy())
            out.weights.insert(0, kept[:, 1].copy())
            out.targets.insert(0, kept[:, 2].copy())
            out.firsts.insert(0, np.r_[0, np.cumsum([len(x) // 24 for x in register])].astype(np.int64))
        return out

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<B", len(self.symbols))]
        for s, w, t, f in zip(self.symbols, self.weights, self.targets, self.firsts, strict=True):
            parts += [_narrow(s), _narrow(w), _narrow(t), _narrow(np.diff(f))]
        return b"".join(parts)

    @staticmethod
    def from_bytes(data: bytes) -> Transducer:
        out, at = Transducer([], [], [], []), 1
        for _ in range(data[0]):
            for held in (out.symbols, out.weights, out.targets):
                x, at = _widened(data, at)
                held.append(x.astype(np.uint64))
            x, at = _widened(data, at)
            out.firsts.append(np.r_[0, np.cumsum(x.astype(np.int64))])
        return out

    def paths(self) -> dict[int, tuple[Columns, np.ndarray]]:
        """Sorted n-grams and weights by number of words, prefixes of weight 0 among them."""
        out: dict[int, tuple[Columns, np.ndarray]] = {}
        columns: Columns = []
        states = np.zeros(1, np.int64)
        for d, first in enumerate(self.firsts):
            many = np.diff(first)[states]
            ends = np.cumsum(many)
            arcs = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[states] - (ends - many), many)
            columns = [np.repeat(c, many) for c in columns] + [self.symbols[d][arcs]]
            out[d + 1] = columns, self.weights[d][arcs]
            states = self.targets[d][arcs].astype(np.int64)
        return out

    def composed(self, columns: Columns) -> np.ndarray:
        """Weights of the n-grams given (0: not a path): both automata are walked arc by arc."""
        states, found = np.zeros(len(columns[0]), np.int64), np.ones(len(columns[0]), bool)
        weights = np.zeros(len(columns[0]), np.uint64)
        for d, wanted in enumerate(columns):
            if d >= len(self.symbols) or not len(self.symbols[d]):
                return np.zeros(len(wanted), np.uint64)
            alphabet, named = np.unique(self.symbols[d], return_inverse=True)
            keys = np.repeat(np.arange(len(self.firsts[d]) - 1), np.diff(self.firsts[d])) * len(alphabet) + named
            symbol = np.minimum(np.searchsorted(alphabet, wanted), len(alphabet) - 1)
            key = states * len(alphabet) + symbol
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            found &= (alphabet[symbol] == wanted) & (keys[at] == key)
            states = self.targets[d][at].astype(np.int64)
            weights = self.weights[d][at]
        return np.where(found, weights, 0)


def _path_index(paths: Columns, wanted: Columns) -> np.ndarray:
    """Places of sorted n-grams, each of them in paths, among the sorted distinct paths."""
    n = len(wanted[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.r_[False, np.any([c[1:] != c[:-1] for c in wanted], axis=0)]
    inside = np.cumsum(new)
    heads = np.r_[0, np.flatnonzero(new)]
    both = [np.concatenate([p, w[heads]]) for p, w in zip(paths, wanted, strict=True)]
    order = np.lexsort([np.arange(len(both[0])), *both[::-1]])
    is_path = order < len(paths[0])
    place = np.cumsum(is_path) - 1
    of = np.empty(len(order), np.int64)
    of[order] = place
    return of[len(paths[0]) :][inside]


def united(transducers: list[Transducer]) -> Transducer:
    """One automaton with the sums of the weights."""
    by_order: dict[int, list[tuple[Columns, np.ndarray]]] = {}
    for t in transducers:
        for n, (columns, weights) in t.paths().items():
            own = weights > 0
            if own.any():
                by_order.setdefault(n, []).append(([c[own] for c in columns], weights[own]))
    return Transducer.of({n: _united([np.concatenate([x[0][i] for x in many]) for i in range(n)], np.concatenate([x[1] for x in many])) for n, many in by_order.items()})


# --- texts to n-grams ------------------------------------------------------------------------


def _tokens(batch: pa.RecordBatch, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows (lang's hash, text): lower-cased bytes, word starts and ends, symbol, piece and row of each word.
    A symbol stands for a word of one lang."""
    data, offsets = flat_bytes(batch.column(1))
    raw = _LOWER[data]
    inside = ~ENDS[raw]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    heads, lasts = offsets[:-1][offsets[:-1] < len(raw)], offsets[1:][offsets[1:] > 0] - 1
    begin[heads], stop[lasts] = inside[heads], inside[lasts]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    langs = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
    symbols = mix(span_hashes(raw, starts, ends) ^ mix(langs, salt)[rows], salt) if len(starts) else np.zeros(0, np.uint64)
    pieces = np.cumsum(BREAKS[raw])[starts] + rows if len(starts) else starts
    return raw, starts, ends, symbols, pieces, rows


def _named(symbols: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n words from each place on; for one word its symbol."""
    if n == 1:
        return symbols
    sums = np.zeros(max(0, len(symbols) - n + 1), np.uint64)
    for j in range(n):
        sums += symbols[j : j + len(sums)] * _PLACES[j]
    return mix(sums, n)


def _passes(words: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = names >> np.uint64(64 - (64 * len(words)).bit_length() + 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _range(columns: Columns, ranges: int) -> np.ndarray:
    """Prefix range: of the first two words, or of the only one."""
    prefix = mix(columns[0] * _PLACES[0] + columns[1] * _PLACES[1], 37) if len(columns) > 1 else mix(columns[0], 41)
    return ((prefix >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def _by_range(columns: Columns, weights: np.ndarray, ranges: int) -> Iterator[tuple[int, Columns, np.ndarray]]:
    """Distinct n-grams range by range, sorted in each."""
    of = _range(columns, ranges)
    order = np.lexsort([*columns[::-1], of])
    bounds = np.searchsorted(of[order], np.arange(ranges + 1)).tolist()
    for r, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if a < b:
            yield r, [c[order[a:b]] for c in columns], weights[order[a:b]]


def _summed(chunks: list[tuple[np.ndarray, Columns, np.ndarray]]) -> tuple[np.ndarray, Columns, np.ndarray]:
    """(name, n-gram, count) with equal neighbours in the order of names summed. Two n-grams of one name are kept
    apart; where they alternate, one may stand twice, which the union sums up."""
    names = np.concatenate([c[0] for c in chunks])
    columns = [np.concatenate(x) for x in zip(*(c[1] for c in chunks), strict=True)]
    counts = np.concatenate([c[2] for c in chunks])
    order = np.argsort(names)
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if len(order) else order
    return names[order[first]], [c[first] for c in columns], np.add.reduceat(counts[order], first) if len(order) else counts


def _words(docs: DataFrame, least: int, salt: int) -> DataFrame:
    """(symbol, lang, word, n) of the words counted `least` times and more, and of the empty word, whose n is that of
    all words of the lang. clash: another word has the symbol."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", COUNT_BYTES):
            raw, starts, ends, symbols, _, rows = _tokens(batch, salt)
            found, at, n = np.unique(symbols, return_index=True, return_counts=True)
            names = batch.column(2).to_pylist()
            data = raw.tobytes()
            words = [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            langs = [names[i] for i in rows[at].tolist()]
            hashes = batch.column(0).to_pylist()
            held: dict[str, list[int]] = {}
            for name, h, many in zip(names, hashes, np.bincount(rows, minlength=batch.num_rows).tolist(), strict=True):
                held.setdefault(name, [h, 0])[1] += many
            yield pa.RecordBatch.from_arrays(
                [pa.array([*found.view(np.int64).tolist(), *(h for h, _ in held.values())], pa.int64()), pa.array([*langs, *held], pa.string()), pa.array([*words, *[b""] * len(held)], pa.binary()), pa.array([*n.tolist(), *(m for _, m in held.values())], pa.int64())],
                ["symbol", "lang", "word", "n"],
            )

    counted = docs.mapInArrow(count, "symbol long, lang string, word binary, n long")
    # The empty word is kept apart by its length, so a hash of a lang meets no symbol.
    summed = counted.groupBy("symbol", (F.octet_length("word") > 0).alias("real")).agg(
        F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("n").alias("n"), ((F.min("word") != F.max("word")) | (F.min("lang") != F.max("lang"))).alias("clash")
    )
    return summed.where((F.col("n") >= least) | ~F.col("real") | F.col("clash"))


def _filter(names: DataFrame, many: int) -> np.ndarray:
    """A bit for each name (64-bit hashes), about eight for each and 2^FILTER_BITS[1] at most."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (8 * many).bit_length()))
    at = F.shiftrightunsigned("name", 64 - bits)
    rows = names.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(name, {64 - bits}) % 64 as int))")).alias("bits")).toPandas()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def _counted(docs: DataFrame, n: int, words: np.ndarray, salt: int, ranges: int) -> DataFrame:
    """Rows (range, data): count transducers of the n-grams of a task whose two parts of n - 1 words pass the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, Columns, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(r, Transducer.of({n: (c, w)}).to_bytes()) for r, c, w in _by_range(held[0][1], held[0][2], ranges)]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["range", "data"])

        for batch in slices(batches, "text", COUNT_BYTES):
            *_, symbols, pieces, _ = _tokens(batch, salt)
            if len(symbols) < n:
                continue
            may = _passes(sent.value, _named(symbols, n - 1))
            at = np.flatnonzero(may[:-1] & may[1:] & (pieces[: 1 - n] == pieces[n - 1 :]))
            held.append(_summed([(_named(symbols, n)[at], [symbols[at + j] for j in range(n)], np.ones(len(at), np.uint64))]))
            if sum(len(h[0]) for h in held) > HELD:
                held = [_summed(held)]
                if len(held[0][0]) > HELD // 2:
                    yield from out()
                    held = []
        if held:
            held = [_summed(held)]
            yield from out()

    return docs.mapInArrow(count, "range int, data binary")


def _frequent(counted: DataFrame, n: int, least: int) -> DataFrame:
    """Rows (range, n, many, names, data): the n-grams of a range counted `least` times and more in all, and their hashes."""

    def unite(table: pa.Table) -> pa.Table:
        (columns, weights) = united([Transducer.from_bytes(d) for d in binaries(table["data"].combine_chunks())]).paths().get(n, ([np.zeros(0, np.uint64)] * n, np.zeros(0, np.uint64)))
        own = weights >= least
        columns, weights = [c[own] for c in columns], weights[own]
        # The hash of each n-gram, as _named has it of a text.
        sums = np.zeros(len(weights), np.uint64)
        for j, c in enumerate(columns):
            sums += c * _PLACES[j]
        names = mix(sums, n).view(np.int64)
        return pa.table(
            {"range": pa.array([table["range"][0].as_py()], pa.int32()), "n": pa.array([n], pa.int32()), "many": pa.array([len(weights)], pa.int64()), "names": pa.array([names], pa.list_(pa.int64())), "data": pa.array([Transducer.of({n: (columns, weights)}).to_bytes()], pa.binary())}
        )

    return counted.groupBy("range").applyInArrow(unite, "range int, n int, many long, names array<long>, data binary")


# --- parts of the candidates -----------------------------------------------------------------


def _parts(whole: Transducer, ranges: int) -> tuple[dict[int, tuple[Columns, np.ndarray]], dict[tuple[int, int], tuple[Columns, np.ndarray]]]:
    """A range's candidates by number of words, and the parts whose counts it needs of others, by range and number of
    words: first words, and all rests of candidates. A part's weight is the largest count of a candidate of which it is
    all but the first word."""
    candidates = {n: ([c[w > 0] for c in columns], w[w > 0]) for n, (columns, w) in whole.paths().items() if n > 1}
    wanted: dict[int, list[tuple[Columns, np.ndarray]]] = {}
    for n, (columns, weights) in candidates.items():
        none = np.zeros(len(weights), np.uint64)
        wanted.setdefault(1, []).append((columns[:1], none))
        for k in range(1, n):
            wanted.setdefault(n - k, []).append((columns[k:], weights if k == 1 else none))
    out = {}
    for n, many in wanted.items():
        columns, weights = _united([np.concatenate([x[0][i] for x in many]) for i in range(n)], np.concatenate([x[1] for x in many]), np.maximum)
        for r, c, w in _by_range(columns, weights, ranges):
            out[r, n] = c, w
    return candidates, out


def _asked(whole: DataFrame, ranges: int) -> DataFrame:
    """Rows (range, block, n, data, extended): the parts that a block of candidates asks a range for, once each."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), strict=True):
                _, parts = _parts(Transducer.from_bytes(data), ranges)
                # Weights say what the parts are extended to; one is added so that each part is a path of its own.
                rows = [(r, block, n, Transducer.of({n: (c, w + np.uint64(1))}).to_bytes()) for (r, n), (c, w) in parts.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in rows], pa.int32()) for i in range(3)), pa.array([x[3] for x in rows], pa.binary())], ["range", "block", "n", "data"])

    return whole.mapInArrow(ask, "range int, block int, n int, data binary")


def _told(asked: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows (block, range, n, data): counts of the parts that block asked range for, in their order; with range -1 the
    marks of block's own candidates of n words: 1 where a longer one around it is as frequent."""

    def tell(wanted: pa.Table, own: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, bytes]] = []
        if own.num_rows:
            here = own["range"][0].as_py()
            counts = Transducer.from_bytes(binaries(own["data"].combine_chunks())[0])
            paths = counts.paths()
            marks = {n: np.zeros(len(w), bool) for n, (_, w) in paths.items()}
            for n, (columns, weights) in paths.items():
                if n > 2 and len(weights):  # a longer candidate's first words are on its own path
                    at = _path_index(paths[n - 1][0], [c for c in columns[:-1]])
                    marks[n - 1][at[weights == paths[n - 1][1][at]]] = True
            blocks, orders, asked_of = (wanted[c].to_pylist() for c in ("block", "n", "data"))
            for block, n, data in zip(blocks, orders, asked_of, strict=True):
                columns, extended = Transducer.from_bytes(data).paths()[n]
                found = counts.composed(columns)
                rows.append((block, here, n, _narrow(found)))
                same = (extended > 1) & (extended - np.uint64(1) == found)
                if n > 1 and same.any():
                    marks[n][_path_index(paths[n][0], [c[same] for c in columns])] = True
            rows += [(here, -1, n, _narrow(m[paths[n][1] > 0].astype(np.uint8))) for n, m in marks.items() if n > 1]
        return pa.table({c: pa.array([x[i] for x in rows], t) for i, (c, t) in enumerate({"block": pa.int32(), "range": pa.int32(), "n": pa.int32(), "data": pa.binary()}.items())})

    return asked.groupBy("range").cogroup(whole.groupBy("range")).applyInArrow(tell, "block int, range int, n int, data binary")


def _cut(told: DataFrame, whole: DataFrame, ranges: int) -> DataFrame:
    """Rows (symbols, a, l, r): candidates that no longer one replaces, and the counts of the two parts of each cut."""

    def cut(replies: pa.Table, own: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"symbols": [], "a": [], "l": [], "r": []}
        if own.num_rows and replies.num_rows:
            whole = Transducer.from_bytes(binaries(own["data"].combine_chunks())[0])
            said = {(r, n): _widened(d, 0)[0] for r, n, d in zip(replies["range"].to_pylist(), replies["n"].to_pylist(), binaries(replies["data"].combine_chunks()), strict=True)}
            candidates, parts = _parts(whole, ranges)
            asked: dict[int, list[tuple[Columns, np.ndarray]]] = {}
            for (r, n), (columns, _) in parts.items():
                asked.setdefault(n, []).append((columns, said[r, n]))
            counts = {n: Transducer.of({n: _united([np.concatenate([x[0][i] for x in many]) for i in range(n)], np.concatenate([x[1] for x in many]).astype(np.uint64))}) for n, many in asked.items()}
            for n, (columns, weights) in candidates.items():
                stay = said[-1, n] == 0
                columns, weights = [c[stay] for c in columns], weights[stay]
                if not len(weights):
                    continue
                first = [(counts[1] if k == 1 else whole).composed(columns[:k]) for k in range(1, n)]
                rest = [counts[n - k].composed(columns[k:]) for k in range(1, n)]
                rows["symbols"] += np.column_stack(columns).view(np.int64).tolist()
                rows["a"] += weights.tolist()
                rows["l"] += np.column_stack(first).tolist()
                rows["r"] += np.column_stack(rest).tolist()
        lists = pa.list_(pa.int64())
        return pa.table({"symbols": pa.array(rows["symbols"], lists), "a": pa.array(rows["a"], pa.int64()), "l": pa.array(rows["l"], lists), "r": pa.array(rows["r"], lists)})

    return told.groupBy("block").cogroup(whole.withColumnRenamed("range", "block").select("block", F.col("block").alias("range"), "data").groupBy("block")).applyInArrow(cut, "symbols array<long>, a long, l array<long>, r array<long>")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, widest: int = WIDEST) -> tuple[DataFrame, DataFrame]:
    """(candidates, words). candidates: (symbols, a, l, r), a phrase of 2 to `widest` words counted a >= least times in
    the texts of one lang, without those inside a longer one as frequent; l and r: counts of the two parts of each cut.
    words: (symbol, real, lang, word, n), the frequent words, and a row a lang with real false and n all its words.

    A phrase's parts are as frequent as it at least, so only n-grams whose two parts of n - 1 words are frequent
    are counted: what can be left out is found by a filter without false negatives. Each task sends an automaton of its
    sorted n-grams to each prefix range; a range's are united. Every range then asks the others once for each
    part of its candidates, and composes what it is asked for with its own automaton. A range is found from the first two words, so
    a frequent word is many ranges'.
    """
    if not 2 <= widest <= WIDEST:
        raise ValueError(f"widest must be from 2 to {WIDEST}")
    spark = docs.sparkSession
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    slim = docs.select(F.xxhash64(lang).alias("hash"), text_of(text_col).alias("text"), lang.alias("lang"))
    salt = 43
    while True:
        words = staged(_words(slim, least, salt), "words")
        if not words.where("clash").limit(1).count():
            break
        salt += 1  # two words of one symbol: other symbols are taken
    total, many = words.agg(F.sum(F.when(~F.col("real"), F.col("n"))), F.count(F.when(F.col("real"), 1))).first()
    ranges = max(RANGES, -(-(total or 0) // RANGE_WORDS))
    names = words.where("real").select(F.col("symbol").alias("name"))
    levels = [words.where("real").groupBy(F.expr(f"cast(pmod(symbol, {ranges}) as int)").alias("share")).applyInArrow(lambda t: _word_rows(t, ranges), "range int, data binary")]
    for n in range(2, widest + 1):
        level = staged(_frequent(_counted(slim.select("hash", "text"), n, _filter(names, many), salt, ranges), n, least), f"grams-{n}")
        many = level.agg(F.sum("many")).first()[0] or 0
        levels.append(level.select("range", "data"))
        if not many:
            break
        names = level.select(F.explode("names").alias("name"))
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)

    def unite(table: pa.Table) -> pa.Table:
        data = united([Transducer.from_bytes(d) for d in binaries(table["data"].combine_chunks())]).to_bytes()
        return pa.table({"range": pa.array([table["range"][0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    whole = staged(every.groupBy("range").applyInArrow(unite, "range int, data binary"), "automata")
    # One row a range: each is a task's, whatever the file sizes.
    asked = staged(_asked(whole.repartition(min(ranges, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "range"), ranges), "parts")
    told = staged(_told(asked, whole), "counts")
    return staged(_cut(told, whole, ranges), "candidates"), words.drop("clash")


def _word_rows(table: pa.Table, ranges: int) -> pa.Table:
    symbols = table["symbol"].to_numpy().view(np.uint64)
    rows = [(r, Transducer.of({1: (c, w)}).to_bytes()) for r, c, w in _by_range([symbols], table["n"].to_numpy().astype(np.uint64), ranges)]
    return pa.table({"range": pa.array([r for r, _ in rows], pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, widest: int = WIDEST, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first `top` phrases by score, a, both falling, and phrase.

    Texts are lower-cased (A-Z) and split at `[.,;:!?\\x0A-\\x0D]` into pieces and those at space and tab into words. a:
    occurrences of the phrase in pieces, overlaps included; n: all words of the lang. Of the cuts of a phrase in two the
    one with the lowest floor(1000 * a * n / (l * r)) counts, of equal ones the first. Null texts are empty, a null lang
    is `und`; repeated rows count as often as they stand, ids are not read. Without text or phrases the result is empty.
    """
    candidates, words = phrase_counts(docs, text_col, lang_col, least, widest)
    real, totals = words.where("real"), words.where("NOT real").groupBy("lang").agg(F.sum("n").alias("total"))
    of = real.select(F.col("symbol").alias("_first"), "lang").join(F.broadcast(totals), "lang")
    found = candidates.withColumn("_first", F.element_at("symbols", 1)).join(of, "_first")
    # Exact to 38 digits: a and n below 10^17 keep 1000 * a * n and l * r within them.
    wide = lambda c: c.cast("decimal(19,0)")
    score = F.expr("transform(arrays_zip(l, r), (p, i) -> struct(1000BD * cast(a as decimal(17,0)) * cast(total as decimal(17,0)) div (cast(p.l as decimal(17,0)) * cast(p.r as decimal(17,0))) as score, i, p.l as l, p.r as r))")
    best = found.withColumn("_best", F.array_min(score)).select("lang", "symbols", "a", F.col("_best.l").alias("l"), F.col("_best.r").alias("r"), F.col("total").alias("n"), F.col("_best.score").alias("score"))
    ahead = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = best.withColumn("_rank", F.rank().over(ahead)).where(F.col("_rank") <= top).drop("_rank")
    spelt = near.select("*", F.posexplode("symbols").alias("_at", "symbol")).join(real.select("symbol", F.col("word").cast("string").alias("_word")), "symbol")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_word"))), lambda x: x["_word"]), " ")
    spelt = spelt.groupBy("lang", "symbols", "a", "l", "r", "n", "score").agg(phrase.alias("phrase"))
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
