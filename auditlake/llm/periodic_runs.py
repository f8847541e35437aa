"""Periodic runs of words: maximal repetitions found as maximal pairs of an LCP-interval tree."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import binaries, slices, text_of, without

#: Bytes of text whose suffixes are sorted together, but for a longer text.
SORT_BYTES = 2 << 20


def _sorted_suffixes(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes that share at least `least` words with another one, in an order of suffixes, and the
    words that each shares with the one before it (0: a new group). Words of different texts have different ids, and
    a text ends with a word of its own, so nothing is shared across texts.

    Prefix doubling: the names of 1, 2, 4 ... words are kept, and the shared lengths are read from them.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    name = np.empty(n, np.int64)
    name[order] = np.searchsorted(ids[order], ids[order])
    names = [name]
    group = name[order]
    width = 1
    while True:
        # Only suffixes that are not yet alone are sorted on.
        same = group[1:] == group[:-1]
        tied = np.r_[same, False] | np.r_[False, same]
        order, group = order[tied], group[tied]
        if not len(order):
            break
        after = order + width
        second = np.where(after < n, name[np.minimum(after, n - 1)], -1)
        place = np.argsort(group * (n + 1) + second)
        order, group, second = order[place], group[place], second[place]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        first = np.flatnonzero(new)
        # A name is the place of its first suffix: the old name, and how many of the group go before.
        heads = np.ones(len(order), bool)
        heads[1:] = group[1:] != group[:-1]
        base = np.maximum.accumulate(np.where(heads, np.arange(len(order)), 0))
        start = np.repeat(first, np.diff(np.r_[first, len(order)]))
        name = name.copy()
        name[order] = group + (start - base)
        names.append(name)
        group, width = name[order], 2 * width
    # The last names are places in the order of all suffixes.
    whole = np.empty(n, np.int64)
    whole[name] = np.arange(n)
    whole = whole[_near(names, whole, least)]
    shared = np.zeros(len(whole), np.int64)
    left, right = whole[:-1].copy(), whole[1:].copy()
    for k in range(len(names) - 1, -1, -1):
        inside = (left < n) & (right < n)
        equal = inside.copy()
        equal[inside] = names[k][left[inside]] == names[k][right[inside]]
        step = equal * (1 << k)
        shared[1:] += step
        left, right = left + step, right + step
    keep = shared >= least
    keep[:-1] |= shared[1:] >= least
    shared = np.where(shared >= least, shared, 0)
    return whole[keep], shared[keep]


def _near(names: list[np.ndarray], whole: np.ndarray, least: int) -> np.ndarray:
    """Places whose suffix has the first words, up to `least`, of a neighbour in the order: a power of two of them."""
    level = names[min(len(names) - 1, least.bit_length() - 1)][whole]
    same = level[1:] == level[:-1]
    return np.r_[same, False] | np.r_[False, same]


class _Interval:
    """An interval of suffixes: their starts in order, and the same by the word to their left."""

    __slots__ = ("classes", "starts")

    def __init__(self, start: int, left: int) -> None:
        self.starts = [start]
        self.classes = {left: [start]}

    def pairs(self, start: int, left: int, near: int, far: int) -> Iterator[int]:
        """Starts whose left word differs and whose distance is from near to far."""
        starts = self.starts
        low, high = bisect_left(starts, start - far), bisect_left(starts, start + far + 1)
        if high - low <= len(self.classes):
            for other in starts[low:high]:
                if abs(other - start) >= near:
                    listed = self.classes.get(left)
                    if listed is not None:
                        at = bisect_left(listed, other)
                        if at < len(listed) and listed[at] == other:
                            continue
                    yield other
            return
        for word, listed in self.classes.items():
            if word != left:
                for other in listed[bisect_left(listed, start - far) : bisect_left(listed, start + far + 1)]:
                    if abs(other - start) >= near:
                        yield other

    def take(self, other: _Interval) -> None:
        """Add a smaller interval's starts."""
        _add(self.starts, other.starts)
        for word, listed in other.classes.items():
            own = self.classes.get(word)
            if own is None:
                self.classes[word] = listed
            elif len(own) < len(listed):
                _add(listed, own)
                self.classes[word] = listed
            else:
                _add(own, listed)


def _add(own: list[int], more: list[int]) -> None:
    if 8 * len(more) < len(own):
        for x in more:
            insort(own, x)
    else:
        own.extend(more)
        own.sort()


def _maximal_pairs(starts: list[int], shared: list[int], lefts: list[int], least: int) -> dict[tuple[int, int], int]:
    """(first word, word after the last) -> smallest period, from the intervals bottom-up.

    Starts in two children of an interval of depth d differ d words on; where their left words differ too, they are
    a maximal pair. At a distance q of at most d its two copies touch or overlap, and q + d words are a run: it
    can be extended neither way. Multiples of a period give the same words, so the smallest stays.
    """
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, _Interval]] = []

    def merged(depth: int, one: _Interval, two: _Interval) -> _Interval:
        large, small = (one, two) if len(one.starts) >= len(two.starts) else (two, one)
        near = max(1, least - depth)
        for left, listed in small.classes.items():
            for start in listed:
                for other in large.pairs(start, left, near, depth):
                    begin, period = min(start, other), abs(start - other)
                    span = (begin, begin + period + depth)
                    if found.get(span, period + 1) > period:
                        found[span] = period
        large.take(small)
        return large

    # The stack holds, bottom to top, intervals and the depth at which each hangs from the one below it.
    current: _Interval | None = None
    for start, depth, left in zip(starts, shared, lefts, strict=True):
        leaf = _Interval(start, left)
        if current is not None:
            while stack and stack[-1][0] >= depth:
                if not stack[-1][0]:
                    break
                hung, below = stack.pop()
                current = merged(hung, below, current)
            if depth:
                stack.append((depth, current))
        current = leaf
    while stack and current is not None:
        hung, below = stack.pop()
        current = merged(hung, below, current)
    return found


def runs_of(texts: list[list[bytes]], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, smallest period) of each list of words, by start, then period."""
    ids, bases, owner = [], [0], 0
    for words in texts:
        # Ids are the words' own, so equal ids are equal words; the text's end has an id of its own.
        own = {w: i for i, w in enumerate(dict.fromkeys(words), owner)}
        ids.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
        ids.append(np.array([owner + len(own)], np.int64))
        owner += len(own) + 1
        bases.append(bases[-1] + len(words) + 1)
    if not ids:
        return []
    flat = np.concatenate(ids)
    starts, shared = _sorted_suffixes(flat, -(-least // 2))
    # The first word of a text has the end of the text before it to its left, which is like no other word.
    lefts = np.where(starts > 0, flat[starts - 1], -1)
    found = _maximal_pairs(starts.tolist(), shared.tolist(), lefts.tolist(), least)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if found:
        spans = np.array([(a, b, q) for (a, b), q in found.items()], np.int64)
        texts_of = np.searchsorted(np.array(bases), spans[:, 0], side="right") - 1
        for text, (a, b, q) in zip(texts_of.tolist(), spans.tolist(), strict=True):
            out[text].append((a - bases[text], b - a, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone)
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=False) if not g)


RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 12) -> DataFrame:
    """All columns of docs with runs (array of start, length, period) and collapsed (string).

    Words are `[^\\x20\\x09-\\x0D]+`, compared as they are and numbered from 0. A run is a stretch of words with
    smallest period q, of at least `least` and 2 * q words, that no neighbouring word extends. collapsed holds the
    words that no run repeats, that is all but those of a run after its first q words, joined by single spaces.
    Null, empty and blank texts have no runs and an empty collapsed. Each row is judged on its own: repeated rows
    and rows without id give a row each, an empty table an empty one. Columns of docs named runs or collapsed in any
    case give way to the new ones. A text is one row, held in memory by one task with some 200 bytes a word.
    """
    docs = without(docs, "runs", "collapsed")
    schema = T.StructType([*docs.schema.fields, T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, SORT_BYTES):
            texts = [x.split() for x in binaries(batch.column(batch.schema.get_field_index(text_col)))]
            runs = runs_of(texts, least)
            collapsed = [_collapsed(w, r) for w, r in zip(texts, runs, strict=True)]
            flat = [r for listed in runs for r in listed]
            values = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], RUN.names)
            at = pa.array(np.r_[0, np.cumsum([len(r) for r in runs])], pa.int32())
            columns = [*batch.columns, pa.ListArray.from_arrays(at, values), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "runs", "collapsed"])

    return docs.mapInArrow(run, schema)


def with_repeats(text: Column, doc_id: Column) -> Column:
    """The text, but for ids whose crc32 ends in 0: from word a on, the p words there over and over again."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = F.when(n > 0, g % n).otherwise(0).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.concat_ws(" ", F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))
    return F.when(h % 10 == 0, made).otherwise(text)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, how many runs, the longest (ties: smallest start, then period; none: nulls), and sha256 of
    the list of runs and of the collapsed text. Rows without id keep their text as it is."""
    slim = docs.select(F.col(id_col), with_repeats(text_of(text_col), F.col(id_col)).alias("text"))
    found = periodic_runs(slim)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return found.withColumn("_best", longest).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
