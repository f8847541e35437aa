"""Byte-level BPE: encoding by a priority queue over a linked symbol list, decoding by concatenation."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import WHITE, flat_bytes, slices

#: Fixed value: the split of byte-level BPE vocabularies, before the merges.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White_Space of Unicode; no piece crosses it but for one leading plain space.
_WS = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CHUNKS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_WIDE_SPACE = "|".join(re.escape(c) for c in _WS[6:])
#: Distinct chunks that a task remembers, and the longest of them in bytes.
CACHE_ENTRIES, CACHE_BYTES = 400_000, 64


def printable() -> dict[str, int]:
    """Characters that stand for bytes in such vocabulary files: visible Latin-1 stands for itself, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}


class Bpe:
    """A vocabulary file of byte-level BPE: encode(text) -> ids, decode(ids) -> bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = printable()
        raw = lambda token: bytes(byte[c] for c in token)
        self.words = {i: raw(t) for t, i in spec["model"]["vocab"].items()}
        ids = {w: i for i, w in self.words.items()}
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.bytes = [ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.words |= {i: t.encode() for t, i in self.special.items()}
        self._split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merge(self, data: bytes) -> list[int]:
        """Merge the symbols of one piece, always the pair of lowest rank and then the leftmost."""
        ids = [self.bytes[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale: one side has since merged
            ids[i], ids[j] = new, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            h = left[i]
            if h >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def parts(self, text: str) -> list[int | list[str]]:
        """Ids of added tokens, and the pieces of the text between them."""
        if self._split is None:
            return [PIECES.findall(text)]
        out, at = [], 0
        for m in self._split.finditer(text):
            out += [PIECES.findall(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return [*out, PIECES.findall(text[at:])]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for x in self.parts(text):
            out += [x] if isinstance(x, int) else [i for piece in x for i in self.merge(piece.encode())]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


def chunk_bounds(raw: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Ends of the chunks (see CHUNKS) of texts that stand one after the other, with a leading 0.

    offsets: where each text begins, and the end. Texts numbered in whole are one chunk. The others
    have no white space beyond ASCII.
    """
    n = len(raw)
    space = WHITE[raw]
    before = np.zeros(n, bool)
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    mark = np.zeros(n + 1, bool)
    mark[:-1] = space & ~before
    word = np.flatnonzero(~space & before)  # words after white space, whose last character is theirs if it is a plain space
    mark[word - 1] = True
    mark[word[raw[word - 1] != 32]] = True
    for k in whole:
        mark[offsets[k] : offsets[k + 1]] = False
    mark[offsets] = True
    return np.flatnonzero(mark)


def _each(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    data, at = raw.tobytes(), offsets.tolist()
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class SliceCoder:
    """Ids of many texts at a time, by way of their distinct chunks, remembered from slice to slice.

    merge: the ids of many pieces (see PIECES), one after the other. Of the chunks seen before, the ones
    asked for of late stay: two tables of half of CACHE_ENTRIES take turns.
    """

    def __init__(self, model: Bpe, merge: Callable[[list[str]], np.ndarray]):
        self.model, self.merge = model, merge
        self.kind = "<u2" if max(model.words) < 1 << 16 else "<u4"  # unsigned ids in two bytes where they fit
        self._sizes = np.array([len(model.words.get(i, b"")) for i in range(max(model.words) + 1)])
        self._apart = re.compile("|".join([*map(re.escape, model.special), _WIDE_SPACE]).encode())
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _whole(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """Texts that hold an added token or white space beyond ASCII: they are encoded as one."""
        found = np.fromiter((m.start() for m in self._apart.finditer(data)), np.int64)
        return np.unique(np.searchsorted(offsets, found, side="right") - 1)

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([[x] if isinstance(x, int) else self.merge(x) for x in self.model.parts(text)] or [[]]).astype(self.kind)

    def _many(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks that hold a word: lines of one text, whose pieces the merges take at once."""
        lines = b"\n".join(chunks)
        text = lines.decode("utf-8", "replace")
        if len(text) != len(lines) and text.encode() != lines:  # not UTF-8
            return [self.encode(x.decode("utf-8", "replace")).tobytes() for x in chunks]
        ids = np.asarray(self.merge([x for x in PIECES.findall(text) if x != "\n"])).astype(self.kind)
        stop = np.searchsorted(np.cumsum(self._sizes[ids]), np.cumsum([len(x) for x in chunks])) + 1
        return _each(ids.view(np.uint8), np.r_[0, stop] * ids.itemsize)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, where each text's ids begin and the end); null is empty."""
        data, offsets = flat_bytes(column)
        whole = self._whole(data.tobytes(), offsets)
        bounds = chunk_bounds(data, offsets, whole)
        chunks = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        names, young, old = _each(*flat_bytes(chunks.dictionary)), self._young, self._old
        ids = [young.get(x) for x in names]
        simple = []
        for k in [k for k, x in enumerate(ids) if x is None]:
            x = names[k]
            own = old.get(x)
            if own is not None:
                young[x] = ids[k] = own
            elif len(x) <= CACHE_BYTES and not x[-1:].isspace() and not (len(whole) and self._apart.search(x)):
                simple.append(k)
            else:
                ids[k] = self.encode(x.decode("utf-8", "replace")).tobytes()
        if simple:
            for k, own in zip(simple, self._many([names[k] for k in simple]), strict=True):
                young[names[k]] = ids[k] = own
        if len(young) > CACHE_ENTRIES // 2:
            self._young, self._old = {}, young
        coded = pa.array(ids, pa.binary()).take(chunks.indices)
        buffer, ends = flat_bytes(coded)
        flat = buffer.view(self.kind)
        return flat, ends[np.searchsorted(bounds, offsets)] // flat.itemsize


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=2)
def slice_coder(path: str) -> SliceCoder:
    """By the priority queue of Bpe.merge; the same in every task of a worker, so what it remembers stays."""
    model = load(path)

    def merge(pieces: list[str]) -> np.ndarray:
        known: dict[str, list[int]] = {}
        out: list[int] = []
        for x in pieces:
            own = known.get(x)
            if own is None:
                own = known[x] = model.merge(x.encode())
            out += own
        return np.array(out, np.int64)

    return SliceCoder(model, merge)


def _table(values: dict[int, bytes]) -> pa.Array:
    return pa.array([values.get(i, b"") for i in range(max(values) + 1)], pa.binary())


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: id, n_tokens, ids_sha256, decoded_sha256. Nothing is shuffled.

    vocabulary is the path of a byte-level BPE file (JSON: vocab, merges, added_tokens) that every
    executor can open. Strings of added tokens inside a text become their ids. Null or empty text has
    no ids, and its digests are those of the empty text. Rows come back as given, repeats and null ids
    too. Memory in a task: a slice of texts (or one long text), its ids, and up to CACHE_ENTRIES short chunks.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, coder = load(vocabulary), slice_coder(vocabulary)
        tables = [_table({i: b"%d," % i for i in model.words}), _table(model.words)]
        for batch in slices(batches, "_text"):
            ids, at = coder(batch.column(1))
            digests = []
            for table, comma in zip(tables, (1, 0), strict=True):
                out, ends = flat_bytes(table.take(pa.array(ids)))
                out = memoryview(out)
                ends = ends[at]
                digests.append([hashlib.sha256(out[a : max(a, b - comma)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), *(pa.array(d, pa.string()) for d in digests)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
