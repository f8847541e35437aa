"""Helpers shared by the corpus operators: scratch tables, text columns, vectorised word hashes."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.scratch import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"
MAX_LONG = (1 << 63) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """A table written between the steps of an operator."""
    return written(df, label, codec)


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs less the columns that an operator is about to add under these names (in any case)."""
    return docs.drop(*(c for c in docs.columns if c.lower() in names))


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast path; lower() would change other letters too."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def ascii_strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, mod folds, equals fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def binaries(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string or binary column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after the other, and where each begins with the end; null is empty."""
    own = column.cast(pa.binary())
    if own.null_count:
        own = own.fill_null(b"")
    at = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1, 4 * own.offset).astype(np.int64) if len(own) else np.zeros(1, np.int64)
    data = own.buffers()[2] if len(own) else None
    raw = np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about limit bytes of one text column, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


# --- word hashes -----------------------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply); other salts give other orders."""
    x = x ^ np.uint64(salt * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64), 7)
_INVERSE_ODD = pow(_ODD, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _ODD, np.uint64), np.full(n, _INVERSE_ODD, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (A-Z), and the starts and ends of the words [^\\x20\\x09-\\x0D]+."""
    raw, starts, ends, _ = word_table(pa.array([data], pa.binary()))
    return raw, starts, ends


def word_table(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_bounds of all rows, which stand one after the other, and where each row's words begin, with the end."""
    data, offsets = flat_bytes(column)
    raw = _LOWER[data]
    inside = ~WHITE[raw]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    heads, lasts = offsets[:-1][offsets[:-1] < len(raw)], offsets[1:][offsets[1:] > 0] - 1
    begin[heads], stop[lasts] = inside[heads], inside[lasts]
    starts = np.flatnonzero(begin)
    return raw, starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word, in order."""
    return span_hashes(*word_bounds(data))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = 1 << max(12, int(len(raw) + 1).bit_length())
    up, down = _powers(n)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Bytes of text whose words are hashed at a time, but for a longer text.
HASH_BYTES = 1 << 18


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, row after row, and where each row's begin, with the end."""
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    words, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for part in slices(iter([batch]), "text", HASH_BYTES):
        raw, starts, ends, first = word_table(part.column(0))
        words.append(span_hashes(raw, starts, ends))
        counts.append(np.diff(first))
    return np.concatenate(words), np.cumsum(np.concatenate(counts))


_PLACES = mix(np.arange(1, 65, dtype=np.uint64), 11) | np.uint64(1)


def shingle_table(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's width-word shingles, row after row, and where each row's
    begin, with the end; fewer words: one hash for the whole sequence; none: no hash."""
    return shingled(column, width)[:2]


def shingled(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingle_table, and the number of words of each row."""
    words, first = hashed_words(column)
    counts = np.diff(first)
    base = np.r_[0, np.cumsum(np.where(counts, np.maximum(1, counts - width + 1), 0))]
    out = np.empty(base[-1], np.uint64)
    if len(words) >= width:
        sums = np.zeros(len(words) - width + 1, np.uint64)
        for j in range(width):
            sums += words[j : j + len(sums)] * _PLACES[j]
        inside = np.arange(len(sums)) + width <= np.repeat(first[1:], counts)[: len(sums)]
        out[np.repeat(counts, np.diff(base)) >= width] = mix(sums[inside], width)
    for k in range(1, width):
        rows = np.flatnonzero(counts == k)
        sums = np.zeros(len(rows), np.uint64)
        for j in range(k):
            sums += words[first[rows] + j] * _PLACES[j]
        out[base[rows]] = mix(sums, k)
    for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[base[:-1][counts > 0]] = True
    return out[new], np.r_[0, np.cumsum(new)][base], counts


def shingle_set(data: bytes, width: int = 5) -> np.ndarray:
    """shingle_table of one text."""
    return shingle_table(pa.array([data], pa.binary()), width)[0]
