"""Best-fit packing of documents into fixed-size sequences, with conflicts between neighbours."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import slices, without, word_table

#: Rows of one packing group; groups are independent, so memory and time of a task are bounded.
GROUP_ROWS = 2048


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (item, piece, size, bin, offset). Items come largest first, ties in the order given.

    Whole capacities of a longer item are bins of their own; the remainder is placed. Open bins are
    ordered by residual and carry bitmaps of their sources and clusters; from the tightest residual
    that fits, the search goes on to the next larger one until neither bitmap has the item's bit. A
    source or cluster under 0 conflicts with nothing.
    """
    out, residuals, n_bins = [], [], 0
    has_source, has_cluster, filled = {}, {}, {}
    rest = []
    for i, size in enumerate(sizes):
        whole = size // capacity if size > capacity else 0
        for piece in range(whole):
            out.append((i, piece, capacity, n_bins, 0))
            n_bins += 1
        if size - whole * capacity:
            rest.append((size - whole * capacity, i, whole))
    for size, i, piece in sorted(rest, key=lambda x: (-x[0], x[1])):
        source = 1 << sources[i] if sources[i] >= 0 else 0
        cluster = 1 << clusters[i] if clusters[i] >= 0 else 0
        at = bisect_left(residuals, (size, -1))
        while at < len(residuals) and (has_source[residuals[at][1]] & source or has_cluster[residuals[at][1]] & cluster):
            at += 1
        if at < len(residuals):
            left, b = residuals.pop(at)
        else:
            left, b = capacity, n_bins
            n_bins += 1
            has_source[b] = has_cluster[b] = filled[b] = 0
        out.append((i, piece, size, b, filled[b]))
        has_source[b] |= source
        has_cluster[b] |= cluster
        filled[b] += size
        if left > size:
            insort(residuals, (left - size, b))
    return out


def _numbers(values: pd.Series) -> list[int]:
    """Dense numbers in order of appearance; -1 for null, and for a value that occurs once (it has nobody to meet)."""
    codes, _ = pd.factorize(values)
    counts = np.bincount(codes[codes >= 0], minlength=1)
    codes = np.where((codes >= 0) & (counts[np.maximum(codes, 0)] > 1), codes, -1)
    _, dense = np.unique(codes, return_inverse=True)
    return (dense - (1 if (codes < 0).any() else 0)).tolist()


def pack_documents(docs: DataFrame, size: Column, source: Column, cluster: Column, capacity: int = 2048, id_col: str = "doc_id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pack every row into bins of capacity units; no bin has two documents of one source or cluster.

    Rows are dealt by a hash to groups of about group_rows, however many rows there are and however
    large a source or cluster is; each group is packed best-fit decreasing (ties: smaller id). Only ids,
    sizes, sources and cluster names travel. An item over capacity is cut into pieces; the pieces
    that fill a bin have it to themselves.

    Returns id, piece, start (units of the item before the piece), n_tokens, bin, bin_start, by
    (group, bin) numbered over all. A null or negative size counts as 0, and an item of size 0 still
    takes 1 unit. Null sources and clusters conflict with nothing. Null ids come last; rows that repeat
    an id are packed one by one. Empty in, empty out.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(1)).alias("_size"), source.cast("string").alias("_source"), cluster.cast("string").alias("_cluster"))
    groups = max(1, -(-docs.count() // group_rows))
    salt = F.when(F.col("_id").isNull(), F.monotonically_increasing_id())  # else all null ids of one text would meet in one group
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_id", "_size", "_cluster", salt), F.lit(groups)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_size", "_id"], ascending=[False, True], kind="stable", na_position="last").reset_index(drop=True)
        placed = best_fit(pdf["_size"].astype(int).tolist(), _numbers(pdf["_source"]), _numbers(pdf["_cluster"]), capacity)
        item, piece, n, b, offset = (np.array(x, np.int64) for x in zip(*placed, strict=True))
        return pd.DataFrame({"_id": pdf["_id"].to_numpy()[item], "piece": piece, "start": piece * capacity, "n_tokens": n, "bin": (np.int64(pdf["_group"].iloc[0]) << 32) + b, "bin_start": offset})

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.groupBy("_group").applyInPandas(pack, f"_id {kind}, piece int, start long, n_tokens long, bin long, bin_start long")
    return out.withColumnRenamed("_id", id_col)


def word_counts(docs: DataFrame, text_col: str = "text", name: str = "n_words") -> DataFrame:
    """docs with the number of words [^\\x20\\x09-\\x0D]+ of the whole text (long, null text: 0) in place of the text.

    Rows, repeated ones too, and all other columns stay; one called name in any case gives way. Empty in, empty out.
    """
    docs = without(docs, name.lower())
    fields = [f for f in docs.schema.fields if f.name != text_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            *_, first = word_table(batch.column(batch.schema.get_field_index(text_col)))
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(first).astype(np.int64))], [*(f.name for f in fields), name])

    return docs.mapInArrow(count, T.StructType([*fields, T.StructField(name, T.LongType())]))
