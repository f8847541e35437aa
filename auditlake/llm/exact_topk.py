"""Exact top-k inner-product search over vectors grouped by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm.common import staged

#: Rows of a bucket and of a query block: what one task holds at a time.
BUCKET_ROWS, BLOCK_ROWS, SEED_ROWS = 4096, 1024, 4096
#: Coordinates that the pruning looks at, and the local cosine from which it is chosen over length.
FOCUS, COORDINATE_FROM = 5, 0.6


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(_id, _vec, _dim, _norm): floor(scale * x), held to 2^52 either way, as little-endian int64 bytes; unusable vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs, dims, norms = [], [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or v is None or any(x is None for x in v):
                    continue
                x = np.floor(scale * np.asarray(v, np.float64))
                if not np.isfinite(x).all():
                    continue
                x = np.clip(x, -(2.0**52), 2.0**52)
                ids.append(i)
                vecs.append(x.astype("<i8").tobytes())
                dims.append(len(x))
                norms.append(float(np.sqrt((x * x).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64())], ["_id", "_vec", "_dim", "_norm"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(run, "_id long, _vec binary, _dim int, _norm double")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(len(column), dim)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can reach 2^53, else in Python integers (held to 64 bits)."""
    most = (float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0))) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    wide = q.astype(object) @ p.astype(object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def coordinate_survivors(q: np.ndarray, unit: np.ndarray, cosine: float) -> np.ndarray:
    """Rows of unit that can reach this cosine with the unit vector q, judged on q's largest coordinates.

    With s = q_f * p_f over the focus set and the rest of both vectors bounded by their leftover
    lengths, q.p <= s + sqrt(1 - |q_F|^2) * sqrt(1 - |p_F|^2).
    """
    focus = np.argsort(-np.abs(q))[:FOCUS]
    inside = unit[:, focus]
    rest_q = np.sqrt(max(0.0, 1.0 - float((q[focus] ** 2).sum())))
    rest_p = np.sqrt(np.maximum(0.0, 1.0 - (inside**2).sum(1)))
    return np.flatnonzero(inside @ q[focus] + rest_q * rest_p >= cosine - 1e-9)


def _first_k(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best rows by score, then smaller id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    start = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[place < k]


def search_bucket(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The up to k best rows of one bucket for each query of one block that can reach its threshold."""
    none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("_q", "_p", "_score")})
    if not len(queries) or not len(rows):
        return none
    dim = int(rows["_dim"].iloc[0])
    rows = rows.sort_values("_norm", ascending=False, kind="stable")
    p, length, ids = _matrix(rows["_vec"], dim), rows["_norm"].to_numpy(), rows["_id"].to_numpy()
    q, norm, qid = _matrix(queries["_vec"], dim), queries["_norm"].to_numpy(), queries["_id"].to_numpy()
    floor = np.nan_to_num(queries["_floor"].to_numpy(np.float64), nan=-np.inf)
    reach = norm * length[0]
    # The local threshold: the cosine that a row of this bucket's greatest length would need.
    cosine = np.divide(floor, reach, out=np.where(floor > 0, np.inf, -np.inf), where=reach > 0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    by_coordinate = np.flatnonzero((cosine >= COORDINATE_FROM) & (cosine <= 1 + 1e-9))
    if len(by_coordinate):
        unit = p / np.maximum(length, 1e-300)[:, None]
        for i in by_coordinate:
            at = coordinate_survivors(q[i] / norm[i], unit, cosine[i])
            score = products(q[i : i + 1], p[at])[0]
            good = score >= floor[i]
            found.append((np.full(int(good.sum()), i), at[good], score[good]))

    by_length = np.flatnonzero(cosine < COORDINATE_FROM)
    if len(by_length):
        # Lengths fall, so the rows long enough for any of these queries come first.
        needed = np.min(np.divide(floor[by_length], norm[by_length], out=np.full(len(by_length), -np.inf), where=norm[by_length] > 0))
        upto = int(np.searchsorted(-length, -needed * (1 - 1e-9), side="right")) if needed > 0 else len(p)
        for some in np.array_split(by_length, -(-len(by_length) // 256)):
            score = products(q[some], p[:upto])
            i, at = np.nonzero(score >= floor[some][:, None])
            found.append((some[i], at, score[i, at]))
    if not found:
        return none
    at_query, at_row, score = (np.concatenate(x) for x in zip(*found, strict=True))
    best = _first_k(at_query, ids[at_row], score, k)
    return pd.DataFrame({"_q": qid[at_query[best]], "_p": ids[at_row[best]], "_score": score[best]})


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """The k best integer inner products of each query with every other row; ties to the smaller id.

    Equal vectors are one: only the k + 1 smallest ids of each can be in any answer, so the rest are
    counted out before the search, exactly. The distinct vectors, sorted by length, form buckets of
    about BUCKET_ROWS. A first look at the SEED_ROWS longest gives every query a score it is sure to
    reach k + 1 times; a bucket whose longest vector cannot reach it is skipped, and inside a bucket
    the local cosine threshold (score over both lengths) picks coordinate or length pruning before the
    products are verified in whole numbers. Queries travel in blocks of BLOCK_ROWS to the buckets they
    need, joined on the bucket number.

    Returns query_id, rank, vec_id, score. Vectors null, or with null or non-finite components, or
    without id, take no part; vectors meet only those of their own dimension. Components beyond 2^52 count as 2^52, and
    scores beyond 64 bits as the last number of 64 bits. A row repeated with the
    same id and vector is one row. Fewer than k others: all of them. Empty in, empty out.
    """
    spark = vectors.sparkSession
    marked = vectors.select(F.col(id_col), F.col(vector_col), is_query.alias("_is_query"))
    points = staged(quantise(marked, id_col, vector_col, scale), "vectors")
    asked = staged(quantise(marked.where("_is_query"), id_col, vector_col, scale).select("_id", "_vec"), "queries")
    same = Window.partitionBy("_vec").orderBy("_id")
    copies = points.distinct().withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k + 1)
    copies = staged(copies, "vector-copies")
    heads = copies.where("_copy = 1").drop("_copy")
    total = heads.count()
    n_buckets = max(1, -(-total // BUCKET_ROWS))
    # Buckets of falling length: range partitions of (dimension, length, id), numbered in that order.
    ranged = heads.repartitionByRange(n_buckets, F.col("_dim"), F.col("_norm").desc(), F.col("_id"))
    ranged = staged(ranged.withColumn("_bucket", F.spark_partition_id()), "buckets")
    spans = ranged.groupBy("_bucket", "_dim").agg(F.max("_norm").alias("_longest"))

    queries = ranged.drop("_bucket").join(asked.select("_vec").distinct(), "_vec", "left_semi")
    seed = ranged.orderBy(F.col("_norm").desc(), "_id").limit(SEED_ROWS).select("_id", "_vec", "_dim")
    queries = staged(_floors(queries, seed, k), "floors")

    n_blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    blocks = queries.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(n_blocks)).cast("int"))
    needs = blocks.groupBy("_block", "_dim").agg(F.min(F.when((F.col("_norm") > 0) & F.col("_floor").isNotNull() & ~F.isnan("_floor"), F.col("_floor") / F.col("_norm")).otherwise(F.lit(float("-inf")))).alias("_least"))
    visits = staged(needs.join(spans, "_dim").where(F.col("_longest") * (1 + 1e-9) >= F.col("_least")).select("_block", "_bucket", "_dim"), "visits")
    left = blocks.join(visits, ["_block", "_dim"])
    right = ranged.join(visits, ["_bucket", "_dim"])
    keys = ["_block", "_bucket", "_dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda q, p: search_bucket(q, p, k + 1), "_q long, _p long, _score long")

    ordered = Window.partitionBy("_q").orderBy(F.col("_score").desc(), "_p")
    found = found.withColumn("_r", F.row_number().over(ordered)).where(F.col("_r") <= k + 1).drop("_r")
    # From distinct vectors back to rows: a vector's ids on the right, all query ids of a vector on the left.
    head_of = heads.select(F.col("_id").alias("_head"), "_vec")
    ids = copies.join(head_of, "_vec").select(F.col("_head").alias("_p"), F.col("_id").alias("vec_id"))
    owners = asked.distinct().join(head_of, "_vec").select(F.col("_head").alias("_q"), F.col("_id").alias("query_id"))
    # An owner can be none of its own answers, so k + 1 ids of a query vector's list are enough for each of its owners.
    enough = Window.partitionBy("_q").orderBy(F.col("_score").desc(), "vec_id")
    listed = found.join(ids, "_p").withColumn("_r", F.row_number().over(enough)).where(F.col("_r") <= k + 1).drop("_r")
    listed = listed.join(owners, "_q").where("query_id != vec_id")
    final = Window.partitionBy("query_id").orderBy(F.col("_score").desc(), "vec_id")
    return listed.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("_score").alias("score"))


def _floors(queries: DataFrame, seed: DataFrame, k: int) -> DataFrame:
    """Adds _floor: the (k+1)-th best product with the seed rows (a bounded broadcast), null if there are fewer."""
    rows = seed.toPandas()
    kept = queries.sparkSession.sparkContext.broadcast({int(d): b"".join(g["_vec"]) for d, g in rows.groupby("_dim")})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            floor = np.full(len(part), np.nan)
            for dim, at in part.groupby("_dim").indices.items():
                data = kept.value.get(int(dim))
                p = np.frombuffer(data, "<i8").reshape(-1, int(dim)) if data and dim else np.zeros((0, int(dim)), np.int64)
                if len(p) > k:
                    for a in range(0, len(at), 512):
                        some = at[a : a + 512]
                        score = products(_matrix(part["_vec"].iloc[some], int(dim)), p)
                        floor[some] = np.partition(score, len(p) - k - 1, axis=1)[:, len(p) - k - 1]
            yield part.assign(_floor=floor)

    return queries.select("_id", "_vec", "_dim", "_norm").mapInPandas(run, "_id long, _vec binary, _dim int, _norm double, _floor double")
