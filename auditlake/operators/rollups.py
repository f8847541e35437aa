
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window


def bounded_examples(rows: DataFrame, keys: list[str], order: Column, value: Column, n: int = 3) -> DataFrame:
    """A1: per key the first n values by an order. Rows beyond n go before they are collected: the rank
    filter is applied on both sides of the shuffle, so that a hot key costs n rows a task."""
    w = Window.partitionBy(*keys).orderBy(order)
    top = rows.select(*keys, order.alias("_o"), value.alias("_v"), F.row_number().over(w).alias("_rn")).where(F.col("_rn") <= n)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"]).alias("examples"))


def verdict(findings: DataFrame, keys: list[str], blocks_bringup: Column, blocks_signoff: Column) -> DataFrame:
    """A verdict per key; nothing that blocks is a pass."""
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.count_if(blocks_bringup).alias("bringup_blocker_count"),
        F.count_if(blocks_signoff).alias("signoff_blocker_count"),
        F.coalesce(F.bool_and(~blocks_bringup), F.lit(True)).alias("bringup_ok"),
        F.coalesce(F.bool_and(~(blocks_bringup | blocks_signoff)), F.lit(True)).alias("signoff_ok"),
    )


def flow_rollup(stages: DataFrame) -> DataFrame:
    """One row over stage verdicts; a stage that did not run bars sign-off and leaves bring-up alone."""
    return stages.agg(
        F.sum(F.coalesce("n_findings", F.lit(0))).alias("n_findings"),
        F.count_if(~F.col("ran")).alias("n_not_run"),
        F.coalesce(F.bool_and(F.coalesce("bringup_ok", F.lit(True))), F.lit(True)).alias("bringup_ok"),
        (F.coalesce(F.bool_and(F.coalesce("signoff_ok", F.lit(True))), F.lit(True)) & (F.count_if(~F.col("ran")) == 0)).alias("signoff_ok"),
    )


def owners(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys with more than one owner, and the sorted owners."""
    found = rows.groupBy(key).agg(F.sort_array(F.collect_set(owner)).alias("owners"))
    return found.where(F.size("owners") > 1)


def owner_rows(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """A9 as (key, owner) rows, for keys of any number of owners: each owner once, where a key has more than one."""
    known = rows.select(key, owner).where(F.col(owner).isNotNull())
    many = known.groupBy(key).agg(F.min(owner).alias("_a"), F.max(owner).alias("_b")).where("_a != _b").select(key)
    return known.distinct().join(many, key, "left_semi")


def ordered_digest(rows: DataFrame, keys: list[str], order: list[Column], piece: Column, separator: str = "", name: str = "digest") -> DataFrame:
    """sha256 over the pieces of each group in order, with a separator between them; null pieces are left out,
    a group without any has none. Groups are sorted on disk and run through the hash: none is held in memory,
    but as sha256 has one order, one task reads all of a group."""
    names = [f"_o{i}" for i in range(len(order))]
    sorted_rows = rows.select(*keys, *(c.alias(n) for c, n in zip(order, names, strict=True)), piece.alias("_piece")).repartition(*keys).sortWithinPartitions(*keys, *names).select(*keys, "_piece")
    between, n_keys = separator.encode(), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, kinds = None, None, None
        done: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, pa.string()], strict=True)], [*keys, name])

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(n_keys)]
            for *key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, digest and digest.hexdigest()))
                    now, digest = key, None
                if text is not None:
                    if digest is None:
                        digest = hashlib.sha256()
                    else:
                        digest.update(between)
                    digest.update(text.encode())
            if done:
                yield batch_of()
        if now is not None:
            done.append((*now, digest and digest.hexdigest()))
            yield batch_of()

    return sorted_rows.mapInArrow(run, StructType([*rows.select(*keys).schema.fields, StructField(name, StringType())]))


def group_digest(rows: DataFrame, keys: list[str], path: Column, digest: Column, separator: str = "\0") -> DataFrame:
    """sha256 over the sorted pairs of a group, whatever order they came in; null digests say MISSING."""
    value = F.coalesce(digest, F.lit("MISSING"))
    return ordered_digest(rows, keys, [path, value], F.concat(path, F.lit(separator), value, F.lit(separator)))


def worst(rows: DataFrame, k: int, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """O1: the k first rows overall, or of each key with their place."""
    if not keys:
        return rows.orderBy(*order).limit(k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def trend(runs: DataFrame, keys: list[str], seq: str, metric: str, higher_is_better: bool, epsilon: float = 1e-9) -> DataFrame:
    """Change against the run appended before; null where either is."""
    w = Window.partitionBy(*keys).orderBy(seq)
    change = F.col(metric) - F.col("previous")
    better = change > epsilon if higher_is_better else change < -epsilon
    label = F.when(change.isNull(), None).when(F.abs(change) <= epsilon, "same").when(better, "better").otherwise("worse")
    return runs.withColumn("previous", F.lag(metric).over(w)).withColumns({"delta": change, "direction": label})


def last_runs(runs: DataFrame, keys: list[str], order: list[Column], n: int = 8, at_least: int = 2) -> DataFrame:
    """The last n rows of each key that has at_least rows. Counts come from an aggregate, so that
    the window keeps its limit."""
    enough = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least).drop("_n")
    w = Window.partitionBy(*keys).orderBy(*order)
    return runs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).join(enough, keys, "left_semi")


def islands(rows: DataFrame, keys: list[str], order: str, starts: Column) -> DataFrame:
    """Numbers blocks that begin where starts holds; rows before the first are block 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def carry_forward(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, back: int | None = None) -> DataFrame:
    """The last non-null value up to a row, or in the back rows before it."""
    w = Window.partitionBy(*keys).orderBy(order)
    w = w.rowsBetween(Window.unboundedPreceding, 0) if back is None else w.rowsBetween(-back, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def share(part: Column, whole: Column) -> Column:
    """A guarded ratio; null where the whole is 0 or unknown."""
    return F.try_divide(part, whole)
