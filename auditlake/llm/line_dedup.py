"""Line dedup: drop lines that several documents share, keeping those of one owner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import MAX_LONG, ascii_lower, ascii_strip, hash128, staged, text_of, without


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 10, min_docs: int = 2) -> DataFrame:
    r"""Remove lines held by at least min_docs documents from all but the smallest id that holds them.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased; keys under
    min_length code points never count. Keys meet as 128-bit hashes, aggregated before they are
    shuffled, so that a line found everywhere is one row per task; only the shared keys are joined
    back, to positions without text, and a hot key is split by the adaptive skew join.

    Returns every input column with text replaced by the kept lines, plus n_lines and n_dropped (which
    take the place of columns so named).
    Null or empty text is one empty line, and comes back empty. A null id is no smaller than any
    other: its rows count as one document, which owns a line only where no other has it. Rows that
    repeat an id are one document and each gets the same decision. An empty table gives no rows.
    """
    docs = without(docs, "n_lines", "n_dropped")
    base = docs.withColumn(text_col, text_of(text_col))
    owner_id = F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_LONG))
    # The second part of the row key keeps apart rows that share an id but not their text.
    keyed = base.select(owner_id.alias("_id"), F.xxhash64(text_col).alias("_row"), F.col(text_col).alias("_text"))
    lines = (
        keyed.select("_id", "_row", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
        .select("_id", "_row", "_pos", ascii_lower(ascii_strip(F.col("_line"))).alias("_key"))
        .where(F.length("_key") >= min_length)
        .select("_id", "_row", "_pos", hash128(F.col("_key")).alias("_hash"))
    )
    if min_docs == 2:
        shared = lines.groupBy("_hash").agg(F.min("_id").alias("_owner"), F.max("_id").alias("_last")).where("_owner < _last")
    else:
        holders = lines.groupBy("_hash", "_id").agg(F.lit(1).alias("_one"))
        shared = holders.groupBy("_hash").agg(F.min("_id").alias("_owner"), F.sum("_one").alias("_n")).where(F.col("_n") >= min_docs)
    shared = staged(shared.select("_hash", "_owner"), "line-owners")
    dropped = (
        lines.join(shared, "_hash")
        .where("_id != _owner")
        .groupBy("_id", "_row")
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    # The input's columns go by number, so that none has the name of one of ours.
    own = [F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(base.columns)]
    joined = base.select(*own, owner_id.alias("_id"), F.xxhash64(text_col).alias("_row")).join(dropped, ["_id", "_row"], "left")
    text = F.col(f"own_{base.columns.index(text_col)}")
    joined = joined.withColumn("_lines", F.split(text, "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("_lines"), i)), "\n")
    clean = F.col("_drop").isNull()
    return joined.select(
        *(F.when(clean, text).otherwise(kept).alias(c) if c == text_col else F.col(f"own_{k}").alias(c) for k, c in enumerate(base.columns)),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(clean, F.lit(0)).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
    )
