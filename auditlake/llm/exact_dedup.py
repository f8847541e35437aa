"""Exact dedup: group by a 128-bit content hash, then compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import ascii_lower, hash128, staged, text_of


#: Rows of a group that one task compares.
SHARE_ROWS = 10_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Label every row with the id that stands for its text: the smallest or the largest of equal texts.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Groups meet as
    (hash, id) rows aggregated before the shuffle; only groups of two and more are joined back, and
    their bytes are compared with the standing row's. Rows that differ from it (a hash collision) are
    grouped once more by their whole text, so a collision never merges texts.

    Returns id, keep_id, group_size, kept, text_sha256. A null id stands only where a group has no
    other, and is then kept; of rows that repeat the standing id all are marked kept. Empty in, empty out.
    """
    rows = docs.select(F.col(id_col).alias("_id"), ascii_lower(text_of(text_col)).alias("_text")).withColumn("_hash", hash128(F.col("_text")))
    stand = F.min if keep == "smallest" else F.max
    groups = rows.groupBy("_hash").agg(stand("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = staged(groups.select("_hash", "_first", F.ceil(F.col("_n") / SHARE_ROWS).cast("int").alias("_shares")), "copy-groups")
    # A large group is dealt to shares, and what stands for it goes to each of them.
    share = F.pmod(F.monotonically_increasing_id(), F.col("_shares")).cast("int")
    members = staged(rows.join(groups, "_hash").withColumn("_share", share), "copy-members")
    every = F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share")
    standing = members.where(F.col("_id").eqNullSafe(F.col("_first"))).groupBy("_hash", "_shares").agg(F.min("_text").alias("_standing"))
    standing = staged(standing, "copy-standing").select("_hash", every, "_standing")
    # _other is empty for bytes equal to the standing row's, else the text itself: the collision classes.
    compared = members.join(standing, ["_hash", "_share"]).select(
        "_hash", "_share", "_shares", "_id", "_text", F.when(F.col("_text") == F.col("_standing"), F.lit("")).otherwise(F.concat(F.lit("="), F.col("_text"))).alias("_other")
    )
    classes = staged(compared.groupBy("_hash", "_other", "_shares").agg(stand("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "copy-classes")
    classes = classes.select("_hash", "_other", every, "keep_id", "group_size")
    copies = compared.join(classes, ["_hash", "_other", "_share"]).select("_id", "keep_id", "group_size", F.sha2("_text", 256).alias("text_sha256"))
    singles = (
        rows.select("_id", "_hash", F.sha2("_text", 256).alias("text_sha256"))
        .join(groups, "_hash", "left_anti")
        .select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    )
    return copies.unionByName(singles).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
