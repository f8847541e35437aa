"""The corpus pipeline: filter, thin out and pack documents, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm.common import ascii_lower, in_fold, read_table, staged, text_of
from auditlake.llm.jaccard_join import jaccard_groups
from auditlake.llm.line_dedup import line_dedup
from auditlake.llm.packing import pack_documents
from auditlake.llm.suffix_dedup import suffix_dedup
from auditlake.llm.toxicity import tag_toxicity, train


def _with_text(docs: DataFrame, out: DataFrame) -> DataFrame:
    """docs' columns from out; n_chars follows the text where there is such a column."""
    recounted = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
    return recounted.select(*(F.col(f"`{c}`") for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger calls toxic go; the fit is that of the toxicity query."""
    model = train(docs, read_table(spark, sf_dir, "labels"), ~in_fold(F.col("doc_id"), 5, 0))
    return tag_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that documents share stay in the smallest doc_id alone."""
    return _with_text(docs, line_dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each linked group the document with the smallest doc_id stays; rows without id all do. Rows that
    share an id but not their text are one document and stay or go together; of equal ones one stays."""
    groups = jaccard_groups(docs)
    standing = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id IS NOT NULL").join(standing, "doc_id", "left_semi")
    same = Window.partitionBy("doc_id", F.md5(text_of("text"))).orderBy(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")))
    kept = kept.withColumn("_place", F.row_number().over(same)).where("_place = 1")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


#: A passage of 50 words and more: so many bytes of one that starts elsewhere too.
PASSAGE_BYTES = 200


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of PASSAGE_BYTES-byte strings that start elsewhere too go."""
    return _with_text(docs, suffix_dedup(docs, length=PASSAGE_BYTES))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 words and ends, no two documents of one source or one text in any. The group of near
    copies is the text itself here: of every linked group one document is left. A text that lines or passages
    emptied is its end alone."""
    words = F.regexp_count(text_of("text"), F.lit(r"[^\x20\x09-\x0D]+"))
    return pack_documents(docs, words + 1, F.col("source"), F.xxhash64(ascii_lower(text_of("text"))), capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", packing),
]

#: A fitted tagger and a packing order are not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
