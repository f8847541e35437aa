"""Records that runs leave behind (S36-S40, K1-K3, K9): JSON lines, waiver files, snapshots as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.sinks.commits import publish, snapshot

_WAIVERS = "waivers array<struct<id: string, match: variant, reason: string, approved_by: string, date: string, evidence_digest: string>>"


def json_rows(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """The fields of JSON lines beside the other columns; a line that is no JSON object of this shape is left out."""
    keep = [c for c in lines.columns if c != value]
    read = lines.withColumn("_r", F.from_json(value, f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    sound = read.where("_r IS NOT NULL AND _r._corrupt_record IS NULL")
    return sound.select(*keep, "_r.*").drop("_corrupt_record")


def last_records(history: DataFrame, keys: list[str], seq: str, stage: str | None = None, limit: int | None = None) -> DataFrame:
    """Records of a stage, the last ones by the order in which they were appended."""
    rows = history if stage is None else history.where(F.col("stage") == stage)
    if limit is None:
        return rows
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))
    return rows.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def waivers_of(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, id, match VARIANT, reason, approved_by, date, evidence_digest) of waiver files (keys, text): an
    object with a list of waivers or the list alone. What cannot be read waives nothing; entries without an id are left
    out. The values of match are of any type."""
    text = F.trim("text")
    whole = F.when(F.startswith(text, F.lit("[")), F.concat(F.lit('{"waivers":'), text, F.lit("}"))).otherwise(text)
    read = json_rows(files.select(*keys, whole.alias("value")), _WAIVERS).select(*keys, F.posexplode("waivers").alias("ord", "w"))
    return read.where("w.id <> ''").select(*keys, "ord", "w.id", F.coalesce("w.match", F.parse_json(F.lit("{}"))).alias("match"), "w.reason", "w.approved_by", "w.date", "w.evidence_digest")


def tool_versions(files: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """(keys, version, parse_error) of version files (keys, text); a file that has a version overrules the one given."""
    read = F.from_json("text", "version string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    found = files.select(*keys, read.alias("r"))
    return found.select(*keys, F.coalesce(F.nullif(F.col("r.version"), F.lit("")), F.lit(version).cast("string")).alias("version"), F.col("r._corrupt_record").isNotNull().alias("parse_error"))


def append_records(records: DataFrame, path: str) -> None:
    """K1-K3: append run records, by stage, to a table that history is read from."""
    records.write.mode("append").partitionBy("stage").parquet(path)


def publish_baseline(spark: SparkSession, current: DataFrame, path: str) -> int:
    """K9: write a snapshot beside the older ones and commit it; its number. Publishers at once get numbers of their own,
    and a build that stops before the commit leaves the last baseline as it was."""
    return publish(spark, current, path)


def last_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """K9: the last snapshot that was committed, if there is one."""
    return snapshot(spark, path)


def discovered(files: DataFrame, explicit: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, path): explicit paths of a run win altogether, else raw/<kind>_<stage>.rpt of its folder.

    files: keys, stage, path; explicit: keys, kind, path.
    """
    name = F.regexp_extract("path", r"/raw/([^/]+)\.rpt$", 1)
    named = files.withColumn("_name", name).where(F.endswith("_name", F.concat(F.lit("_"), F.col("stage"))))
    kind = F.substring("_name", F.lit(1), F.length("_name") - F.length("stage") - 1)
    own = named.select(*keys, kind.alias("kind"), "path").where("kind <> ''")
    return explicit.select(*keys, "kind", "path").unionByName(own.join(explicit.select(*keys).distinct(), keys, "left_anti"))


def located(files: DataFrame, stems: list[str], stage: str) -> DataFrame:
    """(stem, path): <stem>_<stage>.rpt if there is one, else the first name that begins so."""
    name = F.regexp_extract("path", r"([^/]+)\.rpt$", 1)
    named = files.select("path", name.alias("name"), F.explode(F.array(*map(F.lit, stems))).alias("stem")).where(F.startswith("name", F.col("stem")))
    return named.groupBy("stem").agg(F.min_by("path", F.struct(F.col("name") != F.concat("stem", F.lit(f"_{stage}")), "name")).alias("path"))
