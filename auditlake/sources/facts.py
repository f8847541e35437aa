"""Facts about machines and repositories (S34, S35, F22) out of the texts that their tools print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions.columns import lower, os_supported, porcelain_path
from auditlake.sources.lines import lines_of

#: Paths of changed files that a record names; all of them are counted.
DIRTY_SHOWN = 200


def os_release(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, version_id, pretty_name, supported) of os-release files (keys, text); null text is no file.

    Lines are NAME=value, quotes off, names in any case, the last of a name counts. Without an id the system is
    `unknown`, and whether it is supported is not known.
    """
    pairs = lines_of(files).where(F.contains("value", F.lit("=")))
    name = lower(F.trim(F.substring_index("value", "=", 1)))
    value = F.btrim(F.trim(F.substring("value", F.instr("value", "=") + 1, F.length("value"))), F.lit("\"'"))
    of = lambda n: F.max_by("_value", F.when(F.col("_name") == n, F.col("ln"))).alias(n)
    found = pairs.withColumns({"_name": name, "_value": value}).groupBy(*keys).agg(of("id"), of("version_id"), of("pretty_name"))
    out = files.select(*keys).distinct().join(found, keys, "left")
    known = lower(F.coalesce("id", F.lit("")))
    return out.select(*keys, F.coalesce(F.nullif(known, F.lit("")), F.lit("unknown")).alias("id"), F.coalesce("version_id", F.lit("")).alias("version_id"), "pretty_name", os_supported(known, F.col("version_id")).alias("supported"))


def dirty_files(statuses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path) of the changed files in what `status --porcelain` printed (keys, text): of a rename the new name."""
    lines = lines_of(statuses).where(F.length("value") > 3)
    return lines.select(*keys, porcelain_path(F.col("value")).alias("path"))


def repository_facts(heads: DataFrame, statuses: DataFrame, keys: list[str], most: int = DIRTY_SHOWN) -> DataFrame:
    """(keys, available, commit, short, branch, dirty, dirty_file_count, dirty_files) of repositories.

    heads: keys, commit, branch; a null commit means that there is no repository, of which nothing else is told. dirty_files
    holds the first `most` paths in order, the count is of all; the paths themselves are dirty_files's rows.
    """
    rows = dirty_files(statuses, keys)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("path"))
    shown = rows.withColumn("_place", place).where(F.col("_place") <= most).groupBy(*keys).agg(F.sort_array(F.collect_list("path")).alias("_paths"))
    there = F.col("commit").isNotNull()
    n = F.coalesce("_n", F.lit(0))
    only = lambda c, name: F.when(there, c).alias(name)
    out = heads.join(counts, keys, "left").join(shown, keys, "left")
    return out.select(*keys, there.alias("available"), "commit", F.left("commit", F.lit(12)).alias("short"), only(F.col("branch"), "branch"), only(n > 0, "dirty"), only(n, "dirty_file_count"), only(F.coalesce("_paths", F.array().cast("array<string>")), "dirty_files"))


#: Fixed value: the status of a stage that was left out on purpose.
SKIPPED = "skipped"


def status_argument(text: Column, stages: list[str]) -> tuple[Column, Column, Column]:
    """(stage, status, error) of an argument stage=status: a status is a whole number or `skipped`. What is said of a
    stage that there is not, or is no status, is an error, and then there is neither."""
    stage, status = F.substring_index(text, "=", 1), F.substring(text, F.instr(text, "=") + 1, F.length(text))
    number = F.trim(status).try_cast("bigint")
    error = F.when(~F.contains(text, F.lit("=")), "no status").when(~stage.isin(stages), "unknown stage").when((status != SKIPPED) & number.isNull(), "no number")
    sound = text.isNotNull() & error.isNull()
    return F.when(sound, stage), F.when(sound, F.when(status == SKIPPED, status).otherwise(number.cast("string"))), error
