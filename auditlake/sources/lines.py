"""Report text as rows (S1, D1): whole files, split by an explicit pattern so that line numbers are meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.columns import let
from auditlake.operators.scratch import written

#: Fixed value: every break that ends a line in the reports' writers, CR LF as one.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: Texts of these alone, as most are, hold no other break than LF.
_PLAIN = r"\A[\t\n\x20-\x7e]*+\z"
_OTHER_BREAK = "[\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of each file; bad UTF-8 becomes U+FFFD."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def plain_text(text: Column) -> Column:
    """A text whose lines all end in LF; one that has no other break, as most, is only looked through."""
    return F.when(~text.rlike(_PLAIN) & text.rlike(_OTHER_BREAK), F.regexp_replace(text, LINE_BREAK, "\n")).otherwise(text)


def lines_of(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per line with ln from 1, all other columns kept; a final break opens no line.

    Lines stay where their file is: files dealt by a key give lines dealt by it.
    """
    keep = [c for c in files.columns if c != text]
    whole = files.select(*keep, plain_text(F.col(text)).alias("_text"))
    # The last line is left out of the list, as to cut a text by characters is to count them all.
    final = F.endswith("_text", F.lit("\n")).cast("int")
    found = let(F.split("_text", "\n", -1), lambda every: F.slice(every, 1, F.size(every) - final))
    rows = whole.select(*keep, F.posexplode(F.when(F.col("_text") != "", found)).alias("pos", "value"))
    return rows.select(*keep, (F.col("pos") + 1).alias("ln"), "value")


def staged_lines(files: DataFrame, keys: list[str]) -> DataFrame:
    """lines_of files, dealt by keys, in order, and written once, for several parsers to read."""
    return written(lines_of(files).repartition(*keys).sortWithinPartitions(*keys, "ln"), "lines")


def is_blank(text: Column) -> Column:
    return F.trim(text) == ""


def _reason(there: Column, blank: Column, n: Column) -> Column:
    return F.when(~there, "file not found").when(blank, "file is empty").when(F.coalesce(n, F.lit(0)) == 0, "unrecognised format")


def status_reason(text: Column, n: Column) -> Column:
    """Why a report (null: none) was not checked, null where its parser made n rows of it."""
    return _reason(text.isNotNull(), is_blank(text), n)


def report_status(expected: DataFrame, files: DataFrame, rows_found: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected report has a status row; missing, blank and unrecognised ones say why.

    expected: keys; files: keys, path, text; rows_found: keys, n (rows that the parser made). Unchecked
    is never clean: available is false unless rows were made.
    """
    # Of a text it is asked here only whether there is any.
    blank = is_blank(F.coalesce("text", F.lit("")))
    joined = expected.join(files.select(*keys, "path", blank.alias("blank")), keys, "left").join(rows_found.select(*keys, "n"), keys, "left")
    reason = _reason(F.col("path").isNotNull(), F.col("blank"), F.col("n"))
    return joined.select(*keys, reason.isNull().alias("available"), reason.alias("reason"), F.col("path").alias("source"))
