"""Tool logs (S24, S25): message lines, their curated classes, counts and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions.columns import lower
from auditlake.operators.rollups import bounded_examples
from auditlake.operators.scratch import written
from auditlake.sources.lines import lines_of

#: A message line, severities by rank, and the curated classes (ids and wordings) in order.
MESSAGE = r"^\s*(INFO|WARNING|CRITICAL WARNING|ERROR)\s*:\s*\[([A-Za-z][\w-]*\s+\d+-\d+)\]\s*(.*)$"
SEVERITIES = ["INFO", "WARNING", "CRITICAL WARNING", "ERROR"]
CLASSES = {
    "CONSTRAINT_NOT_APPLIED": (
        ["Vivado 12-507", "Vivado 12-1008", "Common 17-55", "Common 17-69", "Vivado 12-4739"],
        ["no objects matched", "expects at least one object", "no constraint will be written", "cannot be applied to any object"],
    ),
    "UNBOUND_MODULE": (["Synth 8-448", "Synth 8-3491", "Netlist 29-160"], ["black box", "unable to bind", "cannot find module", "module not found", "unresolved"]),
    "INFERRED_LATCH": (["Synth 8-327"], ["inferring latch"]),
    "UNDRIVEN_NET": (["Synth 8-3848", "Synth 8-3332"], ["does not have driver", "has no driver", "multiple drivers", "multi-driven"]),
    "WIDTH_MISMATCH": (["Synth 8-6014", "Synth 8-693"], ["truncated", "width mismatch", "size mismatch"]),
    "PLACEMENT_QUALITY": (["Place 30-575", "Route 35-459"], ["poor placement", "congestion", "overlapping"]),
}


def risk_class(message_id: Column, body: Column) -> Column:
    """The first curated class whose ids hold the id or whose wordings the body has."""
    text = lower(F.coalesce(body, F.lit("")))
    out = None
    for name, (ids, wordings) in CLASSES.items():
        hit = F.trim(F.coalesce(message_id, F.lit(""))).isin(ids)
        for wording in wordings:
            hit = hit | F.contains(text, F.lit(wording))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def severity_order(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def messages(lines: DataFrame) -> DataFrame:
    """Message lines: the columns of lines, and severity, id (white space collapsed), body, risk_class."""
    part = lambda i: F.regexp_extract("value", MESSAGE, i)
    found = lines.withColumns({"severity": part(1), "id": F.regexp_replace(part(2), r"\s+", " "), "body": F.trim(part(3))}).where("severity <> ''")
    return found.withColumn("risk_class", risk_class(F.col("id"), F.col("body")))


def summarise_messages(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A1, A3: by id: count, worst severity by rank, first non-null class in document order, 3 first bodies."""
    by = [*keys, "id"]
    place = F.struct(*order)
    facts = found.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("severity", severity_order(F.col("severity"))).alias("severity"),
        F.min_by("risk_class", F.when(F.col("risk_class").isNotNull(), place)).alias("risk_class"),
    )
    return facts.join(bounded_examples(found, by, place, F.substring("body", 1, 300)), by)


def severity_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    """A2: a column per severity, zero where there is none."""
    return found.groupBy(*keys).agg(*(F.count_if(F.col("severity") == s).alias(s.lower().replace(" ", "_")) for s in SEVERITIES))


def in_report_order(summary: DataFrame, keys: list[str]) -> DataFrame:
    """O3: place of each message in its log: worst severity first, then count, then id."""
    w = Window.partitionBy(*keys).orderBy(severity_order(F.col("severity")).desc(), F.desc("n"), "id")
    return summary.withColumn("place", F.row_number().over(w))


def by_class(summary: DataFrame, keys: list[str], examples: int = 3) -> DataFrame:
    """A4: messages by curated class: counts, worst severity, ids and first examples in report order.

    There are as many ids as the tool has messages of a class, whatever the length of the logs.
    """
    rows = in_report_order(summary.where("risk_class IS NOT NULL"), keys)
    ordered = F.array_sort(F.collect_list(F.struct("place", "id", "examples")))
    found = rows.groupBy(*keys, "risk_class").agg(F.sum("n").alias("n"), F.max_by("severity", severity_order(F.col("severity"))).alias("severity"), ordered.alias("m"))
    return found.select(*keys, "risk_class", "n", "severity", F.transform("m", lambda x: x["id"]).alias("ids"), F.slice(F.flatten(F.transform("m", lambda x: x["examples"])), 1, examples).alias("examples"))


def unreadable(expected: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Logs that were asked for and could not be read; they are listed, never taken for clean."""
    return expected.join(files.where("text IS NOT NULL").select(*keys), keys, "left_anti").withColumn("reason", F.lit("file not found"))


def merged_logs(expected: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """The logs of a run as one: (keys, kind, id, n, severity, risk_class, examples, place).

    expected: keys, file_ord, path, the logs asked for in their order; files: path, text, those that could be read. A
    message's examples are the first three by log, then line, so a later log tops up what an earlier one left; the
    first class that is not null counts. Rows of kind message stand in report order; those of kind unavailable name a
    log (id: its path) that could not be read, in the order asked for. A log read by several runs is split once for each.
    """
    read = written(expected.select(*keys, "file_ord", "path").join(files.select("path", "text"), "path", "left"), "logs")
    found = messages(lines_of(read.where("text IS NOT NULL").select(*keys, "file_ord", "text")))
    told = in_report_order(summarise_messages(found, keys, ["file_ord", "ln"]), keys)
    gone = read.where("text IS NULL").withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("file_ord", "path")))
    none = {"n": "bigint", "severity": "string", "risk_class": "string", "examples": "array<string>"}
    columns = ["id", *none, "place"]
    return told.select(*keys, F.lit("message").alias("kind"), *columns).unionByName(
        gone.select(*keys, F.lit("unavailable").alias("kind"), F.col("path").alias("id"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()), "place")
    )
