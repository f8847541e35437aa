"""Parsers of single reports over their lines (S9, S11, S13, S16-S22). A report that none of them
recognises gives no rows, and report_status then says so: unchecked is never clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions.columns import let, lower, mask_tokens, normalise_column, to_float, to_float_timing, to_int
from auditlake.operators.joins import first_wins
from auditlake.operators.rollups import islands
from auditlake.sources.tables import cell, column_spans, first_table, pipe_rows, table_rows

#: Resource names of the device families, and words of IP states.
RESOURCES = {
    "slice luts": "lut", "clb luts": "lut",
    "slice registers": "register", "clb registers": "register", "register as flip flop": "register",
    "slice": "slice", "clb": "slice",
    "block ram tile": "bram", "dsps": "dsp", "bonded iob": "iob", "bufgctrl": "bufg", "global clock buffers": "bufg",
}
IP_UPGRADE = ["upgrade", "out-of-date", "out of date", "re-customize", "older version", "obsolete"]
IP_MISSING = ["output products", "not generated", "missing", "no output", "definition not found", "not found"]
IP_LOCKED = ["locked"]
CLASSIFICATIONS = ["clock_pair_classification", "clock_pair_class", "path_group_classification", "classification"]


def _any_of(text: Column, words: list[str]) -> Column:
    return F.greatest(F.lit(False), *(F.contains(text, F.lit(w)) for w in words))


def utilization(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, key, name, used, available, util_percent); the first sound row of a resource wins."""
    rows = pipe_rows(lines, keys)
    name = F.trim(cell("site_type"))
    synonym = let(lower(name), lambda low: F.coalesce(*(F.when(low == n, k) for n, k in RESOURCES.items())))
    found = rows.select(*keys, "line_start", "row_no", synonym.alias("key"), name.alias("name"), to_int(cell("used")).alias("used"), to_int(cell("available")).alias("available"), to_float(cell("util")).alias("util"))
    percent = F.coalesce("util", F.try_divide(F.lit(100.0) * F.col("used"), F.col("available")))
    sound = found.withColumn("util_percent", percent).where("key IS NOT NULL AND used IS NOT NULL AND util_percent IS NOT NULL")
    return first_wins(sound, [*keys, "key"], [F.col("line_start"), F.col("row_no")]).select(*keys, "key", "name", "used", "available", "util_percent")


def rule_report(lines: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, declared, n, recognised): no blocks are a clean report only where it declares none."""
    pattern = r"^\s*Violations found:\s*(\d+)"
    declared = lines.groupBy(*keys).agg(F.min_by(F.regexp_extract("value", pattern, 1), F.when(F.col("value").rlike(pattern), F.col("ln"))).try_cast("bigint").alias("declared"))
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = declared.join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return out.withColumn("recognised", (F.col("n") > 0) | F.coalesce(F.col("declared") == 0, F.lit(False)))


def cdc(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row per crossing of the detail table."""
    rows = first_table(table_rows(lines, keys), keys, ["severity", "id", "description"], ["severity", "id"])
    text = lambda name: F.trim(F.coalesce(cell(name), F.lit(""))).alias(name)
    out = rows.select(*keys, F.col("row_no").alias("pos"), *map(text, ("severity", "id", "description", "source_clock", "destination_clock")), to_int(cell("endpoints")).alias("endpoints"))
    return out.where("severity <> '' AND id <> ''")


def cdc_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Crossings by severity, from the summary table if it has any, else counted."""
    told = first_table(table_rows(lines, keys), keys, ["severity", "count"]).select(*keys, F.trim(cell("severity")).alias("severity"), to_int(cell("count")).alias("n"), "row_no")
    told = told.where("severity <> '' AND n IS NOT NULL").groupBy(*keys, "severity").agg(F.max_by("n", "row_no").alias("n"))
    counted = cdc(lines, keys).groupBy(*keys, "severity").agg(F.count(F.lit(1)).alias("n"))
    return told.unionByName(counted.join(told.select(*keys).distinct(), keys, "left_anti"))


def clock_pairs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row per pair of clocks; the class column has had several names."""
    rows = first_table(table_rows(lines, keys), keys, ["source_clock", "destination_clock"])
    text = lambda name: F.trim(F.coalesce(cell(name), F.lit(""))).alias(name)
    kind = F.trim(F.coalesce(*map(cell, CLASSIFICATIONS), F.lit(""))).alias("classification")
    return rows.select(*keys, F.col("row_no").alias("pos"), *map(text, ("source_clock", "destination_clock")), kind, *map(text, ("common_primary_clock", "inter_clock_constraints"))).where("source_clock <> '' AND destination_clock <> ''")


def _number_beside(lines: DataFrame, rows: DataFrame, keys: list[str], pattern: str, label: str, name: str) -> DataFrame:
    """The number in the first line that fits a pattern, else in the cell after the first labelled one."""
    in_text = lines.where(F.col("value").rlike(pattern)).select(*keys, F.struct(F.lit(0).alias("k"), "ln", F.lit(0).alias("r")).alias("at"), F.regexp_extract("value", pattern, 1).try_cast("bigint").alias(name))
    place = F.array_position(F.transform("cells", lambda c: F.contains(lower(c), F.lit(label))), True).cast("int")
    in_cell = rows.withColumn("place", place).where((F.col("place") > 0) & (F.col("place") < F.size("cells")))
    in_cell = in_cell.select(*keys, F.struct(F.lit(1).alias("k"), F.col("line_start").alias("ln"), F.col("row_no").alias("r")).alias("at"), to_int(F.get("cells", F.col("place"))).alias(name))
    return in_text.unionByName(in_cell).where(f"{name} IS NOT NULL").groupBy(*keys).agg(F.min_by(name, "at").alias(name))


def control_sets(lines: DataFrame, keys: list[str]) -> DataFrame:
    """S20."""
    return _number_beside(lines, pipe_rows(lines, keys), keys, r"(?i)unique control sets\D*(\d+)", "unique control set", "unique_control_sets")


def qor(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The score, out of 5."""
    found = _number_beside(lines, table_rows(lines, keys), keys, r"(?i)QoR\s+Assessment\s+Score\s*[:|]?\s*(\d+)", "assessment score", "score")
    return found.withColumn("max_score", F.lit(5))


def ip_state(status: Column, recommendation: Column) -> tuple[Column, Column, Column]:
    """(missing, upgrade, locked): missing products come before an upgrade, a lock stands by itself."""
    text = lower(F.concat(status, F.lit(" "), recommendation))
    missing = _any_of(text, IP_MISSING)
    return missing, ~missing & _any_of(text, IP_UPGRADE), _any_of(text, IP_LOCKED)


def ip_status(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row per IP."""
    rows = first_table(table_rows(lines, keys), keys, ["ip_name", "status"], ["ip", "status"], ["name", "status"])
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    name = F.coalesce(cell("ip_name"), cell("ip"), cell("name"))
    out = rows.select(*keys, text(name).alias("name"), text(cell("status")).alias("status"), text(cell("recommendation")).alias("recommendation")).where("name <> ''")
    missing, upgrade, locked = ip_state(F.col("status"), F.col("recommendation"))
    return out.withColumns({"missing": missing, "upgrade": upgrade, "locked": locked})


def without_ip(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Files that say there is no IP: a checked and clean report."""
    return lines.where(F.col("value").rlike("(?i)has no IP|No IP found|0 IP")).select(*keys).distinct()


def design_summary(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, number) of the first WNS(ns) row. Names are cut by the ruler and values by white
    space; where their numbers differ, values are cut by the ruler too."""
    w = Window.partitionBy(*keys).orderBy("ln")
    rows = lines.withColumns({"ruler": F.lead("value").over(w), "numbers": F.lead("value", 2).over(w)})
    rows = rows.where(F.col("value").rlike(r"^\s*WNS\(ns\)") & F.col("ruler").rlike(r"^\s*-{2,}(?:\s+-{2,})+\s*$") & F.col("numbers").isNotNull())
    rows = first_wins(rows, keys, [F.col("ln")]).withColumn("spans", column_spans(F.col("ruler")))
    cut = lambda c: F.transform("spans", lambda s: F.trim(F.substring(c, s["start"], s["width"])))
    words = F.split(F.trim("numbers"), r"\s+")
    values = F.when(F.size(words) == F.size("spans"), words).otherwise(cut(F.col("numbers")))
    pairs = rows.select(*keys, F.explode(F.arrays_zip(F.transform(cut(F.col("value")), normalise_column).alias("name"), values.alias("value"))).alias("p"))
    return pairs.select(*keys, F.col("p.name").alias("name"), to_float_timing(F.col("p.value")).alias("number"))


def clocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the first Clock Summary section."""
    number = r"([-+]?\d+(?:\.\d+)?)"
    pattern = rf"^\s*(\S+)\s+\{{([^}}]*)\}}\s+{number}\s+{number}\s*$"
    banner = F.startswith("value", F.lit("|")) & F.col("value").rlike(r"^\|\s*[^-\s]")
    # Only heads of sections and lines like a clock's are dealt and sorted.
    of_use = lines.where(banner | (F.contains("value", F.lit("{")) & F.col("value").rlike(pattern)))
    rows = islands(of_use, keys, "ln", banner)
    titled = rows.withColumn("title", F.min_by(lower("value"), "ln").over(Window.partitionBy(*keys, "block")))
    part = lambda i: F.regexp_extract("value", pattern, i)
    inside = titled.where(F.col("title").rlike(r"^\|\s*clock summary"))
    inside = inside.withColumn("first", F.min("block").over(Window.partitionBy(*keys))).where("block = first")
    return inside.where(F.col("value").rlike(pattern)).select(*keys, "ln", part(1).alias("name"), F.trim(part(2)).alias("waveform"), part(3).try_cast("double").alias("period_ns"), part(4).try_cast("double").alias("frequency_mhz"))


def constraints_met(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The first verdict line, null where there is none."""
    text = F.trim("value")
    met = F.when(text.startswith("All user specified timing constraints are met"), True).when(text.startswith("Timing constraints are not met"), False)
    return lines.groupBy(*keys).agg(F.min_by(met, F.when(met.isNotNull(), F.col("ln"))).alias("constraints_met"))


def expected_reports(runs: DataFrame, kinds: list[str]) -> DataFrame:
    """Every kind of report for every run; the kinds are a fixed list, so this is no growing product."""
    return runs.select("*", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))


#: Lines that describe a report's layout: borders, rows, rulers, numbered titles, counts, heads and column names.
LAYOUT = [
    r"^\s*\+[-+]+\+\s*$", r"^\s*\|.*\|\s*$", r"^\s*-{2,}(\s+-{2,})+\s*$", r"^\s*\d+(\.\d+)*\.\s+\S",
    r"^\s*Violations found:", r"^[A-Z][A-Z0-9_]*-\d+#\d+\s+", r"^\s*(Severity|Rule|Site Type|Source Clock|Clock)\b",
]


def fingerprint(lines: DataFrame, keys: list[str], most: int = 40, width: int = 160) -> DataFrame:
    """(keys, place, shape): the first layout lines of a file, names masked, for a report that no parser knows."""
    shape = F.left(mask_tokens(F.rtrim("value")), F.lit(width))
    kept = lines.where(F.greatest(*(F.col("value").rlike(p) for p in LAYOUT))).select(*keys, "ln", shape.alias("shape"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ln"))
    return kept.withColumn("place", place).where(F.col("place") <= most).select(*keys, "place", "shape")
