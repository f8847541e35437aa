"""Reports as rows of lines (K4-K8, F14, F15): (name, section, place, line), to be written by report_files.

Every function makes lines by explodes and windows over the rows that a report tells of; no report is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions.columns import fixed_digits, let, severity_rank, text_of_kind, variant_text

#: What stands between the values of a list, after its first five, and between two pairs of evidence.
LIST_SEPARATOR, LIST_CUT, PAIR_SEPARATOR, LIST_SHOWN = "、", " …", "　", 5
SEVERITIES = ["BLOCKER", "CRITICAL", "WARNING", "INFO"]


def number_format(value: Column, digits: int = 3, suffix: str = "") -> Column:
    """a double with so many digits after the point, a dash for none."""
    return F.coalesce(F.concat(fixed_digits(value.cast("double"), digits), F.lit(suffix)), F.lit("-"))


def delta_format(change: Column, direction: Column, digits: int = 3) -> Column:
    """a change with its sign and direction; no change is said in words, an unknown one is a dash."""
    text = fixed_digits(change.cast("double"), digits)
    told = F.concat(F.when(F.startswith(text, F.lit("-")), "").otherwise("+"), text, F.lit(" ("), F.coalesce(direction, F.lit("-")), F.lit(")"))
    return F.when(change.isNull(), "-").when(direction == "same", "no change").otherwise(told)


def evidence_format(evidence: Column) -> Column:
    """an object (VARIANT) as key=value pairs by key; null, empty texts and empty lists are left out, lists show five
    values, doubles three digits."""
    pairs = F.map_entries(F.coalesce(evidence.try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>")))
    pairs = F.transform(pairs, lambda e: F.struct(e["key"].alias("key"), _shown(e["value"]).alias("value")))
    kept = F.filter(pairs, lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.array_join(F.transform(F.array_sort(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), PAIR_SEPARATOR)


def _shown(value: Column) -> Column:
    def listed(many: Column) -> Column:
        told = F.concat(F.array_join(F.transform(F.slice(many, 1, LIST_SHOWN), variant_text), LIST_SEPARATOR, "None"), F.when(F.size(many) > LIST_SHOWN, LIST_CUT).otherwise(""))
        return F.when(F.size(many) > 0, told)

    # Kind and list are bound, as a lambda tells what it is given again for each use.
    def told(kind: Column) -> Column:
        # A decimal without digits after the point may be a whole number too long for 64 bits, which keeps its digits.
        double = kind.rlike("^(DOUBLE|FLOAT|DECIMAL)") & ~kind.rlike(r"^DECIMAL\((19|[23]\d),0\)")
        many = let(value.try_cast("array<variant>"), listed)
        return F.when(kind == "VOID", None).when(F.startswith(kind, F.lit("ARRAY")), many).when(double, let(value.try_cast("double"), lambda x: fixed_digits(x, 3))).otherwise(text_of_kind(value, kind))

    return let(F.schema_of_variant(value), told)


def yes_no(flag: Column) -> Column:
    return F.when(flag, "yes").when(~flag, "no").otherwise("unknown")


def _lines(rows: DataFrame, name: Column, section: Column | int, place: Sequence[Column], lines: Sequence[Column | str]) -> DataFrame:
    """Lines of each row, one after the other, as one line with breaks, null ones left out; place orders the rows of a section."""
    told = [F.lit(x) if isinstance(x, str) else x for x in lines]
    line = told[0] if len(told) == 1 else F.when(F.coalesce(*told).isNotNull(), F.concat_ws("\n", *told))
    at = F.struct(*(p.cast("long").alias(f"p{i}") for i, p in enumerate(place)))
    return rows.select(name.alias("name"), (F.lit(section) if isinstance(section, int) else section).cast("int").alias("section"), at.alias("place"), line.alias("line"))


def _flat(parts: list[DataFrame]) -> DataFrame:
    """Parts with places of any depth, as one: a place is an array."""
    out = None
    for part in parts:
        one = part.select("name", "section", F.array(*(F.col(f"place.{f.name}") for f in part.schema["place"].dataType.fields)).alias("place"), "line")
        out = one if out is None else out.unionByName(one)
    return out


def verdict_block(verdicts: DataFrame, name: Column) -> DataFrame:
    """The two answers of a run. verdicts: bringup_ok, signoff_ok, bringup_blocker_count, signoff_blocker_count."""
    row = lambda label, ok, n: F.concat(F.lit(f"| {label} | "), yes_no(F.col(ok)), F.lit(" | "), F.coalesce(F.col(n).cast("string"), F.lit("-")), F.lit(" |"))
    return _lines(verdicts, name, 1, [F.lit(0)], ["| Question | Answer | Blocked by |", "|---|---|---|", row("Bring-up", "bringup_ok", "bringup_blocker_count"), row("Sign-off", "signoff_ok", "signoff_blocker_count"), ""])


def risk_report(verdicts: DataFrame, findings: DataFrame, uncovered: DataFrame, keys: list[str], title: Column, name: Column) -> DataFrame:
    """K5: a run's verdict, what was not covered, and all findings by severity with their evidence.

    findings: keys, id, severity, blocks_bringup, blocks_signoff, evidence (JSON text), source, digest, place, waived;
    uncovered: keys, kind, reason. title and name are of keys. A run in verdicts without findings has its head alone.
    """
    parts = [_lines(verdicts, name, 0, [F.lit(0)], [F.concat(F.lit("# Risk report: "), title), ""]), verdict_block(verdicts, name)]
    parts.append(_lines(uncovered.select(*keys).distinct(), name, 2, [F.lit(0), F.lit(0)], ["Not covered, as the analysis did not run:", ""]))
    by_kind = F.row_number().over(Window.partitionBy(*keys).orderBy("kind"))
    parts.append(_lines(uncovered.withColumn("_n", by_kind), name, 2, [F.lit(1), F.col("_n")], [F.concat(F.lit("- "), F.col("kind"), F.lit(" ("), F.coalesce("reason", F.lit("unknown")), F.lit(")"))]))
    parts.append(_lines(uncovered.select(*keys).distinct(), name, 2, [F.lit(2), F.lit(0)], [""]))
    rank = severity_rank(F.col("severity"))
    ranked = findings.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "severity").orderBy("place")))
    parts.append(_lines(ranked.where("_n = 1"), name, 3, [rank, F.lit(0)], [F.concat(F.lit("## "), F.col("severity")), ""]))
    told = [
        F.concat(F.lit("### "), F.col("_n").cast("string"), F.lit(". "), F.col("id"), F.when(F.col("waived"), " (waived)").otherwise("")), F.lit(""),
        F.concat(F.lit("- source: "), F.col("source"), F.lit(", digest: `"), F.col("digest"), F.lit("`")),
        F.concat(F.lit("- blocks bring-up: "), yes_no(F.col("blocks_bringup")), F.lit(", sign-off: "), yes_no(F.col("blocks_signoff"))),
        F.concat(F.lit("- evidence: "), F.nullif(evidence_format(F.parse_json("evidence")), F.lit(""))), F.lit(""),
    ]
    parts.append(_lines(ranked, name, 3, [rank, F.col("_n")], told))
    return _flat(parts)


def signoff_report(verdicts: DataFrame, checklist: DataFrame, findings: DataFrame, events: DataFrame, keys: list[str], title: Column, name: Column) -> DataFrame:
    """K7: verdict, checklist with what it leaves open, open findings that block, waived ones, waivers that lapsed.

    checklist: keys, row_no, label, status (plans.evaluate.checklist); findings as for risk_report with waiver (struct),
    place a whole number by which findings stand as they are, in no further window;
    events: joins.waiver_events.
    """
    parts = [_lines(verdicts, name, 0, [F.lit(0)], [F.concat(F.lit("# Sign-off: "), title), ""]), verdict_block(verdicts, name)]
    runs = verdicts.select(*keys)
    parts.append(_lines(runs, name, 2, [F.lit(-1)], ["## Checklist", "", "| Item | Status |", "|---|---|"]))
    parts.append(_lines(checklist, name, 2, [F.col("row_no")], [F.concat(F.lit("| "), F.col("label"), F.lit(" | "), F.col("status"), F.lit(" |"))]))
    gaps = checklist.where("status = 'NOT CHECKED'")
    listed = gaps.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "label"))), lambda x: x["label"]), ", ").alias("gaps"))
    parts.append(_lines(runs.join(listed, keys, "left"), name, 2, [F.lit(1 << 20)], ["", F.concat(F.lit("Not checked: "), F.coalesce("gaps", F.lit("none"))), ""]))
    opened = findings.where("severity IN ('BLOCKER', 'CRITICAL') AND NOT waived")
    parts.append(_lines(runs, name, 3, [F.lit(0)], ["## Open findings", ""]))
    parts.append(_lines(opened, name, 3, [F.col("place")], [F.concat(F.lit("- "), F.col("severity"), F.lit(" `"), F.col("id"), F.lit("` "), evidence_format(F.parse_json("evidence")), F.lit(" (digest "), F.col("digest"), F.lit(")"))]))
    none = runs.join(opened.select(*keys).distinct(), keys, "left_anti")
    parts.append(_lines(none, name, 3, [F.lit(1)], ["No finding blocks."]))
    held = findings.where("waived")
    parts.append(_lines(runs, name, 4, [F.lit(0)], ["", "## Waived", ""]))
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    parts.append(_lines(held, name, 4, [F.col("place")], [F.concat(F.lit("- `"), F.col("id"), F.lit("` ("), F.col("severity"), F.lit("): "), dash("waiver.reason"), F.lit(", "), dash("waiver.approved_by"), F.lit(", "), dash("waiver.date"))]))
    lapsed = events.where("event = 'expired'").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("id", "ord", "current_digest")))
    told = F.concat(F.lit("- `"), F.col("id"), F.lit("`: "), dash("reason"), F.lit(" ("), F.col("recorded_digest"), F.lit(" -> "), F.col("current_digest"), F.lit(")"))
    # The head stands before the first; a null line is left out when the report is written.
    first = lambda line: F.when(F.col("_n") == 1, line)
    parts.append(_lines(lapsed, name, 5, [F.col("_n")], [first(""), first("## Waivers that no longer hold"), first(""), told]))
    return _flat(parts)


def failed_checks(checklist: DataFrame, keys: list[str]) -> DataFrame:
    """K7: the exit rule of each run: 1 where an item of the checklist fails, else 0; and how many fail or were not checked."""
    n = lambda s: F.count_if(F.col("status") == s)
    return checklist.groupBy(*keys).agg(n("FAIL").alias("failed"), n("NOT CHECKED").alias("not_checked")).withColumn("status", F.when(F.col("failed") > 0, 1).otherwise(0))


def flow_report(stages: DataFrame, verdicts: DataFrame, findings: DataFrame, keys: list[str], title: Column, name: Column, most: int = 10) -> DataFrame:
    """K6: all stages of a flow in a table, the flow's verdict, and its worst findings, each for the earliest stage.

    stages: keys, stage_no, stage, and the counts and verdict of evaluate.summarise, null where a stage did not run;
    findings: keys, stage, id, severity, place, in the order that counts.
    """
    mark = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    parts = [_lines(verdicts, name, 0, [F.lit(0)], [F.concat(F.lit("# Flow: "), title), ""]), verdict_block(verdicts, name)]
    parts.append(_lines(verdicts.select(*keys), name, 2, [F.lit(-1)], ["| Stage | Blockers | Criticals | Warnings | Bring-up | Sign-off |", "|---|---|---|---|---|---|"]))
    parts.append(_lines(stages, name, 2, [F.col("stage_no")], [F.concat_ws(" | ", F.concat(F.lit("| "), F.col("stage")), mark("blocker"), mark("critical"), mark("warning"), yes_no(F.col("bringup_ok")), F.concat(yes_no(F.col("signoff_ok")), F.lit(" |")))]))
    worst = findings.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(severity_rank(F.col("severity")), "place"))).where(F.col("_n") <= most)
    parts.append(_lines(worst, name, 3, [F.col("_n")], [F.concat(F.lit("- "), F.col("severity"), F.lit(" `"), F.col("id"), F.lit("` in "), F.col("stage"))]))
    return _flat(parts)


def gate_report(gates: DataFrame, reasons: DataFrame, keys: list[str], title: Column, name: Column) -> DataFrame:
    """K8: whether the next stage may run, and every reason against it. gates and reasons: evaluate.gate, gate_reasons."""
    head = _lines(gates, name, 0, [F.lit(0)], [F.concat(F.lit("# Gate: "), title), "", F.concat(F.lit("Allowed: "), yes_no(F.col("allowed"))), ""])
    why = reasons.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("reason")))
    return _flat([head, _lines(why, name, 1, [F.col("_n")], [F.concat(F.lit("- "), F.col("reason"))])])
