"""Parsers, rules and functions on small texts of our own with the layouts of FIXTURES.md."""

from pyspark.sql import functions as F

from auditlake.functions.columns import banner, file_stamp, glob_regex, porcelain_path, shorten, stem, strip_comment
from auditlake.operators.joins import set_changes
from auditlake.plans.rules import coverage_rules, drc_rules, findings_of, log_rules, worst_first
from auditlake.sources import logs, tables
from auditlake.sources.lines import lines_of, report_status


def lines(spark, text, run="r"):
    return lines_of(spark.createDataFrame([(run, text)], "run string, text string"))


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_lines_keep_every_break_but_the_last(spark):  # S1, T: splitlines
    got = lines(spark, "a\r\nb\x0bc\n\nd\n").orderBy("ln").collect()
    assert [(r.ln, r.value) for r in got] == [(1, "a"), (2, "b"), (3, "c"), (4, ""), (5, "d")]


def test_log_summary_and_rules(spark):  # S24, A1, J9, J10, A7 inputs
    text = "\n".join([
        "INFO: [Common 17-1] start", "WARNING: [Vivado 12-507] No objects matched x", "noise", "CRITICAL WARNING: [Synth  8-3848] net a does not have driver",
        "WARNING: [Synth 8-3848] net b does not have driver", "WARNING: [Synth 8-6014] unused element removed",
    ])
    found = logs.messages(lines(spark, text))
    got = {r.id: (r.n, r.severity, r.risk_class, list(r.examples)) for r in logs.summarise_messages(found, ["run"], ["ln"]).collect()}
    assert got["Synth 8-3848"] == (2, "CRITICAL WARNING", "UNDRIVEN_NET", ["net a does not have driver", "net b does not have driver"])
    assert got["Vivado 12-507"][2] == "CONSTRAINT_NOT_APPLIED" and got["Synth 8-6014"][2] == "WIDTH_MISMATCH"
    facts = found.where("risk_class IS NOT NULL").groupBy("run", "risk_class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "ERROR").alias("n_error"))
    graded = worst_first(findings_of(facts, ["run"], log_rules(), "log")).select("id", "severity").collect()
    assert [tuple(r) for r in graded] == [("LOG.CONSTRAINT_NOT_APPLIED", "BLOCKER"), ("LOG.UNDRIVEN_NET", "CRITICAL"), ("LOG.WIDTH_MISMATCH", "WARNING")]


def test_pipe_tables_pad_rows_and_find_titles(spark):  # S2, S4
    text = "1. Slice\n--------\n\n+---+-----+\n| Site Type | Used |\n+---+-----+\n| LUT | 7 |\n| FF |\n+---+\n\n+--+\n| only header |\n+--+\n"
    got = tables.pipe_cells(lines(spark, text), ["run"]).orderBy("row_no", "col_no").collect()
    assert [(r.row_no, r.col_key, r.value) for r in got] == [(1, "site_type", "LUT"), (1, "used", "7"), (2, "site_type", "FF"), (2, "used", "")]
    assert {r.title for r in got} == {"1. Slice"} and {r.line_start for r in got} == {4}


def test_violation_blocks_and_grades(spark):  # S7, S17, DRC.*
    text = "NSTD-1#1 Critical Warning\nUnspecified standard\nport a\nport b\nRelated violations: <none>\n\nRTSTAT-6#2 Warning\nPartial\n"
    found = tables.violations(lines(spark, text), ["run"])
    assert [(r.rule, r.instance, r.severity, r.title, r.detail) for r in found.orderBy("pos").collect()] == [("NSTD-1", 1, "Critical Warning", "Unspecified standard", "port a port b"), ("RTSTAT-6", 2, "Warning", "Partial", "")]
    graded = findings_of(found.groupBy("run", "rule", "severity").agg(F.count(F.lit(1)).alias("n")), ["run"], drc_rules(), "drc")
    assert {(r.id, r.severity) for r in graded.collect()} == {("DRC.BITSTREAM_BLOCKING", "BLOCKER"), ("DRC.WARNING", "WARNING")}


def test_timing_paths_and_checks(spark):  # S8, S10, S12
    text = "| Design : top\n1. checking no_clock (3)\n1. checking no_clock (2)\nMax Delay Paths\n----\nSlack (VIOLATED) :        -0.234ns  (required time - arrival time)\n  Source:                 a/C\n  Destination:            b/D\n  Requirement:            5.000ns  (clk rise)\n  Logic Levels:           4  (LUT6=4)\n\nMin Delay Paths\nSlack (MET) :             0.021ns  (x)\n  Destination:            c/D\n"
    rows = lines(spark, text)
    got = tables.timing_paths(rows, ["run"]).orderBy("pos").collect()
    assert [(r.status, r.slack_ns, r.delay_kind, r.destination) for r in got] == [("VIOLATED", -0.234, "max", "b/D"), ("MET", 0.021, "min", "c/D")]
    assert (got[0].source, got[0].requirement_ns, got[0].logic_levels, got[0].line_start) == ("a/C", 5.0, 4, 6)
    assert tables.check_items(rows, ["run"]).first().n == 3
    assert tables.banner_fields(rows, ["run"]).first().value == "top"


def test_unchecked_is_never_clean(spark):  # S1, S23, META.*
    expected = spark.createDataFrame([("drc",), ("cdc",), ("qor_assessment",), ("utilization",)], "kind string")
    files = spark.createDataFrame([("cdc", "/c", "  "), ("qor_assessment", "/q", "text"), ("utilization", "/u", "x")], "kind string, path string, text string")
    made = spark.createDataFrame([("utilization", 3)], "kind string, n int")
    status = report_status(expected, files, made, ["kind"])
    assert {r.kind: r.reason for r in status.collect()} == {"drc": "file not found", "cdc": "file is empty", "qor_assessment": "unrecognised format", "utilization": None}
    gaps = findings_of(status.withColumn("checked", F.col("available")), ["kind"], coverage_rules(), "coverage")
    assert {(r.kind, r.severity) for r in gaps.collect()} == {("drc", "CRITICAL"), ("cdc", "CRITICAL"), ("qor_assessment", "INFO")}


def test_column_functions(spark):  # F10, F11, F13, F17, F19, F20, P4, J19
    row = spark.range(1).select(
        strip_comment(F.lit("a.v // b")).alias("c"), stem(F.lit("/x/y.tar.xci")).alias("s"), F.length(shorten(F.lit("n" * 80))).alias("n"), porcelain_path(F.lit('R  a -> "b c"')).alias("p"), file_stamp(F.lit("2024-01-02T03:04:05")).alias("t"),
        F.lit("/p/q/tb_x.v").rlike(glob_regex("*/tb_?.v")).alias("g"), F.lit("/p/a.v").rlike(glob_regex("*[!a].v")).alias("h"), banner(F.lit(0), F.lit(True), F.lit(False), F.lit(0), F.lit(0)).alias("b"),
    ).first()
    assert tuple(row) == ("a.v ", "y.tar", 58, "b c", "20240102030405", True, False, "WARN")
    change = set_changes(spark.sql("SELECT array('b', 'a') AS now, CAST(NULL AS ARRAY<STRING>) AS was"), "now", "was").first()
    assert change.added == [] and change.gone == []


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert values is not None
