"""Parsers of whole texts tell the same as those over lines, and deal, sort and write no line."""

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions.columns import severity_rank
from auditlake.plans import evaluate as E
from auditlake.plans import rules as P
from auditlake.sources import reports, tables, texts
from auditlake.sources.lines import lines_of, status_reason

PATH = """Slack (VIOLATED) :        -0.250ns  (required time)
  Source:                 a/C
                            (rising edge clocked by clk_a  {rise@0.000ns})
                            (clocked by late)
  Destination:            b/D
  Path Group:
  Destination  :          c/D
                            (clocked by clk_b)
  Requirement:            +4.000ns  (x)
  Data Path Delay:        1.5ns  (logic 0.5ns (33.3%)  route 1.0ns (66.7%))
  Logic Levels:           3  (CARRY4=1 LUT6=2)
  Clock Path Skew:        -0.020ns (x)
    Location             Delay type: none
                            (clocked by none)
"""
HEAD = """| Tool Version : 1
| Design : first |
| Design : second: one
1. checking no_clock (3)
2. checking no_input_delay (2)
9. checking no_clock (99999999999999999999)
  WNS(ns)  TNS Total Endpoints  WHS(ns)  WPWS(ns)
  -------  -------------------  -------  --------
"""
TAIL = "\nTiming constraints are not met.\n| Clock Summary\n| -----\nclk {0 1} 0.0 1\nclk {0 1} 5.0 1\nclk {0 1} 2.5 1\n| Other\nclk {0 1} 1.0 1\nMax Delay Paths\n"
REPORTS = {
    "whole": HEAD + "  -0.25  7  0.1  INF\n" + TAIL + PATH + "Min Delay Paths\n" + PATH.replace("-0.250", "-9.5") + "\tSlack (MET) : 1ns\n" + PATH.replace("-0.250", "-0.250").replace("+4", "0").replace("3  (", "20  ("),
    "kinds": "Max Delay Paths\n" + PATH.replace("  Source", " Source") + PATH.replace("Slack (VIOLATED)", "  Slack (MET)") + "Min Delay Paths",
    "short numbers": HEAD + "  NA     7\n" + TAIL, "wide numbers": HEAD + "  1 2 3 4 5\n" + TAIL, "odd numbers": HEAD + "  1e1  +.5  NaN  x\n" + TAIL + PATH,
    "clocks alone": HEAD + "  1 2 3 4\n| Clock Summary\nclk {0 1} 3.0 1", "no summary": TAIL + PATH, "empty": "", "breaks": (HEAD + "  1 2 3 4\n" + TAIL + PATH).replace("\n", "\r\n"), "other breaks": PATH.replace("\n", "\x85") + "é x",
    "tab": HEAD + "\t1 2 3\n" + TAIL + "\tMax Delay Paths\n" + PATH, "gap": PATH.replace("\n", "\n\n"), "final": "\n\n",
}


def rows(spark):
    return spark.createDataFrame([*REPORTS.items(), ("null", None)], "run string, text string").repartition(2, "run")


def told(df):
    plain = lambda v: "NaN" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(plain, r)) for r in df.collect()), key=str)


def unsorted(df):
    """Whether a plan that has not run deals rows once and neither sorts nor orders any."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Window" not in plan and "Sort" not in plan and plan.count("Exchange") == 1


def test_paths_as_over_lines(spark):  # F2 timing_report_paths
    want = tables.timing_paths(lines_of(rows(spark)), ["run"]).select("run", *tables.PATH_COLUMNS)
    got = rows(spark).select("run", F.inline(texts.timing_paths(tables.PATH_COLUMNS)("text")))
    assert unsorted(got) and told(got) == told(want) and got.dtypes == want.dtypes and got.count() > 9


def test_facts_as_over_lines(spark):  # F3 timing_reports, F7 timing_summaries
    want = P.timing_facts(lines_of(rows(spark)), ["run"])
    facts = P.timing_facts_of(rows(spark), ["run"])
    got = facts.select(want.columns)
    assert unsorted(got) and told(got) == told(want) and got.dtypes == want.dtypes
    banner = tables.banner_fields(lines_of(rows(spark)), ["run"]).where("key = 'Design'").join(want.select("run"), "run")
    last = facts.select("run", F.try_element_at(F.filter("banner", lambda b: b["key"] == "Design"), F.lit(-1))["value"].alias("v"))
    assert {tuple(r) for r in last.collect()} == {(r.run, r.value) for r in banner.collect()}


def test_slices_cut_between_texts(spark, monkeypatch):
    import pyarrow as pa

    some = pa.array([*REPORTS.values(), None])
    whole = texts.split_lines(some)
    monkeypatch.setattr(texts, "SLICE_BYTES", 40)
    parts = [texts.split_lines(s) for s in texts.slices(some)]
    assert len(parts) > 3 and [v for p in parts for v in p.value.to_pylist()] == whole.value.to_pylist()
    assert [n for p in parts for n in p.n.tolist()] == whole.n.tolist() and [n for p in parts for n in p.ln.tolist()] == whole.ln.tolist()


BOX = "+--+--+\n| Site Type | Used | Available | Util% |\n+--+--+\n| Slice LUTs | 90 | 100 | |\n| CLB LUTs | 1 | 1 | 1 |\n| DSPs | 8 | 10 | <80.5% |\n| Odd | 1 | 1 | 9 |\n| CLB | x | 1 | 2 |\n| Slice | 1,024 |\n+--+--+\n"
CROSS = "+--+\n| Severity | Count |\n| %s | 2 |\n+--+\n\nID      Severity  Description  Source Clock  Destination Clock\n------  --------  -----------  ------------  -----------------\nCDC-1   Critical               clk_b         clk_a\nCDC-1   critical  bus          clk_a         clk_b and more\nCDC-2             x\nCDC-15  warning   é            \nrest | a |\n\nafter\n"
PAIRS = "+--+\n| Source Clock | Destination Clock | Clock Pair Classification |\n+--+\n| a | b | No Common Clock |\n| b | a | Partial False Path (unsafe) |\n| c | a | partial false path |\n| | a | unsafe |\n| d | e |\n+--+\n"
TABLES = {
    "box": BOX, "odd boxes": "| A |\n" + BOX.replace("+--+--+\n", "+==+\n", 1) + "||\n| Site Type | Used |\n| DSPs | 1 |\n\n" + BOX.replace("| DSPs | 8", "| BUFGCTRL | 9"), "only odd": "+--+\n| Site Type | Used |\n+--+\n| Odd Site | 1 |\n+--+\n", "told": CROSS % "Critical", "counted": CROSS.split("\n\n", 1)[1],
    "no table": "x\n", "empty": "", "pairs": PAIRS, "safe": PAIRS.split("| a | b")[0] + "| d | e | safe |\n+--+\n", "breaks": CROSS.replace("\n", "\r\n") % "x", "rules": "Violations found: 3\nA-1#1 Error\n\n title\n one\n  two\nRelated violations: <none>\nA-1#2 Warning\nB_2-10#7  Critical Warning \nA-1 #3 Error\nx#1 Error\n", "clean": "\n  Violations found: 0\n",
}


def test_tables_as_over_lines(spark):  # F1 open_blockers, F5 evaluated_orders, F6 order_verdicts, F11 crossing_counts
    files = spark.createDataFrame([*TABLES.items(), ("null", None)], "run string, text string").repartition(1)
    lines, keys = lines_of(files), ["run"]
    of = lambda read, **kinds: files.select("run", F.inline(texts.of_lines(read, kinds)("text")))
    assert told(of(texts.utilization_of, key="string", util_percent="double")) == told(reports.utilization(lines, keys).select("run", "key", "util_percent"))
    assert told(of(texts.rules_of, rule="string", n="bigint", severity="string", title="string", detail="string")) == told(P.group_rules(tables.violations(lines, keys), keys).select("run", "rule", "n", "severity", "title", "detail"))
    assert told(of(texts.crossings_of, severity="string", id="string", n="bigint", description="string", pairs="array<string>")) == told(P.cdc_facts(reports.cdc(lines, keys), keys))
    assert told(of(texts.clocks_of, n_unsafe="bigint", n_partial="bigint", unsafe_pairs="array<string>", partial_pairs="array<string>")) == told(P.clock_facts(reports.clock_pairs(lines, keys), keys))
    got = files.select("run", F.inline(texts.crossing_counts("text")))
    assert unsorted(got) and told(got) == told(reports.cdc_counts(lines, keys))


def test_a_report_without_rows_is_unrecognised(spark):  # F12 report_statuses
    files = spark.createDataFrame([*TABLES.items(), ("null", None)], "run string, text string").repartition(1)
    found = files.select("run", *(status_reason(F.col("text"), texts.rows_of(kind)("text")).alias(kind) for kind in ("utilization", "drc", "cdc")))
    got = {r.run: (r.utilization, r.drc, r.cdc) for r in found.collect()}
    none = "unrecognised format"
    assert got["box"] == (None, none, none) and got["only odd"] == (none,) * 3 and got["told"] == got["counted"] == (none, none, None)
    assert got["rules"] == got["clean"] == (none, None, none) and got["null"] == ("file not found",) * 3 and got["empty"] == ("file is empty",) * 3


def test_findings_are_placed_as_they_pass(spark, monkeypatch):  # F5 evaluated_orders
    rows = [(run, id, s, e) for run in (3, None, 1, 2) for id, s, e in [("b", "INFO", "x"), ("b", "BLOCKER", "y"), ("a", "BLOCKER", "z"), ("a", "BLOCKER", None), ("c", "CRITICAL", "{}")]]
    found = spark.createDataFrame(rows, "run int, id string, severity string, evidence string").coalesce(1)
    want = found.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy(severity_rank(F.col("severity")), "id", "evidence")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = E.placed(found, ["run"])
        assert told(got) == told(want) and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_findings_of_families_as_of_each(spark):  # F1 open_blockers
    rows = [("u", "utilization", "lut", 95.0, None), ("u", "utilization", 'd"é', 80.0, None), ("u", "utilization", "x", 1e7, None), ("u", "utilization", "low", 1.0, None), ("q", "qor", None, None, 2), ("q", "other", "lut", 99.0, 1)]
    facts = spark.createDataFrame(rows, "run string, source string, key string, util_percent double, score int").withColumn("max_score", F.lit(5))
    families = {"utilization": P.utilization_rules(False), "qor": P.qor_rules()}
    want = [P.findings_of(facts.where(F.col("source") == s).drop("source"), ["run"], rules, s) for s, rules in families.items()]
    got = P.findings_of_families(facts, ["run"], families)
    assert told(got) == told(want[0].unionByName(want[1]).select(got.columns)) and got.count() == 4
