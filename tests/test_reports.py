"""Report parsers, file lists and rule families on small texts of our own with the layouts of FIXTURES.md."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from auditlake.functions.columns import canonical_json, evidence_digest, fold_path, ip_spec
from auditlake.plans import rules as P
from auditlake.sources import filelists, reports, tables
from auditlake.sources.lines import lines_of


def lines(spark, text):
    return lines_of(spark.createDataFrame([("r", text)], "run string, text string"))


CDC = """1. Summary
+----------+-------+
| Severity | Count |
+----------+-------+
| Critical | 2 |
+----------+-------+

2. Details

ID      Severity  Description            Source Clock  Destination Clock
------  --------  ---------------------  ------------  -----------------
CDC-1   Critical  1-bit unknown          clk_a         clk_b (and more
CDC-1   critical                         clk_b         clk_a
CDC-15  Warning   Clock enable           clk_a         clk_b

after
"""


def test_ruler_tables_and_cdc(spark):  # S3-S6, S18, A6, CDC.*
    rows = tables.ruler_rows(lines(spark, CDC), ["run"]).orderBy("row_no").collect()
    assert [r.cells[0] for r in rows] == ["CDC-1", "CDC-1", "CDC-15"] and rows[0].cells[4] == "clk_b (and more"
    assert {r.title for r in rows} == {"2. Details"} and {r.line_start for r in rows} == {10}
    found = reports.cdc(lines(spark, CDC), ["run"])
    facts = P.cdc_facts(found, ["run"]).withColumnRenamed("id", "crossing")
    got = {(r.severity, r.crossing): (r.n, r.description, list(r.pairs)) for r in facts.collect()}
    assert got[("Critical", "CDC-1")] == (2, "1-bit unknown", ["clk_a -> clk_b (and more", "clk_b -> clk_a"])
    graded = P.findings_of(facts, ["run"], P.cdc_rules(), "cdc").collect()
    assert {(r.id, r.severity) for r in graded} == {("CDC.CRITICAL", "BLOCKER"), ("CDC.WARNING", "CRITICAL")}
    assert [(r.severity, r.n) for r in reports.cdc_counts(lines(spark, CDC), ["run"]).collect()] == [("Critical", 2)]


def test_utilization_first_row_wins(spark):  # S16, J17, UTIL.*
    text = "+--+\n| Site Type | Used | Available | Util% |\n+--+\n| Slice LUTs | 90 | 100 | |\n| CLB LUTs | 1 | 100 | 1.0 |\n| DSPs | 8 | 10 | <80.5 |\n| Odd | 1 | 1 | 100 |\n+--+\n"
    got = {r.key: (r.used, r.util_percent) for r in reports.utilization(lines(spark, text), ["run"]).collect()}
    assert got == {"lut": (90, 90.0), "dsp": (8, 80.5)}


def test_ip_clock_and_scalars(spark):  # S19-S22, IP.*, CLK.*, QOR.*
    text = "+--+\n| IP Name | Status | Recommendation |\n+--+\n| a | Output products missing, upgrade | |\n| b | Up-to-date | Upgrade IP |\n| c | Locked | |\n+--+\n"
    facts = P.ip_facts(reports.ip_status(lines(spark, text), ["run"]), ["run"])
    assert {r.id for r in P.findings_of(facts, ["run"], P.ip_rules(), "ip").collect()} == {"IP.MISSING_PRODUCTS", "IP.NEEDS_UPGRADE", "IP.LOCKED"}
    assert facts.first().n_upgrade == 1
    pairs = reports.clock_pairs(lines(spark, "+--+\n| Source Clock | Destination Clock | Clock Pair Classification |\n+--+\n| a | b | No Common Clock |\n| b | a | Partial False Path |\n+--+\n"), ["run"])
    assert {r.id for r in P.findings_of(P.clock_facts(pairs, ["run"]), ["run"], P.clock_rules(), "clk").collect()} == {"CLK.NO_COMMON_CLOCK", "CLK.PARTIAL_FALSE_PATH"}
    assert reports.control_sets(lines(spark, "x\n| Number of unique control sets | 342 |\n"), ["run"]).first().unique_control_sets == 342
    assert reports.qor(lines(spark, "+--+\n| A | B |\n| Overall Assessment Score | 2 |\n+--+\n"), ["run"]).first().score == 2
    assert reports.without_ip(lines(spark, "design has no IP"), ["run"]).count() == 1


def test_timing_tables(spark):  # S9, S11, S13
    text = "   WNS(ns)   TNS Failing Endpoints\n   -------   ---------------------\n    -0.234                      45\n\nTiming constraints are not met.\n| Clock Summary\n| -------------\n-----\nclk  {0.000 2.500}  5.000  200.000\n| Next\nfar  {0 1}  2.0  500.0\n"
    rows = lines(spark, text)
    assert {(r.name, r.number) for r in reports.design_summary(rows, ["run"]).collect()} == {("wns", -0.234), ("tns_failing_endpoints", 45.0)}
    assert [(r.name, r.period_ns) for r in reports.clocks(rows, ["run"]).collect()] == [("clk", 5.0)]
    assert reports.constraints_met(rows, ["run"]).first().constraints_met is False


@pytest.mark.parametrize("text, declared, n, ok", [("Violations found: 0\n", 0, 0, True), ("garbage", None, 0, False), ("Violations found: 2\n", 2, 0, False), ("A-1#1 Error\nt\n", None, 1, True)])
def test_rule_report_declares_clean(spark, text, declared, n, ok):  # S17
    rows = lines(spark, text)
    r = reports.rule_report(rows, tables.violations(rows, ["run"]), ["run"]).first()
    assert (r.declared, r.n, r.recognised) == (declared, n, ok)


def test_file_lists(spark):  # S26, S27, F9
    text = [("/p/a.f", "x.v // note\n+incdir+../inc +define+W=3 -quiet\n-f\nsub/b.f\n# gone\n"), ("/p/sub/b.f", "y.v -f ../a.f\n"), ("/p/c.f", "z.v")]
    entries = filelists.list_entries(spark.createDataFrame(text, "path string, text string"))
    got = [(r.path, r.kind, r.value) for r in entries.orderBy("path", "ord").collect()]
    assert got == [("/p/a.f", "file", "/p/x.v"), ("/p/a.f", "incdir", "/inc"), ("/p/a.f", "define", "W=3"), ("/p/a.f", "list", "/p/sub/b.f"), ("/p/c.f", "file", "/p/z.v"), ("/p/sub/b.f", "file", "/p/sub/y.v"), ("/p/sub/b.f", "list", "/p/a.f")]
    roots = spark.createDataFrame([("/p/a.f",)], "path string")
    assert {(r.path, r.depth) for r in filelists.reached_lists(roots, entries, 4).collect()} == {("/p/a.f", 0), ("/p/sub/b.f", 1)}
    tcl = spark.createDataFrame([("/p/l.tcl", 'add_files -fileset -library {my file.v}\nread_xdc -quiet "c.xdc"\nputs x.v\n')], "path string, text string")
    assert [r.value for r in filelists.tcl_entries(tcl).orderBy("ln", "at").collect()] == ["/p/my file.v", "/p/c.xdc"]
    assert spark.range(1).select(F.concat_ws(" ", fold_path(F.lit("/a/./b/../../../c")), fold_path(F.lit("../x/..//y")), fold_path(F.lit("a/..")), ip_spec(F.lit("blk_mem_gen_16x8")))).first()[0] == "/c ../y . 16x8"


def test_module_scan(spark):  # S29
    text = [("/a.v", "module top;\n// gone g (\n/* also\n h u (1); */\n  sub #(.W(3)) u0 (\n if (x)\n endmodule"), ("/b.v", "module own;\nown x (\n"), ("/c.vhd", "entity e is\n u: entity work.sub -- component no\n"), ("/d.txt", "module no;")]
    got = {(r.path, r.module, r.edge) for r in filelists.module_edges(spark.createDataFrame(text, "path string, text string")).collect()}
    assert ("/a.v", "sub", "instantiates") in got and ("/c.vhd", "sub", "instantiates") in got and ("/a.v", "top", "declares") in got
    assert not {m for _, m, e in got if e == "instantiates"} & {"own", "g", "h", "if", "no"} and "no" not in {m for _, m, _ in got}


def test_digest_and_remaining_rules(spark):  # F8, PROV, FILELIST, ENV, BITSTREAM, CTRLSET
    evidence = F.struct(F.lit('q"é').alias("b"), F.lit(3).alias("a"), F.lit(None).cast("string").alias("n"), F.lit(2.5).alias("d"))
    found = spark.range(1).select(evidence.alias("e"))
    row = found.select(evidence_digest(F.lit("A.B"), canonical_json(F.col("e"), found.schema["e"].dataType))).first()[0]
    want = json.dumps({"id": "A.B", "evidence": {"b": 'q"é', "a": 3, "n": None, "d": 2.5}}, sort_keys=True, ensure_ascii=False)
    assert row == hashlib.sha256(want.encode()).hexdigest()[:12]
    facts = spark.sql("SELECT 'r' AS run, 1 AS n_missing_file, 0 AS n_missing_incdir, 2 AS n_file_missing, 0 AS n_undefined, CAST(NULL AS BOOLEAN) AS top_found, CAST(NULL AS BOOLEAN) AS consistent, 1 AS n_duplicate, 1 AS n_dirty, 0 AS n_warnings, true AS tool_changed, false AS os_changed, CAST(NULL AS BOOLEAN) AS os_supported, true AS requested, false AS present, 30 AS unique_control_sets, 100 AS registers, 2 AS score, 5 AS max_score")
    every = P.filelist_rules() + P.provenance_rules() + P.environment_rules() + P.bitstream_rules() + P.control_set_rules() + P.qor_rules()
    got = {r.id for r in P.findings_of(facts, ["run"], every, "all").collect()}
    assert got == {"FILELIST.MISSING_FILE", "FILELIST.MODULE_FILE_MISSING", "FILELIST.PROJECT_NOT_CHECKED", "FILELIST.DUPLICATE_MODULE", "PROV.DIRTY_INPUTS", "ENV.VIVADO_CHANGED", "BITSTREAM.MISSING", "CTRLSET.HIGH", "QOR.LOW_SCORE"}
