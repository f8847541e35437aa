"""Records, snapshots and gates on small tables."""

from pyspark.sql import functions as F

from auditlake.functions.columns import mask_tokens, os_supported, project_path
from auditlake.operators import joins as J
from auditlake.plans import evaluate as E
from auditlake.plans import rules as P
from auditlake.sources import filelists, logs, records, reports, tables
from auditlake.sources.lines import lines_of


def test_snapshots_stay_until_the_next_is_whole(spark, tmp_path):  # K9
    place = f"{tmp_path}/base"
    assert records.last_baseline(spark, place) is None
    records.publish_baseline(spark, spark.range(3), place)
    (tmp_path / "base/2").mkdir()  # a writer that stopped halfway
    assert records.last_baseline(spark, place).count() == 3
    records.publish_baseline(spark, spark.range(5), f"{tmp_path}/other")
    assert records.last_baseline(spark, f"{tmp_path}/other").count() == 5


def test_history_is_appended(spark, tmp_path):  # K1-K3, S37
    for i in range(2):
        records.append_records(spark.createDataFrame([("impl", i), ("synth", i)], "stage string, seq int"), f"{tmp_path}/h")
    rows = spark.read.parquet(f"{tmp_path}/h")
    assert sorted(r.seq for r in records.last_records(rows, ["stage"], "seq", "impl", 1).collect()) == [1] and rows.count() == 4


def test_json_lines_and_versions(spark):  # S36, S37, S39
    lines = spark.createDataFrame([('{"a": 1}',), ('{"a": ',), ("[1]",), (None,), ("",), ('{"a": null}',)], "value string")
    assert sorted(str(r.a) for r in records.json_rows(lines, "a int").collect()) == ["1", "None"]
    files = spark.createDataFrame([("x", '{"version": "2024.2"}'), ("y", "{"), ("z", '{"other": 1}')], "k string, text string")
    got = {r.k: (r.version, r.parse_error) for r in records.tool_versions(files, ["k"], "given").collect()}
    assert got == {"x": ("2024.2", False), "y": ("given", True), "z": ("given", False)}


def test_located_prefers_the_exact_name(spark):  # S42
    files = spark.createDataFrame([("/r/cdc_synth.rpt",), ("/r/cdc_impl.rpt",), ("/r/drc_b.rpt",), ("/r/drc_a.rpt",)], "path string")
    assert {r.stem: r.path for r in records.located(files, ["cdc", "drc"], "impl").collect()} == {"cdc": "/r/cdc_impl.rpt", "drc": "/r/drc_a.rpt"}


def test_names_are_masked_by_whole_words(spark):  # F16
    text = r"at C:\x\y.v  bus[3]_q [3] a[x] u/v[1] end"
    assert spark.range(1).select(mask_tokens(F.lit(text))).first()[0] == "at <name>  <name> [3] a[x] <name> end"


def test_supported_systems(spark):  # P11
    rows = spark.createDataFrame([("Ubuntu", "22.04"), ("ubuntu", "22"), ("rhel", "8.7"), ("rhel", "80"), ("arch", "1"), ("", "1"), (None, None)], "i string, v string")
    assert [r[0] for r in rows.select(os_supported(F.col("i"), F.col("v"))).collect()] == [True, False, True, False, False, None, None]
    assert spark.range(1).select(project_path(F.lit("$PSRCDIR/a/../b.v"), F.lit("/w/x.y.xpr"))).first()[0] == "/w/x.y.srcs/b.v"


def test_violations_run_to_the_next_head(spark):  # S7
    text = "A_B-1#1 Error\n\ntitle\nmore\n\nRelated violations: <none>\nlast\nC-2#1 Fatal\nD-3#2 Advisory\n"
    got = tables.violations(lines_of(spark.createDataFrame([("r", text)], "run string, text string")), ["run"]).orderBy("pos").collect()
    assert [(r.rule, r.severity, r.title, r.detail) for r in got] == [("A_B-1", "Error", "title", "more last C-2#1 Fatal"), ("D-3", "Advisory", "", "")]


def test_waivers_and_summary(spark):  # V1, V2, J8
    facts = spark.createDataFrame([("r", "lut", 95.0), ("r", "dsp", 85.0), ("s", "lut", 91.0)], "run string, key string, util_percent double")
    families = [P.findings_of(facts, ["run"], P.utilization_rules(False), "u")]
    digest = {(r.run, r.digest) for r in E.evaluate(families, spark.createDataFrame([], "ord int, id string, match map<string,string>, evidence_digest string"), ["run"]).where("id = 'UTIL.CRITICAL'").collect()}
    held = dict(digest)["r"]
    waivers = spark.createDataFrame([(0, "UTIL.CRITICAL", {"key": "lut"}, held), (1, "UTIL.HIGH", {"none": ""}, None), (2, "UTIL.HIGH", {"none": "x"}, None)], "ord int, id string, match map<string,string>, evidence_digest string")
    found = E.evaluate(families, waivers, ["run"])
    assert {(r.run, r.id): (r.waived, r.expired, r.blocks_signoff) for r in found.collect()} == {("r", "UTIL.CRITICAL"): (True, False, False), ("r", "UTIL.HIGH"): (True, False, False), ("s", "UTIL.CRITICAL"): (False, True, True)}
    got = {r.run: (r.critical, r.waived, r.signoff_ok) for r in E.summarise(spark.createDataFrame([("r",), ("s",), ("t",)], "run string"), found, ["run"]).collect()}
    assert got == {"r": (1, 2, True), "s": (1, 0, False), "t": (0, 0, True)}
    assert E.first_seen(found.unionByName(found), ["run"], F.lit(0), F.col("evidence")).count() == 3


def test_clock_period_and_logs(spark):  # A15, S25
    paths = spark.createDataFrame([("a", 0, "min", 9.0), ("a", 1, "max", 0.0), ("a", 2, "max", 4.0), ("b", 0, "max", None)], "run string, pos int, delay_kind string, requirement_ns double")
    clocks = spark.createDataFrame([("b", 5.0), ("b", 3.0), ("b", 0.0), ("c", 2.0)], "run string, period_ns double")
    assert {r.run: r.period for r in P.clock_period(paths, clocks, ["run"]).collect()} == {"a": 4.0, "b": 3.0, "c": 2.0}
    want = spark.createDataFrame([("x",), ("y",)], "run string")
    assert [r.run for r in logs.unreadable(want, spark.createDataFrame([("x", "t"), ("y", None)], "run string, text string"), ["run"]).collect()] == ["y"]


def test_projects_that_are_none(spark):  # S28
    rows = spark.createDataFrame([("/a.xpr", "<Project><FileSets/></Project>"), ("/b.xpr", "no xml"), ("/c.xpr", '<Project><FileSets><FileSet Name="Sim_x"><File Path="$PPRDIR/t.v"/></FileSet></FileSets></Project>')], "path string, text string")
    assert [(r.path, r.kind, r.value) for r in filelists.project_files(rows).collect()] == [("/c.xpr", "simulation", "/t.v")]
    assert {r.path: r.top for r in filelists.project_tops(rows).collect()} == {"/a.xpr": None, "/b.xpr": None, "/c.xpr": None}


def test_specs_and_shapes(spark):  # S43, J16, K14
    specs = J.specs_of(spark.createDataFrame([("16X8",), (" 16x8 ",), ("# no",), ("",), ("bad",)], "value string"))
    assert {(r.spec, r.bad) for r in specs.collect()} == {("16x8", False), ("bad", True)}
    text = "\n".join(["prose", "1. Title", "| a/b | c |", *["+--+"] * 50])
    got = reports.fingerprint(lines_of(spark.createDataFrame([("r", text)], "run string, text string")), ["run"]).orderBy("place").collect()
    assert [r.shape for r in got[:2]] == ["1. Title", "| <name> | c |"] and len(got) == 40


def test_checksums_leave_out_patterns(spark, tmp_path):  # S32, S33, K15
    (tmp_path / "a.v").write_text("x")
    (tmp_path / "b.log").write_text("y")
    found = filelists.checksums(filelists.file_records(spark, str(tmp_path)), ["*.log"]).collect()
    assert [(r.path.rsplit("/", 1)[1], r.sha256) for r in found] == [("a.v", "2d711642b726")]
    assert filelists.checksums(filelists.file_records(spark, str(tmp_path))).count() == 2
