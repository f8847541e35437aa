"""The static check of a project on a small tree, and facts out of tools' texts."""

from pyspark.sql import functions as F

from auditlake.plans import project_check as C
from auditlake.plans import rules as P
from auditlake.sources import facts, filelists

DISK = {
    "/p/rtl/top.v": "module top (input a);\n  sub u0 (.a(a));\n  blk_mem_gen_512x32 m (.a(a));\n  gone #(.W(2)) g [1:0] (.a(a));\n  BUFG b (.I(a));\n  beside x (.a(a));\n  deep y (.a(a));\n  ip z (.a(a));\n  trireg t (a);\nendmodule\n",
    "/p/rtl/sub.v": "module sub (input a);\n  sub again (.a(a));\nendmodule\n",
    "/p/rtl/beside.v": "module beside;\nendmodule\n",
    "/p/other/a/deep.vhd": "entity deep is end;\narchitecture x of deep is begin u: entity work.none; end;\n",
    "/p/rtl/twice.v": "/*\nmodule sub;\n*/\nmodule twice;\nendmodule\n",
    "/p/rtl/tb_x.v": "module tb;\n top t (.a(1));\nendmodule\n",
}


def test_a_project_is_checked_from_end_to_end(spark):
    run = ["run"]
    listed = spark.createDataFrame(
        [(1, "file", p) for p in ("/p/rtl/./top.v", "/p/rtl/sub.v", "/p/rtl/sub.v", "/p/x/../rtl/twice.v", "/p/none.v", "/p/rtl/tb_x.v")] + [(1, "incdir", "/inc"), (1, "incdir", "/no"), (1, "error", "file list not found: /q.f"), (1, "list", "/p/o.f"), (2, "file", "/p/rtl/sub.v")],
        "run int, kind string, value string",
    )
    projects = spark.createDataFrame([(1, "source", "/p/rtl/top.v"), (1, "constraint", "/p/c.xdc"), (1, "simulation", "/p/rtl/beside.v")], "run int, kind string, value string")
    disk = spark.createDataFrame(list(DISK.items()), "path string, text string")
    folders = spark.createDataFrame([("/inc",)], "path string")
    ignored = spark.createDataFrame([(1, "ip")], "run int, module string")
    search = spark.createDataFrame([(1, "/p/other")], "run int, path string")
    items = C.check_items(listed, projects, disk, folders, run, ["*/tb_?.v"], ignored, spark.createDataFrame([("bufg",)], "module string"), search)
    got = {}
    for r in items.collect():
        got.setdefault((r.run, r.what), set()).add((r.value, r.place))
    bare = lambda what, run=1: {v for v, _ in got.get((run, what), ())}
    assert bare("missing_file") == {"/p/none.v"} and bare("missing_incdir") == {"/no"} and bare("excluded") == {"/p/rtl/tb_x.v"} and bare("parse_error") == {"file list not found: /q.f"}
    assert bare("only_in_list") == {"/p/rtl/sub.v", "/p/rtl/twice.v", "/p/none.v"} and bare("only_in_project") == {"/p/c.xdc"}
    assert got[1, "file_missing"] == {("beside", "/p/rtl/beside.v"), ("deep", "/p/other/a/deep.vhd")}
    assert got[1, "undefined"] == {("gone", "/p/rtl/top.v"), ("blk_mem_gen_512x32", "/p/rtl/top.v")} and bare("spec") == {"512x32"}
    assert got[1, "duplicate"] == {("sub", "/p/rtl/sub.v"), ("sub", "/p/rtl/twice.v")}
    assert bare("declared") == {"top", "sub", "twice"} and "sub" in bare("instantiated") and not bare("instantiated", 2)
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run int")
    tops = spark.createDataFrame([(1, "top"), (2, "absent"), (3, "")], "run int, top string")
    facts_of = {r.run: r for r in C.broken(C.check_facts(runs, items, tops, projects, run)).collect()}
    assert (facts_of[1].n_file_missing, facts_of[1].n_undefined, facts_of[1].n_duplicate, facts_of[1].top_found, facts_of[1].consistent, facts_of[1].broken) == (2, 2, 1, True, False, True)
    assert (facts_of[2].top_found, facts_of[2].consistent, facts_of[2].broken) == (False, None, True) and (facts_of[3].top_found, facts_of[3].n_files, facts_of[3].broken) == (None, 0, False)
    ids = {r.id for r in P.findings_of(C.check_facts(runs, items, tops, projects, run).where("run = 1"), run, P.filelist_rules(), "filelist").collect()}
    assert ids == {f"FILELIST.{x}" for x in ("MISSING_FILE", "MISSING_INCDIR", "MODULE_FILE_MISSING", "MODULE_UNDEFINED", "PROJECT_MISMATCH", "DUPLICATE_MODULE")}
    assert {r.run: r.specs for r in C.specs_wanted(runs, items, run).collect()} == {1: ["512x32"], 2: [], 3: []}
    none = C.check_items(listed.limit(0), projects.limit(0), disk.limit(0), folders, run)
    assert none.count() == 0


def test_reserved_words_are_those_of_the_source_s_language(spark):
    files = spark.createDataFrame([("/a.v", "module a;\n if (x) y;\n signal s (1);\n supply0 z (1);\nendmodule"), ("/b.vhd", "-- component no\ncomponent logic\nu: entity work.top\ncomponent signal\n")], "path string, text string")
    got = {(r.path, r.module) for r in filelists.module_sides(files).where("uses").collect()}
    assert got == {("/a.v", "signal"), ("/b.vhd", "logic"), ("/b.vhd", "top")}


def test_facts_of_machines_and_repositories(spark):
    files = spark.createDataFrame([(1, "NAME=x\nid='Ubuntu'\nVERSION_ID=\"22.04\"\nno line\nPRETTY_NAME=a=b\n"), (2, None), (3, "ID=arch")], "k int, text string")
    got = {r.k: tuple(r)[1:] for r in facts.os_release(files, ["k"]).collect()}
    assert got == {1: ("ubuntu", "22.04", "a=b", True), 2: ("unknown", "", None, None), 3: ("arch", "", None, False)}
    heads = spark.createDataFrame([(1, "c" * 40, "main"), (2, "d" * 40, "x"), (3, None, None)], "k int, commit string, branch string")
    statuses = spark.createDataFrame([(1, "\n".join(f" M f{i:03}" for i in range(250)) + "\nR  a -> \"b c\"\n??\n"), (3, " M x")], "k int, text string")
    rows = {r.k: r for r in facts.repository_facts(heads, statuses, ["k"]).collect()}
    assert (rows[1].dirty_file_count, len(rows[1].dirty_files), rows[1].dirty_files[:2], rows[1].short) == (251, 200, ["b c", "f000"], "c" * 12)
    assert (rows[2].dirty, rows[2].dirty_files) == (False, []) and (rows[3].available, rows[3].dirty, rows[3].branch) == (False, None, None)
    stage, status, error = facts.status_argument(F.col("t"), ["a", "b"])
    said = spark.createDataFrame([("a=0",), ("b=skipped",), ("c=1",), ("a=x",), ("a",), (None,)], "t string").select(stage, status, error).collect()
    assert [tuple(r) for r in said] == [("a", "0", None), ("b", "skipped", None), (None, None, "unknown stage"), (None, None, "no number"), (None, None, "no status"), (None, None, None)]
