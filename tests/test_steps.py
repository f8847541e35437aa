"""Steps that many queries share: nothing is dealt or sorted more often than it must be, and quick ways give what the plain ones give."""

import pytest
from pyspark.sql import functions as F

from auditlake import report_queries  # noqa: F401
from auditlake.functions.columns import initcap, lower, upper
from auditlake.queries import QUERIES
from auditlake.sources import filelists
from auditlake.sources.lines import lines_of

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["rule_groups", "rule_reports", "searched_paths"])
def test_lines_stay_dealt_by_order(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Generate posexplode") == 1


def test_list_entries_are_not_sorted(spark):
    lists = spark.createDataFrame([("/p/a.f", "-f -f x.v\n-F\n b.f // c\n+incdir+../i +define+W -q # y\n\t-f")], "path string, text string")
    entries = filelists.list_entries(lists)
    assert "Sort" not in plan_of(entries) and "Window" not in plan_of(entries)
    assert [(r.ord, r.kind, r.value) for r in entries.orderBy("ord").collect()] == [(0, "list", "/p/-f"), (1, "file", "/p/x.v"), (2, "list", "/p/b.f"), (3, "incdir", "/i"), (4, "define", "W")]


def test_breaks_of_all_kinds(spark):
    got = lines_of(spark.createDataFrame([("r", "a\r\nb\rc\x0bd\n\ne\x85"), ("s", "\n"), ("t", ""), ("u", None)], "run string, text string")).orderBy("run", "ln").collect()
    assert [(r.run, r.ln, r.value) for r in got] == [("r", i + 1, v) for i, v in enumerate(["a", "b", "c", "d", "", "e"])] + [("s", 1, "")]


def test_letters_as_spark_maps_them(spark):
    rows = spark.createDataFrame([("aZ-9 b",), ("Äßİx",), ("word",), ("two words",), ("",), (None,)], "t string")
    for ours, theirs in ((lower, F.lower), (upper, F.upper), (initcap, F.initcap)):
        assert all(a == b for a, b in rows.select(ours(F.col("t")), theirs("t")).collect())


def test_list_keys_where_a_better_key_lies_too_deep(spark):
    # r names c last; by way of a and b, which come first, c lies at the greatest depth and is not followed.
    edges = spark.createDataFrame([("r", 0, "a"), ("a", 0, "b"), ("b", 0, "c"), ("r", 1, "c"), ("c", 0, "d"), ("d", 0, "r")], "path string, ord int, nested string")
    start = spark.createDataFrame([("r", "r", [])], "root string, path string, key array<int>")
    for depth in (3, 4, 16):
        got, want = ({(r.path, tuple(r.key)) for r in f(start, edges, depth).collect()} for f in (filelists._list_keys, filelists._list_keys_together))
        assert got == want and (("d" in {p for p, _ in got}) == (depth > 3))


def test_lines_are_split_without_counting_characters(spark):  # F17 open_check_items and all parsers of texts
    texts = {1: None, 2: "", 3: "\n", 4: "a\n", 5: "a\n\n", 6: "a\r\nb\x85c\rd", 7: "é x\n", 8: "é\ny", 9: " a\tb\nc", 10: "\x1c"}
    rows = lines_of(spark.createDataFrame(list(texts.items()), "k int, text string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" not in plan and "length(" not in plan
    got = {}
    for r in rows.orderBy("k", "ln").collect():
        got.setdefault(r.k, []).append((r.ln, r.value))
    want = {3: [""], 4: ["a"], 5: ["a", ""], 6: ["a", "b", "c", "d"], 7: ["é", "x"], 8: ["é", "y"], 9: [" a\tb", "c"], 10: [""]}
    assert got == {k: list(enumerate(v, 1)) for k, v in want.items()}
