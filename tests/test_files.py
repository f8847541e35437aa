"""Files of any size, logs together, marks of a write."""

import hashlib
import os

from pyspark.sql import functions as F

from auditlake.sinks import markers as M
from auditlake.sources import filelists, logs


def test_files_of_any_size_and_none(spark, tmp_path):
    big, size = tmp_path / "big.bin", (1 << 31) + 12345
    with open(big, "wb") as out:
        out.truncate(size)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "é a.v").write_bytes(b"module\n")
    paths = [str(big), str(tmp_path / "sub" / "é a.v"), str(tmp_path / "none.v"), str(tmp_path), None, str(big)]
    rows = {r.path: r for r in filelists.file_stats(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    whole = hashlib.sha256()
    for _ in range(size >> 20):
        whole.update(bytes(1 << 20))
    whole.update(bytes(size & ((1 << 20) - 1)))
    assert (rows[str(big)].sha256, rows[str(big)].size, rows[str(big)].missing) == (whole.hexdigest(), size, False)
    assert rows[paths[1]].sha256 == hashlib.sha256(b"module\n").hexdigest()
    assert all(rows[p].missing and rows[p].sha256 is None and rows[p].size is None for p in paths[2:4]) and len(rows) == 4
    os.truncate(big, 0)
    under = {r.path.rsplit("/", 1)[1] for r in filelists.files_under(spark, str(tmp_path)).collect()}
    assert len(under) == 2 and filelists.file_records(spark, str(tmp_path), "*.v").count() == 1
    assert filelists.file_stats(spark.createDataFrame([], "path string")).count() == 0


def test_logs_of_a_run_are_one(spark):
    expected = spark.createDataFrame([(1, 0, "/b"), (1, 1, "/a"), (1, 2, "/gone"), (2, 0, "/a"), (3, 0, "/x")], "run int, file_ord int, path string")
    say = lambda *bodies: "\n".join(f"WARNING: [Vivado 1-1] {b}" for b in bodies)
    files = spark.createDataFrame([("/b", say("b1", "b2")), ("/a", say("a1", "a2", "a3", "a4") + "\nERROR: [Vivado  1-1] a5\nINFO: [X 2-2] has no driver"), ("/other", say("o"))], "path string, text string")
    rows = {(r.run, r.kind, r.id): r for r in logs.merged_logs(expected, files, ["run"]).collect()}
    one = rows[1, "message", "Vivado 1-1"]
    assert (one.n, one.severity, one.examples, one.place) == (7, "ERROR", ["b1", "b2", "a1"], 1)
    assert rows[1, "message", "X 2-2"].risk_class == "UNDRIVEN_NET" and rows[2, "message", "Vivado 1-1"].examples == ["a1", "a2", "a3"]
    assert {(k[0], k[2]) for k in rows if k[1] == "unavailable"} == {(1, "/gone"), (3, "/x")} and len(rows) == 6


def test_marks_come_with_the_write(spark, tmp_path):
    rows = spark.createDataFrame([("BLOCKER", False), ("BLOCKER", True), ("INFO", False)], "severity string, waived boolean").repartition(2)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("marks", "")
    told = M.write_marked(rows, str(tmp_path / "out"), {**M.finding_marks(), "rows": F.lit(True)})
    jobs = len(tracker.getJobIdsForGroup("marks"))
    spark.sparkContext.setJobGroup("plain", "")
    rows.write.parquet(str(tmp_path / "plain"))
    assert jobs == len(tracker.getJobIdsForGroup("plain")) > 0
    assert told == {M.RISK_BLOCKERS: 1, "rows": 3} and spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert M.marker_lines(told) == ["##RISK_BLOCKERS## 1", "rows 3"] and M.marker_lines({"x": 0}) == []
    assert M.write_marked(rows.limit(0), str(tmp_path / "none"), M.finding_marks()) == {M.RISK_BLOCKERS: 0}
