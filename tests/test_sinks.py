"""Reports as files, commits by several publishers, formats."""

import json
import random
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditlake.functions.columns import fixed_digits
from auditlake.sinks import rendering as R
from auditlake.sinks.commits import commit, create_once, numbers, pointer, publish, snapshot
from auditlake.sinks import report_files
from auditlake.sinks.report_files import Folder, _Reader, _Writer, read_reports, write_reports


def test_fixed_digits_round_the_binary_value(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 0.0005, 0.0015, 0.0025, 2.0005, 0.125, 0.375, 2.5, 0.5, 1.0005, -99.6005, 1e14 + 0.5, 123456789.0625, 1e15, 7e20]
    values += [round(rng.uniform(-500, 500), rng.randrange(1, 6)) for _ in range(800)] + [rng.randrange(10**7) / 10**4 for _ in range(800)] + [rng.randrange(-4000, 4000) / 16 for _ in range(400)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    got = [tuple(r) for r in frame.select(*(fixed_digits(F.col("v"), d) for d in (1, 2, 3))).collect()]
    assert [x for x in zip(values, got, strict=True) if x[1] != tuple(f"{x[0]:.{d}f}" for d in (1, 2, 3))] == []


def test_evidence_and_delta_texts(spark):
    rows = [('{"b": null, "a": "", "c": [], "d": [1, null, "x", 2.5, true, 6], "e": 2.0005, "f": 7, "z": {"k": [1]}}',), ("{}",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "e string").select(R.evidence_format(F.parse_json("e"))).collect()]
    assert got[0] == R.PAIR_SEPARATOR.join([R.LIST_SEPARATOR.join(["d=1", "None", "x", "2.5", "True"]) + R.LIST_CUT, f"e={2.0005:.3f}", "f=7", 'z={"k":[1]}']) and got[1:] == ["", ""]
    told = spark.sql("SELECT * FROM VALUES (0.31D, 'better'), (-0.31D, 'worse'), (0D, 'same'), (CAST(NULL AS DOUBLE), NULL) AS t(c, d)").select(R.delta_format(F.col("c"), F.col("d")), R.number_format(F.col("c"), 1, "%"))
    assert [tuple(r) for r in told.collect()] == [("+0.310 (better)", "0.3%"), ("-0.310 (worse)", "-0.3%"), ("no change", "0.0%"), ("-", "-")]


def test_reports_are_files_in_order_and_commits_are_whole(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"r{n}.md", s, [p], f"{n}/{s}/{p}") for n in range(40) for s in range(3) for p in range(rng.randrange(1, 30))]
    want = {}
    for name, _, _, line in rows:
        want[name] = want.get(name, "") + line + "\n"
    shuffled = rng.sample(rows, len(rows)) + [("r0.md", 9, [0], None), (None, 0, [0], "x")]
    lines = spark.createDataFrame(shuffled, "name string, section int, place array<long>, line string").repartition(7)
    assert read_reports(spark, str(tmp_path)).count() == 0
    first = write_reports(lines, str(tmp_path))
    second = write_reports(lines.where("name = 'r1.md'"), str(tmp_path))
    assert (first, second) == (1, 2)
    assert {r.name: r.text for r in read_reports(spark, str(tmp_path), first).collect()} == want
    assert {r.name: r.text for r in read_reports(spark, str(tmp_path)).collect()} == {"r1.md": want["r1.md"]}
    assert read_reports(spark, str(tmp_path), write_reports(lines.limit(0), str(tmp_path))).count() == 0


def test_a_lost_attempt_is_not_read_and_a_failed_job_leaves_nothing(spark, tmp_path):
    writer = _Writer(f"file://{tmp_path}/job")
    batch = pa.RecordBatch.from_arrays([pa.array(["a.md", "a.md", "b.md"]), pa.array(["1", "2", "3"])], ["name", "line"])
    writer.write(iter([batch]))  # an attempt whose message never came
    kept = writer.write(iter([batch]))
    writer.commit([kept, None])
    commit(spark, f"file://{tmp_path}", "job")
    assert sorted((r.name, r.text) for r in read_reports(spark, str(tmp_path)).collect()) == [("a.md", "1\n2\n"), ("b.md", "3\n")]
    gone = writer.write(iter([batch]))
    writer.abort([gone])
    assert not (tmp_path / "job" / gone.folder).exists()
    with pytest.raises(ValueError):
        writer.write(iter([pa.RecordBatch.from_arrays([pa.array(["../x"]), pa.array(["1"])], ["name", "line"])]))


def test_publishers_at_once_get_numbers_of_their_own(spark, tmp_path):
    taken, places = [], [f"{tmp_path}/a", f"file://{tmp_path}/b"]
    assert snapshot(spark, places[0]) is None and pointer(spark, places[0]) is None
    for place in places:
        threads = [threading.Thread(target=lambda i=i, place=place: taken.append(commit(spark, place, f"p{i}"))) for i in range(8)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert sorted(taken) == numbers(spark, place) == list(range(1, 9))
        assert {pointer(spark, place, n) for n in range(1, 9)} == {f"p{i}" for i in range(8)}
        taken.clear()
    assert create_once(spark, f"{tmp_path}/x", "1") and not create_once(spark, f"{tmp_path}/x", "2")
    both = [publish(spark, spark.range(n), f"{tmp_path}/c") for n in (3, 5)]
    assert both == [1, 2] and snapshot(spark, f"{tmp_path}/c").count() == 5 and snapshot(spark, f"{tmp_path}/c", 1).count() == 3 and snapshot(spark, f"{tmp_path}/c", 7) is None


def test_reports_are_read_by_the_folder_that_a_task_wrote(spark, tmp_path):  # F23 flow_reports, F27 signoff_reports
    lines = spark.range(300).select(F.format_string("r%d.md", "id").alias("name"), F.lit(0).alias("section"), F.array("id").alias("place"), F.lit("é").alias("line"))
    number = write_reports(lines, str(tmp_path))
    got = read_reports(spark, str(tmp_path), number)
    (job,) = tmp_path.glob("reports-*")
    assert got.rdd.getNumPartitions() == len(json.loads((job / "folders.json").read_text())) <= 3
    assert {tuple(r) for r in got.collect()} == {(f"r{i}.md", "é\n") for i in range(300)}


def test_reports_longer_than_what_is_held(tmp_path, monkeypatch):
    monkeypatch.setattr(report_files, "BUFFER_BYTES", 7)
    names, told = ["a"] * 9 + ["b"] + ["c"] * 3, [f"é{i}" for i in range(13)]
    writer = _Writer(f"file://{tmp_path}/job")
    kept = writer.write(pa.RecordBatch.from_arrays([pa.array(names[i : i + 4]), pa.array(told[i : i + 4])], ["name", "line"]) for i in range(0, 13, 4))
    batches = list(_Reader(f"file://{tmp_path}/job").read(Folder(kept.folder)))
    got = {r["name"]: r["text"] for b in batches for r in b.to_pylist()}
    assert len(batches) > 1 and kept.files == 3
    assert got == {k: "".join(f"{t}\n" for n, t in zip(names, told, strict=True) if n == k) for k in "abc"}


def test_null_lines_are_left_out_by_the_writer(spark, tmp_path):  # F27 signoff_reports: a filter on the line told it twice
    writer = _Writer(f"file://{tmp_path}/job")
    kept = writer.write(iter([pa.RecordBatch.from_arrays([pa.array(["a.md", "a.md", "b.md", "c.md"]), pa.array([None, "1\n2", None, "3"], pa.string())], ["name", "line"])]))
    writer.commit([kept])
    commit(spark, f"file://{tmp_path}", "job")
    assert kept.files == 2 and sorted(map(tuple, read_reports(spark, str(tmp_path)).collect())) == [("a.md", "1\n2\n"), ("c.md", "3\n")]


def test_findings_keep_their_tasks(spark):  # F27 signoff_reports: few bytes of rows are much work
    from auditlake.waiver_queries import nested_findings

    assert nested_findings(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
