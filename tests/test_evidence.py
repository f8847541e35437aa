"""Canonical JSON, digests and waivers against the standard library's JSON and a plain loop; lists against a depth-first walk."""

import hashlib
import json
import random
import struct

from pyspark.sql import functions as F

from auditlake.functions.columns import canonical_json, evidence_digest, number_text, variant_text
from auditlake.operators import joins as J
from auditlake.sources import filelists, records


def test_number_text_is_the_shortest_that_reads_back(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, 2e-3, 1e16, 1e15, 123456789012345680.0, 1e-4, 1e-5, 9.5e-5, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 2.0**-44, 1e23, 9.999999999999999e22, 0.1 + 0.2, 100.0, -12.5]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)] + [rng.uniform(-1e6, 1e6) for _ in range(500)] + [round(rng.uniform(0, 100), 3) for _ in range(500)]
    values = [v for v in values if v == v]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(number_text(F.col("v"))).collect()]
    assert [(v, g) for v, g in zip(values, got, strict=True) if g != repr(v)] == []
    special = spark.sql("SELECT double('NaN') AS v UNION ALL SELECT double('-Infinity') UNION ALL SELECT CAST(NULL AS DOUBLE)").select(number_text(F.col("v")))
    assert {r[0] for r in special.collect()} == {"NaN", "-Infinity", None}


def test_digest_of_nested_evidence(spark):
    schema = "s string, i long, d double, b boolean, n string, l array<string>, m map<string,array<double>>, o struct<z:int,a:array<struct<y:string,x:double>>>, e array<int>"
    rows = [
        ('q"é\\\n\x01\x1f/ \x7f', -3, 2.5e-7, True, None, ["a", None, "b"], {"k": [1.0, None], "a": []}, (None, [("p", 0.5), None]), []),
        ("", 2**62, 1e16, False, "x", None, {}, None, [1, 2]),
    ]
    frame = spark.createDataFrame(rows, schema).withColumn("all", F.struct(*[c.split(" ")[0] for c in ("s i d b n l m o e").split()]))
    got = [tuple(r) for r in frame.select(canonical_json(F.col("all"), frame.schema["all"].dataType), evidence_digest(F.lit("A.B"), canonical_json(F.col("all"), frame.schema["all"].dataType))).collect()]
    want = []
    for s, i, d, b, n, ls, m, o, e in rows:
        evidence = {"s": s, "i": i, "d": d, "b": b, "n": n, "l": ls, "m": m, "o": o and {"z": o[0], "a": [x and {"y": x[0], "x": x[1]} for x in o[1]]}, "e": e}
        text = json.dumps({"id": "A.B", "evidence": evidence}, sort_keys=True, ensure_ascii=False)
        want.append((json.dumps(evidence, sort_keys=True, ensure_ascii=False), hashlib.sha256(text.encode()).hexdigest()[:12]))
    assert got == want


def test_variant_text(spark):
    values = ['"x"', "5", "5.0", "1e-7", "true", "null", '["p",1.5,{"z":1,"y":null}]', "1.50", "123456789012345678901"]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(variant_text(F.parse_json("v"))).collect()]
    assert got == ["x", "5", "5.0", "1e-07", "True", "None", '["p",1.5,{"y":null,"z":1}]', "1.5", "123456789012345678901"]


def test_waivers_in_their_order(spark):
    rng = random.Random(2)
    findings = [(i, rng.choice("AB"), {"n": rng.randrange(3), "l": [rng.randrange(2)]}, f"d{rng.randrange(3)}") for i in range(60)]
    match = [{}, {"n": 1}, {"n": "2"}, {"l": [1]}, {"gone": ""}, {"n": 1, "l": [0]}]
    for _ in range(4):
        listed = [{"id": rng.choice("AB"), "match": rng.choice(match), "reason": f"r{k}", "evidence_digest": rng.choice(["", "d0", "d1", None])} for k in range(7)]
        want = []
        for i, rule, evidence, digest in findings:
            for k, w in enumerate(listed):
                if w["id"] != rule or any(str(evidence.get(key, "")) != str(v) for key, v in w["match"].items()):
                    continue
                if w["evidence_digest"] and w["evidence_digest"] != digest:
                    want.append((i, "expired", k, w["reason"], w["evidence_digest"], digest))
                    continue
                want.append((i, "applied", k, w["reason"], None, digest))
                break
        frame = spark.createDataFrame([(i, r, json.dumps(e), d) for i, r, e, d in findings], "run int, id string, evidence string, digest string").withColumn("attrs", F.parse_json("evidence"))
        frame = frame.withColumns({"blocks_bringup": F.lit(True), "blocks_signoff": F.lit(True)})
        waivers = records.waivers_of(spark.createDataFrame([(0, json.dumps(listed))], "k int, text string"), ["k"])
        out = J.apply_waivers(frame, waivers).cache()
        got = [(e.run, e.event, e.ord, e.reason, e.recorded_digest, e.current_digest) for e in J.waiver_events(out, ["run"]).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        held = {w[0] for w in want if w[1] == "applied"}
        assert {r.run for r in out.where("waived AND NOT blocks_bringup AND NOT blocks_signoff").collect()} == held
        assert {r.run for r in out.where("expired").collect()} == {w[0] for w in want} - held


def walk(texts, root):
    """Depth first, each list once."""
    out, seen = [], set()

    def visit(path, depth):
        if depth > 16:
            out.append(("error", f"file list nesting too deep at {path}"))
            return
        if path in seen:
            return
        seen.add(path)
        out.append(("list", path))
        if path not in texts:
            out.append(("error", f"file list not found: {path}"))
            return
        pending = False
        for token in texts[path].split():
            if pending:
                pending = False
                visit(f"/l/{token}", depth + 1)
            elif token in ("-f", "-F"):
                pending = True
            else:
                out.append(("file", f"/l/{token}"))

    visit(root, 0)
    return out


def test_lists_depth_first_with_cycles_and_diamonds(spark):
    rng = random.Random(3)
    for n in (4, 9):
        texts = {f"/l/{i}.f": " ".join(f"-{rng.choice('fF')} {rng.randrange(n + 1)}.f" if rng.random() < 0.5 else f"x{rng.randrange(9)}.v" for _ in range(rng.randrange(7))) for i in range(n)}
        texts |= {f"/l/c{i}.f": f"a{i}.v -f c{i + 1}.f b{i}.v -f c{i + 1}.f" for i in range(20)}
        lists = spark.createDataFrame(list(texts.items()), "path string, text string")
        roots = [*(f"/l/{i}.f" for i in range(n)), "/l/c0.f", "/l/c9.f", "/l/none.f"]
        got = filelists.flattened_lists(spark.createDataFrame([(r,) for r in roots], "path string"), filelists.entries_of(lists), lists).collect()
        for root in roots:
            assert [(r.kind, r.value) for r in sorted((r for r in got if r.root == root), key=lambda r: r.ord)] == walk(texts, root)
    assert filelists.flattened_lists(lists.limit(0), filelists.entries_of(lists), lists).count() == 0


def test_evidence_is_told_once_for_all_waivers(spark):  # F27, F28, F30
    """Neither inside the loop over waivers and their pairs, nor dealt by the few ids that findings have."""
    frame = spark.createDataFrame([(1, "A", '{"n":1}', "d")], "run int, id string, evidence string, digest string").withColumns({"attrs": F.parse_json("evidence"), "blocks_bringup": F.lit(True), "blocks_signoff": F.lit(True)})
    waivers = records.waivers_of(spark.createDataFrame([(0, '[{"id": "A", "match": {"n": 1}}]')], "k int, text string"), ["k"])
    out = J.apply_waivers(frame, waivers)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    for loop in plan.split("forall(")[1:]:
        depth, end = 1, 0
        while depth:
            depth, end = depth + {"(": 1, ")": -1}.get(loop[end], 0), end + 1
        assert "try_cast" not in loop[:end]
    assert plan.count("forall(") == 1 and "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.waived for r in out.collect()] == [True]


def test_numbers_with_and_without_a_digit_too_many(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 0.001, 0.00099, 9999999.0, 1e7, 1e15, 1e16, 123456789012345.6, 2e-44, 2.0e-3, 0.1 + 0.2, -1234.5, 5e-324, *(rng.uniform(-1, 1) * 10 ** rng.randrange(-20, 20) for _ in range(500)), *(round(rng.uniform(-1e6, 1e6), rng.randrange(9)) for _ in range(500))]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i int, x double").orderBy("i").select(number_text(F.col("x"))).collect()]
    assert got == [repr(v) for v in values]
