"""Registered queries over reports that are written as files and read back: a customer is a run, its orders make the findings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import joins as J
from auditlake.operators.scratch import scratch_root, written
from auditlake.plans import evaluate as E
from auditlake.queries import query, table
from auditlake.sinks import rendering as R
from auditlake.sinks.commits import publish, snapshot
from auditlake.sinks.report_files import read_reports, write_reports
from auditlake.sources import records
from auditlake.waiver_queries import _ACCEPTED, _FILE, _ID, _NONE, nested_findings

RUN = ["o_custkey"]
_SEP = R.PAIR_SEPARATOR
_FOUND = f"""d AS (SELECT o_custkey AS c, o_custkey % 5 AS k, o_orderkey % 3 AS n, o_orderpriority AS p, left(sha256('{{"evidence": {{"files": ["p' || o_custkey % 5 || '", "q"], "n_dirty": ' || o_orderkey % 3 || ', "place": {{"none": null, "priority": "' || o_orderpriority || '"}}}}, "id": "{_ID}"}}'), 12) AS digest FROM orders WHERE o_orderkey % 3 > 0),
    h AS (SELECT *, k = 3 AND digest = '{_ACCEPTED}' AS held, p = '2-HIGH' AS place FROM d),
    f AS (SELECT c, '{_ID}' AS id, 'CRITICAL' AS severity, 1 AS rank, '{{"n_dirty":' || n || ',"files":["p' || k || '","q"],"place":{{"priority":"' || p || '","none":null}}}}' AS evidence, 'files=p' || k || '{R.LIST_SEPARATOR}q{_SEP}n_dirty=' || n || '{_SEP}place={{"none":null,"priority":"' || p || '"}}' AS shown,
            digest, held OR place AS waived, CASE WHEN held THEN 'p3, a, 2026-01-02' ELSE 'place, b, -' END AS said FROM h
        UNION ALL SELECT o_custkey, 'BITSTREAM.MISSING', 'BLOCKER', 0, '{{"share":' || o_totalprice::DOUBLE || '}}', 'share=' || printf('%.3f', o_totalprice::DOUBLE), left(sha256('{{"evidence": {{"share": ' || o_totalprice::DOUBLE || '}}, "id": "BITSTREAM.MISSING"}}'), 12), false, NULL FROM orders WHERE o_orderstatus = 'F'),
    r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY rank, id, evidence) AS at, row_number() OVER (PARTITION BY c, severity ORDER BY rank, id, evidence) AS nth FROM f),
    v AS (SELECT c_custkey AS c, count(r.c) FILTER (NOT waived AND severity = 'BLOCKER') AS bb, count(r.c) FILTER (NOT waived) AS bs, count(r.c) FILTER (severity = 'BLOCKER') AS nb, count(r.c) FILTER (severity = 'CRITICAL') AS nc FROM customer LEFT JOIN r ON r.c = c_custkey GROUP BY 1),
    block AS (SELECT c, 1 AS section, [0, u.at] AS place, u.line FROM (SELECT c, unnest([{{'at': 0, 'line': '| Question | Answer | Blocked by |'}}, {{'at': 1, 'line': '|---|---|---|'}}, {{'at': 2, 'line': '| Bring-up | ' || CASE WHEN bb = 0 THEN 'yes' ELSE 'no' END || ' | ' || bb || ' |'}}, {{'at': 3, 'line': '| Sign-off | ' || CASE WHEN bs = 0 THEN 'yes' ELSE 'no' END || ' | ' || bs || ' |'}}, {{'at': 4, 'line': ''}}]) AS u FROM v))"""


def _each(rows: str, section: int, place: str, *lines: str) -> str:
    """SQL of the lines of some rows, one after the other."""
    listed = ", ".join(f"{{'at': {i}, 'line': {line}}}" for i, line in enumerate(lines))
    return f"SELECT c, {section} AS section, [{place}, u.at]::BIGINT[] AS place, u.line AS line FROM (SELECT *, unnest([{listed}]) AS u FROM {rows})"


def _texts_sql(prefix: str, *parts: str) -> str:
    return f", l AS (SELECT c, section, place::BIGINT[] AS place, line FROM block UNION ALL {' UNION ALL '.join(parts)}) SELECT '{prefix}' || c || '.md' AS name, string_agg(line, chr(10) ORDER BY section, place) || chr(10) AS text FROM l WHERE line IS NOT NULL GROUP BY c"


def customer_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    waivers = records.waivers_of(spark.createDataFrame([(1, _FILE)], "k int, text string"), ["k"])
    return E.evaluate([nested_findings(spark, sf_dir).join(owners, "o_orderkey")], waivers, RUN)


def customer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")


def _name(prefix: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col("o_custkey").cast("string"), F.lit(".md"))


def _title() -> F.Column:
    return F.concat(F.lit("run "), F.col("o_custkey").cast("string"))


def _there_and_back(lines: DataFrame) -> DataFrame:
    spark = lines.sparkSession
    place = f"{scratch_root(spark)}/reports-{uuid.uuid4().hex}"
    return read_reports(spark, place, write_reports(lines, place))


_RISK = _texts_sql(
    "risk_",
    _each("v", 0, "0", "'# Risk report: run ' || c", "''"),
    _each("(SELECT c_custkey AS c FROM customer WHERE c_nationkey % 4 = 0)", 2, "0, 0", "'Not covered, as the analysis did not run:'", "''"),
    _each("(SELECT c_custkey AS c FROM customer WHERE c_nationkey % 4 = 0)", 2, "1, 1", "'- cdc (file is empty)'"),
    _each("(SELECT c_custkey AS c FROM customer WHERE c_nationkey % 8 = 0)", 2, "1, 2", "'- drc (unknown)'"),
    _each("(SELECT c_custkey AS c FROM customer WHERE c_nationkey % 4 = 0)", 2, "2, 0", "''"),
    _each("(SELECT * FROM r WHERE nth = 1)", 3, "rank, 0", "'## ' || severity", "''"),
    _each("r", 3, "rank, nth", "'### ' || nth || '. ' || id || CASE WHEN waived THEN ' (waived)' ELSE '' END", "''", "'- source: manifest, digest: `' || digest || '`'",
          "'- blocks bring-up: ' || CASE WHEN severity = 'BLOCKER' AND NOT waived THEN 'yes' ELSE 'no' END || ', sign-off: ' || CASE WHEN waived THEN 'no' ELSE 'yes' END", "'- evidence: ' || shown", "''"),
)


@query(f"WITH {_FOUND}{_RISK}")
def risk_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole risk report of every run, written as a file each and read back."""
    found, runs = written(customer_findings(spark, sf_dir), "findings"), customer_runs(spark, sf_dir)
    kinds = F.explode(F.array(F.struct(F.lit("cdc").alias("kind"), F.lit("file is empty").alias("reason"), F.lit(4).alias("m")), F.struct(F.lit("drc").alias("kind"), F.lit(None).cast("string").alias("reason"), F.lit(8).alias("m"))))
    uncovered = runs.select("*", kinds.alias("u")).where("c_nationkey % u.m = 0").select(*RUN, "u.kind", "u.reason")
    verdicts = written(E.summarise(runs, found, RUN), "verdicts")
    return _there_and_back(R.risk_report(verdicts, found, uncovered, RUN, _title(), _name("risk_")))


#: Rows of the checklist: which findings they take, and the runs in which their artifact is there.
_CHECKS = """k AS (SELECT c_custkey AS c, unnest([{'no': 0, 'label': 'environment'}, {'no': 1, 'label': 'filelist'}, {'no': 2, 'label': 'preflight'}, {'no': 3, 'label': 'log'}, {'no': 4, 'label': 'timing'}, {'no': 5, 'label': 'cdc'}, {'no': 6, 'label': 'drc'}, {'no': 7, 'label': 'utilization'}, {'no': 8, 'label': 'ip_status'}, {'no': 9, 'label': 'bitstream'}, {'no': 10, 'label': 'inputs'}]) AS k, c_nationkey % 3 AS m FROM customer),
    q AS (SELECT k.c, k.k.no AS no, k.k.label AS label, CASE WHEN label = 'bitstream' AND m <> 1 THEN CASE WHEN nb > 0 THEN 'FAIL' ELSE 'PASS' END WHEN label = 'inputs' AND m = 2 THEN CASE WHEN bs - bb > 0 THEN 'FAIL' WHEN nc > 0 THEN 'WAIVED' ELSE 'PASS' END WHEN label = 'timing' THEN 'PASS' ELSE 'NOT CHECKED' END AS status FROM k JOIN v USING (c)),
    x AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY ord, digest) AS nth FROM (SELECT c, 0 AS ord, 'old' AS reason, '""" + _NONE + """' AS was, digest FROM h WHERE n = 1 UNION ALL SELECT c, 1, 'p3', '""" + _ACCEPTED + """', digest FROM h WHERE k = 3 AND NOT held UNION ALL SELECT c, 3, 'last', '""" + _NONE + """', digest FROM h WHERE NOT place AND NOT held))"""
_SIGNOFF = _texts_sql(
    "signoff_",
    _each("v", 0, "0", "'# Sign-off: run ' || c", "''"),
    _each("v", 2, "-1", "'## Checklist'", "''", "'| Item | Status |'", "'|---|---|'"),
    _each("q", 2, "no", "'| ' || label || ' | ' || status || ' |'"),
    _each("(SELECT c, string_agg(label, ', ' ORDER BY no) FILTER (status = 'NOT CHECKED') AS gaps FROM q GROUP BY c)", 2, str(1 << 20), "''", "'Not checked: ' || coalesce(gaps, 'none')", "''"),
    _each("v", 3, "0", "'## Open findings'", "''"),
    _each("(SELECT *, row_number() OVER (PARTITION BY c ORDER BY r.at) AS o FROM r WHERE NOT waived)", 3, "o", "'- ' || severity || ' `' || id || '` ' || shown || ' (digest ' || digest || ')'"),
    _each("(SELECT c FROM v WHERE bs = 0)", 3, "1", "'No finding blocks.'"),
    _each("v", 4, "0", "''", "'## Waived'", "''"),
    _each("(SELECT *, row_number() OVER (PARTITION BY c ORDER BY r.at) AS o FROM r WHERE waived)", 4, "o", "'- `' || id || '` (' || severity || '): ' || said"),
    _each("(SELECT * FROM x WHERE nth = 1)", 5, "0", "''", "'## Waivers that no longer hold'", "''"),
    _each("x", 5, "nth", f"'- `{_ID}`: ' || reason || ' (' || was || ' -> ' || digest || ')'"),
)


def customer_checklist(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    kinds = F.array(F.lit("timing"), F.when(F.col("c_nationkey") % 3 != 1, "bitstream"), F.when(F.col("c_nationkey") % 3 == 2, "manifest"))
    artifacts = customer_runs(spark, sf_dir).select(*RUN, F.explode(kinds).alias("artifact")).where("artifact IS NOT NULL").withColumn("present", F.lit(True))
    return E.checklist(found, artifacts, RUN)


@query(f"WITH {_FOUND}, {_CHECKS}{_SIGNOFF}")
def signoff_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: the sign-off report of every run with checklist, waivers and what lapsed, written and read back."""
    found = written(customer_findings(spark, sf_dir), "findings")
    verdicts = written(E.summarise(customer_runs(spark, sf_dir), found, RUN), "verdicts")
    checks = written(customer_checklist(spark, sf_dir, found), "checklist")
    return _there_and_back(R.signoff_report(verdicts, checks, found, J.waiver_events(found, RUN), RUN, _title(), _name("signoff_")))


@query(f"WITH {_FOUND}, {_CHECKS} SELECT c AS o_custkey, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'NOT CHECKED') AS not_checked, CASE WHEN failed > 0 THEN 1 ELSE 0 END::INTEGER AS status FROM q GROUP BY c")
def signoff_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: the exit rule of the sign-off report of every run."""
    return R.failed_checks(customer_checklist(spark, sf_dir, customer_findings(spark, sf_dir)), RUN)


_FLOW = """s AS (SELECT o_custkey AS c, no, stage, count(*) FILTER (o_totalprice > 300000) AS b, count(*) FILTER (o_totalprice <= 300000) AS cr FROM orders, (VALUES (0, 'synth', 'F'), (1, 'impl', 'O')) AS t(no, stage, st) WHERE o_orderstatus = st GROUP BY ALL),
    g AS (SELECT c_custkey AS c, t.no AS no, t.stage AS stage, b, cr FROM customer CROSS JOIN (VALUES (0, 'synth'), (1, 'impl')) AS t(no, stage) LEFT JOIN s ON s.c = c_custkey AND s.stage = t.stage),
    v AS (SELECT c, coalesce(sum(b), 0)::BIGINT AS bb, coalesce(sum(b + cr), 0)::BIGINT AS bs FROM g GROUP BY c),
    i AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY rank, id) AS o FROM (SELECT o_custkey AS c, 'R' || o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'synth' ELSE 'impl' END AS stage, CASE WHEN o_totalprice > 300000 THEN 'BLOCKER' ELSE 'CRITICAL' END AS severity, CASE WHEN o_totalprice > 300000 THEN 0 ELSE 1 END AS rank FROM orders WHERE o_orderstatus <> 'P')),
    block AS (SELECT c, 1 AS section, [0, u.at] AS place, u.line FROM (SELECT c, unnest([{'at': 0, 'line': '| Question | Answer | Blocked by |'}, {'at': 1, 'line': '|---|---|---|'}, {'at': 2, 'line': '| Bring-up | ' || CASE WHEN bb = 0 THEN 'yes' ELSE 'no' END || ' | ' || bb || ' |'}, {'at': 3, 'line': '| Sign-off | ' || CASE WHEN bs = 0 THEN 'yes' ELSE 'no' END || ' | ' || bs || ' |'}, {'at': 4, 'line': ''}]) AS u FROM v))"""
_FLOW_TEXTS = _texts_sql(
    "flow_",
    _each("v", 0, "0", "'# Flow: run ' || c", "''"),
    _each("v", 2, "-1", "'| Stage | Blockers | Criticals | Warnings | Bring-up | Sign-off |'", "'|---|---|---|---|---|---|'"),
    _each("g", 2, "no", "'| ' || stage || ' | ' || coalesce(b::VARCHAR, '-') || ' | ' || coalesce(cr::VARCHAR, '-') || ' | ' || CASE WHEN b IS NULL THEN '-' ELSE '0' END || ' | ' || CASE WHEN b IS NULL THEN 'unknown' WHEN b = 0 THEN 'yes' ELSE 'no' END || ' | ' || CASE WHEN b IS NULL THEN 'unknown' WHEN b + cr = 0 THEN 'yes' ELSE 'no' END || ' |'"),
    _each("(SELECT * FROM i WHERE o <= 10)", 3, "o", "'- ' || severity || ' `' || id || '` in ' || stage"),
)


@query(f"WITH {_FLOW}{_FLOW_TEXTS}")
def flow_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: stages side by side and the worst findings of each flow."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    heavy = F.col("o_totalprice") > 300000
    found = orders.select(*RUN, F.when(F.col("o_orderstatus") == "F", "synth").otherwise("impl").alias("stage"), F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("id"), F.when(heavy, "BLOCKER").otherwise("CRITICAL").alias("severity"), heavy.alias("blocks_bringup"), F.lit(True).alias("blocks_signoff"), F.lit(False).alias("waived"), F.lit(False).alias("expired"))
    runs = customer_runs(spark, sf_dir).select(*RUN)
    by_stage = E.summarise(found, found, [*RUN, "stage"])
    order = F.explode(F.array(*(F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage")) for i, s in enumerate(["synth", "impl"])))).alias("s")
    stages = runs.select(*RUN, order).select(*RUN, "s.*").join(by_stage, [*RUN, "stage"], "left")
    worst = found.withColumn("place", F.struct("id"))
    verdicts = written(E.summarise(runs, found, RUN), "verdicts")
    return _there_and_back(R.flow_report(stages, verdicts, worst, RUN, _title(), _name("flow_")))


@query("""WITH s AS (SELECT o_custkey AS c, o_orderkey::VARCHAR AS stage, CASE WHEN o_orderstatus = 'O' THEN 'not run' WHEN o_orderstatus = 'P' AND o_totalprice > 250000 THEN 'ended with a status' WHEN NOT o_totalprice > 100000 THEN 'left no result' END AS why, o_totalprice > 400000 AS b FROM orders),
    y AS (SELECT c, stage || ': ' || why AS reason FROM s WHERE why IS NOT NULL UNION ALL SELECT c, 'blockers' FROM s WHERE b GROUP BY c), t AS (SELECT c, reason, row_number() OVER (PARTITION BY c ORDER BY reason) AS o FROM y)
    SELECT 'gate_' || c || '.md' AS name, '# Gate: run ' || c || chr(10) || chr(10) || 'Allowed: ' || CASE WHEN count(reason) = 0 THEN 'yes' ELSE 'no' END || chr(10) || chr(10) || coalesce(string_agg('- ' || reason || chr(10), '' ORDER BY o), '') AS text FROM (SELECT DISTINCT c FROM s) LEFT JOIN t USING (c) GROUP BY c""")
def gate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8, V4: the gate of each customer with all reasons against it."""
    from auditlake.report_queries import _stages

    stages = _stages(spark, sf_dir)
    return _there_and_back(R.gate_report(E.gate(stages, RUN), E.gate_reasons(stages, RUN), RUN, _title(), _name("gate_")))


@query("SELECT c_custkey, c_acctbal, 3::INTEGER AS number FROM customer WHERE c_acctbal > 2000")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K9: three publishers of one place, readers of the last commit; an older one is still there."""
    rows, place = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), f"{scratch_root(spark)}/latest-{uuid.uuid4().hex}"
    for least in (0, 1000, 2000):
        number = publish(spark, rows.where(F.col("c_acctbal") > least), place)
    return snapshot(spark, place).withColumn("number", F.lit(number))


@query("""SELECT o_orderkey, CASE WHEN previous IS NULL THEN '-' WHEN abs(wns - previous) <= 1e-9 THEN 'no change' ELSE printf('%+.3f', wns - previous) || ' (' || CASE WHEN wns > previous THEN 'better' ELSE 'worse' END || ')' END AS told, printf('%.2f', wns) || '%' AS shown
    FROM (SELECT o_orderkey, o_totalprice / 1000 AS wns, lag(o_totalprice / 1000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders)""")
def told_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and changes as the reports say them."""
    from auditlake.operators.rollups import trend

    rows = table(spark, sf_dir, "orders").select(*RUN, "o_orderkey", (F.col("o_totalprice") / 1000).alias("wns"))
    told = trend(rows, RUN, "o_orderkey", "wns", True)
    return told.select("o_orderkey", R.delta_format(F.col("wns") - F.col("previous"), F.col("direction")).alias("told"), R.number_format(F.col("wns"), 2, "%").alias("shown"))
