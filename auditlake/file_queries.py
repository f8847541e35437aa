"""Registered queries over files of any size, several logs a run, markers and banners."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.columns import file_stamp, ip_spec, shorten
from auditlake.operators.scratch import scratch_root, written
from auditlake.plans import evaluate as E
from auditlake.queries import query, table
from auditlake.report_queries import _IDS, _SEVERITY, one_of
from auditlake.sinks import markers as M
from auditlake.sinks.report_files import write_reports
from auditlake.sink_queries import RUN, customer_findings, customer_runs
from auditlake.sources import facts, filelists, logs, records


@query("""SELECT 'p' || p_partkey || '.v' AS name, CASE WHEN p_size > 10 THEN sha256(p_name || chr(10)) END AS sha256, CASE WHEN p_size > 10 THEN octet_length(encode(p_name)) + 1 END AS size, p_size <= 10 AS missing FROM part""")
def hashed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of files by path, those that are gone among them."""
    part, place = table(spark, sf_dir, "part"), f"{scratch_root(spark)}/files-{uuid.uuid4().hex}"
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".v"))
    write_reports(part.where("p_size > 10").select(name.alias("name"), F.lit(0).alias("section"), F.lit(0).alias("place"), F.col("p_name").alias("line")), place)
    there = filelists.files_under(spark, place, "*.v")
    gone = part.where("p_size <= 10").select(F.concat(F.lit(f"{place}/"), name).alias("path"))
    found = filelists.file_stats(written(there.union(gone), "paths"))
    return found.select(F.substring_index("path", "/", -1).alias("name"), "sha256", "size", "missing")


_LOGS = f"""m AS (SELECT user_id, event_id, event_id % 2 AS f, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS rank, ({[x.replace("  ", " ") for x in _IDS]})[event_id % 6 + 1] AS id,
        CASE event_id % 7 WHEN 0 THEN 'net x has no driver' WHEN 1 THEN 'Module Not Found y' ELSE 'event ' || event_id END AS body FROM events WHERE event_id % 10 <> 9),
    c AS (SELECT *, CASE WHEN id = 'Vivado 12-507' THEN 'CONSTRAINT_NOT_APPLIED' WHEN body = 'Module Not Found y' THEN 'UNBOUND_MODULE' WHEN id = 'Synth 8-327' THEN 'INFERRED_LATCH' WHEN body = 'net x has no driver' THEN 'UNDRIVEN_NET' WHEN id = 'Synth 8-6014' THEN 'WIDTH_MISMATCH' WHEN id = 'Place 30-575' THEN 'PLACEMENT_QUALITY' END AS k FROM m),
    s AS (SELECT user_id, id, count(*)::BIGINT AS n, max(rank) AS rank, arg_min(k, (f, event_id)) FILTER (k IS NOT NULL) AS risk_class, (list(body ORDER BY f, event_id))[1:3] AS examples FROM c GROUP BY ALL)"""


def two_logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(expected, files): each user has a log of even events, one of odd ones, and now and then one that is not there."""
    kind, n = F.col("event_type"), F.col("event_id")
    severity = F.when(kind == "error", "ERROR").when(kind == "purchase", "CRITICAL WARNING").when(kind == "signup", "WARNING").otherwise("INFO")
    body = F.when(n % 7 == 0, "net x has no driver").when(n % 7 == 1, "Module Not Found y").otherwise(F.concat(F.lit("event "), n.cast("string")))
    line = F.when(n % 10 == 9, F.concat(F.lit("no message of "), severity)).otherwise(F.concat(F.lit(" "), severity, F.lit(": ["), one_of(n % 6, _IDS), F.lit("]  "), body, F.lit(" ")))
    events = table(spark, sf_dir, "events").select("user_id", (n % 2).alias("f"), n.alias("event_id"), line.alias("line"))
    path = lambda f: F.concat(F.lit("/log/"), F.col("user_id").cast("string"), F.lit("/"), F.lit(9) - f, F.lit(".log"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"])
    files = events.groupBy("user_id", "f").agg(F.array_join(lines, "\n").alias("text")).select(path(F.col("f")).alias("path"), "text")
    users = events.select("user_id").distinct()
    asked = F.explode(F.when(F.col("user_id") % 3 == 0, F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array(*map(F.lit, (0, 1))))).alias("file_ord")
    return users.select("user_id", asked).select("user_id", "file_ord", path(F.col("file_ord")).alias("path")), files


@query(f"""WITH {_LOGS} SELECT user_id, 'message' AS kind, id, n, {_SEVERITY} AS severity, risk_class, array_to_string(examples, ', ') AS examples, (row_number() OVER (PARTITION BY user_id ORDER BY rank DESC, n DESC, id))::INTEGER AS place FROM s
    UNION ALL SELECT user_id, 'unavailable', '/log/' || user_id || '/' || (9 - f) || '.log', NULL, NULL, NULL, NULL, (row_number() OVER (PARTITION BY user_id ORDER BY f))::INTEGER FROM (
        SELECT DISTINCT user_id, 2 AS f FROM events WHERE user_id % 3 = 0 UNION ALL SELECT user_id, f FROM (SELECT DISTINCT user_id FROM events), (VALUES (0), (1)) AS t(f) WHERE (user_id, f) NOT IN (SELECT (user_id, event_id % 2) FROM events))""")
def merged_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several logs of a run as one, and those that could not be read."""
    expected, files = two_logs(spark, sf_dir)
    return logs.merged_logs(expected, files, ["user_id"]).withColumn("examples", F.array_join("examples", ", "))


@query("""WITH f AS (SELECT o_orderkey % 3 > 0 AS dirty, o_orderstatus = 'F' AS gone, o_orderpriority = '2-HIGH' OR (o_custkey % 5 = 3 AND o_orderkey % 3 = 1 AND o_orderpriority = '1-URGENT') AS w FROM orders)
    SELECT '##RISK_BLOCKERS##' AS marker, count(*) FILTER (gone) AS n FROM f UNION ALL SELECT 'findings', count(*) FILTER (gone) + count(*) FILTER (dirty) FROM f UNION ALL SELECT 'waived', count(*) FILTER (dirty AND w) FROM f""")
def write_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markers of a write of all findings, observed by that write; one row for each marker."""
    marks = {**M.finding_marks(), "findings": F.lit(True), "waived": F.col("waived")}
    found = customer_findings(spark, sf_dir).drop("waiver", "stale")
    told = M.write_marked(found, f"{scratch_root(spark)}/marked-{uuid.uuid4().hex}", marks)
    return spark.createDataFrame(list(told.items()), "marker string, n long")


@query(f"""WITH s AS (SELECT c_custkey AS o_custkey, c_nationkey % 3 AS status, c_nationkey % 5 = 0 AS none, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS bad,
        EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 > 0 AND NOT (o_orderpriority = '2-HIGH' OR (o_custkey % 5 = 3 AND o_orderkey % 3 = 1 AND o_orderpriority = '1-URGENT'))) AS open, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 > 0) AS any_dirty FROM customer),
    b AS (SELECT o_custkey, CASE WHEN none THEN CASE WHEN status = 0 THEN 'WARN' ELSE 'FAIL' END WHEN bad OR status <> 0 THEN 'FAIL' WHEN open THEN 'WARN' WHEN any_dirty THEN 'WARN' ELSE 'PASS' END AS banner FROM s)
    SELECT o_custkey, banner, repeat('=', 60) || chr(10) || '= ' || rpad(banner || ' ' || o_custkey, 56, ' ') || ' =' || chr(10) || repeat('=', 60) AS lines FROM b""")
def run_banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The banner of every run, by exit status and verdict, some without a verdict."""
    verdicts = E.summarise(customer_runs(spark, sf_dir), customer_findings(spark, sf_dir), RUN)
    none = F.col("c_nationkey") % 5 == 0
    runs = customer_runs(spark, sf_dir).join(verdicts, RUN).withColumns({"status": F.col("c_nationkey") % 3, "bringup_ok": F.when(~none, F.col("bringup_ok")), "signoff_ok": F.when(~none, F.col("signoff_ok"))})
    return M.banners(runs, RUN).withColumn("lines", F.array_join("lines", "\n"))


@query("""SELECT c_custkey, CASE WHEN length(c_name || c_mktsegment || c_name || c_mktsegment) > 30 THEN '...' || right(c_name || c_mktsegment || c_name || c_mktsegment, 27) ELSE c_name || c_mktsegment || c_name || c_mktsegment END AS short,
    CASE WHEN c_custkey % 3 = 0 THEN c_custkey || 'x' || c_nationkey END AS spec, '2026' || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || '05' || '010203' AS stamp, CASE WHEN c_custkey % 4 = 0 THEN 'v' || c_nationkey WHEN c_custkey % 4 = 1 THEN 'own' END AS version, c_custkey % 4 = 2 AS parse_error FROM customer""")
def told_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortened names, memories by name, stamps of files, versions out of version files."""
    key, customer = F.col("c_custkey"), table(spark, sf_dir, "customer")
    text = lambda c: F.col(c).cast("string")
    long_name = F.concat("c_name", "c_mktsegment", "c_name", "c_mktsegment")
    spec = F.concat(F.when(key % 3 == 0, "blk_mem_gen_").otherwise("other_"), text("c_custkey"), F.lit("x"), text("c_nationkey"))
    stamp = F.concat(F.lit("2026-"), F.lpad((key % 12 + 1).cast("string"), 2, "0"), F.lit("-05T01:02:03"))
    file = F.when(key % 4 == 0, F.concat(F.lit('{"version": "v'), text("c_nationkey"), F.lit('"}'))).when(key % 4 == 2, '{"version": ').otherwise("{}")
    versions = records.tool_versions(customer.select("c_custkey", file.alias("text")), ["c_custkey"])
    out = customer.select("c_custkey", shorten(long_name, 30).alias("short"), ip_spec(spec).alias("spec"), F.replace(file_stamp(stamp), F.lit("/"), F.lit("")).alias("stamp"))
    return out.join(versions, "c_custkey").withColumn("version", F.when(key % 4 == 1, F.coalesce("version", F.lit("own"))).otherwise(F.col("version")))


_RELEASE = "(['ubuntu', 'RHEL', 'arch', ''])[s_suppkey % 4 + 1]"


@query(f"""WITH r AS (SELECT s_suppkey, lower({_RELEASE}) AS os, '2' || s_nationkey % 3 || '.04' AS v, s_suppkey % 7 = 0 AS none FROM supplier)
    SELECT s_suppkey, CASE WHEN none OR os = '' THEN 'unknown' ELSE os END AS id, CASE WHEN none THEN '' ELSE v END AS version_id, CASE WHEN NOT none THEN 'name of ' || s_suppkey END AS pretty_name,
        CASE WHEN none OR os = '' THEN NULL ELSE os = 'ubuntu' AND v IN ('20.04', '22.04') END AS supported FROM r""")
def machine_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operating systems out of release files, some of which are not there."""
    key = F.col("s_suppkey")
    text = F.concat(F.lit("# release\nOther=1\nPRETTY_NAME=\"name of "), key.cast("string"), F.lit("\"\nID="), one_of(key % 4, ["ubuntu", "RHEL", "arch", ""]), F.lit("\nVERSION_ID='2"), (F.col("s_nationkey") % 3).cast("string"), F.lit(".04'\n"))
    files = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(key % 7 != 0, text).alias("text"))
    return facts.os_release(files, ["s_suppkey"])


@query("""WITH d AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new o' || o_orderkey ELSE 'o' || o_orderkey || '.v' END AS path FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY path) AS rn FROM d), n AS (SELECT o_custkey, count(*) AS n, string_agg(path, ',' ORDER BY path) FILTER (rn <= 3) AS paths FROM r GROUP BY 1)
    SELECT c_custkey AS o_custkey, c_nationkey % 5 <> 0 AS available, CASE WHEN c_nationkey % 5 <> 0 THEN left(sha256(c_name), 12) END AS short, CASE WHEN c_nationkey % 5 <> 0 THEN 'b' || c_nationkey END AS branch,
        CASE WHEN c_nationkey % 5 <> 0 THEN coalesce(n, 0) > 0 END AS dirty, CASE WHEN c_nationkey % 5 <> 0 THEN coalesce(n, 0) END AS dirty_file_count, CASE WHEN c_nationkey % 5 <> 0 THEN coalesce(paths, '') END AS dirty_files FROM customer LEFT JOIN n ON o_custkey = c_custkey""")
def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repositories say of themselves, some of which are none; three changed files are named, all are counted."""
    key = F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("R  old -> \"new o"), key, F.lit("\""))).otherwise(F.concat(F.lit(" M o"), key, F.lit(".v")))
    orders = table(spark, sf_dir, "orders").select(*RUN, line.alias("line"), "o_orderkey")
    statuses = orders.groupBy(*RUN).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n").alias("text"))
    there = F.col("c_nationkey") % 5 != 0
    heads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(there, F.sha2("c_name", 256)).alias("commit"), F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("branch"))
    return facts.repository_facts(heads, statuses, RUN, 3).drop("commit").withColumn("dirty_files", F.array_join("dirty_files", ","))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 AND o_orderkey % 3 < 2 THEN 'stage' || o_orderkey % 3 END AS stage, CASE WHEN o_orderkey % 3 < 2 THEN CASE o_orderkey % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN '-2' END END AS status,
    CASE WHEN o_orderkey % 4 = 3 THEN 'no status' WHEN o_orderkey % 3 = 2 THEN 'unknown stage' WHEN o_orderkey % 4 = 2 THEN 'no number' END AS error FROM orders""")
def status_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stages and their statuses out of arguments, some of which say nothing."""
    turn, name = F.col("o_orderkey") % 4, F.concat(F.lit("stage"), (F.col("o_orderkey") % 3).cast("string"))
    text = F.when(turn == 0, F.concat(name, F.lit("=skipped"))).when(turn == 1, F.concat(name, F.lit("= -2"))).when(turn == 2, F.concat(name, F.lit("=1=2"))).otherwise(name)
    stage, status, error = facts.status_argument(text, ["stage0", "stage1"])
    return table(spark, sf_dir, "orders").select("o_orderkey", stage.alias("stage"), status.alias("status"), error.alias("error"))


@query("""SELECT DISTINCT p_partkey % 50 AS k, '/s/p' || p_size || '.v' AS path FROM part WHERE p_partkey % 4 <> 3""")
def listed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain lists of paths, comments, blank lines and repeats left out, paths folded."""
    turn = F.col("p_partkey") % 4
    line = F.when(turn == 3, "# /s/none.v\n").when(turn == 2, F.concat(F.lit("\n  /s/./x/../p"), F.col("p_size").cast("string"), F.lit(".v "))).otherwise(F.concat(F.lit("/s//p"), F.col("p_size").cast("string"), F.lit(".v")))
    rows = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).alias("k")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    return filelists.path_list(rows, ["k"])
