"""Registered queries: each kernel over the given tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.columns import mask_tokens, normalise_column, severity_of, to_float, to_int
from auditlake.operators import joins as J
from auditlake.operators import rollups as R
from auditlake.operators.scratch import written
from auditlake.plans import rules as P
from auditlake.sources import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SEV = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'CRITICAL WARNING' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END"
_RANK = "CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END"


def _event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    kind = F.col("event_type")
    severity = F.when(kind == "error", "ERROR").when(kind == "purchase", "CRITICAL WARNING").when(kind == "signup", "WARNING").otherwise("INFO")
    return events.select("event_id", F.concat(F.lit("user "), (F.col("user_id") % 10).cast("string")).alias("id"), severity.alias("severity"), F.col("event_id").cast("string").alias("body"), F.when(F.col("value") > 150, "EXPENSIVE").when(F.col("value") > 100, "COSTLY").alias("risk_class"))


@query(f"""
    WITH m AS (SELECT event_id, 'user ' || (user_id % 10) AS id, {_SEV} AS severity, {_RANK} AS rank,
               CASE WHEN value > 150 THEN 'EXPENSIVE' WHEN value > 100 THEN 'COSTLY' END AS risk_class FROM events)
    SELECT id, count(*)::BIGINT AS n, arg_max(severity, rank) AS severity,
           arg_min(risk_class, event_id) FILTER (risk_class IS NOT NULL) AS risk_class,
           array_to_string(list_transform((list(event_id ORDER BY event_id))[1:3], lambda x: x::VARCHAR), ',') AS examples
    FROM m GROUP BY id""")
def log_class_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by id with worst severity, first class and three examples."""
    out = logs.summarise_messages(_event_messages(spark, sf_dir), [], ["event_id"])
    return out.select("id", "n", "severity", "risk_class", F.array_join("examples", ",").alias("examples"))


@query(f"""SELECT 'user ' || (user_id % 10) AS id, (count(*) FILTER ({_RANK} = 0))::BIGINT AS info, (count(*) FILTER ({_RANK} = 1))::BIGINT AS warning,
    (count(*) FILTER ({_RANK} = 2))::BIGINT AS critical_warning, (count(*) FILTER ({_RANK} = 3))::BIGINT AS error FROM events GROUP BY 1""")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    return logs.severity_counts(_event_messages(spark, sf_dir), ["id"])


@query("""SELECT CASE WHEN o_totalprice > 300000 THEN 'BLOCKER' WHEN o_orderstatus = 'F' THEN 'CRITICAL'
    WHEN o_orderpriority LIKE '1%' THEN 'WARNING' ELSE 'INFO' END AS severity, count(*)::BIGINT AS n FROM orders GROUP BY 1""")
def severity_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6."""
    o = table(spark, sf_dir, "orders")
    found = severity_of(F.col("o_totalprice") > 300000, F.col("o_orderstatus") == "F", F.col("o_orderpriority").startswith("1"))
    return o.groupBy(found.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, count(*)::BIGINT AS n_findings, (count(*) FILTER (l_quantity > 49))::BIGINT AS bringup_blocker_count,
    (count(*) FILTER (l_discount > 0.09))::BIGINT AS signoff_blocker_count, coalesce(bool_and(NOT l_quantity > 49), true) AS bringup_ok,
    coalesce(bool_and(NOT (l_quantity > 49 OR l_discount > 0.09)), true) AS signoff_ok FROM lineitem GROUP BY 1""")
def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    return R.verdict(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_quantity") > 49, F.col("l_discount") > 0.09)


@query("""WITH v AS (SELECT n_nationkey, count(s_suppkey) AS n, coalesce(bool_and(s_acctbal > -900), true) AS b, coalesce(bool_and(s_acctbal > 0), true) AS s,
           count(s_suppkey) > 0 AS ran FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT sum(n)::BIGINT AS n_findings, (count(*) FILTER (NOT ran))::BIGINT AS n_not_run, bool_and(b) AS bringup_ok, bool_and(s) AND count(*) FILTER (NOT ran) = 0 AS signoff_ok FROM v""")
def flow_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages (nations) that did not run bar sign-off."""
    v = R.verdict(table(spark, sf_dir, "supplier"), ["s_nationkey"], F.col("s_acctbal") <= -900, F.col("s_acctbal") <= 0)
    stages = table(spark, sf_dir, "nation").join(v, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return R.flow_rollup(stages.withColumn("ran", F.col("n_findings").isNotNull()))


@query("""SELECT coalesce(p.k, l.k) AS k, CASE WHEN l.k IS NULL THEN 'left_only' WHEN p.k IS NULL THEN 'right_only' ELSE 'both' END AS side
    FROM (SELECT DISTINCT p_partkey AS k FROM part) p FULL JOIN (SELECT DISTINCT l_suppkey AS k FROM lineitem) l ON p.k = l.k""")
def reconcile_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 of the keys of all parts with those of the suppliers of all lines."""
    return J.reconcile(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")), "k")


@query("""SELECT coalesce(c.k, o.k) AS k, CASE WHEN o.k IS NULL THEN 'left_only' WHEN c.k IS NULL THEN 'right_only' ELSE 'both' END AS side
    FROM (SELECT DISTINCT c_custkey AS k FROM customer) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.k = o.k""")
def reconcile_both_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 of all customers with all orders."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return J.reconcile(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def missing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return J.missing_refs(c, table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH u AS (SELECT DISTINCT l_partkey AS k FROM lineitem)
    SELECT k, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = k) THEN 'file_missing' ELSE 'undefined' END AS tier FROM u
    WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = k AND p_size > 10) AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = k AND p_type = 'ECONOMY')""")
def two_tier_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "k")
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"))
    return J.two_tier_missing(used, part.where("p_size > 10"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k", part.where("p_type = 'ECONOMY'"))


@query("""WITH a AS (SELECT c_custkey AS k, sha256(c_nationkey::VARCHAR) AS d FROM customer), b AS (SELECT p_partkey AS k, sha256((p_size % 25)::VARCHAR) AS d FROM part)
    SELECT k, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (k) WHERE a.d IS DISTINCT FROM b.d""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 of all customers, as files of one snapshot, with all parts, as those of the next."""
    side = lambda name, key, c: table(spark, sf_dir, name).select(F.col(key).alias("k"), F.sha2(c.cast("string"), 256).alias("d"))
    return J.manifest_diff(side("customer", "c_custkey", F.col("c_nationkey")), side("part", "p_partkey", F.col("p_size") % 25), "k", "d")


@query("""WITH a AS (SELECT p_partkey, sha256(p_size::VARCHAR) AS d FROM part),
    b AS (SELECT l_partkey AS p_partkey, sha256(max(l_quantity)::BIGINT::VARCHAR) AS d FROM lineitem GROUP BY 1)
    SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM a FULL JOIN b USING (p_partkey) WHERE a.d IS DISTINCT FROM b.d""")
def manifest_diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 of all parts with all lines: the size of a part against the largest quantity of its lines."""
    sha = lambda c: F.sha2(c.cast("string"), 256)
    a = table(spark, sf_dir, "part").select("p_partkey", sha(F.col("p_size")).alias("d"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(sha(F.max("l_quantity").cast("long")).alias("d"))
    return J.manifest_diff(a, b, "p_partkey", "d")


@query("SELECT n_regionkey, sha256(string_agg(n_name || chr(1) || n_nationkey || chr(1), '' ORDER BY n_name)) AS digest FROM nation GROUP BY 1")
def group_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return R.group_digest(table(spark, sf_dir, "nation"), ["n_regionkey"], F.col("n_name"), F.col("n_nationkey").cast("string"), "\x01")


@query("""SELECT conv_id, sha256(string_agg(turn || chr(1) || coalesce(sha256(text), 'MISSING') || chr(1), '' ORDER BY turn::VARCHAR, coalesce(sha256(text), 'MISSING'))) AS digest
    FROM conversations GROUP BY 1""")
def group_digest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 over a table that grows."""
    turns = table(spark, sf_dir, "conversations")
    return R.group_digest(turns, ["conv_id"], F.col("turn").cast("string"), F.sha2("text", 256), "\x01")


_WAIVERS = [(0, "error", {"user": "3"}, None), (1, "error", {}, "odd"), (2, "purchase", {"user": "5"}, "even"), (3, "purchase", {"user": "5", "none": ""}, None), (4, "signup", {"user": "1", "none": "x"}, None)]


@query("""WITH f AS (SELECT event_id, event_type AS id, (user_id % 10)::VARCHAR AS u, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS digest,
           event_type = 'error' AS bb, event_type IN ('error', 'purchase') AS bs FROM events),
    w AS (SELECT *, (id = 'error' AND (u = '3' OR digest = 'odd')) OR (id = 'purchase' AND u = '5') AS waived, id = 'error' AND u <> '3' AND digest <> 'odd' AS expired FROM f)
    SELECT event_id, waived, expired AND NOT waived AS expired, bb AND NOT waived AS blocks_bringup, bs AND NOT waived AS blocks_signoff FROM w""")
def waiver_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waivers bind to evidence; when it changes they expire."""
    kind = F.col("event_type")
    findings = table(spark, sf_dir, "events").select("event_id", kind.alias("id"), F.create_map(F.lit("user"), (F.col("user_id") % 10).cast("string")).alias("attrs"), F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("digest"), (kind == "error").alias("blocks_bringup"), kind.isin("error", "purchase").alias("blocks_signoff"))
    waivers = spark.createDataFrame(_WAIVERS, "ord int, id string, match map<string,string>, evidence_digest string")
    return J.apply_waivers(findings, waivers).select("event_id", "waived", "expired", "blocks_bringup", "blocks_signoff")


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS rn FROM documents) WHERE rn = 1")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("key"))
    return J.first_wins(docs, ["key"], [F.col("source"), F.col("doc_id")]).drop("key")


@query("SELECT sha256(text) AS key, array_to_string(list_transform(list(doc_id ORDER BY doc_id), lambda x: x::VARCHAR), ',') AS owners FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"), "doc_id")
    return R.owners(docs, "key", "doc_id").select("key", F.array_join(F.transform("owners", lambda x: x.cast("string")), ",").alias("owners"))


@query("SELECT DISTINCT sha256(text) AS key, doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT doc_id) > 1)")
def duplicate_owner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, a row for each owner."""
    return R.owner_rows(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"), "doc_id"), "key", "doc_id")


@query("SELECT n_nationkey, n_name, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS checked FROM nation")
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was not checked says so."""
    have = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), (F.col("s_acctbal") > 5000).alias("available"))
    return J.coverage(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), have, ["n_nationkey"])


@query("""WITH p AS (SELECT p_brand, count(*) AS n, count(*) FILTER (p_type LIKE 'PROMO%' AND p_size > 25) AS o, count(*) FILTER (p_type LIKE 'PROMO%' AND p_size <= 25) AS w FROM part GROUP BY 1)
    SELECT p_brand, CASE WHEN n < 2 THEN 'NOT CHECKED' WHEN o > 0 THEN 'FAIL' WHEN w > 0 THEN 'WAIVED' ELSE 'PASS' END AS status FROM p""")
def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, J14."""
    promo = F.col("p_type").startswith("PROMO")
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(promo & (F.col("p_size") > 25)).alias("o"), F.count_if(promo & (F.col("p_size") <= 25)).alias("w"))
    return p.select("p_brand", P.checklist_status(F.col("n") >= 2, F.col("o"), F.col("w")).alias("status"))


@query("""WITH r AS (SELECT o_orderstatus, date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, count(*) AS orders FROM orders GROUP BY ALL),
    d AS (SELECT *, lag(orders) OVER (PARTITION BY o_orderstatus ORDER BY month) AS previous FROM r)
    SELECT o_orderstatus, month, orders, previous, orders - previous AS delta,
           CASE WHEN previous IS NULL THEN NULL WHEN orders = previous THEN 'same' WHEN orders > previous THEN 'better' ELSE 'worse' END AS direction FROM d""")
def trend_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, W2."""
    month = F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd")
    runs = table(spark, sf_dir, "orders").groupBy("o_orderstatus", month.alias("month")).agg(F.count(F.lit(1)).alias("orders"))
    return R.trend(runs, ["o_orderstatus"], "month", "orders", True)


@query("""SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INTEGER AS place,
    count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE place <= 8 AND n >= 2""")
def last_n_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    return R.last_runs(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], [F.desc("event_id")]).select("user_id", "event_id", "place")


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'error'), days AS (SELECT DISTINCT day FROM d)
    SELECT day::VARCHAR AS day, (SELECT count(*) FROM d x WHERE x.day = days.day AND NOT EXISTS (SELECT 1 FROM d y WHERE y.day = days.day - 1 AND y.user_id = x.user_id))::BIGINT AS n_new,
           (SELECT count(*) FROM d x WHERE x.day = days.day - 1 AND NOT EXISTS (SELECT 1 FROM d y WHERE y.day = days.day AND y.user_id = x.user_id))::BIGINT AS n_gone FROM days""")
def endpoint_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19 as rows: ids of a day against those of the day before; nothing is gathered into arrays."""
    day = F.to_date("ts")
    seen = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", day.alias("day")).distinct()
    days = seen.select("day").distinct()
    moved = seen.select("user_id", "day", F.lit(1).alias("now")).unionByName(seen.select("user_id", F.date_add("day", 1).alias("day"), F.lit(0).alias("now")))
    state = moved.groupBy("day", "user_id").agg(F.max("now").alias("now"), F.min("now").alias("before"))
    counts = state.groupBy("day").agg(F.count_if(F.col("before") == 1).alias("n_new"), F.count_if(F.col("now") == 0).alias("n_gone"))
    return counts.join(days, "day").select(F.col("day").cast("string").alias("day"), "n_new", "n_gone")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def worst_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 overall."""
    return R.worst(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 20, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")])


@query("""SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INTEGER AS place FROM lineitem) WHERE place <= 3""")
def worst_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 by key."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return R.worst(rows, 3, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], ["l_suppkey"]).drop("l_extendedprice")


@query("SELECT p_brand, arg_max(p_name, (p_retailprice, p_partkey)) AS p_name, max(p_retailprice) AS top FROM part GROUP BY 1")
def max_by_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_name", F.struct("p_retailprice", "p_partkey")).alias("p_name"), F.max("p_retailprice").alias("top"))


_GLOBS = ["*widget", "cold*", "?mall *", "[a-h]*", "[!a-h]*", "*none*"]


@query("""SELECT g.pattern, count(p_partkey)::BIGINT AS hits FROM (VALUES ('*widget', '%widget', NULL), ('cold*', 'cold%', NULL), ('?mall *', '_mall %', NULL), ('[a-h]*', NULL, '^[a-h]'), ('[!a-h]*', NULL, '^[^a-h]'), ('*none*', '%none%', NULL)) g(pattern, lk, rx)
    LEFT JOIN part ON CASE WHEN lk IS NULL THEN regexp_matches(p_name, rx) ELSE p_name LIKE lk END GROUP BY 1""")
def glob_exclude_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, A14."""
    return J.glob_hits(table(spark, sf_dir, "part").select("p_name"), "p_name", _GLOBS)


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '<' || p_size || '%' WHEN 1 THEN 'N/A' WHEN 2 THEN p_size || ',' || '000' WHEN 3 THEN '-' WHEN 4 THEN '~' || p_size || '.75' ELSE p_brand END AS raw FROM part)
    SELECT p_partkey, CASE WHEN upper(trim(raw)) IN ('', 'NA', 'N/A', '-', '--') THEN NULL ELSE TRY_CAST(ltrim(trim(regexp_replace(raw, '[%,]', '', 'g')), '<>~') AS DOUBLE) END AS number,
           CASE WHEN upper(trim(raw)) IN ('', 'NA', 'N/A', '-', '--') THEN NULL ELSE trunc(TRY_CAST(ltrim(trim(regexp_replace(raw, '[%,]', '', 'g')), '<>~') AS DOUBLE))::BIGINT END AS whole,
           lower(trim(regexp_replace(raw, '[^0-9A-Za-z]+', '_', 'g'), '_')) AS key FROM t""")
def numeric_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F3, F4 over cells as reports write them."""
    size, turn = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    raw = F.when(turn == 0, F.concat(F.lit("<"), size, F.lit("%"))).when(turn == 1, "N/A").when(turn == 2, F.concat(size, F.lit(",000"))).when(turn == 3, "-").when(turn == 4, F.concat(F.lit("~"), size, F.lit(".75"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", to_float(F.col("raw")).alias("number"), to_int(F.col("raw")).alias("whole"), normalise_column(F.col("raw")).alias("key"))


@query("""WITH b AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM conversations)
    SELECT conv_id, block::BIGINT AS block, min(turn) AS line_start, max(turn) AS line_end, count(*)::BIGINT AS n FROM b GROUP BY ALL""")
def violation_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, S7."""
    rows = R.islands(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", F.col("role") == "user")
    return rows.groupBy("conv_id", "block").agg(F.min("turn").alias("line_start"), F.max("turn").alias("line_end"), F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked,
    last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS near FROM conversations""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5, S4."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    asked = F.when(F.col("role") == "user", F.col("turn"))
    return R.carry_forward(R.carry_forward(rows, ["conv_id"], "turn", asked, "asked"), ["conv_id"], "turn", asked, "near", 7).drop("role")


_TAGS = ["html", "head", "body", "meta", "title", "style", "script"]


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
    SELECT tag, count(DISTINCT page_id)::BIGINT AS pages, count(*)::BIGINT AS uses FROM t WHERE tag NOT IN ('html', 'head', 'body', 'meta', 'title', 'style', 'script') GROUP BY 1""")
def html_tag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments off, names by pattern, keywords out, owners counted. Pages are counted from (name,
    page) partial sums, so no name's pages meet in one task."""
    body = F.regexp_replace("html", r"(?s)<!--.*?-->", " ")
    uses = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(body, F.lit("<([a-z][a-z0-9]*)"))).alias("tag")).where(~F.col("tag").isin(_TAGS))
    each = uses.groupBy("tag", "page_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("tag").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("uses"))


@query(r"""WITH l AS (SELECT page_id, 'cell ' || url || ' at bus_' || page_id || '[' || (page_id % 8) || ']/q and  reg[' || page_id || ']_x |  [3] C:\\work\\' || page_id || ' ok[a]' AS line FROM pages)
    SELECT page_id, regexp_replace(regexp_replace(line, '\S*[/\\]\S*', '<name>', 'g'), '\S+\[\d+\]\S*', '<name>', 'g') AS masked FROM l""")
def mask_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16."""
    page = F.col("page_id").cast("string")
    line = F.concat(F.lit("cell "), F.col("url"), F.lit(" at bus_"), page, F.lit("["), (F.col("page_id") % 8).cast("string"), F.lit("]/q and  reg["), page, F.lit("]_x |  [3] C:\\work\\"), page, F.lit(" ok[a]"))
    return table(spark, sf_dir, "pages").select("page_id", mask_tokens(line).alias("masked"))


@query("""SELECT c.conv_id, s.line_start, s.line_end, sha256(string_agg(c.text, chr(10) ORDER BY c.turn)) AS block FROM conversations c
    JOIN (SELECT conv_id, min(turn) + 1 AS line_start, max(turn) - 1 AS line_end FROM conversations GROUP BY 1) s ON s.conv_id = c.conv_id AND c.turn BETWEEN s.line_start AND s.line_end GROUP BY ALL""")
def range_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18, S15."""
    rows = table(spark, sf_dir, "conversations")
    spans = rows.groupBy("conv_id").agg((F.min("turn") + 1).alias("line_start"), (F.max("turn") - 1).alias("line_end"))
    out = J.drill_down(spans, rows.select("conv_id", F.col("turn").alias("ln"), F.col("text").alias("value")), "conv_id")
    return R.ordered_digest(out, ["conv_id", "line_start", "line_end"], [F.col("ln"), F.col("value")], F.col("value"), "\n", "block")


_FIELDS = ["s_name", "s_nationkey", "s_acctbal"]


@query("""WITH l AS (SELECT k, field, value FROM (SELECT s_suppkey AS k, s_name AS name, s_nationkey::VARCHAR AS nation, (s_acctbal > 0)::VARCHAR AS balance FROM supplier) UNPIVOT (value FOR field IN (name, nation, balance))),
    r AS (SELECT k, field, value FROM (SELECT c_custkey AS k, c_name AS name, c_nationkey::VARCHAR AS nation, (c_acctbal > 0)::VARCHAR AS balance FROM customer) UNPIVOT (value FOR field IN (name, nation, balance)))
    SELECT k, field, l.value AS was, r.value AS now, l.value <> r.value AS changed FROM l JOIN r USING (k, field)""")
def env_unpivot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier, as an environment, against the customer of its key."""
    def side(name: str, c: str, key: str) -> DataFrame:
        fields = table(spark, sf_dir, name).select(F.col(key).alias("k"), F.col(f"{c}_name").alias("name"), F.col(f"{c}_nationkey").cast("string").alias("nation"), (F.col(f"{c}_acctbal") > 0).cast("string").alias("balance"))
        return fields.unpivot(["k"], ["name", "nation", "balance"], "field", "value")

    return J.field_changes(side("supplier", "s", "s_suppkey"), side("customer", "c", "c_custkey"), ["k"])


@query("""WITH l AS (SELECT s_suppkey, field, value FROM (SELECT s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey, (s_acctbal > 0)::VARCHAR AS s_acctbal FROM supplier) UNPIVOT (value FOR field IN (s_name, s_nationkey, s_acctbal))),
    p AS (SELECT s_suppkey, field, lag(value) OVER (PARTITION BY field ORDER BY s_suppkey) AS was, value AS now FROM l)
    SELECT s_suppkey, field, was, now, was <> now AS changed FROM p WHERE was IS NOT NULL""")
def env_unpivot_diff_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15 over the whole table: every supplier against the one before it."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("s_nationkey"), (F.col("s_acctbal") > 0).cast("string").alias("s_acctbal"))
    long = s.unpivot(["s_suppkey"], _FIELDS, "field", "value")
    steps = J.with_previous(s, "s_suppkey", "_previous")
    previous = steps.join(long.withColumnRenamed("s_suppkey", "_previous"), "_previous")
    return J.field_changes(previous, long, ["s_suppkey"])


@query("""SELECT o_orderstatus, round(count(*) FILTER (o_totalprice > 200000) / nullif(count(*) FILTER (o_orderpriority = '1-URGENT'), 0), 6) AS ratio,
    round(count(*) / (SELECT count(*) FROM lineitem), 6) AS per_line FROM orders GROUP BY 1""")
def scalar_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, A17."""
    lines = table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("lines"))
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 200000).alias("a"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("b"), F.count(F.lit(1)).alias("n"))
    return o.join(F.broadcast(lines)).select("o_orderstatus", F.round(R.share(F.col("a"), F.col("b")), 6).alias("ratio"), F.round(R.share(F.col("n"), F.col("lines")), 6).alias("per_line"))


@query("""WITH RECURSIVE up(k, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT k, node // 2, depth + 1 FROM up WHERE node > 0 AND depth < 16)
    SELECT node AS p_partkey, min(depth)::INTEGER AS depth, count(*)::BIGINT AS reached FROM up GROUP BY 1""")
def recursive_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: every part's chain of parents to depth 16. Rows that meet are counted and go on as one, so a
    round never has more rows than there are keys; each level is written, and the rounds end with it."""
    level = written(table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("at")).agg(F.count(F.lit(1)).alias("n")).withColumn("depth", F.lit(0)), "level")
    out = level
    for depth in range(1, 17):
        level = level.where("at > 0").groupBy(F.floor(F.col("at") / 2).alias("at")).agg(F.sum("n").alias("n"))
        level = written(level.withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.groupBy(F.col("at").alias("p_partkey")).agg(F.min("depth").alias("depth"), F.sum("n").alias("reached"))


@query("""SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
    UNION ALL SELECT 'both', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
    UNION ALL SELECT 'left', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1-U5."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    parts = {"union": c.union(s).distinct(), "both": c.intersect(s), "left": c.subtract(s)}
    out = [df.select(F.lit(op).alias("op"), "k") for op, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH f AS (SELECT l_suppkey, round(min(l_discount - 0.02), 6) AS wns, max(l_quantity) AS route_pct, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT l_suppkey, 'TIMING.SETUP_SEVERE' AS id, 'BLOCKER' AS severity FROM f WHERE wns < -0.015
    UNION ALL SELECT l_suppkey, 'TIMING.SETUP_VIOLATION', 'CRITICAL' FROM f WHERE wns < 0 AND NOT wns < -0.015
    UNION ALL SELECT l_suppkey, 'TIMING.ROUTE_DOMINATED', 'WARNING' FROM f WHERE route_pct > 49
    UNION ALL SELECT l_suppkey, 'TIMING.DEEP_LOGIC', 'WARNING' FROM f WHERE n > 600""")
def timing_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.10 timing family: all rules over each row of facts in one pass."""
    facts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.min(F.col("l_discount") - 0.02), 6).alias("wns"), F.max("l_quantity").alias("route_pct"), F.count(F.lit(1)).alias("logic_levels"))
    none = {c: F.lit(None).cast("double") for c in ("whs", "wpws", "no_clock", "loops", "latch_loops", "unconstrained", "tns_total_endpoints", "no_io_delay")}
    facts = facts.withColumns(none | {"period": F.lit(0.15)})
    return P.findings_of(facts, ["l_suppkey"], P.timing_rules(False, {"route_dominated_percent": 49.0, "deep_logic_levels": 600}), "timing").select("l_suppkey", "id", "severity")
