"""Registered queries over file lists, sources, projects, environments and histories made from the given tables in Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.columns import os_supported, porcelain_path
from auditlake.operators import joins as J
from auditlake.operators import rollups as R
from auditlake.operators.scratch import scratch_root
from auditlake.plans import rules as P
from auditlake.queries import query, table
from auditlake.report_queries import _L, RUN, order_lines, text_of, texts
from auditlake.sources import filelists, records

# --- file lists --------------------------------------------------------------------------------

_ENTRIES = """e AS (SELECT l_orderkey, '/p/o' || l_orderkey || '.f' AS path, pos - 1 AS ord, (['incdir', 'define', 'list', 'file'])[pos % 4 + 1] AS kind,
    CASE pos % 4 WHEN 0 THEN '/inc' || l_suppkey WHEN 1 THEN 'W=' || l_quantity::BIGINT WHEN 2 THEN '/p/sub/o' || l_orderkey // 2 || '.f' ELSE '/p/src/p' || l_partkey || '.v' END AS value FROM l)"""


def list_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit, turn = F.lit, F.col("pos") % 4
    line = (
        F.when(turn == 0, F.concat(lit("+incdir+../inc"), text_of("l_suppkey")))
        .when(turn == 1, F.concat(lit("+define+W="), text_of("l_quantity"), lit(" -quiet # note")))
        .when(turn == 2, F.concat(lit("-f\n  sub/./o"), F.floor(F.col("l_orderkey") / 2).cast("string"), lit(".f")))
        .otherwise(F.concat(lit("lib/../src//p"), text_of("l_partkey"), lit(".v // x.v")))
    )
    found = texts(order_lines(spark, sf_dir), RUN, line, "// list\n\n")
    return found.select(*RUN, F.concat(lit("/p/o"), text_of("l_orderkey"), lit(".f")).alias("path"), "text")


@query(f"WITH {_L}, {_ENTRIES} SELECT path, ord::INTEGER AS ord, kind, value FROM e")
def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of lists, relative to the list that names them."""
    return filelists.list_entries(list_texts(spark, sf_dir))


@query(f"WITH {_L}, {_ENTRIES} SELECT path, count(DISTINCT value) FILTER (kind = 'file') AS file_count, count(DISTINCT value) FILTER (kind = 'incdir') AS incdir_count FROM e GROUP BY 1")
def list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, O6."""
    return filelists.list_counts(filelists.list_entries(list_texts(spark, sf_dir)))


@query("""WITH RECURSIVE roots AS (SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT p_partkey // 3 FROM part)),
    up(k, depth) AS (SELECT k, 0 FROM roots UNION ALL SELECT k // 3, depth + 1 FROM up WHERE depth < 16 AND k IN (SELECT p_partkey FROM part))
    SELECT '/l/' || k || '.f' AS path, min(depth)::INTEGER AS depth FROM up GROUP BY 1""")
def nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that name lists, from those that none names, each at its least depth; the root list names itself."""
    part = table(spark, sf_dir, "part")
    path = lambda k: F.concat(F.lit("/l/"), k.cast("string"), F.lit(".f"))
    entries = filelists.list_entries(part.select(path(F.col("p_partkey")).alias("path"), F.concat(F.lit("-F ./"), F.floor(F.col("p_partkey") / 3).cast("string"), F.lit(".f")).alias("text")))
    roots = part.select(path(F.col("p_partkey")).alias("path")).join(entries.select(F.col("value").alias("path")), "path", "left_anti")
    return filelists.reached_lists(roots, entries)


@query(f"""WITH {_L} SELECT '/t/o' || l_orderkey || '.tcl' AS path, CASE pos % 3 WHEN 0 THEN '/t/my p' || l_partkey || '.v' ELSE '/t/c' || l_suppkey || '.xdc' END AS value FROM l WHERE pos % 3 <> 2""")
def tcl_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of Tcl commands, quoted and after options that take a value."""
    lit, turn = F.lit, F.col("pos") % 3
    line = F.when(turn == 0, F.concat(lit("add_files -fileset sources_1 -norecurse {my p"), text_of("l_partkey"), lit(".v}"))).when(turn == 1, F.concat(lit('read_xdc -quiet "c'), text_of("l_suppkey"), lit('.xdc" # last'))).otherwise("puts x.v")
    found = texts(order_lines(spark, sf_dir), RUN, line)
    return filelists.tcl_entries(found.select(F.concat(lit("/t/o"), text_of("l_orderkey"), lit(".tcl")).alias("path"), "text")).select("path", "value")


# --- sources -----------------------------------------------------------------------------------

_EDGES = """u AS (SELECT DISTINCT '/s/o' || l_orderkey || '.v' AS path, 'm' || 8 * l_partkey AS module FROM l),
    d AS (SELECT DISTINCT '/s/o' || l_orderkey || '.v' AS path, 'm' || l_orderkey AS module FROM l),
    own AS (SELECT module FROM (SELECT module, path, max(a) AS a, max(b) AS b FROM (SELECT module, path, 1 AS a, 0 AS b FROM d UNION ALL SELECT module, path, 0, 1 FROM u) GROUP BY ALL) GROUP BY 1 HAVING min(least(a, b)) = 1),
    edges AS (SELECT path, module, 'declares' AS edge FROM d UNION ALL SELECT path, module, 'instantiates' FROM u WHERE module NOT IN (SELECT module FROM own))"""


def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = F.lit
    use = F.concat(lit("  m"), (8 * F.col("l_partkey")).cast("string"), F.when(F.col("pos") % 3 == 0, " #(\n    .W(3), .F(f(1))) ").when(F.col("pos") % 3 == 1, " ").otherwise(" #( .D ( 2 ) ) "), lit("u"), text_of("pos"), F.when(F.col("pos") % 2 == 0, " [3:0] (.a(x));").otherwise("(.a(x));"))
    noise = lit("\n  // gone g (\n  /* also\n  h u (1); */\n  if (x) y = z(1);\n  assign q = r (2);\n")
    found = texts(order_lines(spark, sf_dir), RUN, F.concat(use, noise), F.concat(lit("// head\nmodule m"), text_of("l_orderkey"), lit(" (input a);\n")), "endmodule\n")
    return found.select(*RUN, F.concat(lit("/s/o"), text_of("l_orderkey"), lit(".v")).alias("path"), "text")


@query(f"WITH {_L}, {_EDGES} SELECT * FROM edges")
def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sources declare and instantiate."""
    return filelists.module_edges(source_texts(spark, sf_dir))


@query(f"""WITH {_L}, {_EDGES}, inside AS (SELECT '/s/o' || o_orderkey || '.v' AS path FROM orders WHERE o_orderstatus = 'F'),
    a AS (SELECT DISTINCT module FROM edges WHERE edge = 'instantiates' AND path IN (SELECT path FROM inside)), b AS (SELECT module FROM edges WHERE edge = 'declares' AND path IN (SELECT path FROM inside)), c AS (SELECT module FROM edges WHERE edge = 'declares' AND path NOT IN (SELECT path FROM inside))
    SELECT module, CASE WHEN module IN (SELECT module FROM c) THEN 'file_missing' ELSE 'undefined' END AS tier FROM a WHERE module NOT IN (SELECT module FROM b) AND module <> 'm0'""")
def missing_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that the build uses and does not declare; stems of IP files are no gaps."""
    edges = filelists.module_edges(source_texts(spark, sf_dir))
    inside = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("/s/o"), F.col("o_orderkey").cast("string"), F.lit(".v")).alias("path"))
    here = edges.join(inside, "path", "left_semi")
    elsewhere = edges.where("edge = 'declares'").join(inside, "path", "left_anti").select("module")
    ignored = filelists.ignored_modules(spark.createDataFrame([("none",)], "module string"), table(spark, sf_dir, "region").select(F.concat(F.lit("/ip/m"), F.col("r_regionkey").cast("string"), F.lit(".xci")).alias("path")).where("path LIKE '%m0.xci'"))
    return J.two_tier_missing(here.where("edge = 'instantiates'").select("module"), here.where("edge = 'declares'").select("module"), elsewhere, "module", ignored)


@query(f"""WITH {_L}, {_ENTRIES}, have AS (SELECT '/p/src/p' || p_partkey || '.v' AS value FROM part WHERE p_size > 10), dirs AS (SELECT '/inc' || s_suppkey AS value FROM supplier WHERE s_acctbal > 0),
    n AS (SELECT l_orderkey, count(DISTINCT value) FILTER (kind = 'file' AND value NOT IN (SELECT value FROM have)) AS f, count(DISTINCT value) FILTER (kind = 'incdir' AND value NOT IN (SELECT value FROM dirs)) AS i FROM e GROUP BY 1)
    SELECT path, id, severity, evidence FROM (SELECT '/p/o' || l_orderkey || '.f' AS path, 'FILELIST.MISSING_FILE' AS id, 'BLOCKER' AS severity, '{{"n_missing_file":' || f || '}}' AS evidence FROM n WHERE f > 0
        UNION ALL SELECT '/p/o' || l_orderkey || '.f', 'FILELIST.MISSING_INCDIR', 'BLOCKER', '{{"n_missing_incdir":' || i || '}}' FROM n WHERE i > 0
        UNION ALL SELECT '/p/o' || l_orderkey || '.f', 'FILELIST.TOP_NOT_FOUND', 'BLOCKER', '{{}}' FROM n WHERE l_orderkey % 3 = 1
        UNION ALL SELECT '/p/o' || l_orderkey || '.f', 'FILELIST.PROJECT_NOT_CHECKED', 'CRITICAL', '{{}}' FROM n WHERE l_orderkey % 4 = 0 UNION ALL SELECT '/p/o' || l_orderkey || '.f', 'FILELIST.PROJECT_MISMATCH', 'BLOCKER', '{{}}' FROM n WHERE l_orderkey % 4 = 1)""")
def list_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, A16, FILELIST.*: listed files and folders that are not there, tops and projects."""
    entries = filelists.list_entries(list_texts(spark, sf_dir))
    files = table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("/p/src/p"), F.col("p_partkey").cast("string"), F.lit(".v")).alias("value"))
    dirs = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("/inc"), F.col("s_suppkey").cast("string")).alias("value"))
    gone = J.missing_refs(entries.where("kind = 'file'"), files, "value").unionByName(J.missing_refs(entries.where("kind = 'incdir'"), dirs, "value"))
    counts = filelists.list_counts(gone).select("path", F.col("file_count").alias("n_missing_file"), F.col("incdir_count").alias("n_missing_incdir"))
    key = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    none = {c: F.lit(0) for c in ("n_file_missing", "n_undefined", "n_duplicate")}
    facts = entries.select("path").distinct().join(counts, "path", "left").withColumns(none | {"top_found": F.when(key % 3 == 0, True).when(key % 3 == 1, False), "consistent": F.when(key % 4 == 1, False).when(key % 4 > 1, True)})
    return P.findings_of(facts, ["path"], P.filelist_rules(), "filelist").select("path", "id", "severity", "evidence")


@query("SELECT o_custkey, 'FILELIST.PARSE_ERROR' AS id, '{\"error\":\"line ' || o_orderkey || '\"}' AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 5")
def list_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FILELIST.PARSE_ERROR: a finding for each of the first five errors of a list."""
    rows = R.last_runs(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 5, 1)
    facts = rows.select("o_custkey", (F.col("place") - 1).alias("ord"), F.concat(F.lit("line "), F.col("o_orderkey").cast("string")).alias("error"))
    return P.findings_of(facts, ["o_custkey"], P.filelist_error_rules(), "filelist").select("o_custkey", "id", "evidence")


# --- projects and inputs -----------------------------------------------------------------------

_SETS = "CASE l_returnflag WHEN 'A' THEN 'sources_1' WHEN 'N' THEN 'constrs_1' ELSE 'sim_1' END"


def project_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = F.lit
    name = F.when(F.col("l_returnflag") == "A", "sources_1").when(F.col("l_returnflag") == "N", "constrs_1").otherwise("sim_1")
    path = F.when(F.col("pos") % 2 == 0, F.concat(lit("$PPRDIR/../src/p"), text_of("l_partkey"), lit(".v"))).otherwise(F.concat(lit("$PSRCDIR/ip/x"), text_of("l_suppkey"), lit(".xci")))
    rows = order_lines(spark, sf_dir).withColumn("set", name)
    sets = texts(rows, [*RUN, "set"], F.concat(lit('<File Path="'), path, lit('"><FileInfo/></File>')))
    option = F.when(F.col("set") == "sources_1", '<Config><Option Name="Other" Val="1"/><Option Name="TopModule" Val="top"/></Config>').otherwise("<Config/>")
    one = sets.select(*RUN, F.concat(lit('<FileSet Name="'), F.col("set"), lit('">'), "text", option, lit("</FileSet>")).alias("v"), F.col("set").alias("pos"))
    whole = texts(one, RUN, F.col("v"), "<Project Version=\"7\"><FileSets Version=\"1\">", "</FileSets></Project>")
    return whole.select(*RUN, F.concat(lit("/w/prj/o"), text_of("l_orderkey"), lit(".xpr")).alias("path"), "text")


@query(f"""WITH {_L} SELECT '/w/prj/o' || l_orderkey || '.xpr' AS path, {_SETS} AS fileset, CASE l_returnflag WHEN 'A' THEN 'source' WHEN 'N' THEN 'constraint' ELSE 'simulation' END AS kind,
    CASE pos % 2 WHEN 0 THEN '/w/src/p' || l_partkey || '.v' ELSE '/w/prj/o' || l_orderkey || '.srcs/ip/x' || l_suppkey || '.xci' END AS value FROM l""")
def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of projects by kind of their set, variables replaced."""
    return filelists.project_files(project_texts(spark, sf_dir))


@query("SELECT '/w/prj/o' || l_orderkey || '.xpr' AS path, CASE WHEN bool_or(l_returnflag = 'A') THEN 'top' END AS top FROM lineitem GROUP BY l_orderkey")
def project_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first top module."""
    return filelists.project_tops(project_texts(spark, sf_dir))


@query("SELECT DISTINCT '/r/src/./p' || l_partkey || '.v' AS path FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40")
def dirty_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of the runs that the repository's status lines call changed."""
    inputs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("/r/src/./p"), F.col("l_partkey").cast("string"), F.lit(".v")).alias("path")).distinct()
    name = F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".v"))
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" M "), name)).otherwise(F.concat(F.lit('R  old -> "'), name, F.lit('"')))
    return J.dirty_inputs(inputs, table(spark, sf_dir, "part").where("p_size > 40").select(porcelain_path(line).alias("path")), "/r")


@query("""SELECT o_orderkey, id, severity, evidence FROM (SELECT o_orderkey, 'PROV.DIRTY_INPUTS' AS id, 'CRITICAL' AS severity, '{"n_dirty":' || o_orderkey % 3 || '}' AS evidence FROM orders WHERE o_orderkey % 3 > 0
    UNION ALL SELECT o_orderkey, 'PROV.PREFLIGHT_WARNINGS', 'WARNING', '{"n_warnings":' || o_orderkey % 4 || '}' FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT o_orderkey, 'BITSTREAM.MISSING', 'BLOCKER', '{}' FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000)""")
def provenance_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PROV.*, BITSTREAM."""
    key = F.col("o_orderkey")
    facts = table(spark, sf_dir, "orders").select("o_orderkey", (key % 3).alias("n_dirty"), (key % 4).alias("n_warnings"), (F.col("o_orderstatus") == "F").alias("requested"), (F.col("o_totalprice") >= 100000).alias("present"))
    return P.findings_of(facts, ["o_orderkey"], P.provenance_rules() + P.bitstream_rules(), "manifest").select("o_orderkey", "id", "severity", "evidence")


@query("""WITH s AS (SELECT DISTINCT p_size || 'x' || p_partkey % 4 AS spec FROM part), m AS (SELECT s_nationkey || 'x' || s_suppkey % 4 AS spec, bool_or(s_acctbal > 3000) AS o FROM supplier GROUP BY 1)
    SELECT spec, CASE WHEN o IS NULL THEN 'missing' WHEN NOT o THEN 'no output' ELSE 'made' END AS state FROM s LEFT JOIN m USING (spec)""")
def produced_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked-for memories, once each, and what became of them."""
    lines = table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "x").otherwise("X"), (F.col("p_partkey") % 4).cast("string"), F.lit(" ")).alias("value"))
    made = table(spark, sf_dir, "supplier").select(F.concat_ws("x", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 4).cast("string")).alias("spec"), (F.col("s_acctbal") > 3000).alias("has_output"))
    return J.produced(J.specs_of(lines).where("NOT bad"), made)


# --- environments, histories, waivers ----------------------------------------------------------

_OS = "(['ubuntu', 'rhel', 'arch', ''])[s_nationkey % 4 + 1]"
_VERSION = "(['22.04', '8.7', '8', '80'])[s_suppkey % 4 + 1]"


@query(f"""WITH e AS (SELECT s_suppkey, s_nationkey::VARCHAR AS tool, {_OS} AS os, {_VERSION} AS version FROM supplier),
    p AS (SELECT *, lag(tool) OVER w AS t, lag(os) OVER w AS o, lag(version) OVER w AS v FROM e WINDOW w AS (ORDER BY s_suppkey))
    SELECT s_suppkey, 'ENV.VIVADO_CHANGED' AS id, 'CRITICAL' AS severity FROM p WHERE t <> tool
    UNION ALL SELECT s_suppkey, 'ENV.OS_CHANGED', 'WARNING' FROM p WHERE (o <> os AND o <> '' AND os <> '') OR v <> version
    UNION ALL SELECT s_suppkey, 'ENV.OS_UNSUPPORTED', 'WARNING' FROM p WHERE os <> '' AND NOT ((os = 'ubuntu' AND version = '22.04') OR (os = 'rhel' AND version IN ('8', '8.7')))""")
def environment_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, P11, P13, ENV.*: each supplier as an environment, against the one before it."""
    pick = lambda c, values: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % 4).cast("int") + 1)
    env = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("tool"), pick("s_nationkey", ["ubuntu", "rhel", "arch", ""]).alias("os.id"), pick("s_suppkey", ["22.04", "8.7", "8", "80"]).alias("os.version_id"))
    long = env.unpivot(["s_suppkey"], ["tool", "`os.id`", "`os.version_id`"], "field", "value").withColumn("field", F.btrim("field", F.lit("`")))
    steps = J.with_previous(env, "s_suppkey", "_previous")
    moved = J.field_changes(steps.join(long.withColumnRenamed("s_suppkey", "_previous"), "_previous"), long, ["s_suppkey"])
    flags = moved.groupBy("s_suppkey").agg(F.bool_or(F.col("changed") & (F.col("field") == "tool")).alias("tool_changed"), F.bool_or(F.col("changed") & F.startswith("field", F.lit("os."))).alias("os_changed"))
    facts = env.select("s_suppkey", os_supported(F.col("`os.id`"), F.col("`os.version_id`")).alias("os_supported")).join(flags, "s_suppkey", "left")
    return P.findings_of(facts, ["s_suppkey"], P.environment_rules(), "environment").select("s_suppkey", "id", "severity")


@query("""WITH r AS (SELECT o_custkey, o_orderkey AS seq, round((o_totalprice - 250000) / 100000, 3) + 0 AS wns FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 10 <> 7),
    t AS (SELECT *, lag(wns) OVER (PARTITION BY o_custkey ORDER BY seq) AS previous, row_number() OVER (PARTITION BY o_custkey ORDER BY seq DESC) AS rn FROM r)
    SELECT o_custkey, seq, wns, previous, CASE WHEN previous IS NULL THEN NULL WHEN abs(wns - previous) <= 1e-9 THEN 'same' WHEN wns > previous THEN 'better' ELSE 'worse' END AS direction FROM t WHERE rn <= 8""")
def history_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records as JSON lines, some cut off; the last eight of each customer with their direction."""
    orders = table(spark, sf_dir, "orders")
    record = F.to_json(F.struct(F.when(F.col("o_orderstatus") == "P", "synth").otherwise("impl").alias("stage"), F.col("o_orderkey").alias("seq"), F.round((F.col("o_totalprice") - 250000) / 100000, 3).alias("wns")))
    lines = orders.select("o_custkey", F.when(F.col("o_orderkey") % 10 == 7, F.left(record, F.length(record) - 5)).otherwise(record).alias("value"))
    history = records.last_records(records.json_rows(lines, "stage string, seq long, wns double"), ["o_custkey"], "seq", "impl")
    told = R.trend(history, ["o_custkey"], "seq", "wns", True)
    return records.last_records(told, ["o_custkey"], "seq", None, 8).select("o_custkey", "seq", "wns", "previous", "direction")


@query("""SELECT c_custkey, ord::INTEGER AS ord, id, k FROM (SELECT c_custkey, unnest([0, 1]) AS ord, unnest(['RULE.' || c_nationkey, 'OTHER']) AS id, unnest([c_mktsegment, NULL]) AS k FROM customer WHERE c_custkey % 4 < 2)""")
def waiver_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiver files as lists, as objects, cut off and without a list; the last two waive nothing."""
    one = F.concat(F.lit('{"id": "RULE.'), F.col("c_nationkey").cast("string"), F.lit('", "match": {"k": "'), F.col("c_mktsegment"), F.lit('"}}'))
    listed = F.concat(F.lit("["), one, F.lit(', {"id": "OTHER", "reason": "x"}, {"match": {}}]'))
    turn = F.col("c_custkey") % 4
    text = F.when(turn == 0, listed).when(turn == 1, F.concat(F.lit('{"waivers": '), listed, F.lit("}"))).when(turn == 2, F.left(listed, F.length(listed) - 3)).otherwise('{"waivers": "none"}')
    found = records.waivers_of(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), ["c_custkey"])
    return found.select("c_custkey", "ord", "id", F.try_variant_get("match", "$.k", "string").alias("k"))


@query("""WITH b AS (SELECT p_partkey, p_size FROM part WHERE p_size < 45)
    SELECT part.p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'added' ELSE 'modified' END AS change FROM part LEFT JOIN b USING (p_partkey) WHERE b.p_partkey IS NULL OR p_brand = 'Brand#2'""")
def baseline_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest against the last published snapshot, which is written and read back."""
    part = table(spark, sf_dir, "part")
    digest = lambda c: F.sha2(c.cast("string"), 256).alias("d")
    place = f"{scratch_root(spark)}/baseline-{uuid.uuid4().hex}"
    records.publish_baseline(spark, part.limit(0).select("p_partkey", digest(F.col("p_size"))), place)
    records.publish_baseline(spark, part.where("p_size < 45").select("p_partkey", digest(F.col("p_size"))), place)
    now = part.select("p_partkey", digest(F.when(F.col("p_brand") == "Brand#2", F.col("p_size") + 1).otherwise(F.col("p_size"))))
    return J.manifest_diff(records.last_baseline(spark, place), now, "p_partkey", "d")


@query("""SELECT o_orderkey, kind, path FROM (SELECT o_orderkey, 'drc' AS kind, '/x/own.rpt' AS path FROM orders WHERE o_orderkey % 5 = 0
    UNION ALL SELECT o_orderkey, unnest(['cdc', 'clock_interaction']), unnest(['/o/' || o_orderkey || '/raw/cdc_impl.rpt', '/o/' || o_orderkey || '/raw/clock_interaction_impl.rpt']) FROM orders WHERE o_orderkey % 5 <> 0)""")
def discovered_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports found by their names where a run names none."""
    orders = table(spark, sf_dir, "orders")
    names = F.explode(F.array(*map(F.lit, ["cdc_impl", "clock_interaction_impl", "cdc_synth", "impl"]))).alias("name")
    files = orders.select("o_orderkey", F.lit("impl").alias("stage"), names).select("o_orderkey", "stage", F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string"), F.lit("/raw/"), F.col("name"), F.lit(".rpt")).alias("path"))
    explicit = orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("drc").alias("kind"), F.lit("/x/own.rpt").alias("path"))
    return records.discovered(files, explicit, ["o_orderkey"])
