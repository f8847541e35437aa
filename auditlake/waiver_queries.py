"""Registered queries over nested evidence, its digests and the waivers that are bound to it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import joins as J
from auditlake.plans import evaluate as E
from auditlake.plans import rules as P
from auditlake.queries import query, table
from auditlake.report_queries import dealt
from auditlake.sources import records

ORDER = ["o_orderkey"]
_ID = "PROV.DIRTY_INPUTS"
#: What a reviewer accepted: one state of the evidence, by its digest.
_ACCEPTED = hashlib.sha256(json.dumps({"id": _ID, "evidence": {"n_dirty": 1, "files": ["p3", "q"], "place": {"none": None, "priority": "1-URGENT"}}}, sort_keys=True).encode()).hexdigest()[:12]
_NONE = "0" * 12
_FILE = json.dumps({"waivers": [
    {"id": _ID, "match": {"n_dirty": 1}, "reason": "old", "evidence_digest": _NONE},
    {"id": _ID, "match": {"files": ["p3", "q"]}, "reason": "p3", "approved_by": "a", "date": "2026-01-02", "evidence_digest": _ACCEPTED},
    {"id": _ID, "match": {"place": {"priority": "2-HIGH", "none": None}}, "reason": "place", "approved_by": "b"},
    {"id": _ID, "match": {"none": ""}, "reason": "last", "evidence_digest": _NONE},
    {"id": "BITSTREAM.MISSING", "match": {"share": "x"}, "reason": "never"},
]})
_DIRTY = """f AS (SELECT o_orderkey, o_custkey % 5 AS c, o_orderkey % 3 AS n, o_orderpriority AS p, left(sha256('{"evidence": {"files": ["p' || o_custkey % 5 || '", "q"], "n_dirty": ' || o_orderkey % 3 || ', "place": {"none": null, "priority": "' || o_orderpriority || '"}}, "id": "PROV.DIRTY_INPUTS"}'), 12) AS digest FROM orders WHERE o_orderkey % 3 > 0)"""


def nested_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with a list, an object with a null in it, and doubles. Orders are dealt in a number of tasks of their own:
    a file may be one task's, and tasks put together by the bytes of narrow rows would leave cores idle."""
    key = F.col("o_orderkey")
    facts = dealt(table(spark, sf_dir, "orders"), ORDER).select(
        "o_orderkey", (key % 3).alias("n_dirty"), F.array(F.concat(F.lit("p"), (F.col("o_custkey") % 5).cast("string")), F.lit("q")).alias("files"),
        F.struct(F.col("o_orderpriority").alias("priority"), F.lit(None).cast("string").alias("none")).alias("place"), F.col("o_totalprice").cast("double").alias("share"), (F.col("o_orderstatus") == "F").alias("gone"),
    )
    rules = [P.Rule(_ID, F.col("n_dirty") > 0, False, True, evidence=("n_dirty", "files", "place")), P.Rule("BITSTREAM.MISSING", F.col("gone"), True, True, evidence=("share",))]
    return P.findings_of(facts, ORDER, rules, "manifest")


def waived(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([(1, _FILE)], "k int, text string")
    return E.evaluate([nested_findings(spark, sf_dir)], records.waivers_of(files, ["k"]), ORDER)


@query(f"""WITH {_DIRTY} SELECT o_orderkey, '{_ID}' AS id, digest FROM f
    UNION ALL SELECT o_orderkey, 'BITSTREAM.MISSING', left(sha256('{{"evidence": {{"share": ' || o_totalprice::DOUBLE || '}}, "id": "BITSTREAM.MISSING"}}'), 12) FROM orders WHERE o_orderstatus = 'F'""")
def finding_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, H4: digests of nested evidence, of its canonical text."""
    return nested_findings(spark, sf_dir).select(*ORDER, "id", "digest")


@query(f"""WITH {_DIRTY}, h AS (SELECT *, c = 3 AND digest = '{_ACCEPTED}' AS held, p = '2-HIGH' AS place FROM f),
    e AS (SELECT o_orderkey, 0 AS ord, 'expired' AS event, 'old' AS reason, NULL AS approved_by, NULL AS date, '{_NONE}' AS recorded_digest, digest, true AS pinned FROM h WHERE n = 1
        UNION ALL SELECT o_orderkey, 1, CASE WHEN held THEN 'applied' ELSE 'expired' END, 'p3', CASE WHEN held THEN 'a' END, CASE WHEN held THEN '2026-01-02' END, CASE WHEN NOT held THEN '{_ACCEPTED}' END, digest, true FROM h WHERE c = 3
        UNION ALL SELECT o_orderkey, 2, 'applied', 'place', 'b', '', NULL, digest, false FROM h WHERE place AND NOT held
        UNION ALL SELECT o_orderkey, 3, 'expired', 'last', NULL, NULL, '{_NONE}', digest, true FROM h WHERE NOT place AND NOT held)
    SELECT o_orderkey, '{_ID}' AS id, event, ord::INTEGER AS ord, reason, approved_by, date, recorded_digest, digest AS current_digest, pinned AS digest_pinned FROM e""")
def waiver_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each waiver that met a finding: lists and objects match by value, stale ones are
    told beside the one that holds."""
    return J.waiver_events(waived(spark, sf_dir), ORDER)


@query(f"""WITH {_DIRTY}, h AS (SELECT *, (c = 3 AND digest = '{_ACCEPTED}') OR p = '2-HIGH' AS waived FROM f)
    SELECT o_orderkey, '{_ID}' AS id, waived, NOT waived AS expired, NOT waived AS blocks_signoff FROM h
    UNION ALL SELECT o_orderkey, 'BITSTREAM.MISSING', false, false, true FROM orders WHERE o_orderstatus = 'F'""")
def waived_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2: pinned waivers that hold and that do not, on nested evidence."""
    return waived(spark, sf_dir).select(*ORDER, "id", "waived", "expired", "blocks_signoff")
