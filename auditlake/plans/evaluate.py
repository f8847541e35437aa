
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from auditlake.functions.columns import has_prefix, severity_rank
from auditlake.operators.joins import apply_waivers, first_wins
from auditlake.plans.rules import checklist_status

SEVERITIES = ["BLOCKER", "CRITICAL", "WARNING", "INFO"]
#: Rows of the sign-off checklist, their rule ids' prefixes and the artifact that shows they ran.
CHECKLIST = [
    ("environment", ["ENV."], "environment"), ("filelist", ["FILELIST."], "filelist"), ("preflight", ["PROV.PREFLIGHT"], "preflight"), ("log", ["LOG."], "log"),
    ("timing", ["TIMING."], "timing"), ("cdc", ["CDC.", "CLK."], "cdc"), ("drc", ["DRC.", "METH."], "drc"), ("utilization", ["UTIL.", "CTRLSET.", "QOR."], "utilization"),
    ("ip_status", ["IP."], "ip_status"), ("bitstream", ["BITSTREAM."], "bitstream"), ("inputs", ["PROV.DIRTY"], "manifest"),
]


def evaluate(families: list[DataFrame], waivers: DataFrame, keys: list[str]) -> DataFrame:
    """V1, V2, O2: the findings of all families with waivers applied and their place in the run's report.

    families: results of rules.findings_of. A waiver's pairs are held against the evidence, whatever its types, and its
    digest against that of the rule and its evidence (F8). waiver and stale say what was decided (joins.waiver_events).
    """
    found = reduce(DataFrame.unionByName, (f.select(*keys, "id", "severity", "blocks_bringup", "blocks_signoff", "evidence", "source", "digest") for f in families))
    order = Window.partitionBy(*keys).orderBy(severity_rank(F.col("severity")), "id", "evidence")
    return decided(found, waivers).withColumn("place", F.row_number().over(order))


def decided(found: DataFrame, waivers: DataFrame) -> DataFrame:
    """V2: findings with waivers applied, each where it stands: none is dealt again."""
    return apply_waivers(found.withColumn("attrs", F.parse_json("evidence")), waivers).drop("attrs")


def placed(found: DataFrame, keys: list[str]) -> DataFrame:
    """O2: findings with their place in the run's report, of a table in which those of a run stand together, as a generator
    leaves them: they are ordered run by run as they pass, and neither dealt nor sorted with others."""
    ranked = found.withColumn("_rank", severity_rank(F.col("severity")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
            if not rows.num_rows:
                continue
            starts = _starts(rows, keys)
            # The last run may go on in the next batch.
            held = rows.slice(starts[-1])
            if starts[-1]:
                yield from _in_order(rows.slice(0, starts[-1]), starts[:-1])
        if held is not None:
            yield from _in_order(held, np.zeros(1, np.int64))

    return ranked.mapInArrow(run, T.StructType([*found.schema.fields, T.StructField("place", T.IntegerType())]))


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for key in keys:
        column = rows.column(key).combine_chunks()
        a, b = column[:-1], column[1:]
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _in_order(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(np.append(starts, rows.num_rows))
    ordered = rows.append_column("_run", pa.array(np.repeat(np.arange(len(starts)), sizes)))
    # Null texts come first, as they do in a window.
    order = ordered.select(["_run", "_rank", "id", "evidence"])
    rows = rows.take(pc.sort_indices(order, sort_keys=[(c, "ascending") for c in order.column_names], null_placement="at_start")).drop_columns(["_rank"])
    yield from rows.append_column("place", pa.array(np.arange(rows.num_rows) - np.repeat(starts, sizes) + 1, pa.int32())).combine_chunks().to_batches()


def summarise(runs: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by severity and verdict of every run; a run without findings passes."""
    n = lambda c, name: F.count_if(c).alias(name)
    found = findings.groupBy(*keys).agg(
        *(n(F.col("severity") == s, s.lower()) for s in SEVERITIES), n(F.col("waived"), "waived"), n(F.col("expired"), "expired"),
        n(F.col("blocks_bringup"), "bringup_blocker_count"), n(F.col("blocks_signoff"), "signoff_blocker_count"),
    )
    counts = [c for c in found.columns if c not in keys]
    out = runs.select(*keys).distinct().join(found, keys, "left").fillna(0, counts)
    return out.withColumns({"bringup_ok": F.col("bringup_blocker_count") == 0, "signoff_ok": F.col("signoff_blocker_count") == 0})


def open_blockers(findings: DataFrame) -> DataFrame:
    """P10: blockers that no waiver lifts."""
    return findings.where("severity = 'BLOCKER' AND NOT waived")


def first_seen(findings: DataFrame, keys: list[str], stage_order: Column, title: Column) -> DataFrame:
    """A finding that several stages make counts once, for the earliest."""
    return first_wins(findings.withColumn("_title", title), [*keys, "id", "_title"], [stage_order, F.col("place")]).drop("_title")


def checklist(findings: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, status) of every checklist row; artifacts: keys, artifact, present."""
    labels = F.explode(F.array(*(F.struct(F.lit(i).alias("row_no"), F.lit(label).alias("label"), F.lit(a).alias("artifact")) for i, (label, _, a) in enumerate(CHECKLIST))))
    rows = artifacts.select(*keys).distinct().select("*", labels.alias("c")).select(*keys, "c.*")
    label = F.coalesce(*(F.when(has_prefix(F.col("id"), prefixes), name) for name, prefixes, _ in CHECKLIST))
    hits = findings.withColumn("label", label).where("label IS NOT NULL").groupBy(*keys, "label").agg(F.count_if(F.col("blocks_bringup") | F.col("blocks_signoff")).alias("open"), F.count_if("waived").alias("waived"))
    ran = artifacts.groupBy(*keys, "artifact").agg(F.bool_or("present").alias("ran"))
    out = rows.join(ran, [*keys, "artifact"], "left").join(hits, [*keys, "label"], "left")
    return out.select(*keys, "row_no", "label", checklist_status(F.col("ran"), F.coalesce("open", F.lit(0)), F.coalesce("waived", F.lit(0))).alias("status"))


def gate_reasons(stages: DataFrame, keys: list[str]) -> DataFrame:
    """V4: (keys, reason) of every reason to stop before elaboration; no row, no objection.

    stages: keys, stage, status (text of an exit code, 'skipped' or null), ran, blockers.
    """
    code = F.col("status")
    reason = F.when(code == "skipped", "not run").when(code != "0", "ended with a status").when(~F.col("ran"), "left no result")
    own = stages.select(*keys, F.concat_ws(": ", "stage", reason).alias("reason"), reason.alias("why")).where("why IS NOT NULL").drop("why")
    blocked = stages.groupBy(*keys).agg(F.sum(F.coalesce("blockers", F.lit(0))).alias("n")).where("n > 0")
    return own.unionByName(blocked.select(*keys, F.lit("blockers").alias("reason")))


def gate(stages: DataFrame, keys: list[str]) -> DataFrame:
    """V4: allowed where there is no reason against it."""
    n = gate_reasons(stages, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reasons"))
    out = stages.select(*keys).distinct().join(n, keys, "left").fillna(0, ["n_reasons"])
    return out.withColumn("allowed", F.col("n_reasons") == 0)


def signoff_verdict(stages: DataFrame, flow: DataFrame, keys: list[str]) -> DataFrame:
    """V5: the flow's own verdict where it has one, else all stages'; a missing stage bars sign-off, no stage at all is no verdict.

    stages: keys, bringup_ok, signoff_ok (null: not run); flow: keys, bringup_ok, signoff_ok.
    """
    seen = F.count("bringup_ok") > 0
    own = stages.groupBy(*keys).agg(
        F.when(seen, F.coalesce(F.bool_and("bringup_ok"), F.lit(True))).alias("_b"),
        F.when(seen, F.bool_and(F.coalesce("signoff_ok", F.lit(False)))).alias("_s"),
    )
    told = flow.select(*keys, F.col("bringup_ok").alias("_fb"), F.col("signoff_ok").alias("_fs"), F.lit(True).alias("_told"))
    pick = lambda a, b, name: F.when(F.col("_told"), F.col(a)).otherwise(F.col(b)).alias(name)
    return own.join(told, keys, "left").select(*keys, pick("_fb", "_b", "bringup_ok"), pick("_fs", "_s", "signoff_ok"))


def first_artifact(artifacts: DataFrame, keys: list[str], stage_order: str) -> DataFrame:
    """The artifact of the first stage that has one."""
    return artifacts.where("artifact IS NOT NULL").groupBy(*keys).agg(F.min_by("artifact", stage_order).alias("artifact"))
