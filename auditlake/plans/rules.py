
from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from auditlake.functions.columns import canonical_json, evidence_digest, initcap, lower, severity_of, severity_rank
from auditlake.sources import texts
from auditlake.sources.reports import clocks, constraints_met, design_summary
from auditlake.sources.tables import check_items, timing_paths

#: Thresholds, rule ids and class grades (blocks bring-up, blocks sign-off) of the catalogue.
THRESHOLDS = {
    "setup_severe_fraction": 0.10,
    "setup_severe_fraction_synth": 0.50,
    "unconstrained_severe_fraction": 0.01,
    "route_dominated_percent": 70.0,
    "deep_logic_levels": 15,
    "util_critical_percent": 90.0,
    "util_high_percent": 80.0,
    "control_sets_per_register": 0.20,
    "qor_score_warn": 3,
}
BITSTREAM_BLOCKING = ["NSTD-1", "UCIO-1"]
UNSAFE_TIMING, CLOCK_PATH = ["TIMING-6", "TIMING-7", "TIMING-9"], ["TIMING-14", "TIMING-15"]
SAFETY_REPORTS = ["utilization", "drc", "methodology", "cdc", "clock_interaction"]
LOG_GRADES = {
    "CONSTRAINT_NOT_APPLIED": (True, True),
    "UNBOUND_MODULE": (True, True),
    "INFERRED_LATCH": (False, True),
    "UNDRIVEN_NET": (False, True),
    "WIDTH_MISMATCH": (False, False),
    "PLACEMENT_QUALITY": (False, False),
}


@dataclass(frozen=True)
class Rule:
    """when: over one row of facts; later rules of a family see only rows that earlier ones of the same group left."""

    id: str
    when: Column
    bringup: bool = False
    signoff: bool = False
    notable: bool = True
    group: str = ""
    evidence: tuple[str, ...] = ()


def findings_of(facts: DataFrame, keys: list[str], rules: list[Rule], source: str) -> DataFrame:
    """All rules over each row of facts in one pass: no rule reads the table again.

    Of rules with one group only the first that holds fires. Severity follows from what a rule blocks. digest names
    the rule and its evidence, nulls included (F8), of whatever type the facts are.
    """
    kinds = {f.name: f.dataType for f in facts.schema.fields}
    fired = []
    for rule, holds in zip(rules, _holds(rules), strict=True):
        inner = [F.concat(F.lit(f'"{c}": '), canonical_json(F.col(c), kinds[c])) for c in sorted(rule.evidence)]
        digest = evidence_digest(F.lit(rule.id), F.concat(F.lit("{"), F.concat_ws(", ", *inner), F.lit("}")))
        fired.append(F.when(holds, F.struct(F.lit(rule.id).alias("id"), F.lit(rule.bringup).alias("blocks_bringup"), F.lit(rule.signoff).alias("blocks_signoff"), F.lit(rule.notable).alias("notable"), _evidence(rule.evidence).alias("evidence"), digest.alias("digest"))))
    # In a step of their own: what a generator is given is interpreted, node by node.
    hits = facts.select(*keys, F.array(*fired).alias("_fired")).select(*keys, F.explode("_fired").alias("f")).where("f IS NOT NULL").select(*keys, "f.*")
    return hits.select(*keys, "id", severity_of(F.col("blocks_bringup"), F.col("blocks_signoff"), F.col("notable")).alias("severity"), "blocks_bringup", "blocks_signoff", "evidence", F.lit(source).alias("source"), "digest")


def findings_of_families(facts: DataFrame, keys: list[str], families: dict[str, list[Rule]]) -> DataFrame:
    """findings_of facts of several families in one table, told apart by source: each row goes by the rules of its own.

    A hit is a number until the generator is passed, and its digest comes from its evidence: the text of all rules' evidence
    and digests in one expression is more than can be compiled.
    """
    every, fires = [], F.lit(None).cast("array<int>")
    for source, rules in families.items():
        fires = F.when(F.col("source") == source, F.array(*(F.when(holds, F.lit(len(every) + i)) for i, holds in enumerate(_holds(rules))))).otherwise(fires)
        every += rules
    hits = facts.withColumn("_hits", fires).withColumn("_i", F.explode("_hits")).where("_i IS NOT NULL")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("_i") + 1)
    evidence = F.lit("{}")
    for columns in {r.evidence for r in every if r.evidence}:
        evidence = F.when(F.col("_i").isin([i for i, r in enumerate(every) if r.evidence == columns]), _evidence(columns)).otherwise(evidence)
    told = hits.select(*keys, pick([r.id for r in every]).alias("id"), pick([r.bringup for r in every]).alias("blocks_bringup"), pick([r.signoff for r in every]).alias("blocks_signoff"), pick([r.notable for r in every]).alias("notable"), evidence.alias("evidence"), "source")
    doubles = frozenset(f.name for f in facts.schema.fields if isinstance(f.dataType, T.FractionalType))
    told = told.withColumn("severity", severity_of(F.col("blocks_bringup"), F.col("blocks_signoff"), F.col("notable")))
    return told.withColumn("digest", digest_of(doubles)("id", "evidence")).select(*keys, *_FINDING)


def digest_of(doubles: frozenset[str]) -> Callable[..., Column]:
    """F8 of a finding's id and evidence, JSON with its numbers in any digits; doubles: names whose NaN and infinities are quoted in it."""

    def run(rules: pa.Array, evidence: pa.Array) -> pa.Array:
        known: dict[tuple[str, str], str] = {}
        out = []
        for key in zip(rules.to_pylist(), evidence.to_pylist(), strict=True):
            found = known.get(key)
            if found is None:
                told = {k: float(v) if k in doubles and isinstance(v, str) else v for k, v in json.loads(key[1]).items()}
                found = hashlib.sha256(json.dumps({"id": key[0], "evidence": told}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]
                known[key] = found
            out.append(found)
        return pa.array(out, pa.string())

    run.__annotations__ = {"rules": pa.Array, "evidence": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


_FINDING = ["id", "severity", "blocks_bringup", "blocks_signoff", "evidence", "source", "digest"]


def _evidence(columns: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*(F.col(c) for c in columns)), {"ignoreNullFields": "false"}) if columns else F.lit("{}")


def _holds(rules: list[Rule]) -> list[Column]:
    """Whether each rule fires: of rules with one group only the first that holds."""
    taken: dict[str, Column] = {}
    out = []
    for rule in rules:
        holds = F.coalesce(rule.when, F.lit(False))
        if rule.group:
            before = taken.get(rule.group)
            taken[rule.group] = holds if before is None else before | holds
            holds = holds if before is None else holds & ~before
        out.append(holds)
    return out


def timing_rules(synth: bool, limits: dict | None = None) -> list[Rule]:
    """Over facts wns, whs, wpws, period, no_clock, loops, latch_loops, unconstrained, tns_total_endpoints, no_io_delay, route_pct, logic_levels."""
    t = THRESHOLDS | (limits or {})
    c = F.col
    severe = c("wns") < -F.abs("period") * (t["setup_severe_fraction_synth"] if synth else t["setup_severe_fraction"])
    share = F.try_divide(c("unconstrained"), c("tns_total_endpoints"))
    setup = "_SYNTH" if synth else ""
    rules = [] if synth else [Rule("TIMING.HOLD_VIOLATION", c("whs") < 0, True, True, evidence=("whs",))]
    return [
        *rules,
        Rule("TIMING.PULSE_WIDTH", c("wpws") < 0, True, True, evidence=("wpws",)),
        Rule(f"TIMING.SETUP_SEVERE{setup}", severe, not synth, True, group="setup", evidence=("wns", "period")),
        Rule(f"TIMING.SETUP_VIOLATION{setup}", c("wns") < 0, False, not synth, group="setup", evidence=("wns",)),
        Rule("TIMING.NO_CLOCK", c("no_clock") > 0, True, True, evidence=("no_clock",)),
        Rule("TIMING.COMB_LOOP", c("loops") > 0, True, True, evidence=("loops",)),
        Rule("TIMING.COMB_LOOP", c("latch_loops") > 0, True, True, evidence=("latch_loops",)),
        Rule("TIMING.UNCONSTRAINED_SEVERE", share > t["unconstrained_severe_fraction"], True, True, group="free", evidence=("unconstrained", "tns_total_endpoints")),
        Rule("TIMING.UNCONSTRAINED_ENDPOINTS", c("unconstrained") > 0, False, True, group="free", evidence=("unconstrained",)),
        Rule("TIMING.NO_IO_DELAY", c("no_io_delay") > 0, False, True, evidence=("no_io_delay",)),
        Rule("TIMING.ROUTE_DOMINATED", c("route_pct") > t["route_dominated_percent"], evidence=("route_pct",)),
        Rule("TIMING.DEEP_LOGIC", c("logic_levels") > t["deep_logic_levels"], evidence=("logic_levels",)),
    ]


def drc_rules() -> list[Rule]:
    """Over rule, severity, n: one row per rule."""
    of = lambda s: F.col("severity") == s
    e = ("rule", "n")
    return [
        Rule("DRC.BITSTREAM_BLOCKING", F.col("rule").isin(BITSTREAM_BLOCKING), True, True, group="drc", evidence=e),
        Rule("DRC.ERROR", of("Error"), True, True, group="drc", evidence=e),
        Rule("DRC.CRITICAL_WARNING", of("Critical Warning"), False, True, group="drc", evidence=e),
        Rule("DRC.WARNING", of("Warning"), group="drc", evidence=e),
        Rule("DRC.ADVISORY", F.lit(True), notable=False, group="drc", evidence=e),
    ]


def methodology_rules() -> list[Rule]:
    e = ("rule", "n")
    return [
        Rule("METH.TIMING_UNSAFE", F.col("rule").isin(UNSAFE_TIMING), True, True, group="meth", evidence=e),
        Rule("METH.CLOCK_PATH", F.col("rule").isin(CLOCK_PATH), False, True, group="meth", evidence=e),
        Rule("METH.CRITICAL", F.col("severity").isin("Error", "Critical Warning"), False, True, group="meth", evidence=e),
        Rule("METH.WARNING", F.col("severity") == "Warning", group="meth", evidence=e),
        Rule("METH.ADVISORY", F.lit(True), notable=False, group="meth", evidence=e),
    ]


def log_rules() -> list[Rule]:
    """Over risk_class, n and n_error: one row per class; a class under no grade makes no finding."""
    graded = [Rule(f"LOG.{k}", F.col("risk_class") == k, *grade, evidence=("risk_class", "n")) for k, grade in LOG_GRADES.items()]
    return [*graded, Rule("LOG.ERROR", F.col("n_error") > 0, True, True, evidence=("n_error",))]


def utilization_rules(synth: bool, limits: dict | None = None) -> list[Rule]:
    """Over key, util_percent; after synthesis only a full device counts."""
    t = THRESHOLDS | (limits or {}) | ({"util_critical_percent": 100.0, "util_high_percent": 100.0} if synth else {})
    return [
        Rule("UTIL.CRITICAL", F.col("util_percent") >= t["util_critical_percent"], False, True, group="util", evidence=("key", "util_percent")),
        Rule("UTIL.HIGH", F.col("util_percent") >= t["util_high_percent"], group="util", evidence=("key", "util_percent")),
    ]


def coverage_rules() -> list[Rule]:
    """Over kind, checked: what was not checked is a finding, and bars sign-off where safety hangs on it."""
    gap = ~F.col("checked")
    return [
        Rule("META.REPORT_UNAVAILABLE", gap & F.col("kind").isin(SAFETY_REPORTS), False, True, group="meta", evidence=("kind",)),
        Rule("META.REPORT_UNAVAILABLE", gap, notable=False, group="meta", evidence=("kind",)),
    ]


def cdc_facts(crossings: DataFrame, keys: list[str]) -> DataFrame:
    """Crossings by severity and id, with the first description and at most 6 pairs of clocks.

    Pairs are made distinct before they are gathered: there are as many as pairs of clocks, whatever the crossings.
    """
    rows = crossings.withColumn("severity", initcap(lower("severity")))
    pair = F.when(F.col("source_clock") != "", F.concat_ws(" -> ", "source_clock", "destination_clock"))
    each = rows.groupBy(*keys, "severity", "id", pair.alias("pair")).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("description") != "", F.struct("pos", "description"))).alias("d"))
    found = each.groupBy(*keys, "severity", "id").agg(F.sum("n").alias("n"), F.min("d").alias("d"), F.slice(F.sort_array(F.collect_set("pair")), 1, 6).alias("pairs"))
    return found.select(*keys, "severity", "id", "n", F.coalesce("d.description", F.lit("")).alias("description"), "pairs")


def cdc_rules() -> list[Rule]:
    """Over cdc_facts with id renamed to crossing; other severities are silent."""
    e = ("crossing", "n", "pairs")
    return [
        Rule("CDC.CRITICAL", F.col("severity") == "Critical", True, True, evidence=e),
        Rule("CDC.WARNING", F.col("severity") == "Warning", False, True, evidence=e),
    ]


def clock_facts(pairs: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """Pairs (with pos) without a safe relation, their count and the first labels; an unsafe pair is not counted as partly false too."""
    text = lower("classification")
    unsafe = F.contains(text, F.lit("unsafe")) | F.contains(text, F.lit("no common"))
    kind = F.when(unsafe, "unsafe").when(F.contains(text, F.lit("partial false path")), "partial")
    rows = pairs.select(*keys, "pos", kind.alias("kind"), F.concat_ws(" -> ", "source_clock", "destination_clock").alias("label"))
    # One order of a kind's pairs tells both: beyond the first none is gathered.
    place = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("pos"))
    told = rows.withColumn("place", place).groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "label")))).alias("first"))
    each = told.select(*keys, "kind", "n", F.when(F.col("kind").isNotNull(), F.col("first.label")).alias("examples")).groupBy(*keys)
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    return each.agg(*(F.coalesce(of(k, "n"), F.lit(0)).alias(f"n_{k}") for k in ("unsafe", "partial")), *(of(k, "examples").alias(f"{k}_pairs") for k in ("unsafe", "partial")))


def clock_rules() -> list[Rule]:
    return [
        Rule("CLK.NO_COMMON_CLOCK", F.col("n_unsafe") > 0, True, True, evidence=("n_unsafe", "unsafe_pairs")),
        Rule("CLK.PARTIAL_FALSE_PATH", F.col("n_partial") > 0, False, True, evidence=("n_partial", "partial_pairs")),
    ]


def control_set_rules(limits: dict | None = None) -> list[Rule]:
    """Over unique_control_sets, registers."""
    ratio = F.try_divide("unique_control_sets", "registers")
    return [Rule("CTRLSET.HIGH", ratio > (THRESHOLDS | (limits or {}))["control_sets_per_register"], evidence=("unique_control_sets", "registers"))]


def provenance_rules() -> list[Rule]:
    return [
        Rule("PROV.DIRTY_INPUTS", F.col("n_dirty") > 0, False, True, evidence=("n_dirty",)),
        Rule("PROV.PREFLIGHT_WARNINGS", F.col("n_warnings") > 0, evidence=("n_warnings",)),
    ]


def filelist_rules() -> list[Rule]:
    """Over counts; top_found and consistent are null where nobody looked, which is not the same as true."""
    some = lambda name, n, bringup: Rule(f"FILELIST.{name}", F.col(n) > 0, bringup, True, evidence=(n,))
    return [
        some("MISSING_FILE", "n_missing_file", True),
        some("MISSING_INCDIR", "n_missing_incdir", True),
        some("MODULE_FILE_MISSING", "n_file_missing", True),
        some("MODULE_UNDEFINED", "n_undefined", False),
        Rule("FILELIST.TOP_NOT_FOUND", ~F.col("top_found"), True, True),
        Rule("FILELIST.PROJECT_NOT_CHECKED", F.col("consistent").isNull(), False, True, group="project"),
        Rule("FILELIST.PROJECT_MISMATCH", ~F.col("consistent"), True, True, group="project"),
        some("DUPLICATE_MODULE", "n_duplicate", False),
    ]


def filelist_error_rules(most: int = 5) -> list[Rule]:
    """Over ord, error: one finding for each of the first errors of a list."""
    return [Rule("FILELIST.PARSE_ERROR", F.col("ord") < most, False, True, evidence=("error",))]


def environment_rules() -> list[Rule]:
    return [
        Rule("ENV.VIVADO_CHANGED", F.col("tool_changed"), False, True),
        Rule("ENV.OS_CHANGED", F.col("os_changed")),
        Rule("ENV.OS_UNSUPPORTED", ~F.col("os_supported")),
    ]


def ip_facts(ips: DataFrame, keys: list[str]) -> DataFrame:
    return ips.groupBy(*keys).agg(*(F.count_if(c).alias(f"n_{c}") for c in ("missing", "upgrade", "locked")))


def ip_rules() -> list[Rule]:
    return [
        Rule("IP.MISSING_PRODUCTS", F.col("n_missing") > 0, True, True, evidence=("n_missing",)),
        Rule("IP.NEEDS_UPGRADE", F.col("n_upgrade") > 0, False, True, evidence=("n_upgrade",)),
        Rule("IP.LOCKED", F.col("n_locked") > 0, False, True, evidence=("n_locked",)),
    ]


def qor_rules(limits: dict | None = None) -> list[Rule]:
    return [Rule("QOR.LOW_SCORE", F.col("score") < (THRESHOLDS | (limits or {}))["qor_score_warn"], evidence=("score", "max_score"))]


def bitstream_rules() -> list[Rule]:
    return [Rule("BITSTREAM.MISSING", F.col("requested") & ~F.col("present"), True, True)]


def worst_first(findings: DataFrame) -> DataFrame:
    """O2: by severity, then id."""
    return findings.orderBy(severity_rank(F.col("severity")), "id", "evidence")


def group_rules(found: DataFrame, keys: list[str]) -> DataFrame:
    """A5: violations by rule: how many, and severity, title and detail (400 characters) of the first."""
    first = F.min_by(F.struct("severity", "title", F.left("detail", F.lit(400)).alias("detail")), "pos")
    return found.groupBy(*keys, "rule").agg(F.count(F.lit(1)).alias("n"), first.alias("f")).select(*keys, "rule", "n", "f.*")


def _setup() -> Column:
    return F.col("delay_kind") == "max"


def _asked() -> Column:
    """The requirement of the first setup path that has one; zero is none."""
    return F.min_by("requirement_ns", F.when(_setup() & (F.col("requirement_ns") != 0), F.col("pos")))


def _worst() -> Column:
    """What the rules ask of the setup path of least slack; the first of equals."""
    return F.min_by(F.struct("route_pct", "logic_levels"), F.when(_setup() & F.col("slack_ns").isNotNull(), F.struct("slack_ns", "pos")))


def clock_period(paths: DataFrame, clocks: DataFrame, keys: list[str]) -> DataFrame:
    """Requirement of the first setup path that has one, else the shortest period; zero is none."""
    shortest = F.min(F.when(F.col("period_ns") != 0, F.col("period_ns")))
    both = paths.groupBy(*keys).agg(_asked().alias("_a")).join(clocks.groupBy(*keys).agg(shortest.alias("_b")), keys, "full_outer")
    return both.select(*keys, F.coalesce("_a", "_b").alias("period"))


def worst_setup(paths: DataFrame, keys: list[str]) -> DataFrame:
    """The setup path of least slack of each run; the first of equals."""
    return paths.where(_setup() & F.col("slack_ns").isNotNull()).groupBy(*keys).agg(_worst().alias("w")).select(*keys, "w.*")


def timing_facts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row of facts per timing report, of summary, checks, clocks and paths (see timing_rules); a report without summary has none."""
    paths = timing_paths(lines, keys, only=["pos", "delay_kind", "slack_ns", "requirement_ns", "route_pct", "logic_levels"])
    of = lambda c, v, names: [F.max(F.when(F.col(c) == n, F.col(v))).alias(n) for n in names]
    summary = design_summary(lines, keys).groupBy(*keys).agg(*of("name", "number", ("wns", "whs", "wpws", "tns_total_endpoints")))
    checks = check_items(lines, keys).groupBy(*keys).agg(*of("name", "n", ("no_clock", "loops", "latch_loops")), F.max(F.when(F.col("name") == "unconstrained_internal_endpoints", F.col("n"))).alias("unconstrained"), F.sum(F.when(F.col("name").isin("no_input_delay", "no_output_delay"), F.col("n"))).alias("no_io_delay"))
    shortest = clocks(lines, keys).groupBy(*keys).agg(F.min(F.when(F.col("period_ns") != 0, F.col("period_ns"))).alias("shortest"))
    # Both facts of the paths come from one aggregate over them.
    by_run = paths.groupBy(*keys).agg(_worst().alias("w"), _asked().alias("asked")).select(*keys, "asked", "w.*")
    out = summary.join(checks, keys, "left").join(by_run, keys, "left").join(shortest, keys, "left").join(constraints_met(lines, keys), keys, "left")
    return out.withColumn("period", F.coalesce("asked", "shortest")).drop("asked", "shortest")


def timing_facts_of(files: DataFrame, keys: list[str]) -> DataFrame:
    """timing_facts of texts (keys, text), a text a row: no line of them is dealt, sorted or written. banner: the pairs of its head."""
    # The facts come out of a generator as columns: as fields of a struct they would be put into each rule and looked up there.
    return files.select(*keys, F.inline(texts.timing_facts("text")))


def log_facts(classes: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """J10 inputs: a row per class (A4) and one with the number of error messages."""
    errors = found.where("severity = 'ERROR'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_error"))
    return classes.select(*keys, "risk_class", "n", F.lit(0).cast("long").alias("n_error")).unionByName(errors.select(*keys, F.lit(None).cast("string").alias("risk_class"), F.lit(0).cast("long").alias("n"), "n_error"))


def checklist_status(ran: Column, open_: Column, waived: Column) -> Column:
    """V3: not checked comes before everything else."""
    return F.when(~F.coalesce(ran, F.lit(False)), "NOT CHECKED").when(open_ > 0, "FAIL").when(waived > 0, "WAIVED").otherwise("PASS")
