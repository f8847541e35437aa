"""Markers and banners (K11, K12): what a write says about its rows, told by the write itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from auditlake.functions.columns import banner

#: The markers that scripts around the tools look for.
RISK_BLOCKERS, MANIFEST_CHANGED, MANIFEST_STATUS, ENV_CHANGED = "##RISK_BLOCKERS##", "##MANIFEST_CHANGED##", "##MANIFEST_STATUS##", "##ENV_CHANGED##"


def write_marked(rows: DataFrame, path: str, marks: dict[str, Column]) -> dict[str, int]:
    """Write rows to a table and return the sum of each mark over them, observed as they are written: no second job, and
    nothing but the sums reaches the driver. An empty table gives zeros."""
    told = Observation()
    columns = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"m{i}") for i, c in enumerate(marks.values())]
    rows.observe(told, *columns).write.parquet(path)
    return {name: told.get[f"m{i}"] for i, name in enumerate(marks)}


def finding_marks() -> dict[str, Column]:
    """K11 over findings: those that block and are not waived."""
    return {RISK_BLOCKERS: (F.col("severity") == "BLOCKER") & ~F.col("waived")}


def change_marks() -> dict[str, Column]:
    """K11 over the changes of a manifest (change: added, removed, modified)."""
    return {MANIFEST_CHANGED: F.lit(True), **{f"{MANIFEST_STATUS} {kind}": F.col("change") == kind for kind in ("added", "removed", "modified")}}


def environment_marks() -> dict[str, Column]:
    """K11 over field changes."""
    return {ENV_CHANGED: F.col("changed")}


def marker_lines(marks: dict[str, int]) -> list[str]:
    """Lines for those who scan a build's output; a mark that nothing bears is not said."""
    return [f"{name} {n}" for name, n in marks.items() if n]


def banners(runs: DataFrame, keys: list[str], width: int = 60) -> DataFrame:
    """(keys, banner, lines): PASS, WARN or FAIL of each run by its exit status and verdict, in a frame.

    runs: keys, status, bringup_ok, signoff_ok, warning, waived; bringup_ok null: there is no verdict.
    """
    outcome = banner(F.col("status"), F.col("bringup_ok"), F.col("signoff_ok"), F.coalesce("warning", F.lit(0)), F.coalesce("waived", F.lit(0)))
    named = runs.withColumn("banner", outcome)
    title = F.concat_ws(" ", F.col("banner"), *(F.col(k).cast("string") for k in keys))
    rule = F.lit("=" * width)
    return named.select(*keys, "banner", F.array(rule, F.concat(F.lit("= "), F.rpad(title, width - 4, " "), F.lit(" =")), rule).alias("lines"))
