
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from auditlake.functions.columns import fold_path, glob_regex, let, lower, resolve_path, variant_text


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of either side, and the side that lacks them ('both' for none)."""
    a = left.select(key).distinct().withColumn("in_left", F.lit(True))
    b = right.select(key).distinct().withColumn("in_right", F.lit(True))
    side = F.when(F.col("in_right").isNull(), "left_only").when(F.col("in_left").isNull(), "right_only").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def missing_refs(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is nowhere in known; a null key is not in it."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def two_tier_missing(used: DataFrame, declared: DataFrame, elsewhere: DataFrame, key: str, ignore: DataFrame | None = None) -> DataFrame:
    """Used keys that the build does not declare: 'file_missing' if another place does, else 'undefined'."""
    gone = used.select(key).distinct().join(declared.select(key), key, "left_anti")
    if ignore is not None:
        gone = gone.join(ignore.select(key), key, "left_anti")
    seen = elsewhere.select(key).distinct().withColumn("seen", F.lit(True))
    return gone.join(seen, key, "left").select(key, F.when(F.col("seen"), "file_missing").otherwise("undefined").alias("tier"))


def manifest_diff(previous: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """Added, removed and modified keys; two null digests are equal."""
    a = previous.select(key, F.col(digest).alias("was"), F.lit(True).alias("in_a"))
    b = current.select(key, F.col(digest).alias("now"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def apply_waivers(findings: DataFrame, waivers: DataFrame) -> DataFrame:
    """Findings with waived and expired flags and the waivers behind them; waived ones block nothing.

    Waivers are few: they are grouped by id first, so findings go through one join, which is broadcast, and are neither
    grouped nor shuffled again; ids are few too, so dealing by them would bring all findings to a few tasks.

    findings: id, attrs VARIANT (the evidence, an object), digest, blocks_bringup, blocks_signoff. waivers: ord, id,
    match VARIANT (an object or null; both may also be maps of text), evidence_digest (null and empty bind to nothing), and reason, approved_by, date
    where there are any. A waiver matches where each of its pairs equals the finding's as text (variant_text), an absent
    key being the empty text. Waivers are tried in their order: one whose digest has changed is stale, the first that
    holds waives and ends the search. If only stale ones match, the finding is not waived but expired.

    waiver: the one that holds (ord, reason, approved_by, date, digest_pinned); stale: those before it (ord, reason,
    recorded_digest).
    """
    said = [F.coalesce(F.col(c) if c in waivers.columns else F.lit(None).cast("string"), F.lit("")).alias(c) for c in ("reason", "approved_by", "date")]
    wanted = F.coalesce(F.map_entries(_texts(waivers, "match")), F.array())
    one = F.struct("ord", wanted.alias("wanted"), F.nullif("evidence_digest", F.lit("")).alias("recorded"), *said)
    rules = waivers.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("_rules"))
    out = findings.join(F.broadcast(rules), "id", "left")
    fits = lambda r, texts: F.forall(r["wanted"], lambda e: F.coalesce(F.try_element_at(texts, e["key"]), F.lit("")) == F.coalesce(e["value"], F.lit("None")))
    holds = lambda r: r["recorded"].isNull() | (r["recorded"] == F.col("digest"))
    # The evidence is told once and bound: a column would be put into the inner lambda and told for each pair of each waiver.
    met = let(_texts(findings, "attrs"), lambda texts: F.filter("_rules", lambda r: fits(r, texts)))
    out = out.withColumn("_met", F.coalesce(F.when(F.col("_rules").isNotNull(), met), F.array()))
    first = F.get(F.filter("_met", holds), F.lit(0))
    out = out.withColumn("_first", first)
    stale = F.filter("_met", lambda r: ~holds(r) & (F.col("_first").isNull() | (r["ord"] < F.col("_first.ord"))))
    out = out.withColumns({
        "waived": F.col("_first").isNotNull(),
        "expired": F.col("_first").isNull() & (F.size("_met") > 0),
        "waiver": F.when(F.col("_first").isNotNull(), F.struct(*(F.col(f"_first.{c}").alias(c) for c in ("ord", "reason", "approved_by", "date")), F.col("_first.recorded").isNotNull().alias("digest_pinned"))),
        "stale": F.transform(stale, lambda r: F.struct(r["ord"].alias("ord"), r["reason"].alias("reason"), r["recorded"].alias("recorded_digest"))),
    })
    blocks = {c: F.col(c) & ~F.col("waived") for c in ("blocks_bringup", "blocks_signoff")}
    return out.withColumns(blocks).drop("_rules", "_met", "_first")


def _texts(rows: DataFrame, name: str) -> Column:
    """The values of an object (VARIANT) as text by name; a map of text is that already."""
    if isinstance(rows.schema[name].dataType, T.MapType):
        return F.col(name)
    return F.transform_values(F.col(name).try_cast("map<string,variant>"), lambda _, v: F.coalesce(variant_text(v), F.lit("None")))


def waiver_events(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, event, ord, reason, approved_by, date, recorded_digest, current_digest, digest_pinned): a row for
    every waiver that took effect (applied) or no longer holds (expired), also where another one waives the finding."""
    text = F.lit(None).cast("string")
    applied = F.when(F.col("waived"), F.array(F.struct(F.lit("applied").alias("event"), F.col("waiver.ord"), F.col("waiver.reason"), F.col("waiver.approved_by"), F.col("waiver.date"), text.alias("recorded_digest"), F.col("waiver.digest_pinned"))))
    expired = F.transform("stale", lambda r: F.struct(F.lit("expired").alias("event"), r["ord"].alias("ord"), r["reason"].alias("reason"), text.alias("approved_by"), text.alias("date"), r["recorded_digest"].alias("recorded_digest"), F.lit(True).alias("digest_pinned")))
    every = F.concat(expired, F.coalesce(applied, F.array().cast(EVENTS)))
    return findings.select(*keys, "id", F.explode(every).alias("e"), F.col("digest").alias("current_digest")).select(*keys, "id", "e.*", "current_digest")


EVENTS = "array<struct<event:string,ord:int,reason:string,approved_by:string,date:string,recorded_digest:string,digest_pinned:boolean>>"


def coverage(expected: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected key with checked = there is an available report; what was not checked is said so."""
    have = reports.groupBy(*keys).agg(F.bool_or(F.coalesce("available", F.lit(False))).alias("checked"))
    return expected.join(have, keys, "left").withColumn("checked", F.coalesce("checked", F.lit(False)))


def field_changes(previous: DataFrame, current: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, field, value) tables compared run by run; a field is comparable where neither side is empty."""
    a = previous.select(*keys, "field", F.nullif(F.col("value"), F.lit("")).alias("was"))
    b = current.select(*keys, "field", F.nullif(F.col("value"), F.lit("")).alias("now"))
    return a.join(b, [*keys, "field"]).select(*keys, "field", "was", "now", F.coalesce(F.col("was") != F.col("now"), F.lit(False)).alias("changed"))


def with_previous(rows: DataFrame, key: str, name: str, width: int = 4096) -> DataFrame:
    """Each whole-number key once, with the next smaller one there is. Only the last key of each width keys is ordered in one task."""
    block = F.floor(F.col(key) / width)
    known = rows.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_block", block)
    lasts = known.groupBy("_block").agg(F.max(key).alias("_last")).withColumn("_before", F.lag("_last").over(Window.orderBy("_block")))
    out = known.withColumn("_in", F.lag(key).over(Window.partitionBy("_block").orderBy(key))).join(lasts, "_block")
    return out.select(key, F.coalesce("_in", "_before").alias(name))


def drill_down(spans: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """The lines of each range as rows, by file first and then by line number."""
    near = spans.join(lines, key).where(F.col("ln").between(F.col("line_start"), F.col("line_end")))
    return near.select(key, "line_start", "line_end", "ln", "value")


def violating(paths: DataFrame, keys: list[str], most: int = 50) -> DataFrame:
    """(keys, endpoints): the first names, in order, of destinations of negative slack."""
    bad = paths.where("slack_ns < 0 AND destination <> ''").select(*keys, "destination").distinct()
    first = bad.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("destination"))).where(F.col("_place") <= most)
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list("destination")).alias("endpoints"))


def set_changes(rows: DataFrame, current: str, previous: str) -> DataFrame:
    """What is new and what is gone between two arrays; no previous array, no change."""
    a, b = F.col(current), F.coalesce(F.col(previous), F.col(current))
    return rows.withColumns({"added": F.sort_array(F.array_except(a, b)), "gone": F.sort_array(F.array_except(b, a))})


def glob_hits(paths: DataFrame, path: str, patterns: list[str]) -> DataFrame:
    """Hits of each pattern, zero included; one pass over the paths whatever the number of patterns."""
    counts = paths.agg(*(F.count_if(F.col(path).rlike(glob_regex(p))).alias(f"p{i}") for i, p in enumerate(patterns)))
    rows = F.array(*(F.struct(F.lit(p).alias("pattern"), F.col(f"p{i}").alias("hits")) for i, p in enumerate(patterns)))
    return counts.select(F.explode(rows).alias("r")).select("r.pattern", "r.hits")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dirty_inputs(inputs: DataFrame, dirty: DataFrame, root: str) -> DataFrame:
    """Input files (path) that the repository under root calls changed (path, relative to it)."""
    places = dirty.select(resolve_path(F.col("path"), F.lit(root.rstrip("/") + "/")).alias("_at")).distinct()
    return inputs.withColumn("_at", fold_path(F.col("path"))).join(places, "_at", "left_semi").drop("_at")


def produced(specs: DataFrame, made: DataFrame) -> DataFrame:
    """Every asked-for spec with what became of it: missing, no output, or made."""
    have = made.groupBy("spec").agg(F.bool_or("has_output").alias("_out"))
    state = F.when(F.col("_out").isNull(), "missing").when(~F.col("_out"), "no output").otherwise("made")
    return specs.select("spec").distinct().join(have, "spec", "left").select("spec", state.alias("state"))


def specs_of(lines: DataFrame) -> DataFrame:
    """(spec, bad): DEPTHxWIDTH lines, each once; a line that is none is bad."""
    text = lines.select(lower(F.trim("value")).alias("spec")).where("spec <> '' AND NOT startswith(spec, '#')")
    return text.distinct().withColumn("bad", ~F.col("spec").rlike(r"^\d+x\d+$"))
