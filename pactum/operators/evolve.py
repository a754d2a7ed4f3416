"""Schema evolution: snapshot diffs, the change taxonomy, rename matching and migration impact."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import longest_common_substring
from ..plans.taxonomy import CHANGE_TYPES, WIDENING

LEAST_COMMON = 4  # characters that two names of a rename share at least


def taxonomy(spark: SparkSession) -> DataFrame:
    rows = [(t, *v) for t, v in CHANGE_TYPES.items()]
    return spark.createDataFrame(rows, "change_type string, backward_compatible boolean, severity string, sprint_notice int, blast_radius_required boolean, required_action string")


def rename_candidates(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(old_field, new_field, score): pairs of equal type and requiredness whose names share enough, best first per old field.

    A pair must also agree on its key (`pair`).  The join is on type, so only
    fields that could match meet; a tie goes to the first new field by name.
    """
    joined = removed.alias("r").join(added.alias("a"), ["pair", "type", "required"]).select("pair", F.col("r.field").alias("old_field"), F.col("a.field").alias("new_field"))
    scored = joined.withColumn("score", longest_common_substring(F.col("old_field"), F.col("new_field"))).where(F.col("score") >= LEAST_COMMON)
    best = Window.partitionBy("pair", "old_field").orderBy(F.desc("score"), "new_field")
    return scored.withColumn("choice", F.row_number().over(best))


def _renames(candidates: DataFrame) -> DataFrame:
    """Greedy in old-field order: each old field takes its best new field that no earlier one has taken.

    Candidates are fields of one diff, so the walk is over a small sorted array per diff.
    """
    listed = candidates.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("old_field", "choice", "new_field"))).alias("c"))
    chosen = F.aggregate(
        "c",
        F.array().cast("array<struct<old_field:string,new_field:string>>"),
        lambda acc, x: F.when(
            F.exists(acc, lambda y: (y["old_field"] == x["old_field"]) | (y["new_field"] == x["new_field"])), acc
        ).otherwise(F.concat(acc, F.array(F.struct(x["old_field"].alias("old_field"), x["new_field"].alias("new_field"))))),
    )
    return listed.select("pair", F.inline(chosen))


def diff(old: DataFrame, new: DataFrame, renames: bool = True) -> DataFrame:
    """Classified changes between field tables (pair, field, type, required, nullable, enum_values).

    Many snapshot pairs are compared at once; `pair` names them.
    """
    side = lambda df, p: df.select("pair", "field", *[F.col(c).alias(f"{p}_{c}") for c in ("type", "required", "nullable", "enum_values")], F.lit(True).alias(f"in_{p}"))
    both = side(old, "old").join(side(new, "new"), ["pair", "field"], "full_outer")
    removed = both.where("in_new IS NULL").select("pair", "field", F.col("old_type").alias("type"), F.col("old_required").alias("required"))
    added = both.where("in_old IS NULL").select("pair", "field", F.col("new_type").alias("type"), F.col("new_required").alias("required"), F.col("new_nullable").alias("nullable"))
    parts = []
    if renames:
        pairs = _renames(rename_candidates(removed, added))
        parts.append(pairs.select("pair", F.col("new_field").alias("field"), F.lit("RENAME_COLUMN").alias("change_type"), F.concat(F.lit("renamed from "), "old_field").alias("detail")))
        removed = removed.join(pairs.select("pair", F.col("old_field").alias("field")), ["pair", "field"], "left_anti")
        added = added.join(pairs.select("pair", F.col("new_field").alias("field")), ["pair", "field"], "left_anti")
    parts.append(removed.select("pair", "field", F.lit("REMOVE_COLUMN").alias("change_type"), F.concat(F.lit("removed, was "), "type").alias("detail")))
    kind = F.when(F.coalesce("required", F.lit(False)), "ADD_NONNULLABLE_COLUMN").otherwise("ADD_NULLABLE_COLUMN")
    parts.append(added.select("pair", "field", kind.alias("change_type"), F.concat(F.lit("added as "), "type").alias("detail")))
    kept = both.where("in_old AND in_new")
    wider = reduce(lambda a, b: a | b, [(F.col("old_type") == o) & (F.col("new_type") == n) for o, n in WIDENING])
    change = F.when(wider, "TYPE_CHANGE_WIDENING").otherwise("TYPE_CHANGE_NARROWING")
    parts.append(kept.where(~F.col("old_type").eqNullSafe(F.col("new_type"))).select("pair", "field", change.alias("change_type"), F.concat_ws(" -> ", "old_type", "new_type").alias("detail")))
    nulls = F.concat_ws(" -> ", F.col("old_nullable").cast("string"), F.col("new_nullable").cast("string"))
    parts.append(kept.where(~F.col("old_nullable").eqNullSafe(F.col("new_nullable"))).select("pair", "field", F.lit("NULLABILITY_CHANGE").alias("change_type"), F.concat(F.lit("nullable "), nulls).alias("detail")))
    none = F.array().cast("array<string>")
    before, after = F.coalesce("old_enum_values", none), F.coalesce("new_enum_values", none)
    gone, come = F.array_sort(F.array_except(before, after)), F.array_sort(F.array_except(after, before))
    enums = kept.select("pair", "field", gone.alias("gone"), come.alias("come")).where((F.size("gone") > 0) | (F.size("come") > 0))
    detail = F.concat(F.lit("removed ["), F.array_join("gone", ","), F.lit("], added ["), F.array_join("come", ","), F.lit("]"))
    parts.append(enums.select("pair", "field", F.when(F.size("gone") > 0, "ENUM_VALUES_BREAKING").otherwise("ENUM_VALUES_ADDITIVE").alias("change_type"), detail.alias("detail")))
    changes = reduce(DataFrame.unionByName, parts)
    return changes.join(F.broadcast(taxonomy(old.sparkSession)), "change_type")  # the taxonomy has nine rows


def consecutive(snapshots: DataFrame, order: str = "taken") -> tuple[DataFrame, DataFrame]:
    """Old and new field tables of each stem's neighbouring snapshots; `pair` is "stem|new time"."""
    times = snapshots.select("stem", order).distinct()
    before = F.lag(order).over(Window.partitionBy("stem").orderBy(order))
    steps = times.withColumn("before", before).where("before is not null").withColumn("pair", F.concat_ws("|", "stem", F.col(order).cast("string")))
    new = snapshots.join(steps.drop("before"), ["stem", order])
    old = snapshots.join(steps.select("stem", F.col("before").alias(order), "pair"), ["stem", order])
    fields = ["pair", "field", "type", "required", "nullable", "enum_values"]
    return old.select(fields), new.select(fields)


def verdicts(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """BREAKING if any change is incompatible, EVOLVED if there are changes, else STABLE."""
    totals = changes.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("changes"), F.count_if(~F.col("backward_compatible")).alias("breaking"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "ERROR", "WARNING", "INFO")])
    return totals.withColumn("verdict", F.when(F.col("breaking") > 0, "BREAKING").when(F.col("changes") > 0, "EVOLVED").otherwise("STABLE"))


def parse_since(text: str, now: datetime) -> datetime:
    """"N days ago", "N hours ago", "N weeks ago", or a date in one of three forms."""
    if m := re.fullmatch(r"(\d+)\s+(day|hour|week)s?\s+ago", text.strip()):
        return now - timedelta(**{f"{m[2]}s": int(m[1])})
    for form in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%Y%m%dT%H%M%SZ"):
        try:
            return datetime.strptime(text.strip(), form)
        except ValueError:
            continue
    raise ValueError(f"not a time: {text!r}")


# A step of the migration checklist per kind of change.
_STEPS = {
    "REMOVE_COLUMN": "Keep '{field}' as an alias, collect consumers' consent, and remove it after {n} sprint(s).",
    "RENAME_COLUMN": "Serve '{field}' under its old name too; tell consumers; drop the old name after {n} sprint(s).",
    "ADD_NONNULLABLE_COLUMN": "Backfill or default '{field}' and update all producers first.",
    "TYPE_CHANGE_NARROWING": "Prove that '{field}' loses no precision; take new statistical baselines afterwards.",
    "NULLABILITY_CHANGE": "Make producers and consumers of '{field}' honour its new nullability.",
    "ENUM_VALUES_BREAKING": "Deprecate the removed values of '{field}' for {n} sprint(s).",
}


def migration_impact(changes: list[dict], stem: str, old_at: str, new_at: str, consumers: list[str] | None = None) -> dict:
    """A report over one diff's changes: verdict, consumers' failure modes, ordered checklist, rollback, readable diff."""
    breaking = [c for c in changes if not c["backward_compatible"]]
    steps = ["Freeze deployments of affected pipelines until the plan is approved."]
    if any(c["severity"] == "CRITICAL" for c in changes):
        steps.append("Take a rollback snapshot before any data is transformed.")
    steps += [_STEPS.get(c["change_type"], c["required_action"]).format(field=c["field"], n=c["sprint_notice"]) for c in breaking]
    steps += ["Validate again after the migration: every check must pass.", "Archive this report and close the ticket."]
    modes = [f"{c['field']}: {c['change_type']} ({c['detail']})" for c in breaking]
    mark = lambda c: "-" if not c["backward_compatible"] else "~" if c["severity"] == "WARNING" else "+"
    return {
        "contract_stem": stem, "old_snapshot_at": old_at, "new_snapshot_at": new_at, "compatibility_verdict": "BREAKING" if breaking else "COMPATIBLE",
        "severity_summary": {s: sum(c["severity"] == s for c in changes) for s in ("CRITICAL", "ERROR", "WARNING", "INFO")}, "changes": changes,
        "human_readable_diff": "\n".join(f"{mark(c)} [{c['change_type']}] {c['field']} {c['severity']}: {c['detail']}" for c in changes),
        "per_consumer_failure_analysis": [{"consumer": x, "failure_modes": modes, "risk_level": "HIGH" if breaking else "MEDIUM"} for x in consumers or []],
        "migration_checklist": [f"{i}. {s}" for i, s in enumerate(steps, 1)],
        "rollback_plan": [f"Restore the schema of {old_at}.", "Restore the contract and validate against it.", "Tell consumers, and find the cause before the next attempt."],
    }


def changes_of(snapshots: DataFrame, order: str = "taken") -> DataFrame:
    """The changes between each stem's neighbouring snapshots."""
    return diff(*consecutive(snapshots, order))


def analyze(snapshots: DataFrame, order: str = "taken") -> tuple[dict, int]:
    """All stems at once: per stem its verdict and changes, and an exit code (0 compatible, 1 breaking)."""
    rows = [r.asDict() for r in changes_of(snapshots, order).orderBy("pair", "field", "change_type").collect()]  # changes of schemas, not of data
    stems = {r.stem: {"verdict": "STABLE", "changes": []} for r in snapshots.select("stem").distinct().collect()}
    for r in rows:
        entry = stems[r["pair"].split("|")[0]]
        entry["changes"].append(r)
        entry["verdict"] = "BREAKING" if not r["backward_compatible"] or entry["verdict"] == "BREAKING" else "EVOLVED"
    return stems, int(any(s["verdict"] == "BREAKING" for s in stems.values()))
