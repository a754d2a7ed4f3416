"""Contract synthesis: from a profile to clauses, a contract, dbt tests and a schema snapshot.

The profile is one row per column, so all of this runs on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from uuid import NAMESPACE_DNS, uuid5

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import taxonomy
from ..functions.columns import slug

ISO_RULE = r"regex: ^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}.*$"
LEAST_CLAUSES = 8


@dataclass
class Profile:
    """What synthesis knows: columns in name order with their structural rows, numeric rows, and nested confidence paths."""

    dataset: str
    columns: dict[str, dict]
    numbers: dict[str, dict]
    nested_confidence: list[str] = field(default_factory=list)
    rows: int = 0
    floor: float = 100.0
    embedding_tokens: float | None = None

    def required(self, name: str) -> bool:
        known = taxonomy.REQUIRED_FIELDS.get(self.dataset, [])
        return name in known or name.split(".")[0] in known

    def is_id(self, name: str) -> bool:
        return name in taxonomy.ID_FIELDS.get(self.dataset, [])

    def pii(self, name: str) -> bool:
        return any(p in name for p in taxonomy.PII_FIELDS)


def profile_of(df: DataFrame, dataset: str, order: str | None = None) -> Profile:
    from pyspark.sql import functions as F

    from ..operators.profile import numeric, quality_floor, structural

    columns = {r["column"]: r.asDict() for r in structural(df, order).collect()}
    numbers = {r["column"]: r.asDict() for r in numeric(df).where("count > 0").collect()}
    nested = [f"{f.name}[*].confidence" for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) and "confidence" in f.dataType.elementType.names]
    floor = quality_floor(df, taxonomy.REQUIRED_FIELDS.get(dataset, [])).first()[0]
    tokens = None
    if {"run_type", "prompt_tokens"} <= set(df.columns):
        tokens = df.where("run_type = 'embedding'").agg(F.round(F.avg("prompt_tokens"), 1)).first()[0]
    return Profile(dataset, dict(sorted(columns.items())), dict(sorted(numbers.items())), nested, df.count(), floor, tokens)


def clauses_for(p: Profile) -> list[dict]:
    """Clauses in a fixed order, which fixes the order of checks."""
    names, out = list(p.columns), []
    has = lambda *c: all(x in p.columns for x in c)

    def custom(name: str, rule: str, fields: list[str] | str | None = None, breaking: bool = True, **more) -> None:
        where = {} if fields is None else {"field": fields} if isinstance(fields, str) else {"fields": fields}
        out.append({"type": "custom", "name": name, **where, "rule": rule, "breaking_if_violated": breaking, **more})

    out.append({"type": "not_null", "fields": [n for n in names if p.required(n)][:10] or names[:3]})
    out.append({"type": "unique", "fields": [n for n in names if p.is_id(n)] or names[:1]})
    enums = [n for n in names if n in taxonomy.ENUM_VALUES]
    out += [{"type": "accepted_values", "field": n, "values": taxonomy.ENUM_VALUES[n]} for n in enums[:2]]
    if len(enums) < 2:
        out.append({"type": "accepted_values", "field": "schema_version", "pattern": r"^\d+\.\d+$"})

    confidence = [n for n in names if "confidence" in n.lower()]
    if confidence:
        stats = [p.numbers[n] for n in confidence if n in p.numbers]
        custom("confidence_range_invariant", "0.0 <= value <= 1.0", confidence[:4], observed_violation=any(s["min"] < 0 or s["max"] > 1 for s in stats))
    for path in p.nested_confidence:
        custom("extracted_facts.confidence.range", "0.0 <= value <= 1.0", path, unit="probability_float_0_1")
        for n in confidence:
            if n in p.numbers and not 0.01 <= p.numbers[n]["mean"] <= 0.99:
                custom(f"confidence_distribution_{n.replace('.', '_')}", "0.01 <= mean <= 0.99", n, breaking=False)

    if has("end_time", "start_time"):
        custom("temporal_ordering", "end_time > start_time")
    elif has("recorded_at", "occurred_at"):
        custom("temporal_ordering", "recorded_at >= occurred_at")
    else:
        custom("created_at_not_future", "created_at <= NOW()", breaking=False)
    if has("total_tokens", "prompt_tokens"):
        custom("token_accounting_invariant", "total_tokens == prompt_tokens + completion_tokens")
    if has("total_cost"):
        custom("cost_non_negative", "value >= 0.0", "total_cost")
    if has("sequence_number"):
        custom("monotonic_sequence_per_aggregate", "sequence_number = ROW_NUMBER() OVER (PARTITION BY aggregate_id ORDER BY occurred_at)")
    if has("event_type"):
        custom("event_type_registry_compliance", r"regex: ^[A-Z][a-zA-Z0-9]*$", "event_type")
    for n in [n for n in p.numbers if "confidence" not in n.lower() and not n.startswith("_")][:2]:
        s = p.numbers[n]
        observed = {k: s[k] for k in ("min", "max", "mean", "p25", "p50", "p75", "p95", "p99")} | {"stddev": s["stddev_pop"]}
        out.append({"type": "custom", "name": f"statistical_bounds_{n.replace('.', '_')}", "field": n, "observed_profile": observed, "rule": "mean - 3*stddev <= value <= mean + 3*stddev"})

    if has("run_type"):
        seen = {} if p.embedding_tokens is None else {"observed_avg_prompt_tokens": p.embedding_tokens}
        out.append({"type": "ai_extension", "name": "embedding_drift_detection", "metric": "cosine_distance", "threshold": 0.15, "baseline_window": "7d", **seen})
    if has("extraction_model") or any(n == "outputs" or n.startswith("outputs.") for n in names):
        out.append({"type": "ai_extension", "name": "llm_output_schema_enforcement", "required_output_keys": ["facts_extracted", "avg_confidence", "extraction_model"]})
    if has("source_path") or any(n == "inputs" or n.startswith("inputs.") for n in names):
        out.append({"type": "ai_extension", "name": "prompt_input_validation", "required_input_keys": ["doc_id", "source_path"]})

    arrays = [n for n in names if p.columns[n]["type"] == "array"]
    stamps = [n for n in names if "timestamp" in p.columns[n]["type"] or n.endswith(("_at", "_time"))]
    fallbacks = [
        (bool(arrays), lambda: custom("array_fields_non_empty", "len(value) >= 1", arrays[:4])),
        (bool(stamps), lambda: custom("timestamp_iso8601_format", ISO_RULE, stamps[:4])),
        (has("nodes", "edges"), lambda: custom("lineage_no_orphan_edges", "edge.source IN nodes[*].id AND edge.target IN nodes[*].id")),
    ]
    for applies, add in fallbacks:
        if applies and len(out) < LEAST_CLAUSES:
            add()
    while len(out) < LEAST_CLAUSES:
        custom(f"minimum_record_count_{len(out)}", "COUNT(*) >= 1")
    return out


def annotate(name: str, kind: str, cache: dict[str, dict] | None = None, ask: Callable[[str, str], dict] | None = None) -> dict:
    """A column's description: from the cache, from an optional client, or from a template."""
    base = name.rsplit(".", 1)[-1]
    for known in (cache or {}).get(name), (cache or {}).get(base):
        if known:
            return {"column": name, **known}
    if ask is not None:
        try:
            return {"column": name, **ask(name, kind)}
        except Exception:  # the client is optional; the template always works
            pass
    rule = "len(value) >= 0" if kind == "array" else "value is a number" if kind in ("integer", "number") else "IS NOT NULL"
    return {"column": name, "description": f"Field '{name}' of type {kind}.", "business_rule": rule, "cross_column_relationship": "No known cross-column relationship."}


def contract_for(p: Profile, path: str = "", lineage: dict | None = None, owner: str = "", now: datetime | None = None,
                 cache: dict[str, dict] | None = None, ask: Callable[[str, str], dict] | None = None) -> dict:
    clauses, now = clauses_for(p), now or datetime.now(timezone.utc)
    notes = {n: annotate(n, c["type"], cache, ask) for n, c in p.columns.items()}
    upstream, downstream = (lineage or {}).get("upstream", []), (lineage or {}).get("downstream", [])
    fields = []
    for n, c in p.columns.items():
        target = taxonomy.FOREIGN_KEYS.get(n.rsplit(".", 1)[-1])
        entry = {
            "name": n, "type": c["type"], "description": notes[n]["description"], "required": p.required(n), "primaryKey": p.is_id(n), "pii": p.pii(n),
            "classification": "restricted" if p.pii(n) else "internal", "null_fraction": c["null_fraction"], "cardinality": c["cardinality"], "sample_values": c["sample_values"],
            "downstream_consumers": [*downstream, *([f"{target[0]} (via FK {n} → {target[1]})"] if target else [])],
        }
        if c.get("char_pattern"):
            entry["char_pattern"] = c["char_pattern"]
        if n in p.numbers:
            s = p.numbers[n]
            entry["statistics"] = {k: round(s[k], 6) for k in ("min", "max", "mean", "p25", "p50", "p75", "p95", "p99")} | {"stddev": round(s["stddev_pop"], 6)}
        if n in taxonomy.ENUM_VALUES:
            entry["enum"] = taxonomy.ENUM_VALUES[n]
        fields.append(entry)
    checks = [f"missing_count({n}) = 0" for n in clauses[0]["fields"]] + [f"duplicate_count({n}) = 0" for n in clauses[1]["fields"]] + ["row_count >= 1"]
    key = [n for n in p.columns if p.required(n)]
    consumers = [{"id": slug(d.split(" (")[0]), "description": d, "fields_consumed": key, "breaking_if_changed": key[:2]} for d in downstream]
    return {
        "kind": "DataContract", "apiVersion": "v3.0.0", "id": str(uuid5(NAMESPACE_DNS, p.dataset)),
        "info": {"title": f"{p.dataset.replace('_', ' ').title()} Data Contract", "version": "1.0.0", "owner": owner, "description": f"Generated from {p.rows} records. Quality floor: {p.floor}%."},
        "servers": {"local": {"type": "local", "path": path, "format": "jsonl"}},
        "terms": {"usage": "Internal inter-system data contract.", "limitations": "All required fields must remain non-null across schema versions."},
        "generatedAt": now.isoformat(), "recordCount": p.rows, "qualityFloor": p.floor, "status": "active",
        "stem": taxonomy.OUTPUT_STEMS.get(p.dataset, p.dataset), "schema": {"fields": fields},
        "quality": {"type": "SodaChecks", "specification": {f"checks for {p.dataset}": checks}}, "quality_extended": clauses,
        "llm_annotations": list(notes.values()), "lineage": {"upstream": upstream, "downstream": consumers}, "contacts": {"owner": owner}, "tags": ["data-contract", p.dataset],
    }


def dbt_schema(contract: dict) -> dict:
    """dbt model tests: not_null, unique, accepted_values, accepted_range, relationships, and unique combinations."""
    columns = []
    for f in contract["schema"]["fields"]:
        tests: list = [t for t, on in (("not_null", f["required"]), ("unique", f["primaryKey"])) if on]
        if f.get("enum"):
            tests.append({"accepted_values": {"values": f["enum"]}})
        if "confidence" in f["name"].lower():
            tests.append({"dbt_utils.accepted_range": {"min_value": 0.0, "max_value": 1.0, "inclusive": True}})
        target = taxonomy.FOREIGN_KEYS.get(f["name"].rsplit(".", 1)[-1])
        if target and not f["primaryKey"]:
            tests.append({"relationships": {"to": f"ref('{target[0]}')", "field": target[1]}})
        columns.append({"name": f["name"], "description": f["description"], **({"tests": tests} if tests else {})})
    several = [c["fields"] for c in contract["quality_extended"] if c["type"] == "unique" and len(c["fields"]) > 1]
    model = {"name": contract["tags"][-1], "columns": columns}
    if several:
        model["tests"] = [{"dbt_utils.unique_combination_of_columns": {"combination_of_columns": x}} for x in several]
    return {"version": 2, "models": [model]}


def snapshot_of(contract: dict, now: datetime | None = None) -> dict:
    """The schema part of a contract, as a dated snapshot."""
    enums = {c["field"]: c["values"] for c in contract.get("quality_extended", []) if c["type"] == "accepted_values" and c.get("values")}
    fields = {
        f["name"]: {"type": f["type"], "required": f["required"], "nullable": not f["required"], "null_fraction": f["null_fraction"], "enum_values": enums.get(f["name"])}
        for f in contract["schema"]["fields"]
    }
    return {"contract_id": contract["id"], "contract_stem": contract["stem"], "snapshot_at": (now or datetime.now(timezone.utc)).isoformat(), "record_count": contract["recordCount"], "fields": fields}


def generate(df: DataFrame, dataset: str, directory: str | None = None, path: str = "", lineage: dict | None = None, order: str | None = None,
             now: datetime | None = None, snapshots: str | None = None) -> dict:
    """Profiles, synthesizes, and (with a directory) writes the contract, its dbt tests and its snapshot."""
    from ..sources.writers import write_snapshot, write_yaml

    contract = contract_for(profile_of(df, dataset, order), path, lineage, now=now)
    if directory:
        write_yaml(contract, f"{directory}/{contract['stem']}.yaml")
        write_yaml(dbt_schema(contract), f"{directory}/{contract['stem']}_dbt.yml")
    if snapshots:
        write_snapshot(snapshot_of(contract, now), snapshots, now)
    return contract
