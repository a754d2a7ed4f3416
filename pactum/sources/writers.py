"""Sinks: reports, contracts, snapshots, violations, quarantine and baselines."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(value, path: str | Path, copy: str | Path | None = None) -> Path:
    """A report of bounded size, written on the driver, and optionally again at a second place."""
    for p in filter(None, (path, copy)):
        Path(p).parent.mkdir(parents=True, exist_ok=True)
        Path(p).write_text(json.dumps(value, indent=2, default=str, ensure_ascii=False))
    return Path(path)


class _Dumper(yaml.SafeDumper):
    """Multi-line strings in block style."""


_Dumper.add_representer(str, lambda d, s: d.represent_scalar("tag:yaml.org,2002:str", s, style="|" if "\n" in s else None))


def write_yaml(value: dict, path: str | Path) -> Path:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.dump(value, Dumper=_Dumper, sort_keys=False, allow_unicode=True, width=100))
    return Path(path)


def write_json_lines(df: DataFrame, path: str, append: bool = True) -> None:
    """Violations and canonical records; one JSON object per line, distributed."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_quarantine(checked: DataFrame, path: str) -> None:
    """Rows with errors and when they were found; nothing is dropped."""
    checked.where(F.size("errors") > 0).withColumn("quarantined_at", F.current_timestamp()).write.mode("append").json(path)


def write_snapshot(snapshot: dict, directory: str | Path, now: datetime | None = None) -> Path:
    """`directory/<stem>/<time>.yaml`."""
    taken = (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")
    return write_yaml(snapshot, Path(directory) / snapshot["contract_stem"] / f"{taken}.yaml")


def seed_snapshots(contracts: list[dict], directory: str | Path, now: datetime | None = None) -> list[Path]:
    """A first snapshot from each contract whose stem has none yet."""
    from ..plans.synth import snapshot_of

    return [write_snapshot(snapshot_of(c, now), directory, now) for c in contracts if not list((Path(directory) / c["stem"]).glob("*.yaml"))]


def write_baselines(current: DataFrame, path: str | Path, replace: bool = True) -> Path:
    """Statistics by dataset and column; a column's old entry is replaced, others stay."""
    p = Path(path)
    try:
        known = json.loads(p.read_text()) if p.exists() else {}
    except ValueError:
        known = {}
    for r in current.collect():  # one row per numeric column
        row = {k: v for k, v in r.asDict().items() if k not in ("dataset", "column")}
        entry = known.setdefault(r["dataset"], {})
        if replace or r["column"] not in entry:
            entry[r["column"]] = row
    return write_json(known, p)


def write_rate(rate: float, path: str | Path, name: str = "output_violation_rate") -> bool:
    """Stores a baseline rate unless one is stored; whether it did."""
    from .readers import load_rate

    if load_rate(path, name) is not None:
        return False
    write_json({name: rate}, path)
    return True


def console_line(report: dict) -> str:
    return f"[{report['overall_status']}] {report['contract_stem']}: {report['passed']}/{report['total_checks']} passed, {report['failed']} failed, {report['warned']} warned"
