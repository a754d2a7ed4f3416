"""Scans: JSON lines, JSON and Markdown documents, contracts, snapshots, baselines and Git history."""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
from datetime import datetime, timezone
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import column
from ..plans.clauses import Contract


def json_lines(spark: SparkSession, path: str, schema: str | None = None, recursive: bool = False, missing_ok: bool = True) -> DataFrame:
    """One row per well-formed line; blank and malformed lines are skipped.

    A missing path is an empty dataset, or an error if `missing_ok` is false.
    """
    reader = spark.read.option("mode", "DROPMALFORMED").option("recursiveFileLookup", recursive)
    if recursive:
        reader = reader.option("pathGlobFilter", "*.jsonl")
    try:
        return reader.schema(schema).json(path) if schema else reader.json(path)
    except Exception as error:
        if missing_ok and ("PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error)):
            return spark.createDataFrame([], schema or "value string")
        raise


def json_variants(spark: SparkSession, path: str) -> DataFrame:
    """(v variant, file, line text) per line; malformed lines have a null variant, so rejects can be counted."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_name").alias("file"), "value")


def json_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """One row per whole-file JSON document."""
    return spark.read.option("multiLine", True).option("pathGlobFilter", pattern).option("mode", "DROPMALFORMED").json(path)


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """(v variant, file) per file: NULs stripped, unparsable content becomes {}."""
    texts = spark.read.option("wholetext", True).text(path)
    parsed = F.coalesce(F.try_parse_json(F.translate("value", "\x00", "")), F.parse_json(F.lit("{}")))
    return texts.select(parsed.alias("v"), F.col("_metadata.file_name").alias("file"))


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files, hashed where they are read; a file is one row, so files are below 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def snapshot_id(spark: SparkSession, path: str, chunk: int = 1 << 16) -> str:
    """The SHA-256 of a file, of any size, read in chunks; of a folder that of its files' names and hashes in order.

    Paths that only Spark can open are hashed by `fingerprint`.
    """

    def of(file: Path) -> str:
        digest = hashlib.sha256()
        with file.open("rb") as f:
            while part := f.read(chunk):
                digest.update(part)
        return digest.hexdigest()

    p = Path(path)
    if p.is_file():
        return of(p)
    if p.is_dir():
        files = sorted(f for f in p.rglob("*") if f.is_file() and not f.name.startswith((".", "_")))
        rows = [(str(f.relative_to(p)), of(f)) for f in files]
    else:
        rows = sorted(tuple(r) for r in fingerprint(spark, path).collect())  # a row per file
    return hashlib.sha256("\n".join(f"{name} {h}" for name, h in rows).encode()).hexdigest()


def load_rate(path: str | Path, name: str = "output_violation_rate") -> float | None:
    """A stored baseline rate; None if there is none."""
    p = Path(path)
    try:
        return float(json.loads(p.read_text())[name]) if p.exists() else None
    except (ValueError, KeyError, TypeError):
        return None


def check_results(spark: SparkSession, path: str, exclude: tuple[str, ...] = ("ai_", "schema_", "migration_", "validation_summary")) -> DataFrame:
    """The union of the results of all report files below `path`, with file names; files of other kinds are left out."""
    reports = json_documents(spark, path).withColumn("file", F.col("_metadata.file_name"))
    for prefix in exclude:
        reports = reports.where(~F.col("file").startswith(prefix))
    return reports.select("file", F.inline("results"))


# --- metadata: small documents, read on the driver ---


def load_yaml(path: str | Path) -> dict:
    text = Path(path).read_text().replace("\x00", "")
    return yaml.safe_load(text) or {}


def load_json(path: str | Path, default=None):
    try:
        return json.loads(Path(path).read_text().replace("\x00", ""))
    except (OSError, ValueError):
        return {} if default is None else default


def load_contract(path: str | Path, with_soda: bool = False) -> Contract:
    d, stem = load_yaml(path), Path(path).stem
    contract = Contract.from_dict(d, stem)
    if with_soda:
        contract = Contract(contract.id, contract.stem, contract.clauses + Contract.soda_clauses(d), contract.path)
    return contract


def contract_files(directory: str | Path) -> list[Path]:
    """Contracts of a directory, without the `_dbt` files."""
    return sorted(p for p in Path(directory).glob("*.y*ml") if not p.stem.endswith("_dbt"))


def load_registry(spark: SparkSession, path: str | Path) -> DataFrame:
    """Subscriptions as rows; a missing file is an empty registry."""
    schema = "contract_id string, subscriber_id string, fields_consumed array<string>, breaking_fields array<struct<field:string,reason:string>>, validation_mode string"
    given = load_yaml(path).get("subscriptions", []) if Path(path).exists() else []
    rows = []
    for s in given:
        breaking = [(b, None) if isinstance(b, str) else (b.get("field"), b.get("reason")) for b in s.get("breaking_fields") or []]
        rows.append((s.get("contract_id"), s.get("subscriber_id"), s.get("fields_consumed") or [], breaking, s.get("validation_mode")))
    return spark.createDataFrame(rows, schema)


SNAPSHOT_SCHEMA = (
    "contract_id string, stem string, snapshot_at string, taken timestamp, record_count long,"
    " field string, type string, required boolean, nullable boolean, null_fraction double, enum_values array<string>"
)


def stem_time(path: Path) -> datetime:
    """A snapshot file's time from its stem, or else its modification time (both in UTC, without zone)."""
    try:
        return datetime.strptime(path.stem, "%Y%m%dT%H%M%SZ")
    except ValueError:
        return datetime.fromtimestamp(path.stat().st_mtime, timezone.utc).replace(tzinfo=None)


def load_snapshots(spark: SparkSession, directory: str | Path, since: datetime | None = None) -> DataFrame:
    """Field rows of all snapshots `directory/<stem>/<time>.yaml`, pruned by file time before they are read."""
    rows = []
    for path in sorted(Path(directory).glob("*/*.yaml")):
        taken = stem_time(path)
        if since is None or taken >= since:
            d = load_yaml(path)
            for name, f in (d.get("fields") or {}).items():
                rows.append((d.get("contract_id"), d.get("contract_stem", path.parent.name), str(d.get("snapshot_at")), taken, d.get("record_count"), name, f.get("type"),
                             bool(f.get("required")), bool(f.get("nullable")), float(f.get("null_fraction") or 0), f.get("enum_values")))
    return spark.createDataFrame(rows, SNAPSHOT_SCHEMA)


BASELINE_SCHEMA = "dataset string, column string, mean double, stddev double, min double, max double, p25 double, p50 double, p75 double, p95 double, count long"


def load_baselines(spark: SparkSession, path: str | Path) -> DataFrame:
    """(dataset, column, statistics); a missing or corrupt file is an empty baseline."""
    names = ("mean", "stddev", "min", "max", "p25", "p50", "p75", "p95")
    rows = [
        (d, c, *[None if s.get(n) is None else float(s[n]) for n in names], s.get("count"))
        for d, columns in load_json(path).items() if isinstance(columns, dict)
        for c, s in columns.items() if isinstance(s, dict)
    ]
    return spark.createDataFrame(rows, BASELINE_SCHEMA)


def resolve_data(contract: Contract, root: str | Path, table: dict[str, str] | None = None) -> Path | None:
    """A contract's data: its server path, then a table of stems, then a file of its stem anywhere below `root`."""
    root = Path(root)
    for candidate in (contract.path, (table or {}).get(contract.stem)):
        if candidate and (root / candidate).exists():
            return root / candidate
    short = re.sub(r"^[a-z]+\d+_", "", contract.stem)
    found = [p for p in sorted(root.rglob("*.jsonl")) if p.stem in (contract.stem, short)]
    return found[0] if found else None


# --- Git, injectable so that tests need no repository ---


def run_command(command: list[str], cwd: str | Path, timeout: int = 30) -> tuple[int, str]:
    try:
        done = subprocess.run(command, cwd=cwd, capture_output=True, text=True, timeout=timeout)
        return done.returncode, done.stdout
    except (OSError, subprocess.SubprocessError):
        return -1, ""


def git_root(start: str | Path, run=run_command) -> str | None:
    code, out = run(["git", "rev-parse", "--show-toplevel"], start)
    return out.strip() or None if code == 0 else None


def git_head(repo: str | Path, run=run_command) -> str:
    """The head commit, or the SHA-1 of the path where there is no repository."""
    import hashlib

    code, out = run(["git", "rev-parse", "HEAD"], repo)
    return out.strip() if code == 0 and out.strip() else hashlib.sha1(str(repo).encode()).hexdigest()


COMMIT_SCHEMA = "file_path string, commit_hash string, author string, commit_timestamp string, commit_message string, place int"


def git_commits(spark: SparkSession, files: list[str], repo: str | Path, days: int = 14, run=run_command) -> DataFrame:
    """Recent commits of each file, renames followed; files are asked once each, whatever the number of failing checks."""
    rows = []
    for file in dict.fromkeys(files):
        code, out = run(["git", "log", "--follow", f"--since={days} days ago", "--format=%H\x1f%ae\x1f%aI\x1f%s", "--", file], repo)
        lines = [x.split("\x1f") for x in out.splitlines() if x.count("\x1f") == 3] if code == 0 else []
        rows += [(file, *x, i) for i, x in enumerate(lines, 1)]
    return spark.createDataFrame(rows, COMMIT_SCHEMA)


def git_blame(spark: SparkSession, files: list[str], repo: str | Path, entries: int = 3, run=run_command) -> DataFrame:
    """The first commits that `git blame` names for each file."""
    rows = []
    for file in dict.fromkeys(files):
        code, out = run(["git", "blame", "-p", "--", file], repo)
        seen: dict[str, dict] = {}
        commit: dict = {}
        for line in out.splitlines() if code == 0 else []:
            if m := re.match(r"^([0-9a-f]{40}) \d+ \d+", line):
                commit = seen.setdefault(m[1], {})
            for key in ("author-mail", "author-time", "summary"):
                if line.startswith(key + " "):
                    commit.setdefault(key, line[len(key) + 1 :].strip("<>"))
        for i, (h, c) in enumerate(list(seen.items())[:entries], 1):
            when = datetime.fromtimestamp(int(c.get("author-time", 0)), timezone.utc).isoformat()
            rows.append((file, h, c.get("author-mail", "unknown"), when, c.get("summary", ""), i))
    return spark.createDataFrame(rows, COMMIT_SCHEMA)


# --- text sources of the transforms ---


def whole_texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(text, file) per file."""
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path)
    return texts.select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"))


def latest(df: DataFrame, by: str) -> DataFrame:
    """The row with the greatest `by`."""
    row = F.struct(*[column(c) for c in df.columns])
    return df.agg(F.max_by(row, column(by)).alias("r")).where("r is not null").select("r.*")
