"""The validation runner: contract and data to check results, roll-ups, samples and gates."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_text, column, flatten_once
from ..plans.clauses import Clause, Contract
from ..plans.compiler import ID_COLUMNS, RESULT_SCHEMA, Check, Compiler, results

SEVERITY_RANK = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "WARNING": 2, "LOW": 1}


def validate(df: DataFrame, contract: Contract | tuple[Clause, ...], stem: str = "data", as_of: Column | None = None, missing: str = "PASS") -> DataFrame:
    """Check results, lazily, with an `ordinal` in clause order; one Spark aggregate per grain."""
    clauses, stem = (contract.clauses, contract.stem) if isinstance(contract, Contract) else (tuple(contract), stem)
    flat = flatten_once(df)
    return results(flat, Compiler(flat, stem, df.schema, as_of, missing).checks(clauses))


def record_id(df: DataFrame) -> Column:
    """A row's best id: the first non-empty of the id columns, or else its first non-empty string, cut to 60."""
    kinds = {f.name: f.dataType for f in df.schema}
    ids = [F.nullif(column(c).cast("string"), F.lit("")) for c in ID_COLUMNS if c in kinds]
    strings = [F.left(F.nullif(column(c), F.lit("")), F.lit(60)) for c, k in kinds.items() if isinstance(k, T.StringType)]
    return F.coalesce(*ids, *strings, F.lit("unknown"))


def failing_rows(df: DataFrame, check: Check, order: str | None = None, n: int = 5) -> DataFrame | None:
    """(__id, __at): the first `n` distinct ids of failing rows, in the order of `order` (or of the scan); None if a check has no rows."""
    flat = flatten_once(df)
    ordinal = column(order).cast("string") if order else F.monotonically_increasing_id()
    keyed = flat.withColumns({"__id": record_id(flat), "__at": ordinal})
    if check.grain[0] == "distinct":
        v = as_text(column(check.grain[1]), flat.schema[check.grain[1]].dataType)
        again = Window.partitionBy("__h").orderBy("__at")  # by hashes, so long values are not shuffled
        keyed = keyed.where(v.isNotNull()).select("__id", "__at", F.struct(F.xxhash64(v), F.hash(v)).alias("__h")).withColumn("__r", F.row_number().over(again)).where("__r > 1")
    elif check.grain[0] == "items":
        keyed = keyed.withColumn("item", F.explode(column(check.grain[1]))).where(check.failing)
    elif check.grain[0] == "sequence":
        w = Window.partitionBy(column(check.grain[1])).orderBy(F.coalesce(column(check.grain[2]).cast("double"), F.lit(0.0)), "__at")
        keyed = keyed.withColumn("__r", F.row_number().over(w)).where(F.coalesce(column(check.grain[2]).cast("double"), F.lit(0.0)) != F.col("__r"))
    elif check.failing is not None:
        keyed = keyed.where(check.failing)
    else:
        return None
    return keyed.groupBy("__id").agg(F.min("__at").alias("__at")).orderBy("__at", "__id").limit(n)


def failing_sample(df: DataFrame, check: Check, order: str | None = None, n: int = 5) -> list[str]:
    rows = failing_rows(df, check, order, n)
    return [] if rows is None else [r[0] for r in rows.orderBy("__at", "__id").collect()]


def failing_samples(df: DataFrame, checks: dict[int, Check], order: str | None = None, n: int = 5) -> dict[int, list[str]]:
    """`failing_sample` of several checks in one job."""
    found = {k: failing_rows(df, c, order, n) for k, c in checks.items()}
    parts = [rows.select(F.lit(k).alias("k"), F.col("__id").alias("id"), F.col("__at").alias("at")) for k, rows in found.items() if rows is not None]
    out: dict[int, list[str]] = {k: [] for k in checks}
    for r in reduce(DataFrame.unionByName, parts).orderBy("k", "at", "id").collect() if parts else ():
        out[r.k].append(r.id)
    return out


def roll_up(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters and overall status: FAIL over WARN over ERROR over PASS."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    totals = checks.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total_checks"), *[count(s) for s in ("PASS", "FAIL", "WARN", "ERROR")])
    named = totals.withColumnsRenamed({"pass": "passed", "fail": "failed", "warn": "warned", "error": "errored"})
    status = F.when(F.col("failed") > 0, "FAIL").when(F.col("warned") > 0, "WARN").when(F.col("errored") > 0, "ERROR").otherwise("PASS")
    return named.withColumn("overall_status", status)


def batch_status(rolled: DataFrame) -> DataFrame:
    """A batch: PASS without fails and errors, WARN with errors only, else FAIL."""
    sums = rolled.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_checks", "passed", "failed", "warned", "errored")], F.count(F.lit(1)).alias("contracts"))
    return sums.withColumn("overall_status", F.when((F.col("failed") == 0) & (F.col("errored") == 0), "PASS").when(F.col("failed") == 0, "WARN").otherwise("FAIL"))


def blocking(checks: DataFrame, mode: str = "AUDIT") -> DataFrame:
    """FAILs that stop a pipeline: none in AUDIT, CRITICAL in WARN, CRITICAL and HIGH in ENFORCE."""
    severities = {"AUDIT": [], "WARN": ["CRITICAL"], "ENFORCE": ["CRITICAL", "HIGH"]}[mode]
    return checks.where((F.col("status") == "FAIL") & F.col("severity").isin(severities))


def report(df: DataFrame, contract: Contract, data_file: str = "", drift: DataFrame | None = None, order: str | None = None,
           samples: bool = True, now: datetime | None = None, snapshot_id: str = "") -> dict:
    """A validation report; failing samples are looked up only for the checks that failed."""
    flat = flatten_once(df)
    checks = Compiler(flat, contract.stem, df.schema).checks(contract.clauses)
    found = results(flat, checks)
    rows = [r.asDict() for r in found.orderBy("ordinal").collect()]  # one row per check
    sampled = failing_samples(df, {r["ordinal"]: checks[r["ordinal"]] for r in rows if samples and r["records_failing"]}, order)
    for r in rows:
        if (at := r.pop("ordinal")) in sampled:
            r["sample_failing"] = sampled[at]
    if drift is not None:
        rows += [r.asDict() for r in drift.select([f.name for f in RESULT_SCHEMA]).orderBy("check_id").collect()]
    count = lambda s: sum(r["status"] == s for r in rows)
    fail, warn, error = count("FAIL"), count("WARN"), count("ERROR")
    return {
        "report_id": str(uuid4()), "contract_id": contract.id, "contract_stem": contract.stem, "data_file": data_file, "snapshot_id": snapshot_id,
        "run_timestamp": (now or datetime.now(timezone.utc)).isoformat(), "total_records": df.count(), "total_checks": len(rows), "passed": count("PASS"),
        "failed": fail, "warned": warn, "errored": error, "overall_status": "FAIL" if fail else "WARN" if warn else "ERROR" if error else "PASS", "results": rows,
    }


def run_batch(spark, contracts: list, root: str, baselines=None) -> dict:
    """Validates every contract whose data can be found; a failing contract is one ERROR entry and the batch goes on."""
    from ..sources.readers import json_lines, load_contract, resolve_data
    from .drift import compare, statistics

    reports = []
    for path in contracts:
        try:
            contract = load_contract(path)
            data = resolve_data(contract, root)
            df = json_lines(spark, str(data), missing_ok=False) if data else None
            if df is None:
                continue
            drift = compare(statistics(df, contract.stem), baselines, contract.stem) if baselines is not None else None
            reports.append(report(df, contract, str(data), drift))
        except Exception as error:
            reports.append({"contract_stem": getattr(path, "stem", str(path)), "overall_status": "ERROR", "total_checks": 0, "passed": 0, "failed": 0, "warned": 0, "errored": 1, "error": str(error)[:300]})
    total = {k: sum(r[k] for r in reports) for k in ("total_checks", "passed", "failed", "warned", "errored")}
    status = "PASS" if not total["failed"] and not total["errored"] else "WARN" if not total["failed"] else "FAIL"
    keys = ("contract_stem", "overall_status", "total_checks", "passed", "failed", "warned", "errored")
    return {"contracts_validated": len(reports), **total, "overall_status": status, "contracts": [{k: r[k] for k in keys} for r in reports], "reports": reports}
