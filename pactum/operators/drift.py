"""Statistical drift: current column statistics against stored baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import numeric

LEAST_VALUES, WARN_Z, FAIL_Z = 5, 2.0, 3.0
STATISTICS = ("mean", "stddev", "min", "max", "p25", "p50", "p75", "p95")


def statistics(df: DataFrame, dataset: str, columns: list[str] | None = None, by: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(dataset, column, mean, stddev, min, max, percentiles, count); columns with under five values are left out.

    Item paths such as `facts[*].confidence` can be named in `columns`, so scale
    faults inside arrays are seen too.  The deviation is the sample one.
    """
    stats = numeric(df, columns, by, approximate).where(F.col("count") >= LEAST_VALUES)
    return stats.select(F.lit(dataset).alias("dataset"), *(by or []), "column", "mean", F.col("stddev_samp").alias("stddev"), "min", "max", "p25", "p50", "p75", "p95", "count")


def scores(current: DataFrame, baseline: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """z and status per column: first runs and unchanged constants pass, z of 2 warns, z of 3 fails.

    Both sides have a row per column, so the join is small whatever the data.
    """
    keys = keys or ["dataset", "column"]
    base = baseline.select(*keys, F.col("mean").alias("base_mean"), F.col("stddev").alias("base_stddev"))
    joined = current.join(base, keys, "left")
    shift = F.abs(F.col("mean") - F.col("base_mean"))
    constant = F.col("base_stddev") == 0
    z = F.when(constant | F.col("base_mean").isNull(), None).otherwise(shift / F.col("base_stddev"))
    status = (
        F.when(F.col("base_mean").isNull(), "PASS")
        .when(constant, F.when(shift > 1e-9, "FAIL").otherwise("PASS"))
        .when(F.col("z") >= FAIL_Z, "FAIL").when(F.col("z") >= WARN_Z, "WARN").otherwise("PASS")
    )
    return joined.withColumn("z", z).withColumn("status", status)


def compare(current: DataFrame, baseline: DataFrame, stem: str) -> DataFrame:
    """Drift check results in the validator's schema."""
    text = lambda c: F.round(c, 6).cast("string")
    s = scores(current, baseline)
    first, constant = F.col("base_mean").isNull(), F.col("base_stddev") == 0
    actual = F.when(first, F.concat(F.lit("baseline established: mean="), text(F.col("mean")), F.lit(", stddev="), text(F.col("stddev")))).when(
        constant, F.concat(F.lit("mean="), text(F.col("mean")), F.lit(" (was constant "), text(F.col("base_mean")), F.lit(")"))
    ).otherwise(F.concat(F.lit("mean="), text(F.col("mean")), F.lit(" (z="), F.round("z", 2).cast("string"), F.lit(")")))
    severity = F.when(F.col("status") == "FAIL", "HIGH").when(F.col("status") == "WARN", "WARNING").otherwise("MEDIUM")
    fails = F.when(F.col("status") == "FAIL", F.col("count")).otherwise(F.lit(0)).cast("long")
    return s.select(
        F.concat(F.lit(f"{stem}."), "column", F.lit(".drift")).alias("check_id"), F.col("column").alias("column_name"), F.lit("drift").alias("check_type"),
        "status", actual.alias("actual_value"), F.when(first, F.lit("baseline")).otherwise(F.lit("z < 2")).alias("expected"), severity.alias("severity"),
        fails.alias("records_failing"), F.array().cast("array<string>").alias("sample_failing"), F.concat("column", F.lit(": "), actual).alias("message"),
    )


def roll_forward(current: DataFrame, baseline: DataFrame, force: bool = False) -> DataFrame:
    """The next baseline: columns that failed keep their old statistics unless `force`, the rest take the new ones."""
    names = ["dataset", "column", *STATISTICS, "count"]
    judged = scores(current, baseline).select("dataset", "column", "status")
    if not force:
        current = current.join(judged.where("status = 'FAIL'").select("dataset", "column"), ["dataset", "column"], "left_anti")
    kept = baseline.select(names).join(current.select("dataset", "column"), ["dataset", "column"], "left_anti")
    return current.select(names).unionByName(kept)
