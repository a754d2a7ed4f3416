"""Contract validation of a stream (an extension: the batch engine is the reference point).

Each micro-batch goes through the batch validator; results carry the batch id
and are appended, so a replayed batch writes the same rows again and readers
keep the last of each (batch, check).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validate import validate
from ..plans.clauses import Contract


def validate_stream(stream: DataFrame, contract: Contract, results_path: str, checkpoint: str, trigger: dict | None = None):
    """Starts the query; stop it or await its end as usual."""

    def check(batch: DataFrame, batch_id: int) -> None:
        validate(batch, contract).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(results_path)

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_results(results: DataFrame) -> DataFrame:
    """One row per (batch, check): replays leave equal rows behind."""
    return results.dropDuplicates(["batch_id", "check_id"])
