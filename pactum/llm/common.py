"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoints import cut  # noqa: F401  (used by the operators)

#: The six ASCII white-space characters \x20 and \x09-\x0D.
WS = " \t\n\x0b\x0c\r"
WS_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = (1 << 63) - 1
_ROOT = str(Path(__file__).resolve().parents[2])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds `value` once per row as a lambda variable, so that a `body` that
    uses it often (or inside another lambda) never computes it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null and blank texts give []."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(WS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_RUN)),
    )


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only.  `lower` is the same, and faster, on pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes, as a long; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """`mapInArrow`, with this package on the path of Python workers even if the session was started elsewhere.

    A worker's linear algebra takes one thread: tasks are what runs in parallel,
    and threads that wait for each other on small matrices double the CPU time.
    """
    environment = df.sparkSession.sparkContext.environment
    environment |= {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *known])
    return df.mapInArrow(run, schema)


def refuse(df: DataFrame, prefix: str) -> None:
    """Raises if a column's name starts with a prefix that the caller reserves for its own columns."""
    taken = [c for c in df.columns if c.lower().startswith(prefix)]
    if taken:
        raise ValueError(f"column names starting with {prefix!r} are reserved: {taken}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(df: DataFrame, key: str, n: int, total: int) -> list:
    """The `n` rows of `df` (of `total`) whose keys have the smallest hashes, in that order.

    Rows far beyond the n-th are filtered where they are, so tasks together send
    about 4 n rows, however many tasks there are.
    """
    space = 1 << 62
    place = F.pmod(F.xxhash64(key), F.lit(space))
    bound = space if total <= 4 * n else space * 4 * n // total
    first = lambda rows: rows.orderBy(place, key).limit(n).collect()
    found = first(df.where(place < bound))
    return found if len(found) == min(n, total) or bound == space else first(df)


def hot_bound(rows: int, spark) -> int:
    """Rows of one key above which a join splits it; at most 4 * partitions keys have more."""
    return max(1024, rows // (4 * shuffle_partitions(spark)))


def hot(values: DataFrame) -> tuple[int, bool]:
    """For keys with n rows each: the bound of `join_split`, and whether a key exceeds it."""
    rows, most = values.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    bound = hot_bound(rows, values.sparkSession)
    return bound, most > bound


def join_split(rows: DataFrame, values: DataFrame, key: str, bound: int, any_hot: bool) -> DataFrame:
    """`rows` joined with `values` (unique `key`, n rows of it, ...) without sending a hot key to one task.

    Keys of more than `bound` rows, whose number the bound limits, are broadcast
    and meet their rows where these lie; the others are joined by exchange.
    """
    if not any_hot:
        return rows.join(values.drop("n"), key)
    hot = F.broadcast(values.where(F.col("n") > bound))
    cold = rows.join(hot.select(key), key, "left_anti").join(values.where(F.col("n") <= bound).drop("n"), key)
    return rows.join(hot.drop("n"), key).unionByName(cold)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
