"""Profiles: structure, numbers, character patterns and confidence flags, one long table each.

All columns are measured in a few fused aggregates.  Exact distinct counts are
pre-aggregated per value hash over the unpivoted columns, so they cost one
shuffle of a few bytes a value whatever the number of columns and the length of
values; `approximate` swaps them for sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_text, char_pattern, column, flatten_once, full_match, number, value_hash

UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
CHUNK = 64  # columns of one numeric aggregate


def contract_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "number"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType, T.VariantType)):
        return "object"
    return "string (timestamp)" if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else "string"


def text_type(first: Column) -> Column:
    """A string column's type from its first value."""
    stamp = F.contains(first, F.lit("T")) & (F.length(first) >= 19) & (F.contains(first, F.lit("+")) | F.contains(first, F.lit("Z")))
    return F.when(full_match(first, UUID), "string (uuid)").when(stamp, "string (timestamp)").otherwise("string")


def _long(df: DataFrame, columns: list[str], order: Column) -> DataFrame:
    """(column, ordinal, v): every value as text."""
    kinds = {f.name: f.dataType for f in df.schema}
    entries = [F.struct(F.lit(c).alias("column"), as_text(column(c), kinds[c]).alias("v")) for c in columns]
    return df.select(order.alias("ordinal"), F.inline(F.array(*entries)))


def structural(df: DataFrame, order: str | None = None, drop_prefix: str = "_source", approximate: bool = False) -> DataFrame:
    """(column, type, total_count, null_count, null_fraction, cardinality, sample_values, char_pattern).

    Samples are the first five distinct values, the pattern the most frequent one
    among the first fifty, ties going to the one seen first; "first" follows
    `order` or else the scan.
    """
    flat = flatten_once(df)
    columns = sorted(c for c in flat.columns if not c.startswith(drop_prefix))
    kinds = {f.name: f.dataType for f in flat.schema}
    ordinal = column(order).cast("long") if order else F.monotonically_increasing_id()
    values = _long(flat, columns, ordinal)
    hashed = values.select("column", "ordinal", *value_hash(F.col("v")))
    counts = hashed.groupBy("column", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("at"))
    if approximate:
        base = hashed.groupBy("column").agg(
            F.count(F.lit(1)).alias("total_count"), F.count_if(F.col("h1").isNull()).alias("null_count"), F.approx_count_distinct("h1").alias("cardinality")
        )
    else:
        base = counts.groupBy("column").agg(F.sum("n").alias("total_count"), F.coalesce(F.sum(F.when(F.col("h1").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.count("h1").alias("cardinality"))
    # the places of each column's first five distinct values are few; only the values there are fetched
    by_place = Window.partitionBy("column").orderBy("at", "h1")
    places = counts.where("h1 is not null").withColumn("r", F.row_number().over(by_place)).where("r <= 5").select("column", "at", "h1", "r")
    fetched = values.where("v is not null").withColumn("h", F.xxhash64("v")).join(
        F.broadcast(places.withColumnRenamed("column", "c")), (F.col("column") == F.col("c")) & (F.col("ordinal") == F.col("at")) & (F.col("h") == F.col("h1"))
    )  # at most five rows a column are broadcast
    firsts = fetched.groupBy("column", "r").agg(F.min("v").alias("v"))
    samples = firsts.groupBy("column").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("sample_values"), F.min_by("v", "r").alias("first_value")
    )
    strings = [c for c in columns if isinstance(kinds[c], T.StringType)]
    head = Window.partitionBy("column").orderBy("ordinal", "v")
    heads = _long(flat, strings, ordinal).where("v is not null").withColumn("r", F.row_number().over(head)).where("r <= 50") if strings else None
    out = base.join(samples, "column", "left")
    known = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(contract_type(kinds[c])))])
    if heads is not None:
        classed = heads.withColumn("p", char_pattern(F.col("v"))).groupBy("column", "p").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("at"))
        patterns = classed.groupBy("column").agg(F.max_by("p", F.struct("n", -F.col("at"))).alias("char_pattern"))
        out = out.join(patterns, "column", "left")
        kind = F.when(known[F.col("column")] == "string", F.coalesce(text_type(F.col("first_value")), F.lit("string"))).otherwise(known[F.col("column")])
    else:
        out, kind = out.withColumn("char_pattern", F.lit(None).cast("string")), known[F.col("column")]
    share = F.round(F.col("null_count") / F.col("total_count"), 4)
    return out.select("column", kind.alias("type"), "total_count", "null_count", share.alias("null_fraction"), "cardinality", F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"), "char_pattern")


def numeric_columns(flat: DataFrame, with_boolean: bool = False) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if with_boolean else (T.NumericType,)
    return sorted(f.name for f in flat.schema if isinstance(f.dataType, kinds))


def numeric(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(by ..., column, count, min, max, mean, p25, p50, p75, p95, p99, stddev_pop, stddev_samp), percentiles interpolated.

    Exact percentiles keep a count of every different value of a column and group
    in memory; `approximate` takes mergeable sketches of bounded size instead
    (rank error 1/10,000), for columns of very many different values.
    One aggregate per CHUNK columns; item paths `array[*].leaf` are profiled over their items.
    """
    flat = flatten_once(df)
    columns = numeric_columns(flat) if columns is None else columns
    by = by or []
    parts = []
    rows = [c for c in columns if "[*]." not in c]
    for at in range(0, len(rows), CHUNK):
        chunk = rows[at : at + CHUNK]
        wide = flat.groupBy(*by).agg(*[_statistics(number(column(c)), approximate).alias(f"s{i}") for i, c in enumerate(chunk)])
        parts.append(wide.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s")) for i, c in enumerate(chunk)]))))
    for c in columns:
        if "[*]." in c:
            array, leaf = c.split("[*].", 1)
            items = df.select(*by, F.explode(column(array)).alias("item"))
            parts.append(items.groupBy(*by).agg(_statistics(number(F.col("item")[leaf]), approximate).alias("s")).select(*by, F.lit(c).alias("column"), "s"))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, count long, min double, max double, mean double, p25 double, p50 double, p75 double, p95 double, p99 double, stddev_pop double, stddev_samp double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*by, "column", "s.*")


def _statistics(x: Column, approximate: bool) -> Column:
    shares = [0.25, 0.5, 0.75, 0.95, 0.99]
    q = F.percentile_approx(x, shares, 10_000) if approximate else F.percentile(x, F.array(*map(F.lit, shares)))
    return F.struct(
        F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
        *[q[i].alias(n) for i, n in enumerate(("p25", "p50", "p75", "p95", "p99"))],
        F.stddev_pop(x).alias("stddev_pop"), F.coalesce(F.stddev_samp(x), F.when(F.count(x) > 0, F.lit(0.0))).alias("stddev_samp"),
    )


def confidence_flags(stats: DataFrame) -> DataFrame:
    """range_ok, and CLAMPED or BROKEN for means near an end."""
    flag = F.when(F.col("mean") > 0.99, "CLAMPED").when(F.col("mean") < 0.01, "BROKEN")
    return stats.select("column", ((F.col("min") >= 0) & (F.col("max") <= 1)).alias("range_ok"), flag.alias("flag"))


def quality_floor(df: DataFrame, required: list[str]) -> DataFrame:
    """Percentage of rows without nulls in the required columns that exist; 100 if none are required, 0 if none exist."""
    present = [c for c in required if c in df.columns]
    if not required or not present:
        return df.sparkSession.createDataFrame([(100.0 if not required else 0.0,)], "quality_floor double")
    complete = F.lit(True)
    for c in present:
        complete = complete & column(c).isNotNull()
    return df.agg(F.coalesce(F.round(100 * F.avg(complete.cast("int")), 1), F.lit(100.0)).alias("quality_floor"))


def with_variants(df: DataFrame, column_name: str, order: Column) -> DataFrame:
    """(key, type, n) of a JSON text column: types from each key's first non-null value, seen through VARIANT."""
    exploded = df.select(order.alias("at"), F.try_parse_json(column(column_name)).alias("v")).where("v is not null").lateralJoin(
        df.sparkSession.tvf.variant_explode(F.col("v").outer())
    )
    kind = F.schema_of_variant("value")
    typed = F.when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(kind == "BIGINT", "integer").when(kind == "BOOLEAN", "boolean").when(
        kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "VOID", None).otherwise("string")
    return exploded.groupBy("key").agg(F.min_by(typed, "at").alias("type"), F.count(F.lit(1)).alias("n"))
