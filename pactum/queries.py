"""The registered queries of the engine, each with the SQL that a second engine can check it by.

Every query reads whole tables.  Names start with the operator's handle in
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.checkpoints import shared_folder
from .operators import ai, drift, etl, evolve, lineage, profile, report, validate
from .plans.clauses import Clause, parse_soda
from .plans.taxonomy import CHANGE_TYPES, WIDENING
from .sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CHECK_COLUMNS = ["check_id", "column_name", "check_type", "status", "severity", "records_failing"]


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked(df: DataFrame, *clauses: Clause, stem: str = "data") -> DataFrame:
    return validate.validate(df, clauses, stem).select(CHECK_COLUMNS)


def custom(name: str, rule: str, *fields: str, breaking: bool = True, profile: dict | None = None) -> Clause:
    return Clause("custom", name=name, fields=fields, rule_text=rule, breaking=breaking, profile=profile or {})


def row_sql(check_id: str, col: str, kind: str, severity: str, bad: str, source: str, status: str | None = None) -> str:
    """One check row: `bad` is an aggregate over `source`."""
    state = status or "CASE WHEN f > 0 THEN 'FAIL' ELSE 'PASS' END"
    return (
        f"SELECT '{check_id}' AS check_id, '{col}' AS column_name, '{kind}' AS check_type, {state} AS status, '{severity}' AS severity,"
        f" CAST(f AS BIGINT) AS records_failing FROM (SELECT {bad} AS f FROM {source})"
    )


def rows_sql(*rows: str) -> str:
    return " UNION ALL ".join(rows)


def where(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


# --- clauses ---

LABELLED = "(SELECT d.doc_id, d.text, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "text", "quality", "toxic")


@query("c01_not_null", rows_sql(*[row_sql(f"data.{c}.not_null", c, "not_null", "CRITICAL", where(f"{c} IS NULL" + (f" OR {c} = ''" if c == "text" else "")), LABELLED) for c in ("doc_id", "text", "quality")],
                                row_sql("data.absent.not_null", "absent", "not_null", "CRITICAL", "count(*)", "documents")))
def c01_not_null(spark, sf_dir):
    return checked(labelled(spark, sf_dir), Clause("not_null", fields=("doc_id", "text", "quality", "absent")))


@query("c02_unique", row_sql("data.o_orderkey.unique", "o_orderkey", "unique", "CRITICAL", "count(o_orderkey) - count(DISTINCT o_orderkey)", "orders"))
def c02_unique(spark, sf_dir):
    return checked(table(spark, sf_dir, "orders"), Clause("unique", fields=("o_orderkey",)))


@query("c02_unique_composite", row_sql("data.key.unique", "key", "unique", "CRITICAL", "count(*) - count(DISTINCT (l_orderkey, l_linenumber))", "lineitem"))
def c02_unique_composite(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key"))
    return checked(lines, Clause("unique", fields=("key",)))


@query("c03_accepted_values", row_sql("data.event_type.accepted_values", "event_type", "accepted_values", "HIGH", where("event_type NOT IN ('click', 'view', 'purchase', 'signup')"), "events"))
def c03_accepted_values(spark, sf_dir):
    return checked(table(spark, sf_dir, "events"), Clause("accepted_values", fields=("event_type",), values=("click", "view", "purchase", "signup")))


@query("c04_accepted_pattern", row_sql("data.o_orderpriority.accepted_values", "o_orderpriority", "accepted_values", "HIGH", where("NOT regexp_full_match(o_orderpriority, '[1-3]-[A-Z]+')"), "orders"))
def c04_accepted_pattern(spark, sf_dir):
    return checked(table(spark, sf_dir, "orders"), Clause("accepted_values", fields=("o_orderpriority",), pattern="[1-3]-[A-Z]+"))


@query("c05_regex", row_sql("data.brand.p_brand", "p_brand", "custom", "CRITICAL", where("NOT regexp_full_match(p_brand, 'Brand#[1-3][0-9]')"), "part"))
def c05_regex(spark, sf_dir):
    return checked(table(spark, sf_dir, "part"), custom("brand", "regex: Brand#[1-3][0-9]", "p_brand"))


@query("c06_value_bound", row_sql("data.balance.c_acctbal", "c_acctbal", "custom", "CRITICAL", where("NOT (c_acctbal >= 0)"), "customer"))
def c06_value_bound(spark, sf_dir):
    return checked(table(spark, sf_dir, "customer"), custom("balance", "value >= 0", "c_acctbal"))


@query("c07_value_range", rows_sql(*[row_sql(f"data.limits.{c}", c, "range", "CRITICAL", where(f"{c} < {lo} OR {c} > {hi}"), "lineitem") for c, lo, hi in (("l_discount", 0, 0.05), ("l_tax", 0, 0.05))]))
def c07_value_range(spark, sf_dir):
    return checked(table(spark, sf_dir, "lineitem"), custom("limits", "0.0 <= value <= 0.05", "l_discount", "l_tax"))


@query("c08_scale_bug", """SELECT 'data.scale' AS check_id, f > 0 AS out_of_range, m > 1 AS looks_like_percent, CAST(f AS BIGINT) AS records_failing
 FROM (SELECT count(*) FILTER (WHERE l_discount * 100 < 0 OR l_discount * 100 > 1) AS f, max(l_discount * 100) AS m FROM lineitem)""")
def c08_scale_bug(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 100).alias("rate"))
    found = validate.validate(df, (custom("scale", "0.0 <= value <= 1.0", "rate"),))
    return found.select("check_id", (F.col("records_failing") > 0).alias("out_of_range"), F.contains("message", F.lit("0-100 scale")).alias("looks_like_percent"), "records_failing")


@query("c09_len_bound", rows_sql(row_sql("data.dimension.embedding", "embedding", "custom", "CRITICAL", where("NOT len(embedding) == 64"), "embeddings")))
def c09_len_bound(spark, sf_dir):
    return checked(table(spark, sf_dir, "embeddings"), custom("dimension", "len(value) == 64", "embedding"))


@query("c09_len_bound_text", row_sql("data.long_enough.text", "text", "custom", "MEDIUM", where("NOT length(text) >= 500"), "documents"))
def c09_len_bound_text(spark, sf_dir):
    return checked(table(spark, sf_dir, "documents"), custom("long_enough", "len(value) >= 500", "text", breaking=False))


@query("c10_column_comparison", row_sql("data.order_before_ship", "o_orderdate,l_shipdate", "custom", "CRITICAL", where("NOT o_orderdate <= l_shipdate"), "lineitem JOIN orders ON l_orderkey = o_orderkey"))
def c10_column_comparison(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderdate", "l_shipdate")
    return checked(joined, custom("order_before_ship", "o_orderdate <= l_shipdate"))


@query("c11_not_future", row_sql("data.ts_not_future", "ts", "custom", "MEDIUM", where("ts > TIMESTAMP '2024-01-15'"), "events"))
def c11_not_future(spark, sf_dir):
    as_of = F.lit("2024-01-15").cast("timestamp")
    return validate.validate(table(spark, sf_dir, "events"), (custom("ts_not_future", "ts <= NOW()", breaking=False),), as_of=as_of).select(CHECK_COLUMNS)


@query("c12_additive", row_sql("data.charge", "total,price,tax", "custom", "CRITICAL", where("abs(l_extendedprice * (1 + l_tax) - (l_extendedprice + round(l_extendedprice * l_tax, 1))) > 0.01"), "lineitem"))
def c12_additive(spark, sf_dir):
    price, tax = F.col("l_extendedprice"), F.col("l_tax")
    df = table(spark, sf_dir, "lineitem").select((price * (1 + tax)).alias("total"), price.alias("price"), F.round(price * tax, 1).alias("tax"))
    return checked(df, custom("charge", "total == price + tax"))


SEQUENCE = "(SELECT l_linenumber AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem)"


@query("c13_sequence", row_sql("data.lines", "l_linenumber", "custom", "CRITICAL", where("s <> r"), SEQUENCE))
def c13_sequence(spark, sf_dir):
    return checked(table(spark, sf_dir, "lineitem"), custom("lines", "l_linenumber = ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)"))


@query("c13_sequence_turns", row_sql("data.turns", "n", "custom", "CRITICAL", where("n <> r"), "(SELECT turn + 1 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)"))
def c13_sequence_turns(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("n"))
    return checked(df, custom("turns", "n = ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY n)"))


@query("c14_stat_bounds", """SELECT e.event_type, count(*) FILTER (WHERE value < m - 2 * s OR value > m + 2 * s) AS outside, round(avg(value), 6) AS mean
 FROM events e JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) p ON e.event_type = p.event_type GROUP BY 1""")
def c14_stat_bounds(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    p = profile.numeric(events, ["value"], by=["event_type"]).select("event_type", "mean", "stddev_pop")
    joined = events.join(F.broadcast(p), "event_type")  # one row per event type
    beyond = (F.col("value") < F.col("mean") - 2 * F.col("stddev_pop")) | (F.col("value") > F.col("mean") + 2 * F.col("stddev_pop"))
    return joined.groupBy("event_type").agg(F.count_if(beyond).alias("outside"), F.round(F.avg("value"), 6).alias("mean"))


@query("c14_stored_profile", row_sql("data.quantity", "l_quantity", "statistical", "MEDIUM", where("l_quantity < 25 - 3 * 7.5 OR l_quantity > 25 + 3 * 7.5"), "lineitem"))
def c14_stored_profile(spark, sf_dir):
    return checked(table(spark, sf_dir, "lineitem"), custom("quantity", "mean - 3*stddev <= value <= mean + 3*stddev", "l_quantity", breaking=False, profile={"mean": 25, "stddev": 7.5}))


@query("c15_row_count", rows_sql(row_sql("data.some", "*", "custom", "CRITICAL", "CASE WHEN count(*) >= 1 THEN 0 ELSE count(*) END", "region"),
                                 row_sql("data.many", "*", "custom", "CRITICAL", "CASE WHEN count(*) >= 1000 THEN 0 ELSE count(*) END", "region")))
def c15_row_count(spark, sf_dir):
    return checked(table(spark, sf_dir, "region"), custom("some", "COUNT(*) >= 1"), custom("many", "COUNT(*) >= 1000"))


@query("c16_unknown", "SELECT 'data.odd' AS check_id, '*' AS column_name, 'custom' AS check_type, 'PASS' AS status, 'MEDIUM' AS severity, CAST(0 AS BIGINT) AS records_failing UNION ALL"
       " SELECT 'data.thing', '*', 'mystery', 'PASS', 'LOW', 0")  # fmt: skip
def c16_unknown(spark, sf_dir):
    return checked(table(spark, sf_dir, "region"), custom("odd", "the moon is full", breaking=False), Clause("mystery", name="thing"))


@query("c17_empty", "SELECT * FROM (VALUES ('data.r_name.not_null', 'PASS', 'CRITICAL', CAST(0 AS BIGINT)), ('data.b.r_regionkey', 'PASS', 'CRITICAL', 0), ('data.n', 'FAIL', 'CRITICAL', 0)) t(check_id, status, severity, records_failing)")
def c17_empty(spark, sf_dir):
    none = table(spark, sf_dir, "region").where("r_regionkey < 0")
    return checked(none, Clause("not_null", fields=("r_name",)), custom("b", "value > 5", "r_regionkey"), custom("n", "COUNT(*) >= 1")).select("check_id", "status", "severity", "records_failing")


@query("c18_required_keys", "SELECT 'data.outputs' AS check_id, 'WARN' AS status, count(*) AS records_failing, 'missing missing: ' || count(*) AS actual_value FROM events")
def c18_required_keys(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.from_json("props", "k int, missing int").alias("outputs"))
    return validate.validate(df, (Clause("ai_extension", name="outputs", keys={"required_output_keys": ["k", "missing"]}),)).select("check_id", "status", "records_failing", "actual_value")


@query("c19_required_inputs", row_sql("data.inputs", "inputs", "ai_extension", "WARNING", where("trim(coalesce(text, '')) = '' OR quality IS NULL"), LABELLED, "CASE WHEN f > 0 THEN 'WARN' ELSE 'PASS' END"))
def c19_required_inputs(spark, sf_dir):
    df = labelled(spark, sf_dir).select(F.struct("text", "quality").alias("inputs"))
    return checked(df, Clause("ai_extension", name="inputs", keys={"required_input_keys": ["text", "quality"]}))


@query("c20_advisory", "SELECT * FROM (VALUES ('data.embedding_drift_detection', 'WARN', 'WARNING'), ('data.other', 'PASS', 'LOW')) t(check_id, status, severity)")
def c20_advisory(spark, sf_dir):
    return checked(table(spark, sf_dir, "region"), Clause("ai_extension", name="embedding_drift_detection"), Clause("ai_extension", name="other")).select("check_id", "status", "severity")


# A contract over orders used by the roll-ups and by the flagship query.
ORDER_CLAUSES = (
    Clause("not_null", fields=("o_orderkey", "o_custkey", "o_orderdate")),
    Clause("unique", fields=("o_orderkey", "o_custkey")),
    Clause("accepted_values", fields=("o_orderstatus",), values=("O", "F", "P")),
    Clause("accepted_values", fields=("o_orderpriority",), pattern="[1-3]-[A-Z]+"),
    custom("price_range", "0.0 <= value <= 300000.0", "o_totalprice"),
    custom("price_spread", "value >= 1000", "o_totalprice", breaking=False),
    custom("enough", "COUNT(*) >= 1"),
)
ORDER_CHECKS = rows_sql(
    *[row_sql(f"orders.{c}.not_null", c, "not_null", "CRITICAL", where(f"{c} IS NULL"), "orders") for c in ("o_orderkey", "o_custkey", "o_orderdate")],
    *[row_sql(f"orders.{c}.unique", c, "unique", "CRITICAL", f"count({c}) - count(DISTINCT {c})", "orders") for c in ("o_orderkey", "o_custkey")],
    row_sql("orders.o_orderstatus.accepted_values", "o_orderstatus", "accepted_values", "HIGH", where("o_orderstatus NOT IN ('O', 'F', 'P')"), "orders"),
    row_sql("orders.o_orderpriority.accepted_values", "o_orderpriority", "accepted_values", "HIGH", where("NOT regexp_full_match(o_orderpriority, '[1-3]-[A-Z]+')"), "orders"),
    row_sql("orders.price_range", "o_totalprice", "range", "CRITICAL", where("o_totalprice < 0 OR o_totalprice > 300000"), "orders"),
    row_sql("orders.price_spread.o_totalprice", "o_totalprice", "custom", "MEDIUM", where("NOT o_totalprice >= 1000"), "orders"),
    row_sql("orders.enough", "*", "custom", "CRITICAL", "0", "(SELECT 1)"),
)


def order_checks(spark, sf_dir):
    return validate.validate(table(spark, sf_dir, "orders"), ORDER_CLAUSES, "orders")


@query("c00_contract_orders", ORDER_CHECKS)
def c00_contract_orders(spark, sf_dir):
    """The flagship: a ten-check contract over orders in one fused aggregate and two pre-aggregated distinct counts."""
    return order_checks(spark, sf_dir).select(CHECK_COLUMNS)


@query("c25_rollup", f"SELECT count(*) AS total_checks, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed, CAST(0 AS BIGINT) AS warned, CAST(0 AS BIGINT) AS errored, CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS overall_status FROM ({ORDER_CHECKS})")
def c25_rollup(spark, sf_dir):
    return validate.roll_up(order_checks(spark, sf_dir))


@query("c26_batch", f"""WITH c AS ({ORDER_CHECKS}), r AS (SELECT split_part(check_id, '.', 1) || severity AS g, count(*) AS n, count(*) FILTER (WHERE status = 'PASS') AS p, count(*) FILTER (WHERE status = 'FAIL') AS f FROM c GROUP BY 1)
 SELECT CAST(sum(n) AS BIGINT) AS total_checks, CAST(sum(p) AS BIGINT) AS passed, CAST(sum(f) AS BIGINT) AS failed, CAST(0 AS BIGINT) AS warned, CAST(0 AS BIGINT) AS errored, count(*) AS contracts, CASE WHEN sum(f) = 0 THEN 'PASS' ELSE 'FAIL' END AS overall_status FROM r""")
def c26_batch(spark, sf_dir):
    return validate.batch_status(validate.roll_up(order_checks(spark, sf_dir), ["severity"]))


@query("c27_gate", f"WITH c AS ({ORDER_CHECKS}) SELECT m.mode, c.check_id, c.severity FROM c, (VALUES ('WARN'), ('ENFORCE')) m(mode) WHERE status = 'FAIL' AND (severity = 'CRITICAL' OR (mode = 'ENFORCE' AND severity = 'HIGH'))")
def c27_gate(spark, sf_dir):
    found = order_checks(spark, sf_dir)
    parts = [validate.blocking(found, m).select(F.lit(m).alias("mode"), "check_id", "severity") for m in ("AUDIT", "WARN", "ENFORCE")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SODA = ["row_count >= 1000", "missing_count(quality) = 0", "duplicate_count(text) = 0", "min(doc_id) >= 0", "max(doc_id) < 500", "avg(quality) >= 0.5"]


@query("c28_soda", rows_sql(
    row_sql("data.row_count", "*", "soda", "HIGH", "CASE WHEN count(*) >= 1000 THEN 0 ELSE count(*) END", LABELLED),
    row_sql("data.quality.missing_count", "quality", "soda", "HIGH", where("quality IS NULL"), LABELLED),
    row_sql("data.text.duplicate_count", "text", "soda", "HIGH", "count(text) - count(DISTINCT text)", LABELLED),
    row_sql("data.doc_id.min", "doc_id", "soda", "HIGH", "CASE WHEN min(doc_id) >= 0 THEN 0 ELSE 1 END", LABELLED),
    row_sql("data.doc_id.max", "doc_id", "soda", "HIGH", "CASE WHEN max(doc_id) < 500 THEN 0 ELSE 1 END", LABELLED),
    row_sql("data.quality.avg", "quality", "soda", "HIGH", "CASE WHEN avg(quality) >= 0.5 THEN 0 ELSE 1 END", LABELLED)))
def c28_soda(spark, sf_dir):
    return checked(labelled(spark, sf_dir), *map(parse_soda, SODA))


@query("c30_edge_integrity", "SELECT 'data.edges' AS check_id, count(*) FILTER (WHERE n.n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3)) AS records_failing FROM nation n")
def c30_edge_integrity(spark, sf_dir):
    nodes = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("region"))
    snapshot = nodes.unionByName(nations.select("node_id")).agg(F.collect_list(F.struct("node_id")).alias("nodes")).join(
        nations.agg(F.collect_list(F.struct(F.col("node_id").alias("source"), F.col("region").alias("target"))).alias("edges")), F.lit(True))
    return checked(snapshot, custom("edges", "edge.source IN nodes[*].id AND edge.target IN nodes[*].id")).select("check_id", "records_failing")


@query("c31_mean_range", row_sql("data.mean.quality", "quality", "custom", "MEDIUM", "CASE WHEN avg(quality) BETWEEN 0.01 AND 0.8 THEN 0 ELSE count(quality) END", "labels"))
def c31_mean_range(spark, sf_dir):
    return checked(table(spark, sf_dir, "labels"), custom("mean", "0.01 <= mean <= 0.8", "quality", breaking=False))


@query("c32_filtered_mean", "SELECT round(avg(value) FILTER (WHERE event_type = 'purchase'), 1) AS mean FROM events")
def c32_filtered_mean(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.round(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), 1).alias("mean"))


# --- projections, samples, profiles ---


@query("p01_flatten_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k FROM events""")
def p01_flatten_json(spark, sf_dir):
    from .functions.columns import flatten_once

    df = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return flatten_once(df).withColumnRenamed("props.k", "props_k")


@query("p02_array_items", "SELECT 'data.unit' AS check_id, count(*) FILTER (WHERE x < -2 OR x > 2) AS records_failing, count(*) AS items FROM (SELECT unnest(embedding) AS x FROM embeddings)")
def p02_array_items(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: F.struct(x.alias("x"))).alias("items"))
    found = checked(vectors, custom("unit", "-2 <= value <= 2", "items[*].x")).select("check_id", "records_failing")
    return found.join(vectors.agg(F.sum(F.size("items")).alias("items")), F.lit(True))


@query("p04_sample_failing", "SELECT CAST(c_custkey AS VARCHAR) AS id, row_number() OVER (ORDER BY c_custkey) AS place FROM (SELECT c_custkey FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 5)")
def p04_sample_failing(spark, sf_dir):
    bad = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("at"))
    first = bad.groupBy("id").agg(F.min("at").alias("at")).orderBy("at").limit(5)  # the report's five samples
    return first.select("id", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))


STRUCTURE = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("ag01_structural", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS total_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS cardinality FROM orders" for c, t in zip(STRUCTURE, ("integer", "integer", "string", "number", "string (timestamp)", "string"))))
def ag01_structural(spark, sf_dir):
    return profile.structural(table(spark, sf_dir, "orders"), "o_orderkey").select("column", "type", "total_count", "null_count", "cardinality")


@query("ag01_samples", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", list(v ORDER BY seen, v) AS sample_values FROM (SELECT CAST({c} AS VARCHAR) AS v, min(c_custkey) AS seen FROM customer GROUP BY 1 ORDER BY seen, v LIMIT 5)" for c in ("c_name", "c_mktsegment", "c_nationkey")))
def ag01_samples(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return profile.structural(df, "c_custkey").select("column", "sample_values").where(F.col("column") != "c_custkey")


NUMBERS = {"customer": ("c_acctbal",), "lineitem": ("l_quantity", "l_extendedprice", "l_discount")}


@query("ag02_numeric", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(quantile_cont({c}, 0.95), 6) AS p95, round(quantile_cont({c}, 0.99), 6) AS p99, round(stddev_pop({c}), 6) AS stddev_pop, round(stddev_samp({c}), 6) AS stddev_samp FROM {t}" for t, cs in NUMBERS.items() for c in cs))
def ag02_numeric(spark, sf_dir):
    parts = [profile.numeric(table(spark, sf_dir, t), list(cs)) for t, cs in NUMBERS.items()]
    out = parts[0].unionByName(parts[1])
    return out.select("column", "count", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "p25", "p50", "p75", "p95", "p99", "stddev_pop", "stddev_samp")])


@query("ag05_char_pattern", "SELECT * FROM (VALUES ('lang', 'snake_case'), ('source', 'snake_case')) t(\"column\", char_pattern)")
def ag05_char_pattern(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return profile.structural(df, "doc_id").where("char_pattern is not null").select("column", "char_pattern")


@query("ag05_pattern_counts", "SELECT CASE WHEN regexp_full_match(url, 'https?://\\S+') THEN 'url' ELSE 'free-text' END AS pattern, count(*) AS n FROM pages GROUP BY 1")
def ag05_pattern_counts(spark, sf_dir):
    from .functions.columns import char_pattern

    return table(spark, sf_dir, "pages").groupBy(char_pattern(F.col("url")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query("ag06_conf_flags", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({x}) >= 0 AND max({x}) <= 1 AS range_ok, CASE WHEN avg({x}) > 0.99 THEN 'CLAMPED' WHEN avg({x}) < 0.01 THEN 'BROKEN' END AS flag FROM lineitem" for c, x in (("discount", "l_discount"), ("tiny", "l_discount / 100"), ("scaled", "l_discount * 100"))))
def ag06_conf_flags(spark, sf_dir):
    d = F.col("l_discount")
    return profile.confidence_flags(profile.numeric(table(spark, sf_dir, "lineitem").select(d.alias("discount"), (d / 100).alias("tiny"), (d * 100).alias("scaled"))))


@query("ag18_variant_types", "SELECT * FROM (SELECT 'k' AS key, 'integer' AS type, count(*) AS n FROM events)")
def ag18_variant_types(spark, sf_dir):
    return profile.with_variants(table(spark, sf_dir, "events"), "props", F.col("event_id"))


@query("b15_quality_floor", f"SELECT round(100.0 * avg(CASE WHEN doc_id IS NOT NULL AND quality IS NOT NULL THEN 1 ELSE 0 END), 1) AS quality_floor FROM {LABELLED}")
def b15_quality_floor(spark, sf_dir):
    return profile.quality_floor(labelled(spark, sf_dir), ["doc_id", "quality", "not_there"])


# --- windows, top-k, joins ---


@query("w02_running_seq", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence_number FROM events")
def w02_running_seq(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w).cast("long").alias("sequence_number"))


@query("w03_duplicates", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r > 1")
def w03_duplicates(spark, sf_dir):
    w = Window.partitionBy("t").orderBy("doc_id")
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("t"))
    return keyed.withColumn("r", F.row_number().over(w)).where("r > 1").select("doc_id")


@query("w05_dedup_first", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def w05_dedup_first(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("t")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("t")


@query("w09_causation", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS causation_id FROM events")
def w09_causation(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("causation_id"))


RANK = "CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'WARNING' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


@query("t02_topk_severity", f"SELECT check_id, severity, records_failing FROM (SELECT *, row_number() OVER (ORDER BY {RANK} DESC, records_failing DESC, check_id) AS r FROM ({ORDER_CHECKS}) WHERE status = 'FAIL') WHERE r <= 3")
def t02_topk_severity(spark, sf_dir):
    ranked = order_checks(spark, sf_dir).withColumn("place", -F.col("records_failing"))
    return report.top_failures(ranked, 3, "place").select("check_id", "severity", "records_failing")


@query("ag09_by_severity", f"SELECT severity, count(*) AS n FROM ({ORDER_CHECKS}) WHERE status = 'FAIL' GROUP BY 1")
def ag09_by_severity(spark, sf_dir):
    return report.by_severity(order_checks(spark, sf_dir))


HALVES = "(SELECT event_type, value, event_id < (SELECT (max(event_id) + 1) // 2 FROM events) AS old FROM events)"


def halves(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    middle = events.agg(F.floor((F.max("event_id") + 1) / 2).alias("middle"))
    return events.join(F.broadcast(middle), F.lit(True)).withColumn("old", F.col("event_id") < F.col("middle"))  # one row


def by_type(df):
    return drift.statistics(df, "events", ["value"], ["event_type"])


@query("j01_drift_z", f"""WITH s AS (SELECT event_type, old, avg(value) AS m, stddev_samp(value) AS d, count(value) AS n FROM {HALVES} GROUP BY 1, 2)
 SELECT c.event_type, round(abs(c.m - b.m) / b.d, 6) AS z, CASE WHEN abs(c.m - b.m) / b.d >= 3 THEN 'FAIL' WHEN abs(c.m - b.m) / b.d >= 2 THEN 'WARN' ELSE 'PASS' END AS status FROM s c JOIN s b ON c.event_type = b.event_type AND b.old AND NOT c.old WHERE c.n >= 5 AND b.n >= 5""")
def j01_drift_z(spark, sf_dir):
    df = halves(spark, sf_dir)
    found = drift.scores(by_type(df.where("NOT old")), by_type(df.where("old")), ["dataset", "column", "event_type"])
    return found.select("event_type", F.round("z", 6).alias("z"), "status")


DRIFT_NOW = "(SELECT unnest(['same', 'shifted', 'other', 'jump']) AS c, unnest([1.0, 2.0, value, value * 100]) AS x FROM events)"
DRIFT_BASE = "(SELECT unnest(['same', 'shifted', 'jump']) AS c, unnest([1.0, 1.0, value]) AS x FROM events)"
DRIFT_STATES = f"""(SELECT n.c, n.m AS now_mean, b.m AS base_mean, CASE WHEN b.c IS NULL THEN 'PASS' WHEN b.s = 0 THEN CASE WHEN abs(n.m - b.m) > 1e-9 THEN 'FAIL' ELSE 'PASS' END
 WHEN abs(n.m - b.m) / b.s >= 3 THEN 'FAIL' WHEN abs(n.m - b.m) / b.s >= 2 THEN 'WARN' ELSE 'PASS' END AS status
 FROM (SELECT c, avg(x) AS m FROM {DRIFT_NOW} GROUP BY c HAVING count(x) >= 5) n LEFT JOIN (SELECT c, avg(x) AS m, stddev_samp(x) AS s FROM {DRIFT_BASE} GROUP BY c HAVING count(x) >= 5) b ON n.c = b.c)"""


def drift_sides(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.select(F.lit(1.0).alias("same"), F.lit(2.0).alias("shifted"), F.col("value").alias("other"), (F.col("value") * 100).alias("jump"))
    base = events.select(F.lit(1.0).alias("same"), F.lit(1.0).alias("shifted"), F.col("value").alias("jump"))
    return drift.statistics(now, "events"), drift.statistics(base, "events")


@query("d03_constant", f'SELECT c AS "column", round(now_mean, 4) AS mean, status FROM {DRIFT_STATES}')
def d03_constant(spark, sf_dir):
    return drift.scores(*drift_sides(spark, sf_dir)).select("column", F.round("mean", 4).alias("mean"), "status")


@query("d05_roll_forward", f"SELECT c AS \"column\", round(CASE WHEN status = 'FAIL' THEN base_mean ELSE now_mean END, 4) AS mean FROM {DRIFT_STATES}")
def d05_roll_forward(spark, sf_dir):
    return drift.roll_forward(*drift_sides(spark, sf_dir)).select("column", F.round("mean", 4).alias("mean"))


@query("j09_fk_orphans", "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphan_lines")
def j09_fk_orphans(spark, sf_dir):
    a = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("unlabelled"))
    b = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("orphan_lines"))
    return a.join(b, F.lit(True))


# --- evolution ---

FIELDS = "pair string, field string, type string, required boolean, nullable boolean, enum_values array<string>"
OLD = [
    ("a", "id", "integer", True, False, None), ("a", "amount", "integer", True, False, None), ("a", "note", "string", False, True, None), ("a", "status", "string", True, False, ["new", "open", "done"]),
    ("a", "customer_name", "string", True, False, None), ("a", "flag", "boolean", False, True, None), ("a", "level", "string", False, True, ["x"]), ("b", "id", "integer", True, False, None),
]
NEW = [
    ("a", "id", "integer", True, False, None), ("a", "amount", "number", True, False, None), ("a", "status", "string", True, False, ["open", "done", "late"]), ("a", "customer_title", "string", True, False, None),
    ("a", "flag", "integer", False, False, None), ("a", "level", "string", False, True, ["x", "y"]), ("a", "zone", "integer", False, True, None), ("b", "id", "integer", True, False, None),
]


def snapshots(spark):
    return spark.createDataFrame(OLD, FIELDS), spark.createDataFrame(NEW, FIELDS)


# field tables of forty datasets at two times, derived from orders: a field is there if an order of its number is
_KINDS = ["integer", "number", "string", "boolean", "float", "bigint"]


def derived(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kinds = F.array(*map(F.lit, _KINDS))

    def at(side: int):
        named = orders.where(F.col("o_orderkey") % 5 != side).select(
            F.concat(F.lit("p"), (F.col("o_custkey") % 40).cast("string")).alias("pair"), F.concat(F.lit("f"), (F.col("o_orderkey") % 13).cast("string")).alias("field"), "o_orderkey", "o_custkey", "o_orderpriority",
        )
        return named.groupBy("pair", "field").agg(
            F.get(kinds, (F.min("o_orderkey") % 6).cast("int")).alias("type"), (F.count("*") % 2 == 0).alias("required"), (F.max("o_orderkey") % 2 == 0).alias("nullable"), F.array_sort(F.collect_set("o_orderpriority")).alias("enum_values"),
        )

    return at(0), at(1)


def _side(n: int) -> str:
    return f"""SELECT 'p' || o_custkey % 40 AS pair, 'f' || o_orderkey % 13 AS field, {_KINDS}[CAST(min(o_orderkey) % 6 AS INT) + 1] AS type, count(*) % 2 = 0 AS required,
 max(o_orderkey) % 2 = 0 AS nullable, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS enum_values FROM orders WHERE o_orderkey % 5 <> {n} GROUP BY 1, 2"""


_TAXONOMY = ", ".join(f"('{t}', {v[0]}, '{v[1]}')" for t, v in CHANGE_TYPES.items())
_WIDER = ", ".join(f"('{x}', '{y}')" for x, y in WIDENING)
CHANGES = f"""(WITH o AS ({_side(0)}), n AS ({_side(1)}),
 x AS (SELECT pair, field, o.type AS ot, n.type AS nt, o.nullable AS onu, n.nullable AS nnu, n.required AS nr, o.field IS NOT NULL AS was, n.field IS NOT NULL AS is_there,
  list_sort(list_filter(o.enum_values, lambda v: NOT list_contains(n.enum_values, v))) AS gone, list_sort(list_filter(n.enum_values, lambda v: NOT list_contains(o.enum_values, v))) AS come FROM o FULL JOIN n USING (pair, field)),
 c AS (SELECT pair, field, 'REMOVE_COLUMN' AS change_type, 'removed, was ' || ot AS detail FROM x WHERE NOT is_there
  UNION ALL SELECT pair, field, CASE WHEN nr THEN 'ADD_NONNULLABLE_COLUMN' ELSE 'ADD_NULLABLE_COLUMN' END, 'added as ' || nt FROM x WHERE NOT was
  UNION ALL SELECT pair, field, CASE WHEN (ot, nt) IN ({_WIDER}) THEN 'TYPE_CHANGE_WIDENING' ELSE 'TYPE_CHANGE_NARROWING' END, ot || ' -> ' || nt FROM x WHERE was AND is_there AND ot <> nt
  UNION ALL SELECT pair, field, 'NULLABILITY_CHANGE', 'nullable ' || onu || ' -> ' || nnu FROM x WHERE was AND is_there AND onu <> nnu
  UNION ALL SELECT pair, field, CASE WHEN len(gone) > 0 THEN 'ENUM_VALUES_BREAKING' ELSE 'ENUM_VALUES_ADDITIVE' END, 'removed [' || coalesce(array_to_string(gone, ','), '') || '], added [' || coalesce(array_to_string(come, ','), '') || ']'
   FROM x WHERE was AND is_there AND len(gone) + len(come) > 0)
 SELECT c.*, t.backward_compatible, t.severity FROM c JOIN (VALUES {_TAXONOMY}) t(change_type, backward_compatible, severity) USING (change_type))"""


@query("e01_schema_diff", f"SELECT pair, field, change_type, backward_compatible, severity FROM {CHANGES}")
def e01_schema_diff(spark, sf_dir):
    return evolve.diff(*derived(spark, sf_dir), renames=False).select("pair", "field", "change_type", "backward_compatible", "severity")


@query("e02_rename", """WITH o AS (SELECT n_regionkey AS r, lower(n_name) || '_total' AS a FROM nation), n AS (SELECT n_regionkey AS r, 'sum_' || reverse(lower(n_name)) || lower(n_name) AS b FROM nation),
 p AS (SELECT r, a, b, max(CASE WHEN contains(b, a[i : i + k - 1]) THEN k ELSE 0 END) AS score FROM o JOIN n USING (r), (SELECT unnest(range(1, 40)) AS i), (SELECT unnest(range(1, 40)) AS k) WHERE i + k - 1 <= length(a) GROUP BY 1, 2, 3)
 SELECT a AS old_field, b AS new_field, CAST(score AS INTEGER) AS score FROM p WHERE score >= 4 QUALIFY row_number() OVER (PARTITION BY r, a ORDER BY score DESC, b) = 1""")
def e02_rename(spark, sf_dir):
    nation, name = table(spark, sf_dir, "nation"), F.lower("n_name")
    fields = lambda x: nation.select(F.col("n_regionkey").cast("string").alias("pair"), x.alias("field"), F.lit("string").alias("type"), F.lit(False).alias("required"))
    gone, come = fields(F.concat(name, F.lit("_total"))), fields(F.concat(F.lit("sum_"), F.reverse(name), name))
    return evolve.rename_candidates(gone, come).where("choice = 1").select("old_field", "new_field", "score")


@query("e02_rename_diff", "SELECT * FROM (VALUES ('customer_title', 'RENAME_COLUMN', 'renamed from customer_name'), ('note', 'REMOVE_COLUMN', 'removed, was string'), ('zone', 'ADD_NULLABLE_COLUMN', 'added as integer')) t(field, change_type, detail)")
def e02_rename_diff(spark, sf_dir):
    return evolve.diff(*snapshots(spark)).where("change_type in ('RENAME_COLUMN', 'REMOVE_COLUMN', 'ADD_NULLABLE_COLUMN', 'ADD_NONNULLABLE_COLUMN')").select("field", "change_type", "detail")


@query("e03_type_change", f"SELECT pair, field, change_type, detail FROM {CHANGES} WHERE change_type LIKE 'TYPE_CHANGE%'")
def e03_type_change(spark, sf_dir):
    return evolve.diff(*derived(spark, sf_dir), renames=False).where("change_type like 'TYPE_CHANGE%'").select("pair", "field", "change_type", "detail")


@query("e05_enum_change", f"SELECT pair, field, change_type, detail FROM {CHANGES} WHERE change_type LIKE 'ENUM%'")
def e05_enum_change(spark, sf_dir):
    return evolve.diff(*derived(spark, sf_dir), renames=False).where("change_type like 'ENUM%'").select("pair", "field", "change_type", "detail")


@query("e06_taxonomy", "SELECT * FROM (VALUES ('CRITICAL', 1), ('ERROR', 5), ('INFO', 1), ('WARNING', 2)) t(severity, n)")
def e06_taxonomy(spark, sf_dir):
    return evolve.taxonomy(spark).groupBy("severity").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("e07_verdict", f"SELECT pair, count(*) AS changes, count(*) FILTER (WHERE NOT backward_compatible) AS breaking, CASE WHEN bool_or(NOT backward_compatible) THEN 'BREAKING' ELSE 'EVOLVED' END AS verdict FROM {CHANGES} GROUP BY 1")
def e07_verdict(spark, sf_dir):
    return evolve.verdicts(evolve.diff(*derived(spark, sf_dir), renames=False), ["pair"]).select("pair", "changes", "breaking", "verdict")


@query("u02_enum_diff", """WITH h AS (SELECT DISTINCT event_type, event_id < 100 AS early FROM events)
 SELECT (SELECT list(event_type ORDER BY event_type) FROM (SELECT event_type FROM h WHERE NOT early EXCEPT SELECT event_type FROM h WHERE early AND event_type < 'p')) AS added""")
def u02_enum_diff(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    seen = lambda c, n: events.agg(F.collect_set(F.when(c, F.col("event_type"))).alias(n))
    both = seen((F.col("event_id") < 100) & (F.col("event_type") < "p"), "old").join(seen(F.col("event_id") >= 100, "new"), F.lit(True))
    return both.select(F.array_sort(F.array_except("new", "old")).alias("added"))


# --- lineage ---

EDGES = """(SELECT 'region::' || r_regionkey AS src, 'nation::' || n_nationkey AS dst FROM nation JOIN region ON r_regionkey = n_regionkey UNION
 SELECT 'nation::' || c_nationkey, 'customer::' || c_custkey FROM customer UNION SELECT 'customer::' || o_custkey, 'order::' || o_orderkey FROM orders)"""


def edges(spark, sf_dir):
    name = lambda kind, c: F.concat(F.lit(f"{kind}::"), F.col(c).cast("string"))
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("nation").select(name("region", "n_regionkey").alias("src"), name("nation", "n_nationkey").alias("dst"))
        .unionByName(t("customer").select(name("nation", "c_nationkey").alias("src"), name("customer", "c_custkey").alias("dst")))
        .unionByName(t("orders").select(name("customer", "o_custkey").alias("src"), name("order", "o_orderkey").alias("dst")).distinct())
    )


@query("g01_upstream", f"WITH RECURSIVE e AS {EDGES}, w(id, hops) AS (SELECT 'order::7', 0 UNION SELECT e.src, w.hops + 1 FROM w JOIN e ON e.dst = w.id WHERE w.hops < 4) SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM w WHERE hops > 0 GROUP BY 1")
def g01_upstream(spark, sf_dir):
    return lineage.upstream(edges(spark, sf_dir), spark.createDataFrame([("order::7",)], "id string"), 4)


@query("g01_upstream_sql", f"WITH RECURSIVE e AS {EDGES}, w(id, hops) AS (SELECT 'order::7', 0 UNION SELECT e.src, w.hops + 1 FROM w JOIN e ON e.dst = w.id WHERE w.hops < 2) SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM w WHERE hops > 0 GROUP BY 1")
def g01_upstream_sql(spark, sf_dir):
    return lineage.upstream_sql(spark, edges(spark, sf_dir), spark.createDataFrame([("order::7",)], "id string"), 2)


@query("g02_downstream", f"WITH RECURSIVE e AS {EDGES}, w(id, hops) AS (SELECT 'region::1', 0 UNION SELECT e.dst, w.hops + 1 FROM w JOIN e ON e.src = w.id) SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM w WHERE hops > 0 GROUP BY 1")
def g02_downstream(spark, sf_dir):
    return lineage.downstream(edges(spark, sf_dir), spark.createDataFrame([("region::1",)], "id string"))


@query("g09_blame_score", "SELECT event_id, round(greatest(0.05, least(1.0, 1.0 - 0.1 * CAST(d AS DOUBLE) - 0.2 * h)), 4) AS score FROM (SELECT event_id, event_id % 12 AS d, event_id % 4 AS h FROM events)")
def g09_blame_score(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", lineage.blame_score((F.col("event_id") % 12).cast("double"), F.col("event_id") % 4).alias("score"))


@query("j04_registry", """WITH f AS (SELECT DISTINCT 'n' || s_nationkey AS contract_id, ['facts[*]', 'facts', 'facts[*].building.x', 'facts.machinery', 'factsx', 'doc_id'][s_suppkey % 6 + 1] AS field FROM supplier),
 r AS (SELECT 'n' || c_nationkey AS contract_id, c_name AS subscriber_id, 'facts.' || lower(c_mktsegment) AS breaks, CASE c_custkey % 3 WHEN 0 THEN 'ENFORCE' WHEN 1 THEN 'AUDIT' END AS mode FROM customer), m AS (SELECT *, replace(field, '[*]', '') AS plain FROM f JOIN r USING (contract_id))
 SELECT contract_id, field, subscriber_id, breaks = plain OR starts_with(plain, breaks || '.') OR starts_with(breaks, plain || '.') AS matched, coalesce(mode, 'ENFORCE') = 'ENFORCE' AS enforced FROM m""")
def j04_registry(spark, sf_dir):
    contract = lambda key: F.concat(F.lit("n"), F.col(key).cast("string")).alias("contract_id")
    mode = F.when(F.col("c_custkey") % 3 == 0, "ENFORCE").when(F.col("c_custkey") % 3 == 1, "AUDIT").alias("validation_mode")
    breaks = F.array(F.struct(F.concat(F.lit("facts."), F.lower("c_mktsegment")).alias("field"), F.lit("type").alias("reason"))).alias("breaking_fields")
    registry = table(spark, sf_dir, "customer").select(contract("c_nationkey"), F.col("c_name").alias("subscriber_id"), breaks, mode)
    names = F.array(*map(F.lit, ["facts[*]", "facts", "facts[*].building.x", "facts.machinery", "factsx", "doc_id"]))
    failing = table(spark, sf_dir, "supplier").select(contract("s_nationkey"), names[(F.col("s_suppkey") % 6).cast("int")].alias("field")).distinct()
    return lineage.registry_matches(failing, registry)


# --- AI checks, reports, transforms ---


@query("ai01_centroid_drift", """WITH x AS (SELECT vec_id < 250 AS old, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), c AS (SELECT i, avg(v) FILTER (WHERE old) AS a, avg(v) FILTER (WHERE NOT old) AS b FROM x GROUP BY 1)
 SELECT round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-9), 4) AS drift, CASE WHEN 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-9) > 0.25 THEN 'FAIL' ELSE 'PASS' END AS status FROM c""")
def ai01_centroid_drift(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return ai.embedding_drift(ai.centroid(v.where("vec_id >= 250")), ai.centroid(v.where("vec_id < 250")))


@query("ai02_baseline_states", """WITH x AS (SELECT vec_id % 7 = 0 AS part, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), c AS (SELECT i, avg(v) AS a, avg(v) FILTER (WHERE part) AS b FROM x GROUP BY 1),
 d AS (SELECT round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-9), 4) AS part, round(1 - sum(a * a) / (sqrt(sum(a * a)) * sqrt(sum(a * a)) + 1e-9), 4) AS same, count(*) AS n, count(*) FILTER (WHERE i <= 8) AS short FROM c),
 t AS (SELECT unnest(['part', 'same', 'other']) AS name, unnest([part, same, 0.0]) AS drift, unnest([false, false, n <> short]) AS resized FROM d)
 SELECT name, drift, CASE WHEN resized THEN 'BASELINE_RESET' WHEN drift > 0.25 THEN 'FAIL' WHEN drift > 0.15 THEN 'WARN' ELSE 'PASS' END AS status FROM t UNION ALL SELECT 'first', 0.0, 'BASELINE_SET'""")
def ai02_baseline_states(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    c, part = ai.centroid(vectors), ai.centroid(vectors.where("vec_id % 7 = 0"))
    short = c.select(F.slice("centroid", 1, 8).alias("centroid"), "n")
    states = [ai.embedding_drift(c, b).select(F.lit(n).alias("name"), "drift", "status") for n, b in (("first", None), ("other", short), ("same", c), ("part", part))]
    return reduce(DataFrame.unionByName, states)


@query("ai05_quarantine", """SELECT doc_id, list_filter([CASE WHEN length(text) < 200 THEN 'text:minLength' END, CASE WHEN length(text) > 5000 THEN 'text:maxLength' END, CASE WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'source:pattern' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang:enum' END], lambda x: x IS NOT NULL) AS errors FROM documents""")
def ai05_quarantine(spark, sf_dir):
    schema = {"required": ["doc_id", "text"], "properties": {"text": {"type": "string", "minLength": 200, "maxLength": 5000}, "source": {"type": "string", "pattern": "^src[0-9]$"}, "lang": {"type": "string", "enum": ["en", "de", "fr"]}}}
    done = ai.validate_schema(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), schema)
    return done.select("doc_id", F.transform("errors", lambda e: F.concat(e["field"], F.lit(":"), e["rule"])).alias("errors"))


@query("ai06_violation_rate", "SELECT count(*) AS total, count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS violations, round(count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) / count(*), 4) AS rate, CASE WHEN round(count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) / count(*), 4) > 0.15 THEN 'rising' WHEN round(count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) / count(*), 4) < 0.05 THEN 'falling' ELSE 'stable' END AS trend, CASE WHEN round(count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) / count(*), 4) > 0.02 THEN 'WARN' ELSE 'PASS' END AS status FROM conversations")
def ai06_violation_rate(spark, sf_dir):
    return ai.violation_rate(table(spark, sf_dir, "conversations"), F.col("role"), ["user", "assistant"], baseline=0.1)


@query("ag12_quarantine_rate", "SELECT count(*) AS total, count(*) FILTER (WHERE length(text) < 500) AS quarantined, round(count(*) FILTER (WHERE length(text) < 500) / count(*), 4) AS rate FROM documents")
def ag12_quarantine_rate(spark, sf_dir):
    return ai.quarantine_rate(ai.validate_schema(table(spark, sf_dir, "documents").select("text"), {"properties": {"text": {"type": "string", "minLength": 500}}}))


@query("p08_prompt_input", "SELECT conv_id, left(string_agg(text, ' ' ORDER BY turn), 8000) AS prompt FROM conversations WHERE turn < 10 GROUP BY 1")
def p08_prompt_input(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("turn < 10").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("facts"))
    return turns.select("conv_id", ai.prompt_input(F.col("facts")).alias("prompt"))


@query("ag10_health", f"SELECT count(*) AS total_checks, count(*) FILTER (WHERE status = 'PASS') AS passed, round(100.0 * count(*) FILTER (WHERE status = 'PASS') / count(*), 1) AS base_score, greatest(0.0, round(round(100.0 * count(*) FILTER (WHERE status = 'PASS') / count(*), 1) - 20 * count(*) FILTER (WHERE status = 'FAIL' AND severity = 'CRITICAL'), 1)) AS score FROM ({ORDER_CHECKS})")
def ag10_health(spark, sf_dir):
    return report.health(order_checks(spark, sf_dir)).select("total_checks", "passed", "base_score", "score")


@query("m02_text_extract", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<li>')) AS items, sha256(url || ':rubric_v1.0.0') AS rubric_id FROM pages")
def m02_text_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))).cast("long").alias("items"), F.sha2(F.concat("url", F.lit(":rubric_v1.0.0")), 256).alias("rubric_id"))


@query("m05_node_ids", r"""WITH t AS (SELECT page_id % 6 AS k, regexp_replace(url, '^https?://', '') AS rest FROM pages),
 r AS (SELECT k, rest, CASE k WHEN 0 THEN 'sink:' WHEN 1 THEN 'SERVICE:' WHEN 2 THEN 'other:' WHEN 3 THEN 'file:' WHEN 4 THEN 'file:C:\cloned_repo_' || length(rest) || '\' ELSE '' END || rest AS raw FROM t)
 SELECT raw, CASE k WHEN 0 THEN 'table::' || rest WHEN 1 THEN 'service::' || rest WHEN 2 THEN 'table::' || rest WHEN 4 THEN 'file::' || rest ELSE 'file::' || array_to_string(string_split(rest, '/')[-3:], '/') END AS node_id FROM r""")
def m05_node_ids(spark, sf_dir):
    rest, k = F.regexp_replace("url", "^https?://", ""), F.col("page_id") % 6
    prefix = F.when(k == 0, "sink:").when(k == 1, "SERVICE:").when(k == 2, "other:").when(k == 3, "file:").when(k == 4, F.format_string("file:C:\\cloned_repo_%d\\", F.length(rest))).otherwise("")
    return table(spark, sf_dir, "pages").select(F.concat(prefix, rest).alias("raw")).select("raw", etl.node_id(F.col("raw")).alias("node_id"))


STREAMS = "(SELECT 'loan-' || user_id AS stream_id, event_id, ts, event_type FROM events)"


@query("m06_events", f"SELECT event_type, 'LoanApplication' AS aggregate_type, row_number() OVER (PARTITION BY stream_id ORDER BY event_id) AS sequence_number, ts AS recorded_at, ts - to_milliseconds(row_number() OVER (PARTITION BY stream_id ORDER BY event_id) % 500) AS occurred_at FROM (SELECT stream_id, event_id, ts, upper(left(event_type, 1)) || substr(event_type, 2) AS event_type FROM {STREAMS} WHERE event_type <> 'error')")
def m06_events(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.initcap("event_type"))
    raw = table(spark, sf_dir, "events").select(F.concat(F.lit("loan-"), "user_id").alias("stream_id"), kind.alias("event_type"), F.lit(1).alias("event_version"), F.col("ts").alias("recorded_at"), F.col("event_id").alias("ordinal"))
    return etl.canonical_events(raw)[0].select("event_type", "aggregate_type", "sequence_number", "recorded_at", "occurred_at")


@query("m06a_rejects", "SELECT count(*) AS rejected FROM events WHERE NOT regexp_full_match(event_type, '[A-Z][a-zA-Z0-9]*')")
def m06a_rejects(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.lit("loan-1").alias("stream_id"), "event_type", F.lit(1).alias("event_version"), F.col("ts").alias("recorded_at"), F.col("event_id").alias("ordinal"))
    return etl.canonical_events(raw)[1].agg(F.count(F.lit(1)).alias("rejected"))


@query("m07_fanout", """SELECT r.run_type, count(*) AS runs, CAST(sum(CASE WHEN r.run_type = 'llm' THEN event_id % 900 + 100 + event_id % 90 + 10 ELSE 0 END) AS BIGINT) AS tokens FROM events, (VALUES ('chain'), ('llm'), ('embedding')) r(run_type) WHERE r.run_type <> 'embedding' GROUP BY 1""")
def m07_fanout(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    records = e.select(F.col("event_id").alias("doc_id"), F.lit("model").alias("extraction_model"), F.lit(2000).alias("processing_time_ms"), (F.col("event_id") % 900 + 100).alias("input_tokens"), (F.col("event_id") % 90 + 10).alias("output_tokens"), F.col("ts").cast("timestamp").alias("started"))
    return etl.traces(records).where("run_type <> 'embedding'").groupBy("run_type").agg(F.count(F.lit(1)).alias("runs"), F.sum("total_tokens").alias("tokens"))


# --- synthesis and snapshots ---


@query("b01_synthesized", """SELECT * FROM (VALUES (0, 'not_null', ''), (1, 'unique', ''), (2, 'accepted_values', ''), (3, 'custom', 'created_at_not_future'), (4, 'custom', 'statistical_bounds_o_custkey'),
 (5, 'custom', 'statistical_bounds_o_orderkey'), (6, 'custom', 'timestamp_iso8601_format'), (7, 'custom', 'minimum_record_count_7')) t(place, type, name)""")
def b01_synthesized(spark, sf_dir):
    from .plans.synth import clauses_for, profile_of

    made = clauses_for(profile_of(table(spark, sf_dir, "orders"), "orders", "o_orderkey"))
    return spark.createDataFrame([(i, c["type"], c.get("name", "")) for i, c in enumerate(made)], "place int, type string, name string")


BEYOND = "SELECT CASE WHEN count(*) FILTER (WHERE {c} < m - 3 * s OR {c} > m + 3 * s) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM customer, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM customer)"


@query("b01_self_check", f"""SELECT 'unique' AS check_type, CASE WHEN count(c_acctbal) = count(DISTINCT c_acctbal) THEN 'PASS' ELSE 'FAIL' END AS status, CAST(1 AS BIGINT) AS n FROM customer
 UNION ALL SELECT 'not_null', 'PASS', 3 UNION ALL SELECT 'accepted_values', 'PASS', 1 UNION ALL SELECT 'custom', 'PASS', 3
 UNION ALL SELECT 'statistical', status, count(*) FROM ({BEYOND.format(c="c_acctbal")} UNION ALL {BEYOND.format(c="c_custkey")}) GROUP BY status""")
def b01_self_check(spark, sf_dir):
    """A contract made from customers, held against customers: without known ids its key is the first column."""
    from .plans.clauses import Contract
    from .plans.synth import contract_for, profile_of

    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    contract = Contract.from_dict(contract_for(profile_of(df, "customers", "c_custkey")), "customers")
    return validate.validate(df, contract).groupBy("check_type", "status").agg(F.count(F.lit(1)).alias("n"))


@query("w04_consecutive", """WITH f AS (SELECT DISTINCT o_orderpriority AS stem, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS taken, o_custkey % 12 AS k FROM orders),
 s AS (SELECT stem, taken, lag(taken) OVER (PARTITION BY stem ORDER BY taken) AS before FROM (SELECT DISTINCT stem, taken FROM f)),
 o AS (SELECT s.stem, s.taken, f.k FROM s JOIN f ON f.stem = s.stem AND f.taken = s.before), n AS (SELECT s.stem, s.taken, f.k FROM s JOIN f ON f.stem = s.stem AND f.taken = s.taken WHERE s.before IS NOT NULL)
 SELECT stem || '|' || CAST(taken AS VARCHAR) AS pair, 'f' || k AS field, CASE WHEN n.k IS NULL THEN 'REMOVE_COLUMN' WHEN k % 2 = 0 THEN 'ADD_NULLABLE_COLUMN' ELSE 'ADD_NONNULLABLE_COLUMN' END AS change_type
 FROM o FULL JOIN n USING (stem, taken, k) WHERE o.k IS NULL OR n.k IS NULL""")
def w04_consecutive(spark, sf_dir):
    k = F.col("o_custkey") % 12
    name = lambda head: F.concat(F.lit(head), k.cast("string"))
    taken = F.trunc(F.col("o_orderdate").cast("date"), "month").alias("taken")
    fields = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stem"), taken, name("f").alias("field"), name("t").alias("type"), (k % 2 != 0).alias("required"), (k % 2 == 0).alias("nullable"))
    given = fields.distinct().withColumn("enum_values", F.lit(None).cast("array<string>"))
    return evolve.diff(*evolve.consecutive(given)).select("pair", "field", "change_type")


@query("g03_contract_lineage", "SELECT * FROM (VALUES ('up', ['b', 'a', 'z']), ('down', ['dashboard'])) t(side, labels)")
def g03_contract_lineage(spark, sf_dir):
    flat = spark.createDataFrame([("y", "z"), ("z", "a"), ("a", "b"), ("b", "orders"), ("orders", "dashboard"), ("dashboard", "readers")], "source string, target string")
    found = lineage.contract_lineage(flat, "week1_orders")
    return spark.createDataFrame([("up", found["upstream"]), ("down", found["downstream"])], "side string, labels array<string>")


@query("ai03_tfidf", """
WITH tokens AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+'), lambda x: length(x) >= 2)) AS w FROM documents
), listed AS (
  SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS place, count(DISTINCT doc_id) AS df FROM tokens GROUP BY w QUALIFY place < 512
), weights AS (
  SELECT t.doc_id, l.place, (1 + ln(count(*))) * ln((n + 1.0) / (l.df + 1.0)) AS x
  FROM tokens t JOIN listed l ON t.w = l.w, (SELECT count(*) AS n FROM documents) GROUP BY t.doc_id, l.place, l.df, n
), unit AS (
  SELECT place, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM weights
)
SELECT l.w AS word, l.place, round(coalesce(sum(x), 0) / (SELECT count(*) FROM documents), 6) AS weight FROM listed l LEFT JOIN unit u ON l.place = u.place GROUP BY l.w, l.place
""")
def ai03_tfidf(spark, sf_dir):
    """The mean TF-IDF vector of all documents, over a vocabulary fitted on all of them."""
    vectors, model = ai.tfidf(table(spark, sf_dir, "documents").select("text"))
    words = spark.createDataFrame(list(enumerate(model.stages[1].vocabulary)), "place long, word string")  # at most 512
    mean = ai.centroid(vectors).select(F.posexplode("centroid").alias("at", "weight"))
    return words.join(F.broadcast(mean), F.col("place") == F.col("at")).select("word", "place", F.round("weight", 6).alias("weight"))


@query("r03_schema_section", f"SELECT DISTINCT pair, field, change_type, detail FROM {CHANGES}")
def r03_schema_section(spark, sf_dir):
    changes = evolve.diff(*derived(spark, sf_dir), renames=False)
    return report.schema_section(changes.unionByName(changes)).select("pair", "field", "change_type", "detail")


# commits of files, the latest first, and the files of checks, derived from lineitem and orders
COMMITS = """(SELECT * FROM (SELECT 'f' || l_partkey % 40 AS file_path, 'h' || l_orderkey % 200 AS commit_hash, '2026-01-' || lpad(CAST(10 - l_orderkey % 9 AS VARCHAR), 2, '0') || 'T00:00:00' AS commit_timestamp,
 l_orderkey % 9 AS days, row_number() OVER (PARTITION BY l_partkey % 40 ORDER BY l_orderkey, l_linenumber) AS place FROM lineitem) WHERE place <= 3)"""


@query("g10_blame_chain", f"""WITH near AS (SELECT 'c' || o_custkey % 30 AS check_id, 'f' || o_orderkey % 25 AS file_path, min(o_orderkey % 5 + 1) AS hops FROM orders GROUP BY 1, 2),
 scored AS (SELECT check_id, c.file_path, commit_hash, round(greatest(0.05, least(1.0, 1.0 - 0.1 * CAST(days AS DOUBLE) - 0.2 * hops)), 4) AS confidence_score FROM near JOIN {COMMITS} c USING (file_path) WHERE place <= 2),
 once AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY check_id, commit_hash ORDER BY confidence_score DESC, file_path) = 1)
 SELECT check_id, file_path, commit_hash, confidence_score, CAST(row_number() OVER (PARTITION BY check_id ORDER BY confidence_score DESC, commit_hash, file_path) AS INT) AS rank FROM once QUALIFY rank <= 5""")
def g10_blame_chain(spark, sf_dir):
    text = lambda head, c, n: F.concat(F.lit(head), (F.col(c) % n).cast("string"))
    files = table(spark, sf_dir, "orders").select(text("c", "o_custkey", 30).alias("check_id"), text("f", "o_orderkey", 25).alias("file_path"), (F.col("o_orderkey") % 5 + 1).alias("hops"))
    day = F.lpad((10 - F.col("l_orderkey") % 9).cast("string"), 2, "0")
    ranked = F.row_number().over(Window.partitionBy(F.col("l_partkey") % 40).orderBy("l_orderkey", "l_linenumber"))
    commits = table(spark, sf_dir, "lineitem").select(
        text("f", "l_partkey", 40).alias("file_path"), text("h", "l_orderkey", 200).alias("commit_hash"), F.lit("a").alias("author"), F.concat(F.lit("2026-01-"), day, F.lit("T00:00:00")).alias("commit_timestamp"),
        F.lit("m").alias("commit_message"), ranked.alias("place"),
    ).where("place <= 3")
    return lineage.blame_chain(files, commits, datetime(2026, 1, 10)).select("check_id", "file_path", "commit_hash", "confidence_score", "rank")


@query("m03_facts", """SELECT d.doc_id || '#' || (i - 1) AS fact_id, left(trim(f[i]), 500) AS text, left(trim(f[i]), 200) AS source_excerpt FROM
 (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS f FROM documents) d, unnest(range(1, len(f) + 1)) AS t(i)""")
def m03_facts(spark, sf_dir):
    units = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(x.alias("content"), F.lit(1).alias("page"), F.lit("paragraph").alias("chunk_type")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("f").alias("filename"), F.lit(0.8).alias("confidence"), F.lit("FASTTEXT").alias("strategy"), F.lit(1.0).alias("processing_time"), units.alias("units"))
    return etl.extractions(docs).select(F.explode("extracted_facts").alias("f")).select("f.fact_id", "f.text", "f.source_excerpt")


@query("s01_json_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def s01_json_round_trip(spark, sf_dir):
    """Customers written as JSON lines beside blank and malformed ones, and read back."""
    path = f"{shared_folder(spark).rstrip('/')}/customers-{uuid4().hex}"
    writers.write_json_lines(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path)
    spark.createDataFrame([("{broken",), ("",), ("[1",)], "value string").write.mode("append").text(path)
    return readers.json_lines(spark, path, "c_custkey long, c_name string, c_nationkey long, c_acctbal double", missing_ok=False)


@query("k07_quarantine", "SELECT doc_id, CASE WHEN lang <> 'en' AND n_chars > 3000 THEN 2 ELSE 1 END AS errors FROM documents WHERE lang <> 'en' OR n_chars > 3000")
def k07_quarantine(spark, sf_dir):
    """Documents that a schema rejects, written to a quarantine folder and read back; nothing is dropped."""
    path = f"{shared_folder(spark).rstrip('/')}/quarantine-{uuid4().hex}"
    schema = {"properties": {"lang": {"type": "string", "enum": ["en"]}, "n_chars": {"type": "integer", "maximum": 3000}}}
    writers.write_quarantine(ai.validate_schema(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), schema), path)
    return readers.json_lines(spark, path, "doc_id long, errors array<struct<field:string,rule:string>>", missing_ok=False).select("doc_id", F.size("errors").alias("errors"))


@query("ai04_overall", "SELECT conv_id, CASE WHEN bool_or(turn % 7 = 6) THEN 'FAIL' WHEN bool_or(turn % 5 = 4) THEN 'WARN' WHEN count(*) > 1 THEN 'PASS' ELSE 'SKIPPED' END AS overall FROM conversations GROUP BY 1")
def ai04_overall(spark, sf_dir):
    seen = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("turn") % 7 == 6).alias("a"), F.bool_or(F.col("turn") % 5 == 4).alias("b"), F.count("*").alias("n"))
    statuses = [F.when(F.col("a"), "FAIL").otherwise("SKIPPED"), F.when(F.col("b"), "WARN").otherwise("SKIPPED"), F.when(F.col("n") > 1, "PASS").otherwise("SKIPPED")]
    return seen.select("conv_id", ai.overall(statuses).alias("overall"))
