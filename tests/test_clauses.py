"""Clause parsing, compilation and results on small frames."""

import pytest
from pyspark.sql import functions as F

from pactum.operators import validate
from pactum.plans.clauses import Clause, Contract, parse_rule, parse_soda


@pytest.mark.parametrize("text,kind", [
    ("regex: ^a+$", "regex"), ("COUNT(*) >= 3", "count_gte"), ("COUNT(*) >=", "count_gte"), ("n = ROW_NUMBER() OVER (PARTITION BY a ORDER BY n)", "sequence"),
    ("mean - 3*stddev <= value <= mean + 3*stddev", "statistical_bounds"), ("0.01 <= mean <= 0.99", "mean_range"), ("t == a + b", "additive"), ("a > b", "columns"),
    ("value >= 0", "value_bound"), ("value >= -1.5e3", "value_bound"), ("0.0 <= value <= 1.0", "value_range"), ("-1 <= value <= 1", "value_range"), ("len(value) >= 1", "len_bound"),
    ("created_at <= NOW()", "not_future"), ("edge.source IN nodes[*].id AND edge.target IN nodes[*].id", "edge_references"), ("whatever", "unknown"), (None, "unknown"),
])
def test_grammar(text, kind):
    assert parse_rule(text).kind == kind


def run(df, *clauses, **more):
    return {r.check_id: r for r in validate.validate(df, clauses, "d", **more).orderBy("ordinal").collect()}


def custom(name, rule, *fields, breaking=True, **more):
    return Clause("custom", name=name, rule_text=rule, fields=fields, breaking=breaking, **more)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        ("a", 1.0, "x1", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", ["p"], [{"c": 0.5}]),
        ("b", None, "", "2024-01-03T00:00:00Z", "2024-01-02T00:00:00Z", [], [{"c": 50.0}, {"c": None}]),
        ("a", 9.0, None, "7", "10", None, None),
        (None, -3.0, "bad\n", "junk", "1", ["q", "r"], []),
    ]
    return spark.createDataFrame(rows, "id string, v double, s string, t0 string, t1 string, tags array<string>, facts array<struct<c:double>>")


def test_row_checks(frame):
    r = run(frame, Clause("not_null", fields=("id", "s", "nope", "facts[*].c")), Clause("unique", fields=("id",)), Clause("accepted_values", fields=("id",), values=("a", "c")),
            Clause("accepted_values", fields=("s",), pattern=r"x\d|bad"), custom("re", r"regex: [a-z]\d?", "s"), custom("vb", "value >= 0", "v"), custom("vs", "value >= 0", "s"), custom("vr", "0 <= value <= 5", "v"))
    assert (r["d.id.not_null"].records_failing, r["d.s.not_null"].records_failing, r["d.nope.not_null"].records_failing, r["d.facts[*].c.not_null"].records_failing) == (1, 2, 4, 1)
    assert r["d.id.not_null"].actual_value == "1/4 null" and r["d.id.not_null"].severity == "CRITICAL"
    assert (r["d.id.unique"].records_failing, r["d.id.unique"].actual_value) == (1, "1 duplicates in 3 values")
    assert r["d.id.accepted_values"].records_failing == 1 and r["d.id.accepted_values"].severity == "HIGH"
    assert r["d.s.accepted_values"].records_failing == 2  # "" and the value with a line break
    assert r["d.re.s"].records_failing == 2
    assert (r["d.vb.v"].records_failing, r["d.vs.s"].records_failing, r["d.vr"].records_failing) == (1, 3, 2)
    assert r["d.vr"].actual_value == "max=9.0, mean=2.3333"


def test_items_lengths_comparisons(frame):
    r = run(frame, custom("conf", "0.0 <= value <= 1.0", "facts[*].c"), custom("len", "len(value) >= 1", "tags", "v"), custom("cmp", "t1 >= t0"), custom("cnt", "COUNT(*) >= 5"), custom("missing", "t9 > t0"))
    assert r["d.conf"].records_failing == 1 and "0-100 scale" in r["d.conf"].message
    assert (r["d.len.tags"].records_failing, r["d.len.v"].records_failing) == (1, 3)
    assert r["d.cmp"].records_failing == 1  # times by time, "7" and "10" by number, junk passes
    assert r["d.cnt"].status == "FAIL" and r["d.cnt"].records_failing == 4
    assert r["d.missing"].status == "PASS" and "column_missing" in r["d.missing"].actual_value
    assert run(frame, custom("missing", "t9 > t0"), missing="ERROR")["d.missing"].status == "ERROR"


def test_sequence_additive_statistics(spark):
    df = spark.createDataFrame([("x", 1, 3.0, 1.0, 2.0), ("x", 2, 3.02, 1.0, 2.0), ("x", 4, None, 1.0, 2.0), ("y", 1, 5.0, 2.0, 3.005)], "g string, n int, t double, a double, b double")
    r = run(df, custom("seq", "n = ROW_NUMBER() OVER (PARTITION BY g ORDER BY n)"), custom("add", "t == a + b"), custom("st", "mean - 3*stddev <= value <= mean + 3*stddev", "t", profile={"mean": 3.0, "stddev": 0.1}), custom("none", "mean - 3*stddev <= value <= mean + 3*stddev", "t"))
    assert (r["d.seq"].records_failing, r["d.add"].records_failing, r["d.st"].records_failing) == (1, 1, 1)
    assert r["d.none"].status == "PASS" and r["d.st"].check_type == "statistical"


def test_empty_and_bad_clauses(spark):
    df = spark.createDataFrame([], "a string, v double")
    r = run(df, Clause("not_null", fields=("a",)), custom("b", "value > 0", "v"), custom("c", "COUNT(*) >= 1"), custom("broken", "regex: [", "a"))
    assert r["d.a.not_null"].status == "PASS" and r["d.b.v"].actual_value == "skipped: no records" and r["d.c"].status == "FAIL"
    assert r["d.broken"].status == "ERROR" and r["d.broken"].severity == "CRITICAL"


def test_soda(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, None)], "n int, s string")
    r = run(df, *map(parse_soda, ["row_count >= 3", "missing_count(n) = 0", "duplicate_count(s) = 0", "max(n) < 2", "avg(n) >= 1.5", "min(nope) > 0"]))
    assert [r[k].status for k in ("d.row_count", "d.n.missing_count", "d.s.duplicate_count", "d.n.max", "d.n.avg")] == ["PASS", "FAIL", "FAIL", "FAIL", "PASS"]
    assert parse_soda("nonsense").rule.kind == "unknown"


def test_samples_follow_order(spark, frame):
    clauses = (Clause("unique", fields=("id",)), custom("vb", "value >= 0", "v"), custom("conf", "0.0 <= value <= 1.0", "facts[*].c"))
    rep = validate.report(frame, Contract("c", "d", clauses))
    assert {r["check_id"]: r["sample_failing"] for r in rep["results"]} == {"d.id.unique": ["a"], "d.vb.v": ["bad\n"], "d.conf": ["b"]}
    assert (rep["failed"], rep["overall_status"], rep["total_records"]) == (3, "FAIL", 4)


def test_permutation_changes_nothing(spark, frame):
    clauses = (Clause("not_null", fields=("id", "s")), Clause("unique", fields=("id",)), custom("vr", "0 <= value <= 5", "v"))
    key = lambda df: [(r.check_id, r.status, r.records_failing) for r in validate.validate(df, clauses).orderBy("ordinal").collect()]
    assert key(frame) == key(frame.orderBy(F.desc("v")))


def test_roll_ups(spark):
    rows = [("a", s, sev) for s, sev in [("PASS", "LOW"), ("FAIL", "CRITICAL"), ("WARN", "WARNING")]] + [("b", "ERROR", "HIGH")]
    df = spark.createDataFrame(rows, "stem string, status string, severity string")
    rolled = validate.roll_up(df, ["stem"])
    assert {r.stem: r.overall_status for r in rolled.collect()} == {"a": "FAIL", "b": "ERROR"}
    assert validate.batch_status(rolled).first().overall_status == "FAIL"
    assert [validate.blocking(df, m).count() for m in ("AUDIT", "WARN", "ENFORCE")] == [0, 1, 1]


def test_fused_plan_reads_once(spark, sf_dir):
    """All row-level checks of a contract are one aggregate over one scan."""
    clauses = (Clause("not_null", fields=("o_orderkey", "o_custkey")), custom("r", "0 <= value <= 1e6", "o_totalprice"), custom("n", "COUNT(*) >= 1"))
    plan = validate.validate(spark.read.parquet(f"{sf_dir}/orders.parquet"), clauses)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "o_orderstatus" not in plan.split("ReadSchema")[1]
