"""Profiles, synthesis, drift, evolution, lineage, AI checks, reports, sources and streams."""

import hashlib
import json
import math
import random
import re
import uuid
from collections import Counter
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

import pytest
import yaml
from pyspark.sql import functions as F

from pactum.operators import ai, drift, etl, evolve, lineage, profile, report, validate
from pactum.plans import synth
from pactum.plans.clauses import Clause, Contract
from pactum.plans.compiler import Compiler
from pactum.plans.taxonomy import CHANGE_TYPES, WIDENING
from pactum.sources import readers, writers
from pactum.streaming.validate import latest_results, validate_stream

NOW = datetime(2026, 4, 3, 8, 0, 0)
INTENTS = [
    {"intent_id": "INT-001", "description": f"step {i}", "created_at": f"2026-02-21T20:4{i}:12.120000+00:00", "governance_tags": ["x"],
     "code_refs": [{"file": "a.ts", "line_start": 1, "line_end": 1, "symbol": "w", "confidence": c}]} for i, c in enumerate((0.87, 0.82))
]


@pytest.fixture
def intents(spark, tmp_path):
    path = tmp_path / "intent_records.jsonl"
    path.write_text("\n".join(map(json.dumps, INTENTS)) + "\n\n{not json\n")
    return readers.json_lines(spark, str(path)), path


def test_json_lines(spark, intents, tmp_path):
    df, path = intents
    assert df.count() == 2
    assert readers.json_variants(spark, str(path)).where("v is null").count() == 1
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "none.jsonl"), missing_ok=False).count()
    assert len(readers.fingerprint(spark, str(path)).first().sha256) == 64


def test_generate_then_validate(spark, intents, tmp_path):
    df, _ = intents
    contract = synth.generate(df, "intent_records", str(tmp_path / "contracts"), "intent_records.jsonl", now=NOW, snapshots=str(tmp_path / "snaps"))
    kinds = [(c["type"], c.get("name")) for c in contract["quality_extended"]]
    assert kinds == [
        ("not_null", None), ("unique", None), ("accepted_values", None), ("custom", "extracted_facts.confidence.range"), ("custom", "created_at_not_future"),
        ("custom", "array_fields_non_empty"), ("custom", "timestamp_iso8601_format"), ("custom", "minimum_record_count_7"),
    ]
    assert contract["qualityFloor"] == 100.0 and contract["id"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "intent_records"))
    loaded = readers.load_contract(tmp_path / "contracts" / "week1_intent_records.yaml")
    rep = validate.report(df, loaded)
    failed = [(r["check_id"], r["sample_failing"]) for r in rep["results"] if r["status"] == "FAIL"]
    assert (rep["total_checks"], rep["passed"], failed) == (11, 10, [("week1_intent_records.intent_id.unique", ["INT-001"])])
    assert len(readers.load_contract(tmp_path / "contracts" / "week1_intent_records.yaml", with_soda=True).clauses) == 8 + 5
    dbt = yaml.safe_load((tmp_path / "contracts" / "week1_intent_records_dbt.yml").read_text())
    tests = {c["name"]: c.get("tests") for c in dbt["models"][0]["columns"]}
    assert tests["intent_id"] == ["not_null", "unique"]
    assert [p.stem for p in readers.contract_files(tmp_path / "contracts")] == ["week1_intent_records"]
    snap = readers.load_snapshots(spark, tmp_path / "snaps")
    assert snap.where("field = 'intent_id'").first().required and snap.select("taken").first()[0] == NOW
    assert readers.load_snapshots(spark, tmp_path / "snaps", datetime(2027, 1, 1)).count() == 0
    assert writers.seed_snapshots([contract], tmp_path / "snaps", NOW) == []
    batch = validate.run_batch(spark, readers.contract_files(tmp_path / "contracts"), str(tmp_path), readers.load_baselines(spark, tmp_path / "b.json"))
    assert (batch["contracts_validated"], batch["failed"], batch["overall_status"]) == (1, 1, "FAIL")
    assert writers.console_line(batch["reports"][0]).startswith("[FAIL] week1_intent_records")


def test_runs_contract_has_every_kind_of_clause():
    names = ["id", "run_type", "start_time", "end_time", "total_tokens", "prompt_tokens", "completion_tokens", "total_cost", "inputs.doc_id", "outputs.x", "event_type", "sequence_number", "confidence"]
    columns = {n: {"type": "number", "null_fraction": 0.0, "cardinality": 1, "sample_values": []} for n in sorted(names)}
    stats = {"min": 0, "max": 2, "mean": 1.0, "p25": 1, "p50": 1, "p75": 1, "p95": 1, "p99": 1, "stddev_pop": 0.1}
    p = synth.Profile("runs", columns, {n: stats for n in ("completion_tokens", "confidence", "prompt_tokens", "total_cost")}, ["facts[*].confidence"], 5, 100.0, 12.5)
    found = [c.get("name", c["type"]) for c in synth.clauses_for(p)]
    assert found == [
        "not_null", "unique", "accepted_values", "accepted_values", "confidence_range_invariant", "extracted_facts.confidence.range", "confidence_distribution_confidence", "temporal_ordering",
        "token_accounting_invariant", "cost_non_negative", "monotonic_sequence_per_aggregate", "event_type_registry_compliance", "statistical_bounds_completion_tokens",
        "statistical_bounds_prompt_tokens", "embedding_drift_detection", "llm_output_schema_enforcement", "prompt_input_validation",
    ]


def test_annotations():
    assert synth.annotate("a.b", "array")["business_rule"] == "len(value) >= 0"
    assert synth.annotate("a.b", "string", {"b": {"description": "known"}})["description"] == "known"
    assert synth.annotate("z", "string", ask=lambda n, k: 1 / 0)["column"] == "z"


def test_profiles(spark):
    rows = [(i, s, float(i), {"x": i}) for i, s in enumerate(["abc_d", "abc_d", "Abc", None, "12.5"])]
    df = spark.createDataFrame(rows, "o long, s string, v double, m struct<x:int>")
    p = {r["column"]: r for r in profile.structural(df, "o").collect()}
    assert (p["s"]["null_count"], p["s"]["cardinality"], p["s"]["sample_values"], p["s"]["char_pattern"]) == (1, 3, ["abc_d", "Abc", "12.5"], "snake_case")
    assert p["m.x"]["type"] == "integer" and p["v"]["type"] == "number"
    rough = {r["column"]: r["cardinality"] for r in profile.structural(df, "o", approximate=True).collect()}
    assert rough["s"] == 3
    n = {r["column"]: r for r in profile.numeric(df).collect()}
    assert (n["v"]["p25"], n["v"]["p50"], n["v"]["stddev_pop"], round(n["v"]["stddev_samp"], 4)) == (1.0, 2.0, pytest.approx(2**0.5), 1.5811)
    assert profile.numeric(df, approximate=True).where("column = 'v'").first()["p50"] == 2.0
    one = profile.numeric(df.where("o = 0")).where("column = 'v'").first()
    assert one["stddev_samp"] == 0.0


def test_drift(spark):
    base = spark.createDataFrame([("d", "a", 10.0, 1.0), ("d", "b", 10.0, 1.0), ("d", "c", 5.0, 0.0), ("d", "e", 10.0, 1.0)], "dataset string, column string, mean double, stddev double")
    df = spark.createDataFrame([(10.5, 12.5, 6.0, 20.0, 1.0)] * 6, "a double, b double, c double, e double, f double")
    got = {r["column_name"]: (r["status"], r["severity"], r["records_failing"]) for r in drift.compare(drift.statistics(df, "d"), base, "d").collect()}
    assert got == {"a": ("PASS", "MEDIUM", 0), "b": ("WARN", "WARNING", 0), "c": ("FAIL", "HIGH", 6), "e": ("FAIL", "HIGH", 6), "f": ("PASS", "MEDIUM", 0)}
    assert drift.statistics(df.limit(4), "d").count() == 0
    items = spark.createDataFrame([([{"c": float(i)} for i in range(6)],)], "facts array<struct<c:double>>")
    assert drift.statistics(items, "d", ["facts[*].c"]).first()["mean"] == 2.5


def test_baseline_roll_forward(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 1.0)] * 6, "a double, b double")
    path = writers.write_baselines(drift.statistics(df, "d"), tmp_path / "base.json")
    base = readers.load_baselines(spark, path)
    moved = drift.statistics(spark.createDataFrame([(1.0, 9.0)] * 6, "a double, b double"), "d")
    rolled = {r["column"]: r["mean"] for r in drift.roll_forward(moved, base).collect()}
    forced = {r["column"]: r["mean"] for r in drift.roll_forward(moved, base, force=True).collect()}
    assert rolled == {"a": 1.0, "b": 1.0} and forced == {"a": 1.0, "b": 9.0}
    (tmp_path / "bad.json").write_text("{")
    assert readers.load_baselines(spark, tmp_path / "bad.json").count() == 0


FIELDS = "pair string, field string, type string, required boolean, nullable boolean, enum_values array<string>"


def diff(spark, old, new):
    make = lambda rows: spark.createDataFrame([("p", *r) for r in rows], FIELDS)
    return sorted((r.field, r.change_type) for r in evolve.diff(make(old), make(new)).collect())


def test_evolution(spark):
    base = [("id", "integer", True, False, None), ("user_name", "string", True, False, None), ("n", "integer", False, True, ["a", "b"])]
    assert diff(spark, base, base) == []
    assert diff(spark, base, [*base, ("note", "string", False, True, None)]) == [("note", "ADD_NULLABLE_COLUMN")]
    assert diff(spark, base, base[1:]) == [("id", "REMOVE_COLUMN")]
    assert diff(spark, base, [base[0], ("user_title", "string", True, False, None), base[2]]) == [("user_title", "RENAME_COLUMN")]
    assert diff(spark, base, [base[0], base[1], ("n", "number", False, False, ["a"])]) == [("n", "ENUM_VALUES_BREAKING"), ("n", "NULLABILITY_CHANGE"), ("n", "TYPE_CHANGE_WIDENING")]
    for a, b in WIDENING:
        assert diff(spark, [("x", b, True, False, None)], [("x", a, True, False, None)])[0][1] in ("TYPE_CHANGE_NARROWING", "TYPE_CHANGE_WIDENING")
    assert len(CHANGE_TYPES) == 9


def test_renames_are_greedy_and_one_to_one(spark):
    old = [("alpha_one", "string", True, False, None), ("alpha_two", "string", True, False, None)]
    new = [("alpha_on", "string", True, False, None)]
    assert diff(spark, old, new) == [("alpha_on", "RENAME_COLUMN"), ("alpha_two", "REMOVE_COLUMN")]


def test_analyze_snapshots_and_impact(spark):
    rows = []
    for day, fields in ((1, ["a", "b"]), (2, ["a", "b", "review_notes"]), (3, ["b", "review_notes"])):
        rows += [("c", "s", str(day), datetime(2026, 4, day), 1, f, "string", f != "review_notes", f == "review_notes", 0.0, None) for f in fields]
    rows += [("c", "still", "1", datetime(2026, 4, 1), 1, "x", "string", True, False, 0.0, None)]
    found, code = evolve.analyze(spark.createDataFrame(rows, readers.SNAPSHOT_SCHEMA))
    assert code == 1 and found["s"]["verdict"] == "BREAKING" and found["still"]["verdict"] == "STABLE"
    assert [c["change_type"] for c in found["s"]["changes"]] == ["ADD_NULLABLE_COLUMN", "REMOVE_COLUMN"]
    impact = evolve.migration_impact(found["s"]["changes"], "s", "1", "3", ["team"])
    assert impact["compatibility_verdict"] == "BREAKING" and len(impact["migration_checklist"]) == 4 and impact["per_consumer_failure_analysis"][0]["risk_level"] == "HIGH"
    assert evolve.parse_since("2 days ago", NOW) == datetime(2026, 4, 1, 8) and evolve.parse_since("2026-01-02", NOW) == datetime(2026, 1, 2)
    with pytest.raises(ValueError):
        evolve.parse_since("soon", NOW)


def snapshot(spark):
    nodes = [{"node_id": n, "label": l, "metadata": {"path": p}} for n, l, p in [("f1", "load.py", "src/load.py"), ("f2", "clean.py", "src/clean.py"), ("t", "orders", "orders"), ("d", "report", "out/report")]]
    edges = [{"source": a, "target": b} for a, b in [("f1", "f2"), ("f2", "t"), ("t", "d"), ("d", "t"), ("f2", "t")]]
    return spark.createDataFrame([(nodes, edges)], "nodes array<struct<node_id:string,label:string,metadata:struct<path:string>>>, edges array<struct<source:string,target:string>>")


def test_graphs(spark):
    nodes, edges = lineage.graph(snapshot(spark))
    assert edges.count() == 4
    start = spark.createDataFrame([("t",)], "id string")
    assert {(r.id, r.hops) for r in lineage.upstream(edges, start).collect()} == {("f2", 1), ("f1", 2), ("d", 1)}
    assert {r.id for r in lineage.upstream(edges, start, 1).collect()} == {"f2", "d"}
    assert {r.id for r in lineage.downstream(edges, start).collect()} == {"d"}
    assert {r.id for r in lineage.dataset_nodes(nodes, "week9_orders").collect()} == {"t"}
    flat = spark.createDataFrame([("a", "b"), ("a", "b")], "`from` string, `to` string")
    assert lineage.graph(flat)[1].count() == 1


def test_attribution(spark):
    results = spark.createDataFrame([("w.orders.unique", "id", "FAIL", "CRITICAL", "m", 3), ("w.ok", "x", "PASS", "LOW", "m", 0)], "check_id string, column_name string, status string, severity string, message string, records_failing long")
    registry = spark.createDataFrame([("c1", "s1", [], [("id", "key")], "ENFORCE")], "contract_id string, subscriber_id string, fields_consumed array<string>, breaking_fields array<struct<field:string,reason:string>>, validation_mode string")
    asked = []

    def commits(files):
        asked.append(files)
        rows = [("src/clean.py", "c" * 40, "a@x", "2026-04-01T08:00:00+00:00", "late", 1), ("src/load.py", "d" * 40, "b@x", "2026-03-20T08:00:00+00:00", "old", 1)]
        return spark.createDataFrame(rows, readers.COMMIT_SCHEMA)

    found = lineage.attribute(results, snapshot(spark), registry, "c1", "week9_orders", NOW, commits, ["src/fallback.py"])
    assert len(found) == 1 and len(asked) == 1
    chain = found[0]["blame_chain"]
    assert [(b["rank"], b["commit_hash"][0], b["confidence_score"]) for b in chain] == [(1, "c", 0.6), (2, "d", 0.05)]
    assert found[0]["blast_radius"]["affected_nodes"] == ["subscriber::s1", "report"] and found[0]["blast_radius"]["breaking_field_matched"]
    none = lineage.attribute(results, snapshot(spark), registry, "c1", "week9_orders", NOW, None, ["src/fallback.py"])
    assert none[0]["blame_chain"][0]["commit_hash"] == "0" * 40


def test_git_sources(spark):
    calls = []

    def fake(command, cwd, timeout=30):
        calls.append(command)
        if command[1] == "log":
            return 0, "h1\x1fa@x\x1f2026-04-01T00:00:00+00:00\x1fone\nh2\x1fb@x\x1f2026-03-01T00:00:00+00:00\x1ftwo"
        if command[1] == "blame":
            return 0, f"{'e' * 40} 1 1 1\nauthor-mail <z@x>\nauthor-time 0\nsummary first\n\tcode"
        return -1, ""

    assert [(r.commit_hash, r.place) for r in readers.git_commits(spark, ["f", "f"], ".", run=fake).collect()] == [("h1", 1), ("h2", 2)] and len(calls) == 1
    assert readers.git_blame(spark, ["f"], ".", run=fake).first().author == "z@x"
    assert readers.git_root(".", fake) is None and len(readers.git_head("/x", fake)) == 40


def test_ai(spark):
    v = spark.createDataFrame([([1.0, 0.0],), ([1.0, 2.0],)], "embedding array<double>")
    assert ai.centroid(v).first()["centroid"] == [1.0, 1.0]
    other = ai.centroid(spark.createDataFrame([([1.0, -1.0],)], "embedding array<double>"))
    assert tuple(ai.embedding_drift(ai.centroid(v), other).first()) == (1.0, "FAIL")
    texts = spark.createDataFrame([("red green red",), ("green blue",)], "text string")
    vectors, model = ai.tfidf(texts, features=8)
    again, _ = ai.tfidf(texts.limit(1), model=model)
    assert len(vectors.first().embedding) == len(again.first().embedding) == 3
    df = spark.createDataFrame([("a", "b"), ("", "b"), (None, None)], "doc_id string, extra string")
    checked = ai.validate_schema(df, {"required": ["doc_id", "path"], "properties": {"doc_id": {"type": "string", "minLength": 1}, "path": {}}, "additionalProperties": False})
    good, bad = ai.split(checked)
    assert good.count() + bad.count() == df.count() and bad.count() == 3
    assert {(e.field, e.rule) for e in checked.first().errors} == {("path", "required"), ("extra", "additionalProperties")}
    rate = ai.violation_rate(spark.createDataFrame([("PASS",), ("odd",), (None,)], "v string"), F.col("v")).first()
    assert (rate.violations, rate.trend, rate.status) == (2, "baseline_set", "WARN")
    assert ai.violation_rate(spark.createDataFrame([], "v string"), F.col("v"), baseline=0.5).first().trend == "falling"
    row = spark.range(1).select(ai.overall([F.lit("PASS"), F.lit("WARN")]).alias("x"), ai.overall([F.lit("SKIPPED")]).alias("y")).first()
    assert tuple(row) == ("WARN", "SKIPPED")


def test_tfidf_is_sublinear(spark, sf_dir):
    """The vectors of ai03_tfidf's operator, and its mean, against brute force over the model's vocabulary."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(150).cache()
    vectors, model = ai.tfidf(docs)
    words = model.stages[1].vocabulary
    counts = {r.doc_id: Counter(re.split(r"\W+", r.text.lower(), flags=re.ASCII)) for r in docs.collect()}
    weights = [math.log((len(counts) + 1) / (sum(w in c for c in counts.values()) + 1)) for w in words]
    want = {}
    for i, c in counts.items():
        x = [(1 + math.log(c[w])) * weight if c[w] else 0.0 for w, weight in zip(words, weights)]
        norm = math.sqrt(sum(v * v for v in x))
        want[i] = [v / norm if norm else 0.0 for v in x]
    got = {r.doc_id: r.embedding for r in vectors.collect()}
    assert vectors.columns == ["doc_id", "text", "embedding"] and got.keys() == want.keys() and any(n > 1 for c in counts.values() for n in c.values())
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    mean = [sum(v) / len(want) for v in zip(*want.values())]
    assert ai.centroid(vectors).first()["centroid"] == pytest.approx(mean, abs=1e-9)


def test_quarantine_sink(spark, tmp_path):
    checked = ai.validate_schema(spark.createDataFrame([("a",), (None,)], "x string"), {"required": ["x"]})
    writers.write_quarantine(checked, str(tmp_path / "q"))
    back = spark.read.json(str(tmp_path / "q")).first()
    assert back.errors[0].rule == "required" and back.quarantined_at


def checks(spark, n_pass, fails):
    rows = [(i, f"s.p{i}", "PASS", "LOW", 0, "") for i in range(n_pass)] + [(100 + i, f"s.{name}", "FAIL", sev, 2, "x") for i, (name, sev) in enumerate(fails)]
    return spark.createDataFrame(rows, "ordinal int, check_id string, status string, severity string, records_failing long, actual_value string")


def test_reports(spark):
    c = checks(spark, 86, [("a.unique", "CRITICAL"), ("temporal_ordering", "CRITICAL"), ("c", "CRITICAL")] + [(f"h{i}", "HIGH") for i in range(7)])
    h = report.health(c).first()
    assert (h.total_checks, h.base_score, h.score, h.band) == (96, 89.6, 29.6, "critical")
    rep = report.build(c, evolve.taxonomy(spark).limit(0).select(F.lit("p").alias("pair"), F.lit("f").alias("field"), "*", F.lit("d").alias("detail")), {"embedding": "FAIL", "output": "PASS"})
    assert rep["violations"] == {"CRITICAL": 3, "HIGH": 7} and [t["check_id"] for t in rep["top_failures"]] == ["s.a.unique", "s.temporal_ordering", "s.c"]
    assert rep["ai_risk"]["overall_risk"] == "HIGH" and len(rep["recommended_actions"]) == 3
    assert "2 records" in rep["recommended_actions"][0]["action"]
    page = report.to_html(rep)
    assert "29.6" in page and "<script" not in page
    assert report.health(checks(spark, 0, [])).first().score == 0.0


def test_pdf_pages_and_places(spark):
    many = [("unit(\\)", "LOW")] + [(f"c{i}", "LOW") for i in range(3)]
    rep = report.build(checks(spark, 1, many)) | {"schema_changes": [{"pair": "p", "field": f"f{i} é 漢", "change_type": "ADD", "severity": "INFO", "detail": "x " * 120} for i in range(60)]}
    page = report.to_pdf(rep)
    start = int(page.split(b"startxref\n")[1].split()[0])
    assert page[start : start + 4] == b"xref" and page.endswith(b"%%EOF\n")
    places = [int(x.split()[0]) for x in page[start:].split(b"\n")[3:] if x.endswith(b"n ")]
    assert all(page[at:].startswith(b"%d 0 obj" % i) for i, at in enumerate(places, 1)) and len(places) > 10
    assert page.count(b"/Type /Page ") == (len(places) - 3) // 2 and b"f59 \xe9 ?" in page and rb"unit\(\\\)" in page
    for part in page.split(b"/Length ")[1:]:
        n, rest = part.split(b" >>\nstream\n", 1)
        assert rest[int(n) :].startswith(b"\nendstream")


def test_remote_embeddings(spark):
    """A small service on this machine: vectors come back by index, in batches, and the bound holds."""
    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            given = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((len(given["input"]), given["model"], self.headers["Authorization"]))
            rows = [{"index": i, "embedding": [len(t), 1]} for i, t in enumerate(given["input"])]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": rows[::-1]}).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        client = ai.remote_client(f"http://127.0.0.1:{server.server_port}/", "m", "k")
        texts = spark.createDataFrame([("x" * (i % 9),) for i in range(30)] + [(None,)], "text string")
        rows = ai.embed(texts, client, batch=4).collect()
        assert len(rows) == 30 and all(r.embedding == [len(r.text), 1.0] for r in rows)
        assert max(n for n, *_ in asked) <= 4 and {x[1:] for x in asked} == {("m", "Bearer k")}
        assert [r.text for r in ai.embed(texts, client, most=3).collect()] == ["", "", ""] and ai.embed(texts.limit(0), client).count() == 0
        assert ai.centroid(ai.embed(texts, client, most=None)).first().n == 30
    finally:
        server.shutdown()


def test_synthetic_padding(spark):
    rows = etl.padded(etl.synthetic_extractions(spark.range(2)), 5, etl.synthetic_extractions).collect()
    assert len(rows) == 5 and all(0.7 <= f.confidence < 1 and f.entity_refs == [r.entities[0].entity_id] for r in rows for f in r.extracted_facts)


def test_report_files(spark, tmp_path):
    for stem in ("a", "b"):
        writers.write_json({"results": [{"check_id": f"{stem}.x", "status": "PASS"}]}, tmp_path / f"{stem}_report.json", tmp_path / "copy" / f"{stem}.json")
    writers.write_json({"results": [{"check_id": "skip", "status": "FAIL"}]}, tmp_path / "ai_extensions_report.json")
    assert {r.check_id for r in readers.check_results(spark, str(tmp_path)).collect()} == {"a.x", "b.x"}
    assert (tmp_path / "copy" / "a.json").exists()


def test_uuid5_is_the_standard_one(spark):
    names = ["events", "", "é", "orders:7"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(etl.uuid5(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_intents_and_verdicts(spark):
    traces = spark.createDataFrame([("I1", "write_to_file", "src/auth/Login.ts", "EVOLUTION", "h", "2026-01-01T00:00:00Z"), ("I2", "other", "pay/billing.ts", "X", "h", None)], "intent_id string, tool string, file_path string, semantic_change string, content_sha256 string, timestamp string")
    a, b = etl.intent_records(traces).orderBy("intent_id").collect()
    assert a.governance_tags == ["evolution", "feature", "auth", "pii"] and a.code_refs[0].confidence == 0.87 and "modified 'Login.ts'" in a.description
    assert b.governance_tags == ["evolution", "billing"] and (b.code_refs[0].confidence, b.code_refs[0].symbol) == (0.85, "other")
    text = "# R\n**Repository:** https://github.com/x/y\n**Overall Score:** 3.8/5\n**Verdict:** pass\n## Criterion: Code Quality\nok\n**Score:** 9/5\n## Criterion: Docs\n**Score:** 2/5\n"
    reports = spark.createDataFrame([(text, "r.md"), ("**Overall Score:** 0.0/5", "z.md"), ("nothing", "n.md")], "text string, file string")
    v = {r._source.source_file: r for r in etl.verdicts(reports, "now").collect()}
    assert set(v) == {"r.md", "z.md"}
    assert (v["r.md"].overall_verdict, v["r.md"].confidence, [(s.criterion, s.score) for s in v["r.md"].scores]) == ("PASS", 0.866, [("code_quality", 5), ("docs", 2)])
    assert (v["z.md"].overall_verdict, v["z.md"].confidence, v["z.md"].target_ref, v["z.md"].scores[0].score) == ("FAIL", 0.5, "z", 1)


def test_extractions_and_traces(spark):
    docs = spark.createDataFrame([("d1", "f.pdf", 87.0, "VISION", 2.5, [("The Acme Bank paid Berlin.", 3, "title"), (" ", 1, "x"), ("Then Acme grew", None, None)])], "doc_id string, filename string, confidence double, strategy string, processing_time double, units array<struct<content:string,page:int,chunk_type:string>>")
    ledger = spark.createDataFrame([("f.pdf", "2026-01-01"), ("f.pdf", "2026-01-02")], "filename string, timestamp string")
    r = etl.extractions(docs, ledger).first()
    assert etl.padded(etl.extractions(docs, ledger), 40, etl.synthetic_extractions).count() == 40
    assert [f.confidence for f in r.extracted_facts] == [0.9, 0.87] and r.extracted_at == "2026-01-02" and r.processing_time_ms == 2500
    assert [(e.name, e.type) for e in r.entities] == [("Acme", "OTHER"), ("Bank", "ORG"), ("Berlin", "PERSON")]
    assert list(r.extracted_facts[1].entity_refs) == [r.entities[0].entity_id] and (r.token_count.input, r.token_count.output) == (100, 50)
    rows = spark.createDataFrame([(7, "m", 500, 1000, 200, NOW)], "doc_id long, extraction_model string, processing_time_ms int, input_tokens int, output_tokens int, started timestamp")
    runs = {t.run_type: t for t in etl.traces(rows).collect()}
    assert set(runs) == {"chain", "llm", "embedding"} and runs["llm"].total_tokens == 1200
    assert runs["chain"].total_cost == pytest.approx(runs["llm"].total_cost + runs["embedding"].total_cost) and all(t.end_time > t.start_time for t in runs.values())
    assert runs["llm"].parent_run_id == runs["chain"].id and runs["embedding"].parent_run_id == runs["llm"].id


def plain_entities(contents, doc_id):
    """The entity rule stated as steps, for comparison."""
    order, out, refs = [], {}, []
    for text in contents:
        mine = []
        if len(order) < 20:
            for at, word in enumerate(text.split()):
                name = re.sub("[.,;:()]+$", "", word)
                if at == 0 or len(name) < 4 or not name.isalpha() or not name[0].isupper() or name in etl.NOT_NAMES:
                    continue
                key = name.lower()
                if key not in out and len(order) < 20:
                    kind = "ORG" if any(m in key for m in etl.ORGANISATION_MARKS) else "PERSON" if at > 1 and name[1:].islower() else "OTHER"
                    out[key] = (f"{doc_id}:{len(order)}", name, kind, key)
                    order.append(key)
                if key in out and out[key][0] not in mine:
                    mine.append(out[key][0])
                if len(mine) == 3:
                    break
        refs.append(mine)
    return [out[k] for k in order], refs


def test_entities_of_many_facts(spark):
    rnd = random.Random(4)
    names = ["Berlin", "Acme", "ACME", "acme", "Bank", "This", "Incorp,", "Zed", "Quarkland.", "Übersee", "McCoy", "X1234"] + [f"Name{chr(97 + i) * 3}" for i in range(25)]
    docs = [(f"d{k}", [" ".join(rnd.choices(names, k=rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 15))]) for k in range(60)] + [("d9", ["Then Berlin"]), (None, ["Then Berlin"])]
    rows = [(d, "f", None, None, None, [(c, None, None) for c in cs]) for d, cs in docs]
    frame = spark.createDataFrame(rows, "doc_id string, filename string, confidence double, strategy string, processing_time double, units array<struct<content:string,page:int,chunk_type:string>>")
    got = etl.extractions(frame).collect()
    assert len(got) == len(docs)  # repeated and null ids stay
    want = sorted(repr(plain_entities(cs, d or "")) for d, cs in docs)
    assert sorted(repr(([tuple(e) for e in r.entities], [list(f.entity_refs) for f in r.extracted_facts])) for r in got) == want


def test_snapshot_ids(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"x" * 200_000)
    assert readers.snapshot_id(spark, str(tmp_path / "a.jsonl")) == hashlib.sha256(b"x" * 200_000).hexdigest()
    both = readers.snapshot_id(spark, str(tmp_path))
    (tmp_path / "b.jsonl").write_text("y")
    assert len(both) == 64 and readers.snapshot_id(spark, str(tmp_path)) != both


def test_blast_radius_names_pipelines(spark):
    nodes = spark.createDataFrame([(x, x, None) for x in ("t", "load_pipeline.py", "b", "job_runner")], "id string, label string, path string")
    edges = spark.createDataFrame([("t", "load_pipeline.py"), ("load_pipeline.py", "b"), ("b", "job_runner"), ("job_runner", "t")], "src string, dst string")
    r = lineage.blast_radius(edges, nodes, spark.createDataFrame([("t",)], "id string"), ["s"])
    assert r["affected_pipelines"] == ["load_pipeline.py", "job_runner"] and r["contamination_depth"] == 3
    assert r["affected_nodes"] == ["subscriber::s", "file::load_pipeline.py", "b", "job_runner"]


def test_samples_of_all_checks_in_one_job(spark):
    df = spark.createDataFrame([(str(i), i % 4 if i % 7 else None) for i in range(40)], "id string, v int")
    c = Compiler(df, "t", df.schema)
    checks = dict(enumerate(c.checks((Clause("not_null", fields=("v",)), Clause("unique", fields=("v",)), Clause("unique", fields=("id",))))))
    got = validate.failing_samples(df.coalesce(1), checks)
    assert got == {k: validate.failing_sample(df.coalesce(1), x) for k, x in checks.items()} and got[0] == ["0", "7", "14", "21", "28"] and got[2] == []


def test_lineage_records_and_steps(spark):
    modules = spark.createDataFrame([("C:\\w\\cloned_repo_3\\src\\test_a.py", "py"), ("x/y/models/b.sql", "sql")], "file_path string, language string")
    data = spark.createDataFrame([("sink:orders",), ("file:/a/cloned_repo_3/src/test_a.py",)], "id string")
    n = {r.node_id: r for r in etl.lineage_nodes(modules, data).collect()}
    assert set(n) == {"file::src/test_a.py", "file::y/models/b.sql", "table::orders"}
    assert n["file::src/test_a.py"].purpose.startswith("Tests") and n["file::y/models/b.sql"].type == "TABLE"
    e = etl.lineage_edges(spark.createDataFrame([("sink:a", "file:p/q.py", "FEEDS"), ("a", "b", None)], "source string, target string, relation string")).collect()
    assert {(x.source, x.target, x.relationship) for x in e} == {("table::a", "file::p/q.py", "PRODUCES"), ("file::a", "file::b", "IMPORTS")}
    done = etl.run_steps([("one", lambda: spark.range(3)), ("few", lambda: spark.range(1)), ("bad", lambda: 1 / 0)], {"one": 2, "few": 5})
    assert [d["status"] for d in done] == ["OK", "TOO_FEW", "FAILED"]
    assert etl.padded(spark.range(2), 5, lambda r: r.select((F.col("id") + 100).alias("id"))).count() == 5


def test_registry_file(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("subscriptions:\n- contract_id: c\n  subscriber_id: s\n  fields_consumed: [a]\n  breaking_fields:\n  - field: a\n    reason: key\n  validation_mode: ENFORCE\n")
    assert readers.load_registry(spark, tmp_path / "r.yaml").first().breaking_fields[0].field == "a"
    assert readers.load_registry(spark, tmp_path / "none.yaml").count() == 0


def test_stream(spark, tmp_path, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.limit(100).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(orders.schema).parquet(str(tmp_path / "in"))
    contract = Contract("c", "orders", (Clause("not_null", fields=("o_orderkey",)), Clause("unique", fields=("o_orderkey",))))
    validate_stream(stream, contract, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert latest_results(spark.read.parquet(str(tmp_path / "out"))).where("status = 'PASS'").count() == 2
