"""The command line end to end on a small dataset."""

import json

from pactum.cli import main

from .test_engine import INTENTS


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "intent_records.jsonl").write_text("\n".join(map(json.dumps, INTENTS)))
    (tmp_path / "lineage.jsonl").write_text(json.dumps({"captured_at": "2026-01-01", "nodes": [{"node_id": "a", "label": "load.py"}, {"node_id": "b", "label": "intent_records"}], "edges": [{"source": "a", "target": "b"}]}))
    at = lambda name: str(tmp_path / name)
    assert main(["generate", "--source", at("intent_records.jsonl"), "--output", at("contracts"), "--lineage", at("lineage.jsonl"), "--snapshots", at("snaps")]) == 0
    assert "load.py" in (tmp_path / "contracts" / "week1_intent_records.yaml").read_text()
    assert main(["generate", "--source", at("nothing.jsonl"), "--output", at("contracts")]) == 1
    common = ["validate", "--contracts", at("contracts"), "--outputs", str(tmp_path), "--report", at("reports"), "--baselines", at("base.json")]
    assert main(common) == 0 and main([*common, "--mode", "ENFORCE"]) == 1
    rep = json.loads((tmp_path / "reports" / "week1_intent_records_report.json").read_text())
    assert (rep["total_checks"], rep["failed"]) == (11, 1) and len(rep["snapshot_id"]) == 64
    assert main(["attribute", "--reports", at("reports"), "--lineage", at("lineage.jsonl"), "--registry", at("none.yaml"), "--output", at("violations"), "--no-git"]) == 0
    lines = [json.loads(x) for p in (tmp_path / "violations").glob("part-*") for x in p.read_text().splitlines()]
    assert [v["check_id"] for v in lines] == ["week1_intent_records.intent_id.unique"] and lines[0]["blame_chain"]
    assert main(["evolve", "--snapshots", at("snaps"), "--reports", at("reports")]) == 0
    assert main(["evolve", "--snapshots", at("empty"), "--reports", at("reports")]) == 2
    (tmp_path / "verdicts.jsonl").write_text('{"overall_verdict": "PASS"}\n{"overall_verdict": "ODD"}')
    ai = lambda: json.loads((tmp_path / "reports" / "ai_extensions_report.json").read_text())
    assert main(["ai", "--verdicts", at("verdicts.jsonl"), "--reports", at("reports")]) == 0
    assert (ai()["output_violations"]["trend"], ai()["output_violations"]["rate"]) == ("baseline_set", 0.5)
    (tmp_path / "verdicts.jsonl").write_text("\n".join(['{"overall_verdict": "ODD"}'] * 9 + ['{"overall_verdict": "PASS"}']))
    assert main(["ai", "--verdicts", at("verdicts.jsonl"), "--reports", at("reports")]) == 0
    assert ai()["output_violations"]["trend"] == "rising" and json.loads((tmp_path / "reports" / "ai_baselines.json").read_text()) == {"output_violation_rate": 0.5}
    facts = lambda words: json.dumps({"doc_id": words, "source_path": "p" if words else "", "extracted_facts": [{"text": f"{words} fact number {i}"} for i in range(3)]})
    (tmp_path / "ex.jsonl").write_text("\n".join(map(facts, ["alpha", "beta", ""])))
    (tmp_path / "other.jsonl").write_text("\n".join(map(facts, ["gamma delta", "epsilon zeta"])))
    run = lambda name: main(["ai", "--extractions", at(name), "--baseline", at("embed"), "--quarantine", at("quarantine"), "--reports", at("reports")])
    assert run("ex.jsonl") == 0 and ai()["embedding_drift"]["status"] == "BASELINE_SET"
    assert (ai()["prompt_input_validation"]["quarantined"], ai()["prompt_input_validation"]["status"]) == (1, "FAIL")
    kept = [json.loads(x) for p in (tmp_path / "quarantine").glob("part-*") for x in p.read_text().splitlines()]
    assert len(kept) == 1 and {e["field"] for e in kept[0]["errors"]} == {"doc_id", "source_path"}
    assert run("ex.jsonl") == 0 and (ai()["embedding_drift"]["drift"], ai()["embedding_drift"]["status"]) == (0.0, "PASS")
    assert run("other.jsonl") == 0 and ai()["embedding_drift"]["drift"] > 0  # on the stored vocabulary, whose size is unchanged
    taken = next((tmp_path / "snaps").rglob("*.yaml"))
    (taken.parent / "20991231T000000Z.yaml").write_text(taken.read_text().replace("intent_id", "intent_key"))
    assert main(["report", "--reports", at("reports"), "--snapshots", at("snaps"), "--output", at("changes")]) == 0
    assert any(c["field"] for c in json.loads((tmp_path / "changes" / "report_data.json").read_text())["schema_changes"])
    assert main(["report", "--reports", at("reports"), "--output", at("health")]) == 0
    assert json.loads((tmp_path / "health" / "report_data.json").read_text())["health"]["critical"] == 1
    assert (tmp_path / "health" / "report.html").read_text().startswith("<!doctype html>")
    assert (tmp_path / "health" / "report.pdf").read_bytes().startswith(b"%PDF-1.4")
