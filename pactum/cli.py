"""Command line: python -m pactum.cli <generate|validate|attribute|evolve|ai|report> ...

Exit codes: generate 1 if a source failed; validate 1 if the mode blocks; evolve
1 on breaking changes, 2 without snapshots; attribute 1 without reports; else 0.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import ai, evolve, lineage, report, validate
from .operators.drift import compare, roll_forward, scores, statistics
from .plans import synth, taxonomy
from .sources import readers, writers

NAMES = {stem: dataset for dataset, stem in taxonomy.OUTPUT_STEMS.items()}


def session() -> SparkSession:
    return SparkSession.builder.appName("pactum").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def generate(a, spark) -> int:
    sources = sorted(Path(a.source).rglob("*.jsonl")) if a.all else [Path(a.source)]
    failed = 0
    for path in sources:
        try:
            df = readers.json_lines(spark, str(path), missing_ok=False)
            around = lineage.contract_lineage(readers.latest(readers.json_lines(spark, a.lineage), "captured_at"), path.stem) if a.lineage else None
            contract = synth.generate(df, NAMES.get(path.stem, path.stem), a.output, str(path), around, snapshots=a.snapshots)
            print(f"{contract['stem']}: {len(contract['quality_extended'])} clauses")
        except Exception as error:
            failed += 1
            print(f"{path}: {str(error)[:200]}", file=sys.stderr)
    return int(failed > 0)


def run_validate(a, spark) -> int:
    baselines = readers.load_baselines(spark, a.baselines) if a.baselines else None
    paths = [Path(a.contract)] if a.contract else readers.contract_files(a.contracts)
    blocked = False
    for path in paths:
        contract = readers.load_contract(path, a.soda)
        data = a.data or readers.resolve_data(contract, a.outputs)
        if data is None:
            print(f"{contract.stem}: no data", file=sys.stderr)
            continue
        df, drifted = readers.json_lines(spark, str(data), missing_ok=False), None
        if baselines is not None and not a.no_drift:
            now = statistics(df, contract.stem)
            drifted = compare(now, baselines, contract.stem)
            if a.rebaseline or scores(now, baselines).where("status = 'FAIL'").isEmpty():
                writers.write_baselines(roll_forward(now, baselines.where(F.col("dataset") == contract.stem), a.rebaseline), a.baselines)
        rep = validate.report(df, contract, str(data), drifted, snapshot_id=readers.snapshot_id(spark, str(data)))
        writers.write_json(rep, Path(a.report) / f"{contract.stem}_report.json")
        print(writers.console_line(rep))
        severities = {"AUDIT": (), "WARN": ("CRITICAL",), "ENFORCE": ("CRITICAL", "HIGH")}[a.mode]
        stops = [r for r in rep["results"] if r["status"] == "FAIL" and r["severity"] in severities]
        for r in stops:
            print(f"blocked by {r['check_id']}: {r['message'][:120]}", file=sys.stderr)
        blocked |= bool(stops)
    return int(blocked)


def attribute(a, spark) -> int:
    reports = sorted(Path(a.reports).glob("*_report.json")) if Path(a.reports).is_dir() else [Path(a.reports)]
    reports = [p for p in reports if not p.name.startswith(("ai_", "schema_", "migration_"))]
    if not reports:
        return 1
    now, root = datetime.now(timezone.utc), None if a.no_git else readers.git_root(a.git_root)
    records, registry = readers.json_lines(spark, a.lineage), readers.load_registry(spark, a.registry)
    found = []
    for path in reports:
        d = readers.load_json(path)
        rows = [[r.get(k) for k in ("check_id", "column_name", "status", "severity", "message", "records_failing")] for r in d.get("results", [])]
        results = spark.createDataFrame(rows, "check_id string, column_name string, status string, severity string, message string, records_failing long")
        history = readers.git_blame if a.blame else readers.git_commits
        commits = (lambda files, history=history: history(spark, files, root)) if root else None
        found += lineage.attribute(results, records, registry, d.get("contract_id", ""), d.get("contract_stem", path.stem), now, commits, [d.get("data_file") or "src/unknown.py"])
    if found:
        import json

        lines = spark.createDataFrame([(json.dumps(v),) for v in found], "value string")
        lines.coalesce(1).write.mode("append" if a.append else "overwrite").text(a.output)
    print(f"{len(found)} violations")
    return 0


def run_evolve(a, spark) -> int:
    since = evolve.parse_since(a.since, datetime.now(timezone.utc).replace(tzinfo=None)) if a.since else None
    snapshots = readers.load_snapshots(spark, a.snapshots, since)
    if a.stem:
        snapshots = snapshots.where(F.col("stem") == a.stem)
    if snapshots.isEmpty():
        return 2
    found, code = evolve.analyze(snapshots)
    for stem, entry in found.items():
        writers.write_json(entry, Path(a.reports) / f"schema_evolution_{stem}.json")
        if entry["verdict"] == "BREAKING":
            writers.write_json(evolve.migration_impact(entry["changes"], stem, "previous", "current"), Path(a.reports) / f"migration_impact_{stem}.json")
        print(f"{stem}: {entry['verdict']}, {len(entry['changes'])} changes")
    return code


def run_ai(a, spark) -> int:
    out = {}
    if a.extractions:
        records = readers.json_lines(spark, a.extractions)
        texts = ai.fact_texts(records)
        # a centroid means something only with the vocabulary it was taken with, so both are stored together
        stored = a.baseline and Path(a.baseline, "centroid").exists() and (a.embedding_url or Path(a.baseline, "model").exists())
        if a.embedding_url:
            vectors, model = ai.embed(texts, ai.remote_client(a.embedding_url, a.embedding_model, a.embedding_key)), None
        else:
            vectors, model = ai.tfidf(texts, model=PipelineModel.load(f"{a.baseline}/model") if stored else None)
        now = ai.centroid(vectors)
        out["embedding_drift"] = ai.embedding_drift(now, spark.read.parquet(f"{a.baseline}/centroid") if stored else None, a.threshold).first().asDict()
        if a.baseline and not stored:
            if model is not None:
                model.write().overwrite().save(f"{a.baseline}/model")
            now.write.mode("overwrite").parquet(f"{a.baseline}/centroid")
        path = F.col("source_path") if "source_path" in records.columns else F.lit(None).cast("string")
        prompts = records.select("doc_id", path.alias("source_path"), ai.prompt_input(F.col("extracted_facts")).alias("content_preview"))
        checked = ai.validate_schema(prompts, readers.load_json(a.schema) if a.schema else ai.PROMPT_SCHEMA)
        rate = ai.quarantine_rate(checked).first().asDict()
        out["prompt_input_validation"] = rate | {"status": "FAIL" if rate["quarantined"] else "PASS"}
        if rate["quarantined"]:
            writers.write_quarantine(checked, a.quarantine)
    if a.verdicts:
        rates = Path(a.rates or Path(a.reports) / "ai_baselines.json")
        found = ai.violation_rate(readers.json_lines(spark, a.verdicts), F.col("overall_verdict"), baseline=readers.load_rate(rates)).first().asDict()
        writers.write_rate(found["rate"], rates)  # the first run only
        out["output_violations"] = found
    writers.write_json(out, Path(a.reports) / "ai_extensions_report.json")
    return 0


def run_report(a, spark) -> int:
    checks = readers.check_results(spark, a.reports).withColumn("ordinal", F.monotonically_increasing_id())
    ai_report = readers.load_json(Path(a.reports) / "ai_extensions_report.json")
    snapshots = readers.load_snapshots(spark, a.snapshots, None) if a.snapshots else None
    changes = evolve.changes_of(snapshots) if snapshots is not None and not snapshots.isEmpty() else None
    built = report.build(checks, changes, {k: v.get("status", "SKIPPED") for k, v in ai_report.items()})
    if not a.dry_run:
        writers.write_json(built, Path(a.output) / "report_data.json")
        (Path(a.output) / "report.html").write_text(report.to_html(built))
        (Path(a.output) / "report.pdf").write_bytes(report.to_pdf(built))
    print(f"health {built['health']['score']}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pactum")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name, run, *options):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for flag, default in options:
            p.add_argument(f"--{flag}", **({"action": "store_true"} if default is False else {"default": default, "type": type(default) if isinstance(default, float) else str}))

    command("generate", generate, ("source", "."), ("all", False), ("output", "contracts"), ("lineage", None), ("snapshots", None))
    command("validate", run_validate, ("contract", None), ("data", None), ("contracts", "contracts"), ("outputs", "."), ("report", "reports"), ("baselines", None), ("no-drift", False), ("rebaseline", False), ("soda", False), ("mode", "AUDIT"))
    command("attribute", attribute, ("reports", "reports"), ("lineage", "lineage.jsonl"), ("registry", "subscriptions.yaml"), ("output", "violations"), ("git-root", "."), ("no-git", False), ("blame", False), ("append", False))
    command("evolve", run_evolve, ("snapshots", "snapshots"), ("stem", None), ("since", None), ("reports", "reports"))
    command("ai", run_ai, ("extractions", None), ("verdicts", None), ("baseline", None), ("embedding-url", ""), ("embedding-model", ""), ("embedding-key", ""), ("threshold", 0.15), ("schema", None), ("quarantine", "quarantine"), ("rates", None), ("reports", "reports"))
    command("report", run_report, ("reports", "reports"), ("snapshots", None), ("output", "health"), ("dry-run", False))
    args = parser.parse_args(argv)
    return args.run(args, session())


if __name__ == "__main__":
    sys.exit(main())
