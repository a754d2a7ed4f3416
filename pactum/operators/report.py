"""Health reports over check results, schema changes and AI checks."""

from __future__ import annotations

from html import escape
from textwrap import wrap

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .validate import SEVERITY_RANK

# Part of a check's name -> what its failure means downstream
IMPACTS = [
    ("temporal_ordering", "time-series analytics and SLA calculations become wrong"),
    ("unique", "joins and idempotency checks return duplicate rows"),
    ("accepted_values", "roll-ups include unknown categories"),
    ("statistical_bounds", "outliers skew models and dashboards"),
    ("null", "nulls propagate through downstream SQL"),
]


def health(checks: DataFrame) -> DataFrame:
    """100 * passed / total to one place, less 20 per critical failure, not below 0."""
    critical = F.count_if((F.col("status") == "FAIL") & (F.upper("severity") == "CRITICAL"))
    base = checks.agg(F.count(F.lit(1)).alias("total_checks"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"),
                      F.count_if(F.col("status") == "WARN").alias("warned"), critical.alias("critical"))
    scored = base.withColumn("base_score", F.coalesce(F.round(F.try_divide(100 * F.col("passed"), F.col("total_checks")), 1), F.lit(0.0)))
    scored = scored.withColumn("score", F.greatest(F.lit(0.0), F.round(F.col("base_score") - 20 * F.col("critical"), 1)))
    band = F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 70, "attention").when(F.col("score") >= 50, "degraded").otherwise("critical")
    return scored.withColumn("band", band)


def by_severity(checks: DataFrame) -> DataFrame:
    """Failures per severity, and all warnings as WARN."""
    kind = F.when(F.col("status") == "FAIL", F.col("severity")).when(F.col("status") == "WARN", F.lit("WARN"))
    return checks.withColumn("severity", kind).where("severity is not null").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def top_failures(checks: DataFrame, n: int = 3, order: str = "ordinal") -> DataFrame:
    """The `n` most severe failures, in check order within a severity, with their downstream impact."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for p in SEVERITY_RANK.items() for x in p])[F.upper("severity")], F.lit(0))
    impact = F.lit("downstream consumers may see wrong data")
    for part, text in reversed(IMPACTS):
        impact = F.when(F.contains("check_id", F.lit(part)), text).otherwise(impact)
    return checks.where("status = 'FAIL'").withColumns({"severity_rank": rank, "impact": impact}).orderBy(F.desc("severity_rank"), order, "check_id").limit(n)


def schema_section(changes: DataFrame) -> DataFrame:
    """Changes once per (pair, field, change type, detail)."""
    w = Window.partitionBy("pair", "field", "change_type", "detail").orderBy("severity")
    return changes.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def ai_risk(statuses: dict[str, str]) -> dict:
    """FAIL is HIGH, WARN is MEDIUM, all else LOW; the overall risk is the highest."""
    level = {k: "HIGH" if v == "FAIL" else "MEDIUM" if v == "WARN" else "LOW" for k, v in statuses.items()}
    return {"checks": level, "overall_risk": next((x for x in ("HIGH", "MEDIUM") if x in level.values()), "LOW")}


# Rules of recommended actions: (priority, part of a check id, file hint, action); {n} is the number of failing records.
ACTIONS = [
    (1, "temporal_ordering", "producer of {stem}", "Correct the order of timestamps in {stem}: {n} records end before they start."),
    (1, "confidence", "producer of {stem}", "Return confidences of {stem} to 0.0-1.0: {n} records are outside."),
    (2, ".unique", "writer of {stem}", "Make writes of {stem} idempotent: {n} duplicate keys."),
    (2, "accepted_values", "contract of {stem}", "Register or repair the unknown values of {stem}: {n} records."),
    (3, "statistical_bounds", "extractor of {stem}", "Look into the outliers of {stem}: {n} records beyond three deviations."),
    (3, "prompt_input_validation", "prompts of {stem}", "Fill the prompt inputs of {stem}: {n} records lack keys."),
]


def recommended_actions(checks: list[dict], breaking: int = 0, overall_risk: str = "LOW", most: int = 3) -> list[dict]:
    """Top actions by priority, one per file hint, counts taken from the results."""
    found = []
    for priority, part, hint, action in ACTIONS:
        by_stem: dict[str, int] = {}
        for r in checks:
            if r["status"] in ("FAIL", "WARN") and part in r["check_id"]:
                stem = r["check_id"].split(".")[0]
                by_stem[stem] = by_stem.get(stem, 0) + (r["records_failing"] or 0)
        found += [{"priority": priority, "file_hint": hint.format(stem=s), "action": action.format(stem=s, n=n)} for s, n in by_stem.items()]
    if breaking:
        found.append({"priority": 2, "file_hint": "contracts", "action": f"Plan the migration of {breaking} breaking schema changes."})
    if overall_risk == "HIGH":
        found.append({"priority": 2, "file_hint": "AI checks", "action": "Stop model consumers until AI checks pass again."})
    top: dict[str, dict] = {}
    for a in sorted(found, key=lambda a: a["priority"]):
        top.setdefault(a["file_hint"], a)
    general = {"priority": 9, "file_hint": "general", "action": "Keep baselines and contracts under review."}
    return [a | {"priority": i} for i, a in enumerate([*list(top.values()), general][:most], 1)]


def build(checks: DataFrame, changes: DataFrame | None = None, ai_statuses: dict[str, str] | None = None) -> dict:
    """The whole report as a dictionary of bounded size."""
    rows = [r.asDict() for r in checks.where("status in ('FAIL', 'WARN')").select("check_id", "status", "records_failing").collect()]
    breaking = changes.where("NOT backward_compatible").count() if changes is not None else 0
    risk = ai_risk(ai_statuses or {})
    return {
        "health": health(checks).first().asDict(), "violations": {r.severity: r.n for r in by_severity(checks).collect()},
        "top_failures": [r.asDict() for r in top_failures(checks).select("check_id", "severity", "actual_value", "records_failing", "impact").collect()],
        "schema_changes": [r.asDict() for r in schema_section(changes).collect()] if changes is not None else [], "ai_risk": risk,
        "recommended_actions": recommended_actions(rows, breaking, risk["overall_risk"]),
    }


def to_html(report: dict) -> str:
    h = report["health"]
    table = lambda rows, keys: "<table><tr>" + "".join(f"<th>{k}</th>" for k in keys) + "</tr>" + "".join("<tr>" + "".join(f"<td>{escape(str(r.get(k, '')))}</td>" for k in keys) + "</tr>" for r in rows) + "</table>"
    return (
        "<!doctype html><meta charset='utf-8'><title>Data health</title>"
        f"<h1>Health {h['score']} / 100 ({h['band']})</h1><p>{h['passed']} of {h['total_checks']} checks passed, {h['critical']} critical failures.</p>"
        f"<h2>Failures</h2>{table(report['top_failures'], ['check_id', 'severity', 'records_failing', 'actual_value', 'impact'])}"
        f"<h2>Schema changes</h2>{table(report['schema_changes'], ['pair', 'field', 'change_type', 'severity', 'detail'])}"
        f"<h2>AI risk</h2><p>{report['ai_risk']['overall_risk']}</p><h2>Actions</h2>{table(report['recommended_actions'], ['priority', 'action', 'file_hint'])}"
    )


def _pdf_lines(report: dict) -> list[tuple[int, str]]:
    """The report as lines of a size in points, wrapped to a page's width."""
    h = report["health"]
    out = [(18, f"Health {h['score']} / 100 ({h['band']})"), (10, f"{h['passed']} of {h['total_checks']} checks passed, {h['critical']} critical failures.")]
    sections = [
        ("Violations", [f"{k}: {n}" for k, n in report["violations"].items()]),
        ("Failures", [f"{r['check_id']} ({r['severity']}, {r['records_failing']} records, {r['actual_value']}): {r['impact']}" for r in report["top_failures"]]),
        ("Schema changes", [f"{r['pair']} {r['field']}: {r['change_type']} ({r['severity']}), {r['detail']}" for r in report["schema_changes"]]),
        ("AI risk", [report["ai_risk"]["overall_risk"], *(f"{k}: {v}" for k, v in report["ai_risk"]["checks"].items())]),
        ("Actions", [f"{r['priority']}. {r['action']} ({r['file_hint']})" for r in report["recommended_actions"]]),
    ]
    for title, rows in sections:
        out += [(10, ""), (14, title), *((10, line) for row in rows or ["none"] for line in wrap(row, 92) or [""])]
    return out


def to_pdf(report: dict, per_page: int = 48) -> bytes:
    """The report as a PDF of A4 pages in a standard font; characters that the font lacks become question marks."""
    lines = _pdf_lines(report)
    pages = [lines[at : at + per_page] for at in range(0, len(lines), per_page)]
    quoted = lambda t: t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(),
               b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for i, page in enumerate(pages):
        body = b"BT 16 TL 50 790 Td " + b"".join(b"/F1 %d Tf (%s) Tj T* " % (size, quoted(text)) for size, text in page) + b"ET"
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    table = b"".join(b"%010d 00000 n \n" % at for at in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
