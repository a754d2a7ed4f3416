"""Lineage: graphs, bounded and unbounded traversal, blast radius, registry matches and blame.

Graphs are edge tables.  Traversals move a frontier by joins and drop what was
visited by anti-joins, so cycles end and only new nodes travel; the lineage of
the plan is cut every few steps.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checkpoints import cut
from ..sources.readers import COMMIT_SCHEMA

MOST_CANDIDATES, LEAST_CANDIDATES, FLOOR = 5, 1, 0.05


def _pick(df: DataFrame, struct: str, names: list[str]) -> Column:
    """The first non-null of a struct's fields, whichever exist."""
    kind = df.schema[struct].dataType
    found = [F.col(struct)[n].cast("string") for n in names if isinstance(kind, T.StructType) and n in kind.names]
    return F.coalesce(*found, F.lit(None).cast("string"))


def graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from snapshots with `nodes` and `edges` arrays, or from flat edge rows.

    Ends are named source/target or from/to, ids node_id or id; repeated edges count once.
    """
    if "edges" in records.columns:
        e = records.select(F.explode("edges").alias("e"))
        n = records.select(F.explode("nodes").alias("n"))
        meta = n.schema["n"].dataType
        path = F.col("n.metadata.path") if "metadata" in meta.names and "path" in meta["metadata"].dataType.names else F.lit(None).cast("string")
        nodes = n.select(F.coalesce(_pick(n, "n", ["node_id", "id"])).alias("id"), _pick(n, "n", ["label", "name"]).alias("label"), F.coalesce(_pick(n, "n", ["path", "file_path", "source_file", "module"]), path).alias("path"))
        edges = e.select(_pick(e, "e", ["source", "from"]).alias("src"), _pick(e, "e", ["target", "to"]).alias("dst"))
    else:
        names = records.columns
        edges = records.select(*[F.coalesce(*[F.col(c).cast("string") for c in pair if c in names]).alias(a) for pair, a in ((("source", "from", "src"), "src"), (("target", "to", "dst"), "dst"))])
        ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
        nodes = ends.select("id", F.col("id").alias("label"), F.lit(None).cast("string").alias("path"))
    one = nodes.where("id is not null").groupBy("id").agg(F.min("label").alias("label"), F.min("path").alias("path"))
    return one, edges.where("src is not null and dst is not null").distinct()


def upstream(edges: DataFrame, starts: DataFrame, max_hops: int = 4) -> DataFrame:
    """(id, hops): nodes from which a start can be reached in at most `max_hops` steps, by fewest; starts are left out."""
    return _walk(edges.select(F.col("dst").alias("at"), F.col("src").alias("next")), starts, max_hops)


def downstream(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(id, hops): everything that a start reaches; without a bound, the full closure."""
    return _walk(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")), starts, max_hops)


def _walk(steps: DataFrame, starts: DataFrame, max_hops: int | None) -> DataFrame:
    steps = cut(steps.distinct())
    visited = starts.select("id", F.lit(0).alias("hops")).distinct()
    frontier, hop = visited, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        reached = steps.join(frontier, steps["at"] == frontier.id).select(F.col("next").alias("id")).distinct()
        frontier = cut(reached.join(visited, "id", "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if hop % 8 == 0:
            visited = cut(visited)
    return visited.where("hops > 0")


def upstream_sql(spark: SparkSession, edges: DataFrame, starts: DataFrame, max_hops: int = 4) -> DataFrame:
    """The same as `upstream` as one recursive query, for small graphs: no jobs until it is read."""
    edges.createOrReplaceTempView("pactum_edges")
    starts.createOrReplaceTempView("pactum_starts")
    return spark.sql(f"""
        WITH RECURSIVE walk(id, hops) AS (
          SELECT DISTINCT id, 0 FROM pactum_starts
          UNION ALL
          SELECT e.src, w.hops + 1 FROM walk w JOIN pactum_edges e ON e.dst = w.id WHERE w.hops < {int(max_hops)})
        SELECT id, min(hops) AS hops FROM walk GROUP BY id HAVING min(hops) > 0""")


def dataset_nodes(nodes: DataFrame, dataset: str) -> DataFrame:
    """Ids of nodes whose label matches a dataset's name, or else whose path does."""
    name, short = dataset.lower(), dataset.lower().split("_", 1)[-1]
    label = F.lower("label")
    by_label = nodes.where(F.contains(label, F.lit(name)) | F.contains(label, F.lit(short)) | (F.contains(F.lit(name), label) & (label != "")))
    by_path = nodes.where(F.contains(F.lower("path"), F.lit(short)))
    any_label = by_label.select(F.lit(1).alias("hit")).limit(1)
    return by_label.select("id").unionByName(by_path.join(any_label, F.lit(True), "left_anti").select("id")).distinct()


def node_files(nodes: DataFrame) -> DataFrame:
    """(id, file_path): a node's path if it looks like one, or else its label."""
    like_path = lambda c: F.when(c.rlike(r"[./]"), c)
    like_label = F.when(F.col("label").rlike(r"/|\.py$|\.jsonl$"), F.col("label"))
    return nodes.select("id", F.coalesce(like_path(F.col("path")), like_label).alias("file_path")).where("file_path is not null")


def blame_score(days: Column, hops: Column) -> Column:
    """1 - 0.1 a day - 0.2 a hop, between 0.05 and 1, to four places."""
    return F.round(F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), 1.0 - 0.1 * days - 0.2 * hops)), 4)


def days_since(stamp: Column, as_of: Column, default: float = 7.0) -> Column:
    """Days from an ISO time to `as_of`, not below 0; `default` if it does not parse."""
    seconds = as_of.cast("timestamp").cast("double") - F.try_to_timestamp(stamp).cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), seconds / 86400.0), F.lit(default))


def blame_chain(files: DataFrame, commits: DataFrame, as_of: datetime, fallback: list[str] | None = None, key: str = "check_id") -> DataFrame:
    """Ranked suspects per check: two latest commits of each upstream file, one of each fallback file.

    files: (key, file_path, hops).  Commits count once per check, best score
    first, five at most; a check without any gets its first fallback file at the floor score.
    """
    spark, now = files.sparkSession, F.lit(as_of.isoformat())
    nearest = files.groupBy(key, "file_path").agg(F.min("hops").alias("hops"), F.lit(2).alias("most"))
    given = spark.createDataFrame([(f,) for f in fallback or []], "file_path string")
    extra = files.select(key).distinct().join(given, F.lit(True)).join(nearest.select(key, "file_path"), [key, "file_path"], "left_anti")  # fallback files are a short fixed list
    wanted = nearest.unionByName(extra.select(key, "file_path", F.lit(1).alias("hops"), F.lit(1).alias("most")))
    found = wanted.join(commits, "file_path").where(F.col("place") <= F.col("most"))
    score = blame_score(days_since(F.col("commit_timestamp"), now), F.col("hops"))
    fields = ["file_path", "commit_hash", "author", "commit_timestamp", "commit_message", "confidence_score"]
    scored = found.withColumn("confidence_score", score).select(key, *fields)
    none = files.select(key).distinct().join(scored.select(key), key, "left_anti").join(given.limit(1), F.lit(True))
    blank = none.select(key, "file_path", F.lit("0" * 40).alias("commit_hash"), F.lit("unknown@unknown.com").alias("author"), now.alias("commit_timestamp"),
                        F.concat(F.lit("(no recent git history for "), "file_path", F.lit(")")).alias("commit_message"), F.lit(FLOOR).alias("confidence_score"))
    once = Window.partitionBy(key, "commit_hash").orderBy(F.desc("confidence_score"), "file_path")
    best = Window.partitionBy(key).orderBy(F.desc("confidence_score"), "commit_hash", "file_path")
    unique = scored.unionByName(blank).withColumn("r", F.row_number().over(once)).where("r = 1").drop("r")
    return unique.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= MOST_CANDIDATES)


def registry_matches(failing: DataFrame, registry: DataFrame) -> DataFrame:
    """failing (contract_id, field) with every subscriber of the contract, and whether the field breaks it.

    `[*]` is dropped from paths before fields are compared by equality or dotted prefix, either way round.
    """
    plain = F.replace("field", F.lit("[*]"), F.lit(""))
    f = failing.withColumn("plain", plain)
    hit = F.exists(
        "breaking_fields",
        lambda b: (b["field"] == F.col("plain")) | F.startswith(F.col("plain"), F.concat(b["field"], F.lit("."))) | F.startswith(b["field"], F.concat(F.col("plain"), F.lit("."))),
    )
    enforced = (F.coalesce("validation_mode", F.lit("ENFORCE")) == "ENFORCE").alias("enforced")
    return f.join(registry, "contract_id").select("contract_id", "field", "subscriber_id", F.coalesce(hit, F.lit(False)).alias("matched"), enforced)


RUNNERS = ("pipeline", "runner")  # labels of nodes that are pipelines contain one of these


def closure(edges: DataFrame, nodes: DataFrame, starts: DataFrame, most: int = 10) -> dict:
    """What lies downstream: labels of the `most` nearest nodes, of the `most` nearest pipelines among all, and the number of nodes."""
    reached = cut(downstream(edges, starts).join(nodes.select("id", "label"), "id", "left").select("id", "hops", F.coalesce("label", "id").alias("label")))
    nearest = lambda rows: [r.label for r in rows.orderBy("hops", "id").limit(most).collect()]
    runs = reduce(or_, (F.contains(F.lower("label"), F.lit(x)) for x in RUNNERS))
    return {"labels": nearest(reached), "pipelines": nearest(reached.where(runs)), "depth": reached.count()}


def blast_radius(edges: DataFrame, nodes: DataFrame, starts: DataFrame, subscribers: list[str], pipelines: list[str] | None = None, most: int = 10, reached: dict | None = None) -> dict:
    """Affected nodes: registry subscribers first, then at most ten downstream nodes; depth is the size of the closure.

    Affected pipelines are those given, or else the downstream nodes that are named as such.  `reached` is the
    `closure`, if it is known already.
    """
    reached = reached or closure(edges, nodes, starts, most)
    found = [f"file::{x}" if "/" in x or x.endswith((".py", ".jsonl")) else x for x in reached["labels"]]
    found = found or [f"dataset::{p}" for p in pipelines or []]
    first = [f"subscriber::{s}" for s in subscribers]
    return {
        "affected_nodes": [*first, *(n for n in found if n not in first)],
        "affected_pipelines": pipelines or reached["pipelines"] or ["unknown-pipeline"], "contamination_depth": reached["depth"],
    }


def attribute(results: DataFrame, records: DataFrame, registry: DataFrame, contract_id: str, dataset: str, as_of: datetime,
              commits=None, fallback: list[str] | None = None, pipelines: list[str] | None = None) -> list[dict]:
    """One violation per failed or errored check, with its blame chain and blast radius.

    `commits` maps a list of files to a commit table (injectable; None means no
    history).  The graph is walked once for all checks of the dataset.
    """
    nodes, edges = graph(records)
    starts = dataset_nodes(nodes, dataset)
    failing = results.where(F.col("status").isin("FAIL", "ERROR"))
    rows = failing.collect()  # one row per failed check
    if not rows:
        return []
    above = upstream(edges, starts).join(node_files(nodes), "id").groupBy("file_path").agg(F.min("hops").alias("hops"))
    files = failing.select("check_id").join(above, F.lit(True), "left").select("check_id", F.coalesce("file_path", F.lit((fallback or ["src/unknown.py"])[0])).alias("file_path"), F.coalesce("hops", F.lit(1)).alias("hops"))
    names = [r.file_path for r in files.select("file_path").distinct().collect()] + list(fallback or [])
    history = commits(names) if commits else results.sparkSession.createDataFrame([], COMMIT_SCHEMA)
    chain: dict[str, list] = {}
    for r in blame_chain(files, history, as_of, fallback or ["src/unknown.py"]).orderBy("check_id", "rank").collect():
        chain.setdefault(r.check_id, []).append({k: v for k, v in r.asDict().items() if k != "check_id"})
    fields = failing.select(F.lit(contract_id).alias("contract_id"), F.col("column_name").alias("field")).distinct()
    matches: dict[str, list] = {}
    for r in registry_matches(fields, registry).orderBy(F.desc("enforced"), "subscriber_id").collect():
        matches.setdefault(r.field, []).append(r)
    reached, out = closure(edges, nodes, starts), []
    for r in rows:
        radius = blast_radius(edges, nodes, starts, [m.subscriber_id for m in matches.get(r.column_name, [])], pipelines, reached=reached)
        out.append({
            "check_id": r.check_id, "detected_at": as_of.isoformat(), "severity": r.severity, "status": r.status, "message": r.message, "records_failing": r.records_failing,
            "blame_chain": chain.get(r.check_id, []), "blast_radius": radius | {"estimated_records": r.records_failing, "breaking_field_matched": any(m.matched for m in matches.get(r.column_name, []))},
        })
    return out


def contract_lineage(records: DataFrame, dataset: str, hops: int = 3, most: int = 5) -> dict:
    """A contract's surroundings: labels of up to five nodes above it, within three hops, and of up to five right below."""
    nodes, edges = graph(records)
    starts = dataset_nodes(nodes, dataset)

    def labels(found: DataFrame) -> list[str]:
        return [r.label for r in found.join(nodes, "id", "left").select("hops", F.coalesce("label", "id").alias("label")).orderBy("hops", "label").limit(most).collect()]

    return {"upstream": labels(upstream(edges, starts, hops)), "downstream": labels(downstream(edges, starts, 1))}
