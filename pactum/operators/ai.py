"""Checks of AI data: embedding drift, prompt-input validation with quarantine, output violation rates."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import column, cosine_distance

WARN_DISTANCE, FAIL_DISTANCE = 0.15, 0.25
VERDICTS = ["PASS", "FAIL", "WARN"]
#: What a prompt's input must hold, if no other schema is given.
PROMPT_SCHEMA = {
    "required": ["doc_id", "source_path", "content_preview"], "additionalProperties": False,
    "properties": {"doc_id": {"type": "string", "minLength": 1}, "source_path": {"type": "string", "minLength": 1}, "content_preview": {"type": "string", "maxLength": 8000}},
}


def centroid(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """One row (centroid array<double>, n): element-wise means, pre-aggregated per position."""
    means = vectors.select(F.posexplode(vector_col).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"), F.count("x").alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return means.agg(ordered.alias("centroid"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def embedding_drift(current: DataFrame, baseline: DataFrame | None, warn: float = WARN_DISTANCE, fail: float = FAIL_DISTANCE) -> DataFrame:
    """(drift, status) of two centroids: BASELINE_SET without a baseline, BASELINE_RESET on another dimension."""
    if baseline is None:
        return current.select(F.lit(0.0).alias("drift"), F.lit("BASELINE_SET").alias("status"))
    both = current.select(F.col("centroid").alias("a")).join(baseline.select(F.col("centroid").alias("b")), F.lit(True), "left")  # one row each
    distance = F.round(cosine_distance(F.col("a"), F.col("b")), 4)
    none, other = F.col("b").isNull() | (F.size("b") <= 0), F.size("a") != F.size("b")
    return both.select(F.when(none | other, F.lit(0.0)).otherwise(distance).alias("drift"), none.alias("none"), other.alias("other")).select(
        "drift", F.when(F.col("none"), "BASELINE_SET").when(F.col("other"), "BASELINE_RESET").when(F.col("drift") > fail, "FAIL").when(F.col("drift") > warn, "WARN").otherwise("PASS").alias("status")
    )


def remote_client(url: str, model: str, key: str = "", timeout: float = 30.0) -> Callable[[list[str]], list[list[float]]]:
    """A client of a service that takes {model, input: [texts]} and answers {data: [{index, embedding}]}."""

    def ask(texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        with urlopen(Request(url, json.dumps({"model": model, "input": texts}).encode(), headers), timeout=timeout) as answer:
            rows = json.load(answer)["data"]
        if len(rows) != len(texts):
            raise ValueError(f"{len(rows)} vectors for {len(texts)} texts")
        return [[float(x) for x in r["embedding"]] for r in sorted(rows, key=lambda r: r["index"])]

    return ask


def embed(texts: DataFrame, ask: Callable[[list[str]], list[list[float]]], text_col: str = "text", most: int | None = 200, batch: int = 50) -> DataFrame:
    """(text, embedding) of the first `most` texts in their own order (all if None), asked for by the tasks in batches.

    The bound is the feature: each text is a paid call to a service.  Null texts are left out.
    """
    kept = texts.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    kept = kept if most is None else kept.orderBy("text").limit(most)

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            rows = b["text"].tolist()
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                yield pd.DataFrame({"text": part, "embedding": ask(part)})

    import pandas as pd

    return kept.mapInPandas(run, "text string, embedding array<double>")


def tfidf(texts: DataFrame, text_col: str = "text", features: int = 512, model=None):
    """(vectors, model): sublinear TF-IDF as arrays.  Passing a stored model keeps its vocabulary, so centroids stay comparable.

    The vocabulary is the `features` most frequent words, of equal ones the first in order.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizerModel, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    if model is None:
        tokenizer = RegexTokenizer(inputCol=text_col, outputCol="__words", pattern=r"\W+", minTokenLength=2)
        words = tokenizer.transform(texts.where(F.col(text_col).isNotNull())).select(F.explode("__words").alias("w")).groupBy("w").count()
        listed = [r.w for r in words.orderBy(F.desc("count"), "w").limit(features).collect()]
        counter = CountVectorizerModel.from_vocabulary(listed or [""], inputCol="__words", outputCol="__counts")
        model = Pipeline(stages=[tokenizer, counter, IDF(inputCol="__counts", outputCol="__idf")]).fit(texts)
    # the model weighs raw counts c; document frequencies, and so the weights, are the same for 1 + ln(c)
    counted = model.transform(texts).withColumns({"__c": vector_to_array("__counts"), "__w": vector_to_array("__idf")})
    damped = F.zip_with("__w", "__c", lambda w, c: F.when(c > 0, w / c * (1 + F.log(c))).otherwise(F.lit(0.0)))
    # arrays of one hold the vector and its length as lambda variables, so that neither is computed again for each feature
    length = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda total, v: total + v * v))
    unit = F.transform(F.array(damped), lambda x: F.transform(F.array(length(x)), lambda n: F.transform(x, lambda v: F.when(n > 0, v / n).otherwise(F.lit(0.0))))[0])[0]
    return counted.withColumn("embedding", unit).drop("__words", "__counts", "__idf", "__c", "__w"), model


def fact_texts(extractions: DataFrame, facts_col: str = "extracted_facts", most: int | None = None, order: str | None = None) -> DataFrame:
    """Trimmed, non-empty fact texts; a bounded deterministic sample by hash if `most` is given."""
    texts = extractions.select(F.explode(facts_col).alias("f")).select(F.trim("f.text").alias("text")).where("text <> ''")
    return texts if most is None else texts.orderBy(F.xxhash64("text"), "text").limit(most)


def prompt_input(facts: Column, parts: int = 10, chars: int = 8000) -> Column:
    """The first facts' texts joined by spaces, cut to a length."""
    return F.left(F.array_join(F.transform(F.slice(facts, 1, parts), lambda x: F.coalesce(x["text"], F.lit(""))), " "), F.lit(chars))


def validate_schema(df: DataFrame, schema: dict) -> DataFrame:
    """Adds `errors`, an array of (field, rule) built from a JSON-schema-like dictionary.

    Understood: required, properties.{type, minLength, maxLength, minimum, maximum,
    enum, pattern}, additionalProperties.  All rules are predicates of one
    projection; nothing is parsed again per row.
    """
    rules: list[tuple[str, str, Column]] = []
    kinds = {"string": ["string"], "integer": ["bigint", "int", "smallint", "tinyint"], "number": ["double", "float", "bigint", "int", "smallint", "tinyint"], "boolean": ["boolean"]}
    types = dict(df.dtypes)
    for name in schema.get("required", []):
        rules.append((name, "required", column(name).isNull() if name in types else F.lit(True)))
    for name, p in schema.get("properties", {}).items():
        if name not in types:
            continue
        v = column(name)
        wanted = kinds.get(p.get("type", ""), [types[name]])
        if types[name] not in wanted and not types[name].startswith("decimal"):
            rules.append((name, "type", v.isNotNull()))
            continue
        checks = {
            "minLength": lambda x, v=v: F.char_length(v) < x, "maxLength": lambda x, v=v: F.char_length(v) > x, "minimum": lambda x, v=v: v < x,
            "maximum": lambda x, v=v: v > x, "enum": lambda x, v=v: ~v.isin(x), "pattern": lambda x, v=v: ~v.rlike(x),
        }
        rules += [(name, k, F.coalesce(f(p[k]), F.lit(False))) for k, f in checks.items() if k in p]
    if schema.get("additionalProperties") is False:
        rules += [(c, "additionalProperties", column(c).isNotNull()) for c in types if c not in schema.get("properties", {})]
    errors = F.array(*[F.when(bad, F.struct(F.lit(n).alias("field"), F.lit(r).alias("rule"))) for n, r, bad in rules])
    none = F.array().cast("array<struct<field:string,rule:string>>")
    return df.withColumn("errors", F.array_compact(errors) if rules else none)


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, quarantined): every row is in exactly one of them."""
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def quarantine_rate(checked: DataFrame) -> DataFrame:
    bad = F.count_if(F.size("errors") > 0)
    return checked.agg(F.count(F.lit(1)).alias("total"), bad.alias("quarantined"), F.round(F.coalesce(F.try_divide(bad, F.count(F.lit(1))), F.lit(0.0)), 4).alias("rate"))


def violation_rate(df: DataFrame, value: Column, allowed: list[str] | None = None, baseline: float | None = None, warn: float = 0.02) -> DataFrame:
    """Share of values outside the allowed ones, with its trend against a baseline rate; WARN above 2 %."""
    bad = F.count_if(~F.coalesce(value.isin(allowed or VERDICTS), F.lit(False)))
    base = df.agg(F.count(F.lit(1)).alias("total"), bad.alias("violations"))
    rate = F.round(F.coalesce(F.try_divide("violations", "total"), F.lit(0.0)), 4)
    known = F.lit(baseline).cast("double")
    trend = F.when(known.isNull(), "baseline_set").when(F.col("rate") > 1.5 * known, "rising").when(F.col("rate") < 0.5 * known, "falling").otherwise("stable")
    return base.withColumn("rate", rate).withColumns({"trend": trend, "status": F.when(F.col("rate") > warn, "WARN").otherwise("PASS")})


def overall(statuses: list[Column]) -> Column:
    """FAIL over WARN over PASS over SKIPPED."""
    any_of = lambda s: reduce(lambda a, b: a | b, [x == s for x in statuses], F.lit(False))
    return F.when(any_of("FAIL"), "FAIL").when(any_of("WARN"), "WARN").when(any_of("PASS"), "PASS").otherwise("SKIPPED")
