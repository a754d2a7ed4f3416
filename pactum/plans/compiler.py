"""Compiles clauses to checks, and fuses the checks of one grain into one aggregate.

A check is a set of named aggregates and a function from their values to a
result row, both as columns.  Grains are

* rows      - all row-level checks of a contract are one `df.agg`;
* items     - per array path, one aggregate over the exploded array;
* distinct  - per column, counts per value (pre-aggregated) and their sum;
* sequence  - per (partition, order), one window and one aggregate;
* edges     - per reference, an anti-join of exploded edges and node ids.

Nothing here runs a job: the outcome of `results` is a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import COMPARE, as_text, column, comparison, full_match, moment, number, value_hash
from .clauses import Clause

RESULT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("check_id", "column_name", "check_type", "status", "actual_value", "expected", "severity")]
    + [T.StructField("records_failing", T.LongType()), T.StructField("sample_failing", T.ArrayType(T.StringType())), T.StructField("message", T.StringType())]
)
#: Columns tried, in order, for a record's id (fixed values).
ID_COLUMNS = ("id", "event_id", "doc_id", "verdict_id", "intent_id", "snapshot_id", "run_id", "record_id")

Metrics = Callable[[str], Column]


@dataclass
class Check:
    check_id: str
    column: str
    type: str
    expected: str
    severity: str
    grain: tuple
    metrics: dict[str, Column]
    fails: Callable[[Metrics], Column]  # number of failing records
    actual: Callable[[Metrics], Column]
    failing: Column | None = None  # row or item predicate, for samples
    status: Callable[[Metrics], Column] | None = None
    note: Callable[[Metrics], Column] | None = None


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _text(value: Column, digits: int = 4) -> Column:
    return F.round(value.cast("double"), digits).cast("string")


class Compiler:
    """Compiles the clauses of one contract against the schema of one (flattened) dataset."""

    def __init__(self, df: DataFrame, stem: str, raw: T.StructType | None = None, as_of: Column | None = None, missing: str = "PASS"):
        """`missing` is the status of rules on absent columns; their results say column_missing either way."""
        self.missing = missing
        self.df, self.stem, self.kinds = df, stem, {f.name: f.dataType for f in df.schema}
        self.raw, self.as_of = raw or df.schema, as_of if as_of is not None else F.current_timestamp()

    def checks(self, clauses: tuple[Clause, ...]) -> list[Check]:
        out: list[Check] = []
        for c in clauses:
            try:
                out += self._clause(c)
            except Exception as error:  # one bad clause is one ERROR row
                out.append(self._fixed(f"{self.stem}.{c.name or c.type}", ",".join(c.fields) or "*", c.type, "ERROR", "compile error", c.rule_text, "CRITICAL", str(error)))
        return out

    def _sound(self, pattern: str) -> str:
        """The pattern, if the engine that will run it accepts it; else an error, here and not in a task."""
        jvm = getattr(self.df.sparkSession, "_jvm", None)
        if jvm is not None:
            jvm.java.util.regex.Pattern.compile(pattern)
        return pattern

    # --- one method per clause type ---

    def _clause(self, c: Clause) -> list[Check]:
        kind = {"not_null": self._not_null, "unique": self._unique, "accepted_values": self._accepted, "custom": self._custom, "ai_extension": self._ai, "soda": self._soda}.get(c.type)
        if kind is None:
            return [self._fixed(f"{self.stem}.{c.name or c.type}", ",".join(c.fields) or "*", c.type, "PASS", "clause type not executable", c.rule_text, "LOW", f"Clause type '{c.type}' is not known; nothing was checked.")]
        return kind(c)

    def _place(self, name: str) -> tuple[tuple, Column | None, T.DataType | None]:
        """Grain, value and type of a field: a column, or `array[*].leaf` at item grain; None if it is missing."""
        if "[*]." in name:
            array, leaf = name.split("[*].", 1)
            kind = self.kinds.get(array)
            item = kind.elementType if isinstance(kind, T.ArrayType) else None
            if isinstance(item, T.StructType) and leaf in item.names:
                return ("items", array), F.col("item")[leaf], item[leaf].dataType
            return ("rows",), None, None
        if name in self.kinds:
            return ("rows",), column(name), self.kinds[name]
        return ("rows",), None, None

    def _fixed(self, check_id, column_name, check_type, status, actual, expected, severity, message) -> Check:
        return Check(check_id, column_name, check_type, expected, severity, ("rows",), {}, lambda m: F.lit(0), lambda m: F.lit(actual),
                     status=lambda m: F.lit(status), note=lambda m: F.lit(message))

    def _missing(self, check_id, name, check_type, expected, severity) -> Check:
        """On a column that is absent."""
        return self._fixed(check_id, name, check_type, self.missing, "column_missing", expected, severity, f"'{name}' is not in the data; nothing was checked.")

    def _counted(self, check_id, name, check_type, expected, severity, grain, bad: Column, fine: str, extra: dict | None = None, actual=None, note=None) -> Check:
        shown = actual or (lambda m: F.when(m("bad") == 0, F.lit(fine)).otherwise(F.concat(m("bad").cast("string"), F.lit(" violations"))))
        return Check(check_id, name, check_type, expected, severity, grain, {"bad": _count(bad), **(extra or {})}, lambda m: m("bad"), shown, failing=bad, note=note)

    def _not_null(self, c: Clause) -> list[Check]:
        out = []
        for name in c.fields:
            grain, v, kind = self._place(name)
            bad = F.lit(True) if v is None else v.isNull() | ((v == "") if isinstance(kind, T.StringType) else F.lit(False))
            actual = lambda m: F.concat(m("bad").cast("string"), F.lit("/"), m("n").cast("string"), F.lit(" null"))
            out.append(self._counted(f"{self.stem}.{name}.not_null", name, "not_null", "IS NOT NULL", "CRITICAL", grain, bad, "", {"n": F.count(F.lit(1))}, actual))
        return out

    def _unique(self, c: Clause) -> list[Check]:
        out = []
        for name in c.fields:
            check_id = f"{self.stem}.{name}.unique"
            if name not in self.kinds:
                out.append(self._missing(check_id, name, "unique", "UNIQUE", "CRITICAL"))
                continue
            actual = lambda m: F.when(m("dup") == 0, F.concat(m("kinds").cast("string"), F.lit(" distinct / "), m("n").cast("string"), F.lit(" records"))).otherwise(
                F.concat(m("dup").cast("string"), F.lit(" duplicates in "), m("n").cast("string"), F.lit(" values"))
            )
            out.append(Check(check_id, name, "unique", "UNIQUE", "CRITICAL", ("distinct", name), {}, lambda m: m("dup"), actual))
        return out

    def _accepted(self, c: Clause) -> list[Check]:
        if c.pattern is None and c.values is None:
            return []
        if c.pattern is not None:
            self._sound(c.pattern)
        out = []
        for name in c.fields:
            grain, v, kind = self._place(name)
            check_id = f"{self.stem}.{name}.accepted_values"
            expected = f"IN {c.pattern}" if c.pattern is not None else f"IN {list(c.values)}"
            if v is None:
                out.append(self._missing(check_id, name, "accepted_values", expected, "HIGH"))
                continue
            text = as_text(v, kind)
            bad = v.isNotNull() & ~(full_match(text, c.pattern) if c.pattern is not None else text.isin(list(c.values)))
            out.append(self._counted(check_id, name, "accepted_values", expected, "HIGH", grain, bad, "all values valid", {"least": F.min(F.when(bad, text))}, lambda m: F.when(m("bad") == 0, F.lit("all values valid")).otherwise(F.concat(F.lit("unexpected: "), m("least")))))
        return out

    def _custom(self, c: Clause) -> list[Check]:
        rule, severity, base = c.rule, "CRITICAL" if c.breaking else "MEDIUM", f"{self.stem}.{c.name or 'custom'}"
        whole = {"count_gte": self._row_count, "sequence": self._sequence, "columns": self._columns, "additive": self._additive, "not_future": self._not_future, "edge_references": self._edges}.get(rule.kind)
        if whole:
            return whole(c, rule.args, base, severity)
        if rule.kind == "unknown":
            return [self._fixed(base, ",".join(c.fields) or "*", "custom", "PASS", "rule not automatically executable", c.rule_text, severity, f"UNSUPPORTED rule '{c.rule_text}': needs manual review.")]
        per_field = {"regex": self._regex, "value_bound": self._bound, "value_range": self._range, "len_bound": self._length, "statistical_bounds": self._statistical, "mean_range": self._mean}[rule.kind]
        out = []
        for name in c.fields:
            several = rule.kind not in ("value_range", "statistical_bounds") or len(c.fields) > 1
            check_id = f"{base}.{name}" if several else base
            grain, v, kind = self._place(name)
            if v is None:
                out.append(self._missing(check_id, name, "range" if rule.kind == "value_range" else "custom", c.rule_text, severity))
            else:
                out.append(per_field(c, rule.args, check_id, severity, name, grain, v, kind))
        return out

    def _regex(self, c, args, check_id, severity, name, grain, v, kind) -> Check:
        return self._counted(check_id, name, "custom", c.rule_text, severity, grain, v.isNotNull() & ~full_match(as_text(v, kind), self._sound(args[0])), "all match")

    def _bound(self, c, args, check_id, severity, name, grain, v, kind) -> Check:
        holds = F.coalesce(COMPARE[args[0]](number(v, kind), F.lit(float(args[1]))), F.lit(False))
        return self._counted(check_id, name, "custom", c.rule_text, severity, grain, v.isNotNull() & ~holds, f"all satisfy {c.rule_text}")

    def _range(self, c, args, check_id, severity, name, grain, v, kind) -> Check:
        low, high, x = float(args[0]), float(args[1]), number(v, kind)
        actual = lambda m: F.concat(F.lit("max="), _text(m("max")), F.lit(", mean="), _text(m("mean")))
        scale = F.lit(high <= 1)
        note = lambda m: F.when(m("bad") == 0, F.lit(f"'{name}' lies in [{low}, {high}].")).otherwise(
            F.concat(F.lit(f"'{name}' leaves [{low}, {high}]."), F.when(scale & (m("max") > 1), F.lit(" Looks like a 0-100 scale in place of 0.0-1.0.")).otherwise(F.lit("")))
        )
        return self._counted(check_id, name, "range", c.rule_text, severity, grain, (x < low) | (x > high), "", {"max": F.max(x), "mean": F.avg(x)}, lambda m: F.coalesce(actual(m), F.lit("no numeric values")), note)

    def _length(self, c, args, check_id, severity, name, grain, v, kind) -> Check:
        size = F.size(v) if isinstance(kind, (T.ArrayType, T.MapType)) else F.length(v) if isinstance(kind, T.StringType) else F.lit(0)
        return self._counted(check_id, name, "custom", c.rule_text, severity, grain, v.isNotNull() & ~COMPARE[args[0]](size, F.lit(int(args[1]))), f"all satisfy {c.rule_text}")

    def _statistical(self, c, args, check_id, severity, name, grain, v, kind) -> Check:
        x, p = number(v, kind), c.profile
        if "mean" not in p or "stddev" not in p:
            return self._fixed(check_id, name, "custom", "PASS", "no stored profile", c.rule_text, severity, f"'{name}' has no stored profile to compare with.")
        low, high = float(p["mean"]) - 3 * float(p["stddev"]), float(p["mean"]) + 3 * float(p["stddev"])
        actual = lambda m: F.coalesce(F.concat(F.lit("mean="), _text(m("mean")), F.lit(", stddev="), _text(F.coalesce(m("sd"), F.lit(0.0)))), F.lit("no numeric values"))
        return self._counted(check_id, name, "statistical", c.rule_text, severity, grain, (x < low) | (x > high), "", {"mean": F.avg(x), "sd": F.stddev_samp(x)}, actual)

    def _mean(self, c, args, check_id, severity, name, grain, v, kind) -> Check:
        low, high = float(args[0]), float(args[1])
        fails = lambda m: F.when(m("mean").between(low, high) | m("mean").isNull(), F.lit(0)).otherwise(m("n"))
        actual = lambda m: F.coalesce(F.concat(F.lit("mean="), _text(m("mean"))), F.lit("no numeric values"))
        return Check(check_id, name, "custom", c.rule_text, severity, grain, {"mean": F.avg(number(v, kind)), "n": F.count(number(v, kind))}, fails, actual)

    def _row_count(self, c, args, base, severity) -> list[Check]:
        least = int(args[0] or 1)
        fails = lambda m: F.when(m("n") >= least, F.lit(0)).otherwise(m("n"))
        status = lambda m: F.when(m("n") >= least, F.lit("PASS")).otherwise(F.lit("FAIL"))
        return [Check(base, "*", "custom", f"COUNT(*)>={least}", severity, ("rows",), {"n": F.count(F.lit(1))}, fails, lambda m: F.concat(F.lit("COUNT(*)="), m("n").cast("string")), status=status)]

    def _sequence(self, c, args, base, severity) -> list[Check]:
        seq, part = args[0] or "sequence_number", args[1] or "aggregate_id"
        if seq not in self.kinds or part not in self.kinds:
            return [self._missing(base, seq, "custom", c.rule_text, severity)]
        return [Check(base, seq, "custom", c.rule_text, severity, ("sequence", part, seq), {}, lambda m: m("bad"), lambda m: F.when(m("bad") == 0, F.lit("sequences 1..n without gaps")).otherwise(F.concat(m("bad").cast("string"), F.lit(" out of sequence"))))]

    def _columns(self, c, args, base, severity) -> list[Check]:
        a, op, b = args
        if a not in self.kinds or b not in self.kinds:
            return [self._missing(base, f"{a},{b}", "custom", c.rule_text, severity)]
        bad = ~comparison(column(a), column(b), self.kinds[a], self.kinds[b], COMPARE[op])
        return [self._counted(base, f"{a},{b}", "custom", c.rule_text, severity, ("rows",), bad, f"all satisfy {c.rule_text}")]

    def _additive(self, c, args, base, severity) -> list[Check]:
        if any(x not in self.kinds for x in args):
            return [self._missing(base, ",".join(args), "custom", c.rule_text, severity)]
        total, x, y = (number(column(n), self.kinds[n]) for n in args)
        return [self._counted(base, ",".join(args), "custom", c.rule_text, severity, ("rows",), F.abs(total - (x + y)) > 0.01, f"all satisfy {c.rule_text}")]

    def _not_future(self, c, args, base, severity) -> list[Check]:
        if args[0] not in self.kinds:
            return [self._missing(base, args[0], "custom", c.rule_text, severity)]
        return [self._counted(base, args[0], "custom", c.rule_text, severity, ("rows",), moment(column(args[0])) > self.as_of, "none in the future")]

    def _edges(self, c, args, base, severity) -> list[Check]:
        if "nodes" not in self.kinds or "edges" not in self.kinds:
            return [self._missing(base, "edges", "custom", c.rule_text, severity)]
        return [Check(base, "edges", "custom", c.rule_text, severity, ("edges",), {}, lambda m: m("bad"), lambda m: F.concat(m("bad").cast("string"), F.lit(" orphan edges")))]

    def _ai(self, c: Clause) -> list[Check]:
        base = f"{self.stem}.{c.name or 'ai_extension'}"
        for key, parent in (("required_output_keys", "outputs"), ("required_input_keys", "inputs")):
            if key in c.keys:
                return [self._required_keys(base, parent, list(c.keys[key]), parent == "inputs")]
        if c.name == "embedding_drift_detection":
            return [self._fixed(base, "*", "ai_extension", "WARN", "delegated to the embedding drift operator", "cosine distance <= threshold", "WARNING", "Compare centroids with pactum.operators.ai.embedding_drift.")]
        return [self._fixed(base, "*", "ai_extension", "PASS", "advisory", c.rule_text, "LOW", "Advisory clause; nothing was checked.")]

    def _required_keys(self, base: str, parent: str, keys: list[str], non_blank: bool) -> Check:
        """Per-key counts of rows whose struct, map or flattened columns lack a key."""
        kind = self.kinds.get(parent)

        def value(k: str) -> Column:
            if f"{parent}.{k}" in self.kinds:
                return column(f"{parent}.{k}").cast("string")
            if isinstance(kind, T.MapType):
                return F.try_element_at(column(parent), F.lit(k)).cast("string")
            if isinstance(kind, T.StringType):
                return F.get_json_object(column(parent), f"$.{k}")
            return column(k).cast("string") if k in self.kinds and parent == "inputs" else F.lit(None).cast("string")

        lacks = {k: (F.trim(F.coalesce(value(k), F.lit(""))) == "") if non_blank else value(k).isNull() for k in keys}
        bad = reduce(lambda a, b: a | b, lacks.values(), F.lit(False))
        counts = lambda m: F.concat_ws(", ", *[F.when(m(f"k{i}") > 0, F.concat(F.lit(f"{k}: "), m(f"k{i}").cast("string"))) for i, k in enumerate(keys)])
        return Check(base, parent, "ai_extension", f"keys {keys}", "WARNING", ("rows",), {"bad": _count(bad), **{f"k{i}": _count(x) for i, x in enumerate(lacks.values())}},
                     lambda m: m("bad"), lambda m: F.when(m("bad") == 0, F.lit("all keys present")).otherwise(F.concat(F.lit("missing "), counts(m))), failing=bad,
                     status=lambda m: F.when(m("bad") == 0, F.lit("PASS")).otherwise(F.lit("WARN")))

    def _soda(self, c: Clause) -> list[Check]:
        metric, name, op, bound = c.name, c.fields[0] if c.fields else "*", c.rule_text, c.profile["bound"]
        check_id = f"{self.stem}.{name}.{metric}" if c.fields else f"{self.stem}.{metric}"
        grain, v, kind = self._place(name)
        if metric != "row_count" and v is None:
            return [self._missing(check_id, name, "soda", c.profile["line"], "HIGH")]
        if metric == "duplicate_count":
            read, metrics, grain = (lambda m: m("dup")), {}, ("distinct", name)
        else:
            agg = {"row_count": lambda: F.count(F.lit(1)), "missing_count": lambda: _count(v.isNull()), "min": lambda: F.min(number(v, kind)), "max": lambda: F.max(number(v, kind)), "avg": lambda: F.avg(number(v, kind))}[metric]
            read, metrics = (lambda m: m("x")), {"x": agg()}
        holds = lambda m: F.coalesce(COMPARE[op](read(m).cast("double"), F.lit(bound)), F.lit(True))
        fails = lambda m: F.when(holds(m), F.lit(0)).otherwise(read(m).cast("long") if metric.endswith("_count") else F.lit(1))
        status = lambda m: F.when(holds(m), F.lit("PASS")).otherwise(F.lit("FAIL"))
        return [Check(check_id, name, "soda", c.profile["line"], "HIGH", grain, metrics, fails, lambda m: F.concat(F.lit(f"{metric}="), F.coalesce(_text(read(m)), F.lit("null"))), status=status)]


# --- execution plans ---


def _source(df: DataFrame, grain: tuple, kinds: dict, checks: list[Check]) -> DataFrame:
    """The one-row aggregate of a grain; metric columns are named m{check}_{metric}."""
    named = [c.alias(f"m{i}_{k}") for i, check in enumerate(checks) for k, c in check.metrics.items()]
    if grain[0] == "rows":
        return df.agg(F.count(F.lit(1)).alias("rows"), *named)
    if grain[0] == "items":
        items = df.select(F.explode(column(grain[1])).alias("item")).where("item is not null")
        return items.agg(F.count(F.lit(1)).alias("rows"), *named)
    if grain[0] == "distinct":
        # 128 bits of hash stand for a value, so long values are not shuffled
        counts = df.select(*value_hash(as_text(column(grain[1]), kinds[grain[1]]))).where("h1 is not null").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(*[x for i in range(len(checks)) for x in (
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"m{i}_dup"), F.count(F.lit(1)).alias(f"m{i}_kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias(f"m{i}_n"))])
    if grain[0] == "sequence":
        w = Window.partitionBy("p").orderBy("s")
        seq = df.select(column(grain[1]).alias("p"), F.coalesce(number(column(grain[2])), F.lit(0.0)).alias("s")).withColumn("r", F.row_number().over(w))
        return seq.agg(*[F.count_if(F.col("s") != F.col("r")).alias(f"m{i}_bad") for i in range(len(checks))])
    nodes = df.select(F.explode("nodes").alias("n"))
    keys = [k for k in ("node_id", "id") if k in nodes.schema["n"].dataType.names]
    ids = nodes.select(F.coalesce(*[F.col("n")[k].cast("string") for k in keys]).alias("id")).where("id is not null").distinct()
    edges = df.select(F.explode("edges").alias("e"))
    ends = [[k for k in pair if k in edges.schema["e"].dataType.names] for pair in (("source", "from"), ("target", "to"))]
    numbered = edges.select(*[F.coalesce(*[F.col("e")[k] for k in ks]).alias(a) for ks, a in zip(ends, ("a", "b"))])
    known = numbered.join(ids.select(F.col("id").alias("ia"), F.lit(1).alias("ka")), F.col("a") == F.col("ia"), "left").join(
        ids.select(F.col("id").alias("ib"), F.lit(1).alias("kb")), F.col("b") == F.col("ib"), "left"
    )
    return known.agg(*[F.count_if(F.col("ka").isNull() | F.col("kb").isNull()).alias(f"m{i}_bad") for i in range(len(checks))])


def _row(i: int, order: int, check: Check, empty: Column | None) -> Column:
    m = lambda k: F.col(f"m{i}_{k}")
    fails = check.fails(m).cast("long")
    status = check.status(m) if check.status else F.when(fails > 0, F.lit("FAIL")).otherwise(F.lit("PASS"))
    actual = check.actual(m)
    message = check.note(m) if check.note else F.when(status == "PASS", F.lit(f"'{check.column}' satisfies {check.expected}.")).otherwise(
        F.concat(F.lit(f"'{check.column}' violates {check.expected}: "), actual)
    )
    counts_rows = check.expected.startswith("COUNT(*)") or check.type in ("soda", "not_null", "unique")
    if empty is not None and not counts_rows:  # an empty dataset skips value rules
        skip = empty & (status != "ERROR")
        status, fails = F.when(skip, F.lit("PASS")).otherwise(status), F.when(skip, F.lit(0)).otherwise(fails)
        actual = F.when(skip, F.lit("skipped: no records")).otherwise(actual)
    values = [F.lit(check.check_id), F.lit(check.column), F.lit(check.type), status, actual, F.lit(check.expected), F.lit(check.severity), fails.cast("long"), F.array().cast("array<string>"), message]
    return F.struct(F.lit(order).alias("ordinal"), *[v.alias(f.name) for v, f in zip(values, RESULT_SCHEMA)])


def results(df: DataFrame, checks: list[Check]) -> DataFrame:
    """All check results, lazily: one aggregate per grain, in clause order by `ordinal`."""
    kinds = {f.name: f.dataType for f in df.schema}
    grains: dict[tuple, list[int]] = {}
    for i, c in enumerate(checks):
        grains.setdefault(c.grain, []).append(i)
    parts = []
    for grain, members in grains.items():
        own = [checks[i] for i in members]
        totals = _source(df, grain, kinds, own)
        empty = F.col("rows") == 0 if grain[0] in ("rows", "items") else None
        parts.append(totals.select(F.inline(F.array(*[_row(k, i, checks[i], empty) for k, i in enumerate(members)]))))
    if not parts:
        return df.sparkSession.createDataFrame([], "ordinal int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RESULT_SCHEMA))
    return reduce(DataFrame.unionByName, parts)
