"""Column expressions: names, patterns, JSON, statistics and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Character patterns in order of precedence (fixed values); the first full match names a string.
CHAR_PATTERNS = [
    ("uuid-v4", r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    ("iso-8601-timestamp", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}.*"),
    ("sha1-hex", r"(?i)[0-9a-f]{40}"),
    ("sha256-hex", r"(?i)[0-9a-f]{64}"),
    ("semver-like", r"\d+\.\d+"),
    ("url", r"https?://\S+"),
    ("PascalCase", r"[A-Z][a-zA-Z0-9]+"),
    ("snake_case", r"[a-z][a-z0-9_]+"),
    ("numeric-string", r"\d+"),
    ("SCREAMING_SNAKE", r"[A-Z_]+"),
    ("path-like", r"[\w./-]+"),
]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col(quoted(name))


def full_match(value: Column, pattern: str) -> Column:
    """Whole-string match; a trailing line break is not overlooked as `$` would."""
    return value.rlike(r"\A(?:" + pattern + r")\z")


def char_pattern(value: Column) -> Column:
    out = F.lit("free-text")
    for name, pattern in reversed(CHAR_PATTERNS):
        out = F.when(full_match(value, pattern), name).otherwise(out)
    return out


def flatten_once(df: DataFrame) -> DataFrame:
    """Struct columns become `parent.child`, one level deep; arrays, maps and deeper structs stay."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.StructType):
            out += [column(f.name)[c.name].alias(f"{f.name}.{c.name}") for c in f.dataType]
        else:
            out.append(column(f.name))
    return df.select(*out)


def as_text(value: Column, kind: T.DataType) -> Column:
    """A value's text for distinctness and display; nested values as JSON."""
    nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
    return F.to_json(value) if nested else value.cast("string")


def value_hash(value: Column) -> list[Column]:
    """128 bits of hash as two columns, h1 and h2; both null for null."""
    return [F.when(value.isNotNull(), F.xxhash64(value)).alias("h1"), F.when(value.isNotNull(), F.xxhash64(F.lit(2), value)).alias("h2")]


TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def number(value: Column, kind: T.DataType | None = None) -> Column:
    """A double, null where the value is none; times and nested values are none."""
    nested = isinstance(kind, (*TEMPORAL, T.StructType, T.ArrayType, T.MapType, T.VariantType, T.BinaryType))
    return F.lit(None).cast("double") if nested else value.try_cast("double")


def moment(value: Column) -> Column:
    """A timestamp from a timestamp or ISO text, null where it is neither."""
    return F.try_to_timestamp(value.cast("string"))


def comparison(a: Column, b: Column, kind_a: T.DataType, kind_b: T.DataType, compare) -> Column:
    """Compares times as times and numbers as numbers; texts as times if both parse, else as numbers; null where neither fits."""
    if isinstance(kind_a, T.NumericType) and isinstance(kind_b, T.NumericType):
        return compare(a, b)
    if isinstance(kind_a, TEMPORAL) and type(kind_a) is type(kind_b):
        return compare(a, b)
    return F.coalesce(compare(moment(a), moment(b)), compare(number(a, kind_a), number(b, kind_b)))


COMPARE = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def slug(text: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def longest_common_substring(a: Column, b: Column) -> Column:
    """Length of the longest common substring, ignoring case, inside the JVM.

    Every start in `a` is extended while `b` still holds the piece; column names
    are short, so the cubic cost does not matter.
    """
    x, y = F.lower(a), F.lower(b)
    starts = F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)))
    longest = F.transform(
        starts,
        lambda i: F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.length(x) - i + 1, F.lit(1))),
            F.lit(0),
            lambda best, n: F.when((i + n - 1 <= F.length(x)) & F.contains(y, F.substr(x, i, n)), F.greatest(best, n)).otherwise(best),
        ),
    )
    return F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0)).otherwise(F.array_max(longest))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos, with 1e-9 added to the denominator."""
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)
