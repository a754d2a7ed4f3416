"""Shared fixtures of the operators' tests: awkward documents, and readers."""

import pyarrow.parquet as pq

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

PROSE = "The quick brown fox jumps over the lazy dog near the quiet river bank. " * 3
AWKWARD = [
    None,
    "",
    " \t\r\n\n ",
    "one",
    "two words",
    "a b c a b c a b c",
    "Shared line of text here\nown line é number 1\nSHARED line of text here  \nshort",
    "\tshared LINE of text here\nother\nother\nother line that is long enough\n",
    "shared line of text here",
    "ÀÉ shared umlaut LINE ß\nàé shared umlaut line ß\nÀÉ SHARED UMLAUT line ß",
    PROSE,
    PROSE,
    PROSE + "And one more sentence follows.",
    "漢字 emoji 😀😀 zero​width space " * 30,
    " ".join(f"w{i % 37}" for i in range(3000)),
    "x" * 30_000,
    "word " * 5_000,
    "\n".join(f"line number {i} of a very long text" for i in range(2000)),
    "!!! ### $$$ %%% &&& *** <a> |b|",
    "Nul \x00 and \x1c separators \x85 here don't we'll\nit's  two   spaces",
]


def awkward(spark, extra=False):
    """The awkward texts, two repeated rows, a null id and null columns."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(AWKWARD)]
    rows += [rows[7], rows[7], (None, "shared line of text here", None, None, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "doc_id AS id", "1 AS key", "'x' AS line", "text AS h", "source AS words") if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def read(sf_dir, name):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()
