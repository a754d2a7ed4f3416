"""Line deduplication that returns keep bitmaps instead of text (DataFrame functions only).

Every line becomes a 128-bit hash of its key with its document and position.
Hashes are range-partitioned, and each partition is sorted by hash, document
and position, so a window streams every hash's occurrences in order and
compares each with the first.  Only the positions that go travel on, folded
into run-length-compressed bitmaps, one per document.

A hash that holds more than a quarter of a partition's fair share of all lines
would make one task long.  Such hashes number at most four times the
partitions, so their first documents are found by a pre-aggregated minimum and
broadcast (size proven by that bound); their lines are never shuffled.

Defined results
---------------
* A null or empty text is one empty line, which has no key and stays.
* A null id sorts after all others.
* Repeated rows of one id and text get the same bitmap; occurrences inside the
  smallest document all stay.
* Other columns pass through `apply_bitmaps` untouched, but a given kept_text,
  n_lines or n_dropped is replaced; `__`-prefixed names are reserved,
  and refused.
* Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, WS, cut, lower_ascii, refuse, shuffle_partitions

LEAST_BUCKETS = 1 << 16


def line_key(line: Column) -> Column:
    """A line's key: white space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(WS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    lines = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(text_col).alias("version"),
        F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"),
    ).select("doc", "version", "pos", line_key(F.col("line")).alias("key"))
    return lines.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"), "doc", "version", "pos"
    )


def bucket_count(parts: int) -> int:
    """Buckets of hashes (a power of two): so many that an average one is far below a partition's share of lines."""
    return max(LEAST_BUCKETS, 1 << (64 * parts).bit_length())


def _firsts_of_hot(lines: DataFrame, most: int) -> DataFrame | None:
    """First documents of the hashes with more than `most` lines; at most lines / most rows."""
    spark = lines.sparkSession
    bucket = F.col("k1").bitwiseAND(F.lit(bucket_count(shuffle_partitions(spark)) - 1))
    full = cut(lines.groupBy(bucket.alias("b")).count().where(F.col("count") > most).select("b"))  # at most lines / most rows
    if full.isEmpty():
        return None
    return (
        lines.join(F.broadcast(full), bucket == F.col("b"), "left_semi")
        .groupBy("k1", "k2")
        .agg(F.min("doc").alias("first_doc"), F.count("*").alias("n"))
        .where(F.col("n") > most)
        .drop("n")
    )


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, least_hot: int = 2048
) -> DataFrame:
    """One row (doc, version, drop_runs) per document that loses lines.

    `drop_runs` is the run-length form of the keep bitmap: sorted
    (start, length) runs of cleared bits; all other bits are set.  `version` is
    the hash of the text, which tells rows apart that share an id.
    """
    lines = cut(hashed_lines(docs, id_col, text_col, min_chars))
    parts = shuffle_partitions(docs.sparkSession)
    hot = _firsts_of_hot(lines, max(least_hot, lines.count() // (4 * parts)))
    cold = lines if hot is None else lines.join(F.broadcast(hot), ["k1", "k2"], "left_anti")
    in_order = Window.partitionBy("k1", "k2").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = (
        cold.repartitionByRange(parts, "k1")
        .withColumn("first_doc", F.first("doc").over(in_order))
        .where(F.col("doc") > F.col("first_doc"))
        .select("doc", "version", "pos")
    )
    if hot is not None:
        repeated = lines.join(F.broadcast(hot), ["k1", "k2"]).where(F.col("doc") > F.col("first_doc"))
        later = later.unionByName(repeated.select("doc", "version", "pos"))
    # a document's own lines bound the collected set
    dropped = later.groupBy("doc", "version").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    starts = F.filter("p", lambda x, i: (i == 0) | (F.get(F.col("p"), i - 1) != x - 1))
    ends = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get(F.col("p"), i + 1) != x + 1))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))
    return dropped.select("doc", "version", runs.alias("drop_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`, with kept_text, n_lines and n_dropped."""
    refuse(docs, "__")
    marked = docs.withColumns(
        {"__doc": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), "__version": F.xxhash64(text_col)}
    )
    maps = bitmaps.select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("drop_runs").alias("__runs"))
    gone = F.flatten(F.transform("__runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    kept = F.when(F.col("__runs").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone), lambda p: F.get(F.col("__lines"), p)
            ),
            "\n",
        )
    )
    n_dropped = F.coalesce(F.aggregate("__runs", F.lit(0).cast("long"), lambda a, r: a + r["length"]), F.lit(0).cast("long"))
    return (
        marked.join(maps, ["__doc", "__version"], "left")
        .withColumn("__lines", lines_of(F.col(text_col)))
        .withColumns({"kept_text": kept, "n_lines": F.size("__lines").cast("long"), "n_dropped": n_dropped})
        .drop("__doc", "__version", "__runs", "__lines")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """`apply_bitmaps` of `keep_bitmaps`: every row of `docs`, with its lines deduplicated."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)
