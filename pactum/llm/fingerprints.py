"""Document fingerprints by threshold-scaled sketches (DataFrame functions only).

A sketch keeps every 64-bit hash of a five-word shingle whose unsigned value is
below 2^64 / scale.  The bound is the same for all documents, so sketches of
very unequal documents stay comparable: their kept hashes are the same fixed
fraction of their shingles, and |A n B| / |A| estimates containment.  A text with
no hash below the bound keeps its smallest one, so that no text with words has
an empty sketch.  Merging is the union, of which hashes above the bound go as
soon as one below it is there, so it is associative and idempotent.

The written form is the sorted hashes as 16 hex digits each, without
separators; `from_string` reads it back.

Defined results
---------------
* Null texts count as empty.  Texts of one to four words are one shingle.
* A text without words has the empty sketch; two empty sketches are alike (1.0),
  an empty and another one are not (0.0).
* Equal texts have equal fingerprints, as repeated rows do.
* `next_in_order` orders rows by descending id (nulls last), then by text hash;
  fully equal rows are interchangeable.  A table of one row follows itself.
* Extra columns of the input are not carried; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, shuffle_partitions, words_of

SHINGLE_WORDS, SCALE = 5, 8
NO_ID = -(1 << 63)


def shingle_hashes(text: Column, n_words: int = SHINGLE_WORDS) -> Column:
    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - n_words), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n_words)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(
            F.size(w) <= n_words, F.array(F.xxhash64(*[F.get(w, F.lit(k)) for k in range(n_words)]))
        ).otherwise(windows)

    return let(words_of(text), of)


def _threshold(hashes: Column, scale: int) -> Column:
    """The hashes below the bound, or else the smallest.  Adding -2^63 turns unsigned order into signed order."""
    order = lambda h: h.bitwiseXOR(F.lit(-(1 << 63)))
    bound = F.lit((1 << 64) // scale - (1 << 63))  # a row's hashes are unsigned 64-bit numbers held in longs
    smallest = lambda hs: order(F.array_min(F.transform(hs, order)))
    return let(
        F.filter(hashes, lambda h: order(h) < bound),
        lambda low: F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).otherwise(F.array(smallest(hashes))),
    )


def sketch(text: Column, n_words: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """The sketch of a text as a sorted array of longs."""
    return let(
        shingle_hashes(text, n_words),
        lambda hs: F.when(F.size(hs) == 0, hs).otherwise(_threshold(hs, scale)),
    )


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    return let(F.array_union(a, b), lambda u: F.when(F.size(u) == 0, u).otherwise(_threshold(u, scale)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of shingles in common (Jaccard), 0 to 1."""
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b)))
    )


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds, 0 to 1."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def to_string(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def from_string(written: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(written), F.lit(16))
    low = lambda i: F.conv(F.substr(written, i, F.lit(16)), 16, -10).cast("long")
    return F.when(F.length(written) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(at, low))


def _identity(id_col: str, text_col: str) -> list[Column]:
    """Two columns without nulls that name a document: `h` hashes the text and whether the id is null."""
    key = F.col(id_col).cast("long")
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), key.isNull())
    return [F.coalesce(key, F.lit(NO_ID)).alias("id"), hashed.alias("h")]


def next_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, need, next_id, next_h): each document's successor by descending id.

    `need` is half the text's code points; null ids come last, as the least number.  The narrow
    rows are range-partitioned in that order, whatever the ids' spacing, so a
    window holds one partition's share; a second window, over one row per
    partition, links each partition's last row to the next one's first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*_identity(id_col, text_col), F.floor(F.char_length(text) / 2).cast("int").alias("need"))
    rows = rows.groupBy("id", "h").agg(F.max("need").alias("need"))
    order = [F.col("id").desc(), F.col("h").asc()]
    # the range is sampled once; what is stored tells which partition a row went to
    rows = cut(rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).withColumn("block", F.spark_partition_id()))
    down = Window.partitionBy("block").orderBy(*order)
    this = F.struct("id", "h")
    inside = rows.withColumns({"next": F.lead(this).over(down), "place": F.row_number().over(down)})
    heads = rows.groupBy(F.col("block").alias("b")).agg(F.max(F.struct("id", (-F.col("h").cast("decimal(20,0)")).alias("o"), "h")).alias("head"))
    heads = heads.select("b", F.struct("head.id", "head.h").alias("head"))
    top = Window.partitionBy(F.lit(0)).orderBy("b")
    whole = top.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("b", F.coalesce(F.lead("head").over(top), F.first("head").over(whole)).alias("after"))  # one row a partition
    linked = inside.join(F.broadcast(after), F.col("block") == F.col("b")).withColumn("next", F.coalesce("next", "after"))
    return linked.select("id", "h", "need", F.col("next.id").alias("next_id"), F.col("next.h").alias("next_h"))


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                n_words: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """Per row: id, n_chars, text, edited (text), and the arrays sketch, edited_sketch, next_sketch.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document's text.  A text is sketched where
    it lies and shuffled once with its sketch, by document; both joins read that
    exchange, and only the needed beginnings and the sketch travel on from a
    document to the one before it.
    """
    links = next_in_order(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(*_identity(id_col, text_col), text.alias("text"), sketch(text, n_words, scale).alias("sketch"))
    texts = texts.repartition("id", "h")
    one = Window.partitionBy("id", "h").orderBy(F.lit(0))
    source = texts.withColumn("copy", F.row_number().over(one)).where("copy = 1")
    source = source.select(F.col("id").alias("from_id"), F.col("h").alias("from_h"), F.col("text").alias("from_text"), F.col("sketch").alias("next_sketch"))
    begun = links.join(source, (F.col("next_id") == F.col("from_id")) & (F.col("next_h") == F.col("from_h"))).select(
        F.col("id").alias("to_id"), F.col("h").alias("to_h"), F.substr("from_text", F.lit(1), F.col("need")).alias("begin"), "next_sketch"
    )
    joined = texts.join(begun, (F.col("id") == F.col("to_id")) & (F.col("h") == F.col("to_h")))
    n = F.char_length("text")
    edited = F.concat(F.substr("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), "begin")
    given = F.when((F.col("id") != NO_ID) | (F.col("h") != F.xxhash64("text", F.lit(True))), F.col("id"))
    out = joined.select(given.alias("id"), n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_sketch", "sketch")
    return out.withColumn("edited_sketch", sketch(F.col("edited"), n_words, scale))
