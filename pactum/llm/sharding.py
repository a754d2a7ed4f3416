"""Sharding by histogram sort: shards of near-equal bytes, in key order.

The key is 64 bits wide: its upper 40 bits hash the text, the lower 24 the id
and text, so equal texts are neighbours and yet divisible.  Rounds of exact
counts find the splitters: round one counts bytes and rows in 2^12 equal key
intervals; every later round cuts only the intervals in which a splitter is not
within tolerance yet, at most one per splitter, into 2^12 parts.  What reaches
the driver are the counts of these intervals: at most 2^12 * (1 + splitters *
later rounds), however many rows there are.  A row's shard is the number of
splitters at or below its key.

Rows are then exchanged once, into buckets: a bucket is a key prefix, so short
that a bucket of average size is `task_bytes`.  The prefixes that a hot text
makes heavier than that (and than a 2^14th of everything, so that at most 2^14
are broadcast) are cut by the next bits of the text's hash and the id's, as
fine again.  A row's rank is its place in its bucket plus the rows of all
buckets before; these are sums over a distributed table of buckets, which meets
the rows where the exchange put them.  Its slot is its rank in the shard.

Defined results
---------------
* Null and empty texts have size 1.  Null ids are keyed like any value.
* Fully equal rows share a key and cannot be divided; otherwise a group of equal
  texts is divided wherever a splitter needs it.
* Shards can be empty if there are fewer rows than shards; an empty table gives
  an empty result.
* All columns pass through, but a given size, shard or slot is replaced; names
  that start with `__` are reserved, and refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, refuse, shuffle_partitions

FAN_BITS, KEY_BITS, TEXT_BITS = 12, 64, 40
MOST_HEAVY = 1 << 14


@dataclass(frozen=True)
class Interval:
    """Keys whose first `bits` bits are `prefix`; bytes and rows in it."""

    bits: int
    prefix: int
    size: int
    rows: int

    @property
    def first(self) -> int:
        return self.prefix << (KEY_BITS - self.bits)


@dataclass(frozen=True)
class Splitter:
    """The first key (unsigned) of a shard, and the exact bytes and rows below it."""

    key: int
    size: int
    rows: int


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def sort_key(id_col: str, text_col: str) -> Column:
    fine = (1 << (KEY_BITS - TEXT_BITS)) - 1
    return F.xxhash64(text_col).bitwiseAND(F.lit(~fine)).bitwiseOR(F.xxhash64(id_col, text_col).bitwiseAND(F.lit(fine)))


def in_order(key: Column) -> Column:
    """A key whose signed order is the given key's unsigned order."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")


def _signed(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


def histogram_rounds(keyed: DataFrame, shards: int, tolerance: float) -> tuple[list[Splitter], list[int]]:
    """The `shards - 1` splitters, and the number of interval counts that each round gathered.  `keyed` has __key and __size."""
    count = lambda rows, bits: [
        Interval(bits, r.p % (1 << 64), r["size"], r.rows)
        for r in rows.groupBy(_prefix(F.col("__key"), bits).alias("p")).agg(F.sum("__size").alias("size"), F.count("*").alias("rows")).collect()
    ]
    done = sorted(count(keyed, FAN_BITS), key=lambda x: x.first)
    gathered, bits = [len(done)], FAN_BITS
    total = sum(x.size for x in done)
    targets, allowed = [total * k / shards for k in range(1, shards)], tolerance * total / shards
    while bits < KEY_BITS:
        open_, below = set(), 0
        for x in done:
            if x.bits == bits and x.rows > 1 and any(below + allowed < t < below + x.size - allowed for t in targets):
                open_.add(x.prefix)
            below += x.size
        if not open_:
            break
        inner = keyed.where(_prefix(F.col("__key"), bits).isin([_signed(p) for p in open_]))  # at most one a splitter
        parts = count(inner, min(KEY_BITS, bits + FAN_BITS))
        gathered.append(len(parts))
        done = sorted([x for x in done if not (x.bits == bits and x.prefix in open_)] + parts, key=lambda x: x.first)
        bits = min(KEY_BITS, bits + FAN_BITS)
    splitters, below, rows, at = [], 0, 0, 0
    for x in [*done, None]:
        # a splitter is the interval's start that is nearest to its target
        while at < len(targets) and (x is None or below + x.size / 2 >= targets[at]):
            splitters.append(Splitter(x.first if x else 1 << KEY_BITS, below, rows))
            at += 1
        if x:
            below, rows = below + x.size, rows + x.rows
    return splitters, gathered


def bucket_bits(total: int, goal: int) -> int:
    """Prefix bits that make an average bucket `goal` bytes."""
    return min(24, max(0, (max(total, 1) // max(goal, 1)).bit_length()))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
          tolerance: float = 0.001, task_bytes: int = 64 << 20) -> DataFrame:
    """All rows and columns of `docs` with size, shard and slot (gapless from 0 in each shard)."""
    refuse(docs, "__")
    spark = docs.sparkSession
    keyed = docs.withColumns({"__key": sort_key(id_col, text_col), "__size": size_of(F.col(text_col))})
    counted = cut(keyed.select("__key", "__size"))
    splitters, _ = histogram_rounds(counted, shards, tolerance)
    total = counted.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]
    goal = min(task_bytes, max(1, total // (2 * shuffle_partitions(spark))))
    bits = bucket_bits(total, goal)
    # a hot prefix is cut by as many bits of the id's hash again; at most MOST_HEAVY prefixes can be heavier than this
    prefixes = counted.groupBy(_prefix(F.col("__key"), bits).alias("__prefix")).agg(F.sum("__size").alias("size"))
    heavy = prefixes.where(F.col("size") > max(2 * goal, total // MOST_HEAVY)).select("__prefix")
    fine = F.shiftrightunsigned("__key", KEY_BITS - TEXT_BITS - bits) if bits < KEY_BITS - TEXT_BITS else F.col("__key")
    heavy = F.broadcast(cut(heavy.withColumn("__heavy", F.lit(True))))

    def placed(rows: DataFrame) -> DataFrame:
        with_prefix = rows.withColumn("__prefix", _prefix(F.col("__key"), bits)).join(heavy, "__prefix", "left")
        # both parts in key order: the prefix, and the longer one where it is cut
        return with_prefix.withColumn("__bucket", in_order(F.when(F.col("__heavy"), fine).otherwise(F.lit(0).cast("long")))).drop("__heavy")

    # rows before each bucket: sums over the buckets of a coarse prefix, and over the 2^12 coarse ones
    coarse = min(FAN_BITS, bits)
    sums = placed(counted).groupBy("__prefix", "__bucket").agg(F.count("*").alias("n"))
    sums = cut(sums.withColumn("c", F.shiftrightunsigned("__prefix", bits - coarse)))
    tops = sums.groupBy("c").agg(F.sum("n").alias("t"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("c", F.coalesce(F.sum("t").over(before(Window.partitionBy(F.lit(0)).orderBy("c"))), F.lit(0)).alias("above"))  # at most 2^12 rows
    inside = F.coalesce(F.sum("n").over(before(Window.partitionBy("c").orderBy("__prefix", "__bucket"))), F.lit(0))
    firsts = sums.withColumn("in", inside).join(F.broadcast(tops), "c").select("__prefix", "__bucket", (F.col("above") + F.col("in")).alias("__first"))

    in_bucket = Window.partitionBy("__prefix", "__bucket").orderBy("__order", id_col)
    ranked = placed(keyed).withColumn("__order", in_order(F.col("__key"))).withColumn("__place", F.row_number().over(in_bucket))
    ranked = ranked.join(firsts, ["__prefix", "__bucket"]).withColumn("__rank", F.col("__first") + F.col("__place") - 1)
    at_or_above = [F.col("__order") >= F.lit(_signed(s.key ^ (1 << 63))) if s.key < 1 << KEY_BITS else F.lit(False) for s in splitters]
    number = sum((a.cast("int") for a in at_or_above), F.lit(0))
    below = F.element_at(F.array(*[F.lit(n).cast("long") for n in (0, *(s.rows for s in splitters))]), number + 1)
    return ranked.withColumns({"size": F.col("__size"), "shard": number, "slot": F.col("__rank") - below}).select(
        *[c for c in docs.columns if c not in ("size", "shard", "slot")], "size", "shard", "slot"
    )
