"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint of `8 * width * positions` bits is read as `positions` positional
values of `width` bytes.  If two fingerprints differ in at most d bits, at most
d positions differ, so at least m = positions - d positions agree: the
guaranteed count.  The index lists fingerprints under every choice of m
positions together with their values.  A pair that shares t positions meets in
C(t, m) lists, so the lists hold exactly the pairs whose tally reaches m;
posting lists of single bytes would hold 1/256 of all fingerprints each, and
tallying over them would be quadratic.  Inside a list the shared positional
bytes of each pair that is compared are tallied, pairs below the guaranteed
count are dropped, and the others are verified by bit count.

A list may hold a large group of near copies.  Its pairs are not emitted: a
breadth-first sweep in numpy emits a spanning forest of the list's links, which
has fewer edges than members and the same components.  A list above
`most_listed` members is not gathered at all; its members take another exact
way: each is put under all values within d/2 bits of it, and two values are
within d bits if and only if they share such a neighbour.

`keep_one` looks for a Jaccard similarity that parts more bits than any count of
shared bytes covers.  It lists wider fingerprints, of 192 positions of two bytes,
under single positions, and verifies what meets by bits and then by shingles.

Components come from alternating large-star and small-star rounds, each a
pre-aggregated minimum and a join, with the lineage cut every round.

Defined results
---------------
* Null texts count as empty; a text without words has fingerprint zero, which
  links like any other.
* Equal fingerprints are one node, so copies never multiply; repeated rows
  appear once per row, in their component.
* Null ids are linked but never name a component unless it has no other id.
* Columns other than id and text are not carried by `fingerprints`, so their
  names cannot clash; `keep_one` carries all; names that start with `__` are
  reserved, and refused.
* Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, cut, hot, join_split, map_arrow, refuse, shuffle_partitions

SEED, BITS, MOST_LISTED = 42, 64, 1 << 15
SHORT = 16  # members of lists all of whose pairs are compared at once
_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """The words (uint64) whose bits are set in over half the rows of `hashes` (rows, words)."""
    n, words = hashes.shape
    out = np.zeros(words, dtype=np.uint64)
    for bit in range(8):
        lanes = (hashes >> np.uint64(bit)) & _LANES
        # a byte lane holds sums of up to 255 rows
        counts = np.zeros((words, 8), dtype=np.int64)
        for at in range(0, n, 255):
            counts += lanes[at : at + 255].sum(axis=0, dtype=np.uint64).view(np.uint8).reshape(words, 8)
        over = (2 * counts > n).astype(np.uint8)
        out |= np.ascontiguousarray(over).view(np.uint64).reshape(words) << np.uint64(bit)
    return out


def shingle_hashes(text: str, n_words: int, seed: int = SEED) -> list[int]:
    """XXH64 of the space-joined shingles of a text lower-cased in A-Z, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return []
    joined, starts, at = b" ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    digest = xxhash.xxh64_intdigest
    if len(words) <= n_words:
        return [digest(joined, seed)]
    ends = [*(s - 1 for s in starts[n_words:]), len(joined)]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends)]


def simhash(text: str, n_words: int, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text."""
    hashes = shingle_hashes(text, n_words, seed)
    return int(majority_bits(np.array(hashes, dtype=np.uint64).reshape(-1, 1))[0]) if hashes else 0


def fingerprints(docs: DataFrame, n_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.array([simhash(t or "", n_words) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, fp long")


def tallies(prints: np.ndarray, own: np.ndarray, width: int = 1) -> np.ndarray:
    """For each of `prints` (rows, words) the number of positions, of `width` bytes, whose values `own` shares."""
    same = ((prints ^ own).view(np.uint8) == 0).reshape(len(prints), -1, width).all(axis=2)
    return same.sum(axis=1)


def sweep(ids: np.ndarray, prints: np.ndarray, distance: int, least_shared: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of the links among `prints` (rows, words): ids with the new ones each reaches.

    Pairs are tallied first: only those that share `least_shared` positional
    bytes, the number guaranteed within the distance, are verified by their bits.
    """
    while len(ids) > 1:
        frontier = [(ids[0], prints[0])]
        ids, prints = ids[1:], prints[1:]
        while frontier and len(ids):
            node, own = frontier.pop()
            near = tallies(prints, own) >= least_shared if least_shared else np.ones(len(ids), dtype=bool)
            near[near] = np.bitwise_count(prints[near] ^ own).sum(axis=1) <= distance
            if near.any():
                found = ids[near]
                yield int(node), found
                frontier.extend(zip(found, prints[near]))
                ids, prints = ids[~near], prints[~near]


def apart(prints: np.ndarray, distance: int) -> bool:
    """Whether no two of `prints` (rows, words) are within the distance."""
    bits = sum(np.bitwise_count(w[:, None] ^ w).astype(np.int16) for w in prints.T)
    return int((bits <= distance).sum()) == len(prints)


def short_links(keys: np.ndarray, ids: np.ndarray, prints: np.ndarray, short: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All links of the lists, sorted by key, whose rows are marked `short`: each row against the next, the next but one ..."""
    out = []
    for step in range(1, SHORT):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & short[step:])
        if not len(at):
            break
        near = at[np.bitwise_count(prints[at] ^ prints[at + step]).sum(axis=1) <= distance]
        near = near[ids[near] != ids[near + step]]
        if len(near):
            out.append((ids[near], ids[near + step]))
    return out


def _forest(distance: int, most_listed: int, overfull: str, least_shared: int = 0):
    """mapInArrow over (key, id, words of the print ...) sorted by key: the lists' links (u, v).

    The members of a list above `most_listed` are not held.  With overfull
    "report" they become (id, null), with "chain" each is linked to the list's
    first, whatever their prints (for links that are verified later).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, count, first = None, [], 0, 0  # the open list

        def closed() -> list:
            if not 1 < count <= most_listed:
                return []
            ids, at = np.unique(np.concatenate([h[0] for h in held]), return_index=True)
            prints = np.concatenate([h[1] for h in held])[at]
            if not least_shared and len(ids) <= 512 and apart(prints, distance):
                return []
            return [(np.full(len(v), u, dtype=np.int64), v) for u, v in sweep(ids, prints, distance, least_shared)]

        def passed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
            return (ids, None) if overfull == "report" else (np.full(len(ids), first, dtype=np.int64), ids)

        def table(found: list) -> pa.RecordBatch:
            u = pa.array(np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)]))
            v = [pa.nulls(len(f[0]), pa.int64()) if f[1] is None else pa.array(f[1]) for f in found]
            return pa.RecordBatch.from_arrays([u, pa.concat_arrays(v) if v else pa.array([], pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids, *words = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            prints = np.stack([w.view(np.uint64) for w in words], axis=1)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends, out = np.r_[starts[1:], len(keys)], []
            # lists of one member inside a batch have no links; the first and the last may go on
            several, inside = ends - starts > 1, (starts > 0) & (ends < len(keys))
            if not least_shared and most_listed >= SHORT:
                short = inside & (ends - starts <= SHORT)
                pairs = short_links(keys, np.arange(len(keys)), prints, np.repeat(short, ends - starts), distance)
                linked = np.concatenate([keys[at] for at, _ in pairs] or [keys[:0]])
                several &= ~short | np.isin(keys[starts], linked)  # a list with links yields a forest of them, not all
            for i in np.flatnonzero(several | ~inside):
                a, b = starts[i], ends[i]
                if key is None or keys[a] != key:
                    out += closed()
                    key, held, count, first = keys[a], [], 0, ids[a]
                count += b - a
                held.append((ids[a:b], prints[a:b]))
                if count > most_listed:
                    out += [passed(h[0]) for h in held]
                    held = []
            yield table(out)
        yield table(closed())

    return run


def choices(positions: int, width: int, shared: int) -> list[int]:
    """Masks over 64 bits: every choice of `shared` of the positions of `width` bytes."""
    one = (1 << 8 * width) - 1
    masks = [reduce(int.__or__, (one << 8 * width * p for p in chosen)) for chosen in combinations(range(positions), shared)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _linked(index: DataFrame, forest) -> DataFrame:
    listed = index.repartition(shuffle_partitions(index.sparkSession), "key").sortWithinPartitions("key")
    return cut(map_arrow(listed, forest, "u long, v long").distinct())


def thinned(pairs: DataFrame, most_held: int = 1 << 20) -> DataFrame:
    """Links (u, v) with the components of `pairs`: each task drops those whose ends its others join already.

    The square root of the tasks' count shares the work, so a group that many lists
    name has about that many links a member, however many lists there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            kept = np.zeros(batch.num_rows, dtype=bool)
            for i, (u, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                a, b = root(u), root(v)
                if a != b:
                    parent[a], kept[i] = b, True
            yield batch.filter(pa.array(kept))
            if len(parent) > most_held:
                parent.clear()

    groups = int(pairs.rdd.getNumPartitions() ** 0.5) or 1
    return map_arrow(pairs.coalesce(groups), run, "u long, v long")


def links(fps: DataFrame, distance: int = 4, most_listed: int = MOST_LISTED) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within `distance` bits among the distinct `fp`."""
    masks = F.array(*[F.lit(m).cast("long") for m in choices(8, 1, 8 - distance)])
    index = fps.select("fp", F.posexplode(masks).alias("i", "mask")).select(
        F.xxhash64("i", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", F.col("fp").alias("print")
    )
    found = _linked(index, _forest(distance, most_listed, "report", 8 - distance))
    out = found.where("v is not null")
    overfull = found.where("v is null").select(F.col("u").alias("fp"))
    if overfull.isEmpty():
        return out
    return out.unionByName(neighbour_links(overfull, distance))


def neighbour_links(fps: DataFrame, distance: int) -> DataFrame:
    """The same through shared neighbours within distance / 2 bits; a neighbour lists at most as many as it has itself."""
    if distance % 2:
        raise ValueError("an even distance is needed")
    masks = [0, *(sum(1 << b for b in bits) for k in range(1, distance // 2 + 1) for bits in combinations(range(BITS), k))]
    flips = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in masks])
    near = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    grouped = near.groupBy("point").agg(F.sort_array(F.collect_set("fp")).alias("g")).where(F.size("g") > 1)
    pairs = F.zip_with(F.slice("g", F.lit(1), F.size("g") - 1), F.slice("g", F.lit(2), F.size("g") - 1), lambda a, b: F.struct(a.alias("u"), b.alias("v")))
    return grouped.select(F.inline(pairs)).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of `pairs` (u, v): root is the smallest node reachable."""
    edges = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        # large star: every node hands its larger neighbours to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = join_split(both.where("v > u"), least, "u", *hot(least))
        large = cut(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: every node hands its smaller neighbours, and itself, to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = large.join(least.where("n > 1").drop("n"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(prints: DataFrame, distance: int = 4, most_listed: int = MOST_LISTED) -> DataFrame:
    """(id, fp, component_id) of every row of `prints` (id, fp): the smallest id reachable over links."""
    first = cut(prints.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("rows")))
    roots = components(links(first.select("fp"), distance, most_listed))
    rooted = cut(first.join(roots, first.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id", "rows"))
    least = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    named = join_split(rooted.select("root", "fp", "rows"), least, "root", *hot(least))
    named = cut(named.select("fp", "component_id", F.col("rows").alias("n")))
    return join_split(prints, named, "fp", *hot(named)).select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, n_words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return classes(cut(fingerprints(docs, n_words, id_col, text_col)), distance)


# --- near-duplicate texts: candidates of the byte-position index over wide fingerprints, verified by their shingles ---

POSITIONS, WIDTH = 192, 2  # texts at a similarity of 0.8 differ in 15 % of the bits: none of 192 shared has a probability of 4e-7
SKETCH, CHECKED_DISTANCE = 2, 41  # words beside the positions, and the bits of these 128 that candidates may differ in
BLOCK, BLOCK_BYTES, PIVOTS = 4096, 16 << 20, 16
_WORDS = POSITIONS * WIDTH // 8
_SALTS = np.random.default_rng(SEED).integers(0, 1 << 64, 2 * (_WORDS + SKETCH), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def wide_simhash(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint (words) of a set of shingles' hashes: `POSITIONS` values of `WIDTH` bytes, then the sketch.

    Each shingle votes twice a bit, by two hashes.  So votes are even, and sets of
    different parity, small ones above all, do not part where theirs are tied.
    """
    half = len(_SALTS) // 2
    if not len(shingles):
        return np.zeros(half, dtype=np.uint64)
    counts = np.zeros((8, half, 8), dtype=np.int64)
    # a byte lane holds sums of up to 255 rows
    for at in range(0, len(shingles), 127):
        votes = _mixed(shingles[at : at + 127, None] ^ _SALTS).reshape(-1, half)
        for bit in range(8):
            counts[bit] += ((votes >> np.uint64(bit)) & _LANES).sum(axis=0, dtype=np.uint64).view(np.uint8).reshape(half, 8)
    over = (counts > len(shingles)).astype(np.uint8)
    return np.bitwise_or.reduce([np.ascontiguousarray(x).view(np.uint64).reshape(half) << np.uint64(bit) for bit, x in enumerate(over)])


def wide_fingerprints(docs: DataFrame, n_words: int, text_id: str, text_col: str) -> DataFrame:
    """(tid, print) of every row: the wide fingerprint of its text's set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = (np.unique(np.array(shingle_hashes(t or "", n_words), dtype=np.uint64)) for t in part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([wide_simhash(x).tobytes() for x in sets], pa.binary())], ["tid", "print"])

    return map_arrow(docs.select(text_id, text_col), run, "tid long, print binary")


def positional_index(prints: DataFrame) -> DataFrame:
    """(key, tid, a, b): the index over `prints` (tid, print) lists each under every position with its value; a and b are its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.arange(POSITIONS, dtype=np.int64) << (8 * WIDTH)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint64).reshape(part.num_rows, -1)
                keys = first + np.ascontiguousarray(rows[:, :_WORDS]).view(np.uint16)
                columns = [part.column(0).to_numpy(), *rows[:, _WORDS:].view(np.int64).T]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(c, POSITIONS)) for c in columns)], ["key", "tid", "a", "b"])

    return map_arrow(prints.select("tid", "print"), run, "key long, tid long, a long, b long")


def _verify(n_words: int, similarity: float):
    """mapInArrow over (root, lo, hi, tid, text) sorted by the first three: verified links (u, v) of each block."""

    def block_links(tids: list[int], texts: list[str]):
        tids, at = np.unique(np.array(tids, dtype=np.int64), return_index=True)
        sets = [np.unique(np.array(shingle_hashes(texts[i], n_words), dtype=np.uint64)) for i in at]
        sizes = np.array([len(x) for x in sets])
        if len(sets) < 2:
            return
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        owner, bounds = np.repeat(np.arange(len(sets)), sizes), np.r_[0, np.cumsum(sizes)]
        rest = np.arange(len(sets))
        held = np.zeros(codes.max(initial=0) + 1, dtype=bool)
        while len(rest) > 1:
            frontier, rest = [rest[0]], rest[1:]
            while frontier and len(rest):
                node = frontier.pop()
                own = codes[bounds[node] : bounds[node + 1]]
                held[own] = True
                common = np.bincount(owner, held[codes], len(sets))[rest]
                held[own] = False
                union = sizes[rest] + sizes[node] - common
                near = common >= similarity * union  # two texts without words are alike
                if near.any():
                    yield tids[node], tids[rest[near]]
                    frontier.extend(rest[near])
                    rest = rest[~near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tids, texts = None, [], []

        def closed() -> pa.RecordBatch:
            found = list(block_links(tids, texts)) if len(tids) > 1 else []
            u = np.concatenate([np.full(len(v), u, dtype=np.int64) for u, v in found] or [np.zeros(0, np.int64)])
            v = np.concatenate([v for _, v in found] or [np.zeros(0, np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            for root, lo, hi, tid, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, lo, hi) != key:
                    yield closed()
                    key, tids, texts = (root, lo, hi), [], []
                tids.append(tid)
                texts.append(text)
        yield closed()

    return run


def _blocked(rows: DataFrame, n_words: int, similarity: float) -> DataFrame:
    """Verified links (u, v) inside each block of `rows` (root, lo, hi, node, t)."""
    by = ["root", "lo", "hi"]
    blocks = rows.select(*by, "node", "t").repartition(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    return cut(map_arrow(blocks, _verify(n_words, similarity), "u long, v long"))


def _pieces(n: str, of_bytes: str | None, block: int) -> Column:
    """Blocks for n texts: of about `block` texts, and of about BLOCK_BYTES bytes, each."""
    by_bytes = F.ceil(F.col(of_bytes) / BLOCK_BYTES) if of_bytes else F.lit(1).cast("long")
    return F.greatest(F.ceil(F.col(n) / block), by_bytes, F.lit(1).cast("long"))


def _numbers(k: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))


def _dealt(k: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(k))


def _with_texts(rows: DataFrame, texts: DataFrame, lo: str, hi: str) -> DataFrame:
    return rows.select("root", F.col(lo).alias("lo"), F.col(hi).alias("hi"), "node").join(texts, "node")


def verified_links(groups: DataFrame, texts: DataFrame, prints: DataFrame, n_words: int, similarity: float, block: int) -> DataFrame:
    """Links (u, v) with the components of all pairs at the similarity that share a list or a small candidate group.

    groups: (node, root, bytes) of candidate groups; texts: (node, t) of their
    members; prints: (tid, print), whose index has the candidate lists.  Groups of up to `block`
    texts are verified whole, in one task's memory.  A larger one is dealt into
    blocks, each verified whole together with the group's `PIVOTS` most central
    members, so every text travels once and families join through their middle.
    What is left are pairs that share a list and are not yet joined: of each list
    with several components the members outside its largest one are compared
    with all, in blocks again.
    """
    sizes = cut(groups.groupBy("root").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).withColumn("k", _pieces("n", "b", block)).drop("b"))
    members = cut(join_split(groups.select("node", "root"), sizes, "root", *hot(sizes)))
    big = members.where("k > 1")
    dealt = members.select("root", _dealt("k").alias("i"), "node")
    if big.isEmpty():
        return _blocked(_with_texts(dealt, texts, "i", "i"), n_words, similarity)
    listed = positional_index(prints.join(big.select(F.col("node").alias("tid")), "tid", "left_semi"))
    lists = cut(listed.select("key", F.col("tid").alias("node")))
    # the members whose lists are the longest are nearest to the middle of their group
    lengths = cut(lists.groupBy("key").agg(F.count("*").alias("n")))
    degrees = join_split(lists, lengths.withColumn("length", F.col("n")), "key", *hot(lengths)).groupBy("node").agg(F.sum("length").alias("degree"))
    first = Window.partitionBy("root").orderBy(F.desc("degree"), "node")
    pivots = big.join(degrees, "node").withColumn("place", F.row_number().over(first)).where(F.col("place") <= PIVOTS)
    dealt = dealt.unionByName(pivots.select("root", _numbers("k").alias("i"), "node"))
    links = _blocked(_with_texts(dealt, texts, "i", "i"), n_words, similarity)
    joined = components(links).withColumnsRenamed({"node": "of", "root": "found"})
    labels = big.join(joined, big.node == joined.of, "left").select("node", F.coalesce("found", "node").alias("label"))
    lists = cut(lists.join(labels, "node"))
    counts = lists.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    mixed = mixed.withColumn("rest", F.col("n") - F.col("top.c"))
    mixed = cut(mixed.select("key", "n", F.col("top.label").alias("main"), _pieces("n", None, block).alias("k"), _pieces("rest", None, block).alias("r")))
    if mixed.isEmpty():
        return links
    every = cut(join_split(lists, mixed, "key", *hot(mixed)))
    others = every.where("label <> main").select("key", _dealt("r").alias("lo"), _numbers("k").alias("hi"), "node")
    every = every.select("key", _numbers("r").alias("lo"), _dealt("k").alias("hi"), "node")
    rest = _with_texts(every.unionByName(others).withColumnRenamed("key", "root"), texts, "lo", "hi")
    return links.unionByName(_blocked(rest, n_words, similarity))


def keep_one(docs: DataFrame, n_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
             block: int = BLOCK, most_listed: int = MOST_LISTED) -> DataFrame:
    """The rows of `docs`, all columns, without near-duplicates: of each group the row with the smallest id stays.

    Texts link if their sets of `n_words`-word shingles (A-Z lower-cased) have a
    Jaccard similarity of at least `similarity`; groups are the components.
    Candidates come from the byte-position index over SimHash fingerprints of the
    shingles, 192 positions of two bytes: at a similarity of 0.8 or more at most
    15 % of the bits differ, which no count of shared positions follows from for
    certain, but one of 192 is shared but for a probability of 4e-7.  The lists so
    hold the pairs whose tally reaches one.  A listed pair is verified by the bits
    of a sketch of 128 beside the positions, of which at most 41 may differ (at
    0.8 more do with a probability of 4e-7).  These odds are for 0.8; a lower
    `similarity` needs more positions and a wider check.  Every link is verified
    exactly on the shingles; see `verified_links`.
    """
    refuse(docs, "__")
    fixed = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__tid": F.xxhash64(text), "__id": fixed})
    first = cut(keyed.groupBy("__tid").agg(F.min("__id").alias("first_id"), F.count("*").alias("rows"), F.max(F.octet_length(text)).cast("long").alias("bytes")))
    prints = cut(wide_fingerprints(keyed, n_words, "__tid", text_col).groupBy("tid").agg(F.min("print").alias("print")))
    index = positional_index(prints)
    candidates = components(thinned(_linked(index, _forest(CHECKED_DISTANCE, most_listed, "chain"))))
    groups = candidates.select("node", "root").unionByName(candidates.select(F.col("root").alias("node"), "root")).distinct()
    groups = cut(groups.join(first, groups.node == first["__tid"]).select("node", "root", "first_id", "bytes"))
    whole = keyed.select("__id", "__tid", text.alias("t")).join(groups.select("node", "first_id"), (F.col("__id") == F.col("first_id")) & (F.col("__tid") == F.col("node")))
    texts = cut(whole.select("node", "t"))
    verified = components(verified_links(groups, texts, prints, n_words, similarity, block))
    classed = first.join(verified, first["__tid"] == verified.node, "left").select("__tid", F.coalesce("root", "__tid").alias("class"), "first_id", "rows")
    kept = cut(classed.groupBy("class").agg(F.min(F.struct("first_id", "__tid")).alias("one"), F.max("rows").alias("rows")))
    stay = kept.select(F.col("one.first_id").alias("__id"), F.col("one.__tid").alias("__tid"))
    out = keyed.join(stay, ["__id", "__tid"], "left_semi").select(*keyed.columns)
    repeated = keyed.groupBy("__id", "__tid").count().where("count > 1")
    if not repeated.isEmpty():
        out = out.dropDuplicates(["__id", "__tid"])
    return out.drop("__tid", "__id")
