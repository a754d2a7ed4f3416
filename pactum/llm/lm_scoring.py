"""Document scores by masked pseudo-likelihood.

A window network predicts every token from the two tokens on either side, and a
memory of the corpus refines it; the sum of log P(token | both sides) scores a
document.

* The network.  The `classes * members` most frequent words of all documents
  have an embedding each, all other words share `SLOTS` embeddings by hash.  The
  embeddings of the window's words, each through its position's matrix, are
  summed through tanh.  From there a softmax over classes, and one over the
  class's words, give the word; classes are runs of equally frequent words.  All
  other words are one class more, in which a word is spelled by character
  frequencies, counted over all documents.  It is trained in numpy.
* The memory.  Every context, the word on the left with the word on the right,
  has a cell (a caller of `score` may ask for a fraction of them).  A cell counts
  the words that occur in it in all documents, so the memory grows with the
  corpus and stays distributed.  A token is predicted without itself: with n - 1
  other occurrences of its word among N - 1 in its cell,

      P = SHARE * (n - 1) / (N - 1) + (1 - SHARE) * P(network),

  and P(network) alone where there is no cell or N is 1.  Tokens travel once, to
  the bucket of their cell, packed; nothing of them is stored.

Training is data-parallel: in each round every task starts from the shared
parameters, makes one pass over every token of its own documents, and returns
its parameters and the number of predictions they saw.  Averages are formed in
two steps, so the driver receives a square root of the tasks' count.

Defined results
---------------
* Null, empty and blank texts have no tokens and a log-likelihood of 0.
* Texts of any length are scored whole; contexts are padded at both ends and
  never reach into another document.
* The network is an average over the input's partitions, trained in their rows'
  order, so scores depend (slightly) on how the input is split; for one split
  they are the same in every run.
* Repeated rows are scored, and counted, one by one; null ids stay null.
* Other columns are not carried, so their names cannot clash; an empty table
  gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_bound, map_arrow, shuffle_partitions
from .quality_rules import bin_of

CLASSES, MEMBERS, SLOTS, HIDDEN, ROUNDS = 32, 64, 1024, 12, 1
OFFSETS = (-2, -1, 1, 2)
REACH = 2
CELLS, SHARE = 1, 0.5
FREQUENT = 32  # words at most whose common cells are counted beforehand
LEAST_BUCKETS, BUCKET_TOKENS = 1 << 11, 1 << 20
MOST_CHARS = 500


@dataclass
class Vocabulary:
    """The listed words with their counts, most frequent first, and log probabilities of characters ("" ends a word)."""

    words: list[tuple[str, int]] = field(default_factory=list)
    others: int = 0  # occurrences of all other words
    chars: dict[str, float] = field(default_factory=dict)
    other_char: float = -10.0

    @property
    def total(self) -> int:
        return self.others + sum(n for _, n in self.words)

    def buckets(self) -> int:
        """A power of two: buckets of the memory that hold about `BUCKET_TOKENS` tokens, or fewer, each."""
        return max(LEAST_BUCKETS, 1 << (self.total // BUCKET_TOKENS).bit_length())

    def lookup(self, spell: bool = True) -> "Lookup":
        return Lookup(self, spell)


class Lookup(dict):
    """A vocabulary in use: numbers words as it meets them, and keeps per number the word's rank, hash and (if asked to
    spell) log P of its spelling.

    A listed word's rank is its place; any other word's is `listed` plus its slot.
    """

    MOST_WORDS = 1 << 18

    def __init__(self, vocabulary: Vocabulary, spell: bool = True):
        super().__init__()
        self.vocabulary, self.spell, self.listed = vocabulary, spell, len(vocabulary.words)
        self._start()

    def _start(self) -> None:
        self.clear()
        self.update({word: i for i, (word, _) in enumerate(self.vocabulary.words)})
        hashes = [xxhash.xxh64_intdigest(word.encode()) for word, _ in self.vocabulary.words]
        self.rank, self.spelt, self.hash = np.arange(self.listed, dtype=np.int32), np.zeros(self.listed), np.array(hashes, dtype=np.uint64)

    def _meet(self, words: list[str]) -> None:
        """Numbers new words; the arrays grow by doubling."""
        held, end = len(self), len(self) + len(words)
        self.update(zip(words, range(held, end)))
        if end > len(self.rank):
            more = end + len(self.rank)
            self.rank, self.spelt, self.hash = (np.concatenate([x, np.zeros(more, dtype=x.dtype)]) for x in (self.rank, self.spelt, self.hash))
        hashes = np.array([xxhash.xxh64_intdigest(word.encode()) for word in words], dtype=np.uint64)
        self.hash[held:end], self.rank[held:end] = hashes, self.listed + (hashes % np.uint64(SLOTS)).astype(np.int32)
        if self.spell:
            log_p, other = self.vocabulary.chars.get, self.vocabulary.other_char
            self.spelt[held:end] = [sum([log_p(c, other) for c in word]) + log_p("", other) for word in words]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words per text, the words' numbers); numbers hold until the next batch."""
        if len(self) > self.MOST_WORDS + self.listed:
            self._start()
        sizes, places, distinct = split_words(texts)
        numbers = np.fromiter(map(self.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(numbers < 0)
        numbers[new] = np.arange(len(self), len(self) + len(new))
        self._meet(distinct[new].tolist())
        return sizes, numbers[places]


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, each word's place among the distinct ones, the distinct ones) of lower-cased texts split at white space.

    Words become Python strings once a batch, not once an occurrence.
    """
    split = pc.utf8_split_whitespace(pa.array([t.lower().strip() or None for t in texts], pa.large_string()))
    words = split.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_numpy(zero_copy_only=False)


def count_words(docs: DataFrame, text_col: str, most_held: int = 1 << 18) -> DataFrame:
    """(word, n) over all documents; tasks count first, holding few more than `most_held` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        table = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for _, texts in _chunks(batches, 0):
            _, places, distinct = split_words(texts)
            for word, n in zip(distinct, np.bincount(places, minlength=len(distinct)).tolist()):
                seen[word] = seen.get(word, 0) + n
            if len(seen) > most_held:
                yield table()
                seen.clear()
        yield table()

    return map_arrow(docs.select(text_col), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text_col: str = "text", most_words: int = CLASSES * MEMBERS) -> Vocabulary:
    """Counts every word of every document; only bounded tables reach the driver."""
    counts = cut(count_words(docs, text_col))
    # the counts of counts, in some hundred bins, tell which words can be among the listed ones
    least, seen = 1, 0
    for r in sorted(counts.groupBy(bin_of(F.col("n")).alias("b")).count().collect(), key=lambda r: -r.b):
        seen += r["count"]
        if seen >= most_words:
            least = max(least, r.b)
            break
    listed = [(r.word, r.n) for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most_words).collect()]
    total = counts.agg(F.sum("n")).first()[0] or 0
    # characters of all words, by their number of occurrences
    chars = counts.select(F.explode(F.split("word", "")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    found = {r.c: r.n for r in chars.orderBy(F.desc("n"), "c").limit(MOST_CHARS).collect() if r.c}
    found[""] = total or 1
    every = sum(found.values()) + len(found) + 1
    return Vocabulary(listed, total - sum(n for _, n in listed), {c: float(np.log((n + 1) / every)) for c, n in found.items()}, float(np.log(1 / every)))


def log_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of each column's softmax at one place; `x` is used up."""
    x -= x.max(axis=0)
    own = x[at, np.arange(x.shape[1])]
    return own - np.log(np.exp(x, out=x).sum(axis=0, dtype=np.float64))


def softmax(x: np.ndarray) -> np.ndarray:
    """Of each column, in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


class Network:
    """Embeddings (listed words, slots, padding); a matrix per position; hidden bias; outputs over classes and over each class's words."""

    def __init__(self, words: Vocabulary, classes: int = CLASSES, members: int = MEMBERS, hidden: int = HIDDEN, seed: int = 0):
        self.listed, self.classes, self.members, self.hidden = len(words.words), classes, members, hidden
        self.pad = self.listed + SLOTS
        self.shapes = [(self.pad + 1, hidden), (len(OFFSETS), hidden, hidden), (hidden,), (hidden, classes + 1), (classes + 1,), (classes, hidden, members), (classes, members)]
        rng = np.random.default_rng(seed)
        scales = [0.3, 0.5, 0.0, 0.1, 0.0, 0.1, 0.0]
        self.load(np.concatenate([(rng.standard_normal(s) * k).ravel() for s, k in zip(self.shapes, scales)]))
        # the biases start at the words' shares
        mass = np.full((classes, members), 1e-9)
        mass.ravel()[: self.listed] = [n for _, n in words.words]
        by_class = np.append(mass.sum(axis=1), max(words.others, 1e-9))
        self.parts[4][:] = np.log(by_class / by_class.sum() + 1e-9)
        self.parts[6][:] = np.log(mass / mass.sum(axis=1, keepdims=True) + 1e-9)

    def load(self, flat: np.ndarray) -> "Network":
        self.flat = np.array(flat, dtype=np.float32)
        at, self.parts = 0, []
        for s in self.shapes:
            n = int(np.prod(s))
            self.parts.append(self.flat[at : at + n].reshape(s))
            at += n
        return self

    def copy(self) -> "Network":
        other = object.__new__(Network)
        other.__dict__.update(self.__dict__)
        return other.load(self.flat)

    def targets(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A rank's class and its place in the class; the last class holds the words that are not listed."""
        return np.where(rank < self.listed, rank // self.members, self.classes), rank % self.members

    def hidden_values(self, context: np.ndarray) -> np.ndarray:
        """Per prediction the hidden layer, and a one that takes the outputs' biases."""
        table, matrices, bias = self.parts[:3]
        through = np.matmul(table, matrices)
        out = np.ones((len(context), self.hidden + 1), dtype=np.float32)
        np.tanh(sum(through[k].take(context[:, k], axis=0) for k in range(len(OFFSETS))) + bias, out=out[:, :-1])
        return out

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights with their biases: of the classes, and of each class's words."""
        *_, u1, c1, u2, c2 = self.parts
        return np.vstack([u1, c1]), np.concatenate([u2, c2[:, None]], axis=1)

    def by_class(self, h: np.ndarray, kind: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """Predictions of listed words sorted by class: their places, hidden layers, a column of logits each, and each class's run.

        Softmaxes run down columns, so that all columns share one vector operation.
        """
        order = np.argsort(kind.astype(np.int16), kind="stable")
        ends = np.searchsorted(kind[order], np.arange(self.classes + 1))
        order = order[: ends[-1]]
        own, logits = h[order], np.empty((self.members, len(order)), dtype=np.float32)
        runs = [(c, slice(ends[c], ends[c + 1])) for c in np.flatnonzero(np.diff(ends))]
        for c, run in runs:
            np.matmul(weights[c].T, own[run].T, out=logits[:, run])
        return order, own, logits, runs

    def log_p(self, context: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """log P(word | context); of words that are not listed without their spelling."""
        first, second = self.outputs()
        h, (kind, place) = self.hidden_values(context), self.targets(rank)
        out = log_at(first.T @ h.T, kind)
        order, _, logits, _ = self.by_class(h, kind, second)
        out[order] += log_at(logits, place[order])
        return out

    def gradient(self, context: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of the mean log-loss of these predictions."""
        table, matrices = self.parts[:2]
        first, second = self.outputs()
        h, (kind, place) = self.hidden_values(context), self.targets(rank)
        n = len(rank)
        d1 = softmax(first.T @ h.T)
        d1[kind, np.arange(n)] -= 1
        dh = d1.T @ first[:-1].T
        order, own, d2, runs = self.by_class(h, kind, second)
        softmax(d2)[place[order], np.arange(len(order))] -= 1
        dsecond, back = np.zeros_like(second), np.empty((len(order), self.hidden), dtype=np.float32)
        for c, run in runs:
            dsecond[c] = own[run].T @ d2[:, run].T
            np.matmul(d2[:, run].T, second[c, :-1].T, out=back[run])
        dh[order] += back
        dz = dh * (1 - h[:, :-1] ** 2)
        # sums of dz per position and word
        columns = dz.T.astype(np.float64, order="C")
        sums = np.array([[np.bincount(at, x, len(table)) for x in columns] for at in context.T.astype(np.int64, order="C")], dtype=np.float32).transpose(0, 2, 1)
        dt = np.matmul(sums, matrices.transpose(0, 2, 1)).sum(axis=0)
        dfirst = h.T @ d1.T
        parts = (dt, table.T @ sums, dz.sum(axis=0), dfirst[:-1], dfirst[-1], dsecond[:, :-1], dsecond[:, -1])
        return np.concatenate([x.ravel() for x in parts]) / np.float32(n)

    def step(self, context: np.ndarray, rank: np.ndarray, rate: float, squares: np.ndarray) -> None:
        """One Adagrad step."""
        g = self.gradient(context, rank)
        squares += g * g
        self.flat -= rate * g / (np.sqrt(squares) + 1e-6)


def padded(sizes: np.ndarray, values: np.ndarray, pad) -> tuple[np.ndarray, np.ndarray]:
    """The texts' values in one line, kept apart by padding, and the places of the tokens in it."""
    at = np.arange(len(values)) + REACH * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    line = np.full(len(values) + REACH * (len(sizes) + 1), pad, dtype=values.dtype)
    line[at] = values
    return line, at


def contexts(sizes: np.ndarray, ranks: np.ndarray, pad: int) -> np.ndarray:
    line, at = padded(sizes, ranks, pad)
    return np.stack([line[at + o] for o in OFFSETS], axis=1)


def _chunks(batches: Iterator[pa.RecordBatch], column: int, most_rows: int = 2048, most_bytes: int = 1 << 21):
    """Runs of rows with their texts: of at most `most_bytes` of text, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, side="right"))
            stop = max(at + 1, min(at + most_rows, fits))
            part, at = batch.slice(at, stop - at), stop
            yield part, [t or "" for t in part.column(column).to_pylist()]


def train(docs: DataFrame, words: Vocabulary, text_col: str = "text", rounds: int = ROUNDS, classes: int = CLASSES, members: int = MEMBERS,
          hidden: int = HIDDEN, rate: float = 0.05, batch: int = 4096) -> Network:
    """Every token of every document is a target in each round; `words` holds at most classes * members words.

    The network's `common` holds the documents' common cells, counted on the way.
    """
    net, common = Network(words, classes, members, hidden), no_common_cells(words, docs.sparkSession)
    schema = "n long, flat binary, counts binary"
    row = lambda n, flat, counts: pa.RecordBatch.from_arrays([pa.array([n]), pa.array([flat.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["n", "flat", "counts"])

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, flat, counts = 0, None, common.counts.copy()
        for b in batches:
            for n, data, counted in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(data, dtype=np.float32).astype(np.float64) * n
                total, flat = total + n, x if flat is None else flat + x
                counts += np.frombuffer(counted, dtype=np.int64)
        if total:
            yield row(total, (flat / total).astype(np.float32), counts)

    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, look = net.copy(), words.lookup(spell=False)
        cells, places = CommonCells(common.words, np.zeros_like(common.counts)), common.by_rank(words)
        squares, seen, held, waiting = np.full_like(own.flat, 1e-6), 0, [], 0

        def learn() -> int:
            context, rank = (np.concatenate(x) for x in zip(*held))
            for a in range(0, len(rank), batch):
                own.step(context[a : a + batch], rank[a : a + batch], rate, squares)
            return len(rank)

        for _, texts in _chunks(batches, 0):
            sizes, numbers = look.batch(texts)
            ranks = look.rank[numbers]
            cells.add(sizes, places[np.minimum(ranks, look.listed)])
            held.append((contexts(sizes, ranks, own.pad), ranks))
            waiting += len(ranks)
            if waiting >= batch:
                seen, held, waiting = seen + learn(), [], 0
        if waiting:
            seen += learn()
        if seen:
            yield row(seen, own.flat, cells.counts)

    for _ in range(rounds):
        results = cut(map_arrow(docs.select(text_col), one_pass, schema))
        groups = max(1, round(results.rdd.getNumPartitions() ** 0.5))
        rows = map_arrow(results.coalesce(groups), averaged, schema).collect()
        net.common = CommonCells(common.words, sum((np.frombuffer(r.counts, dtype=np.int64) for r in rows), np.zeros_like(common.counts)))
        if not rows:
            return net
        total = sum(r.n for r in rows)
        net.load(sum(np.frombuffer(r.flat, dtype=np.float32).astype(np.float64) * (r.n / total) for r in rows))
    return net


def cell_keys(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash of each token's neighbours."""
    line, at = padded(sizes, hashes, np.uint64(0))
    return cell_key(line[at - 1], line[at + 1])


def cell_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The keys of given pairs of neighbours' hashes."""
    x = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x7F4A7C15))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class CommonCells:
    """Exact counts over all documents of the cells between the most frequent words and the ends of a text.

    `of` counts the tokens of each cell (left, right), `n` those of its frequent
    words (left, word, right); place 0 is the end of a text.  No other cell, and no
    other word of these cells, has more tokens than the words that are left out.
    """

    words: list[str]
    counts: np.ndarray

    @property
    def side(self) -> int:
        return len(self.words) + 1

    @property
    def of(self) -> np.ndarray:
        return self.counts[self.side**3 :]

    @property
    def n(self) -> np.ndarray:
        return self.counts[: self.side**3]

    def add(self, sizes: np.ndarray, places: np.ndarray) -> None:
        """Counts tokens by their words' places, -1 for the words that are left out."""
        line, at = padded(sizes, places, 0)
        left, word, right = line[at - 1], line[at], line[at + 1]
        cell = np.flatnonzero((left >= 0) & (right >= 0))
        left, word, right = left[cell], word[cell], right[cell]
        known = word > 0
        self.n[:] += np.bincount(((left * self.side + word) * self.side + right)[known], minlength=len(self.n))
        self.of[:] += np.bincount(left * self.side + right, minlength=len(self.of))

    def places(self) -> dict[str, int]:
        return {word: i + 1 for i, word in enumerate(self.words)}

    def by_rank(self, words: Vocabulary) -> np.ndarray:
        """The places of the listed words and, last, of all others."""
        return np.array([self.places().get(word, -1) for word, _ in words.words] + [-1], dtype=np.int64)


def no_common_cells(words: Vocabulary, spark) -> CommonCells:
    """Of the words so frequent that a cell between them might not fit one task; nothing is counted yet."""
    bound = max(1 << 14, hot_bound(words.total, spark))
    frequent = [word for word, n in words.words[:FREQUENT] if n > bound]
    return CommonCells(frequent, np.zeros((len(frequent) + 1) ** 3 + (len(frequent) + 1) ** 2, dtype=np.int64))


def common_cells(docs: DataFrame, words: Vocabulary, text_col: str = "text") -> CommonCells:
    """Counts them; a task returns one table of at most (FREQUENT + 1) ** 3 numbers, and they are added up in two steps."""
    common = no_common_cells(words, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, places = CommonCells(common.words, common.counts.copy()), common.places()
        for _, texts in _chunks(batches, 0):
            sizes, at, distinct = split_words(texts)
            own.add(sizes, np.fromiter(map(places.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))[at])
        yield pa.RecordBatch.from_arrays([pa.array([own.counts.tobytes()], pa.binary())], ["counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = common.counts.copy()
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.frombuffer(data, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    results = cut(map_arrow(docs.select(text_col), run, "counts binary"))
    groups = int(results.rdd.getNumPartitions() ** 0.5) or 1
    rows = map_arrow(results.coalesce(groups), summed, "counts binary").collect()
    return CommonCells(common.words, sum((np.frombuffer(r.counts, dtype=np.int64) for r in rows), common.counts))


def gains(n: np.ndarray, of: np.ndarray, logs: np.ndarray, share: float) -> np.ndarray:
    """What the memory adds to the tokens' log P; `of` is above 1."""
    with np.errstate(divide="ignore"):  # the log of 0 is right where n is 1
        return np.logaddexp(np.log(share * (n - 1) / (of - 1)) - logs, np.log(1 - share))


#: A token in a bucket, by bytes: its cell there, its word's hash, its log P, its row in the chunk.
_PLANES = ((np.uint64, 5), (np.uint32, 4), (np.uint32, 3), (np.uint16, 2))
_BYTES, _KEY_BITS = sum(k for _, k in _PLANES), 40


def packed(cells: np.ndarray, hashes: np.ndarray, logs: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Tokens as planes of bytes (bytes, tokens); a log P keeps 16 bits of its fraction."""
    short = (logs.astype(np.float32).view(np.uint32) + np.uint32(0x80)) >> np.uint32(8)
    planes, at = np.empty((_BYTES, len(cells)), dtype=np.uint8), 0
    for x, (kind, k) in zip((cells, hashes, short, rows), _PLANES):
        planes[at : at + k] = np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(len(cells), np.dtype(kind).itemsize).T[:k]
        at += k
    return planes


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(cells, hashes, logs, rows) of the tokens of some blobs."""
    planes = np.concatenate([np.frombuffer(b, dtype=np.uint8).reshape(_BYTES, -1) for b in blobs], axis=1)
    out, at = [], 0
    for kind, k in _PLANES:
        wide = np.zeros((planes.shape[1], np.dtype(kind).itemsize), dtype=np.uint8)
        wide[:, :k] = planes[at : at + k].T
        out.append(wide.view(kind).ravel())
        at += k
    return out[0], out[1], (out[2] << np.uint32(8)).view(np.float32), out[3]


def network_scores(docs: DataFrame, words: Vocabulary, net: Network, id_col: str, text_col: str, cells: int = CELLS,
                   share: float = SHARE, common: CommonCells | None = None) -> DataFrame:
    """(bucket, row, id, n_tokens, log_p, gain, tokens).

    Each document has a row with the network's sum and what the memory adds for
    tokens that `common` knows; its `tokens` is null.  The other rows hold packed
    tokens whose context has a cell, by the bucket of their cell: `row` is the
    first of their chunk.  Cells are told apart by their bucket and 40 bits more.
    Of a common cell, whose total is known, the words that are not counted yet go
    to buckets of their own (from `buckets` on) by the cell and the word.
    """
    kind, bound, buckets = docs.schema[id_col].dataType.simpleString(), (1 << 64) // cells - 1, words.buckets()
    bits = buckets.bit_length() - 1
    rest = np.uint64(64 - bits - _KEY_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, row = words.lookup(), TaskContext.get().partitionId() << 40
        places = common.by_rank(words) if common else None
        for part, texts in _chunks(batches, 1):
            sizes, numbers = look.batch(texts)
            ranks, log_p, hashes = look.rank[numbers], look.spelt[numbers], look.hash[numbers]
            context = contexts(sizes, ranks, net.pad)
            for a in range(0, len(ranks), 8192):
                log_p[a : a + 8192] += net.log_p(context[a : a + 8192], ranks[a : a + 8192])
            doc = np.repeat(np.arange(len(texts)), sizes)
            keys = cell_keys(sizes, hashes)
            held = keys <= np.uint64(bound)
            gain, place, cell = np.zeros(len(texts)), keys >> rest, keys >> rest
            cell &= np.uint64((1 << _KEY_BITS) - 1)
            place = (place >> np.uint64(_KEY_BITS)).astype(np.int32)
            if common:
                line, at = padded(sizes, places[np.minimum(ranks, look.listed)], 0)
                left, word, right = line[at - 1], line[at], line[at + 1]
                inside = held & (left >= 0) & (right >= 0)
                known = np.flatnonzero(inside & (word > 0))
                held[known] = False
                of = common.of[left[known] * common.side + right[known]]
                known, of = known[of > 1], of[of > 1]
                n = common.n[(left[known] * common.side + word[known]) * common.side + right[known]]
                gain = np.bincount(doc[known], gains(n, of, log_p[known], share), len(texts))
                apart = np.flatnonzero(inside & held)
                place[apart] = buckets + (cell_key(keys[apart], hashes[apart]) % np.uint64(buckets // 8 or 1)).astype(np.int32)
                cell[apart] = left[apart] * common.side + right[apart]
            held = np.flatnonzero(held)
            # by bucket, and by row in it
            held = held[np.argsort(place[held].astype(np.uint16) if buckets <= 1 << 15 else place[held], kind="stable")]
            place = place[held]
            planes = packed(cell[held], hashes[held], log_p[held], doc[held])
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(held) else np.zeros(0, dtype=np.int64)
            blobs = [planes[:, a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(held)])]
            sums, k = np.bincount(doc, log_p, len(texts)).astype(float), len(blobs)
            own = np.arange(row, row + len(texts))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[-1 - own % 1024, place[starts].astype(np.int64)]), pa.array(np.r_[own, np.full(k, row)]),
                pa.concat_arrays([part.column(0), pa.nulls(k, part.column(0).type)]), pa.concat_arrays([pa.array(sizes), pa.nulls(k, pa.int64())]),
                pa.concat_arrays([pa.array(sums), pa.nulls(k, pa.float64())]), pa.concat_arrays([pa.array(gain.astype(float)), pa.nulls(k, pa.float64())]),
                pa.array([None] * len(texts) + blobs, pa.binary()),
            ], ["bucket", "row", "id", "n_tokens", "log_p", "gain", "tokens"])
            row += len(texts)

    return map_arrow(docs.select(id_col, text_col), run, f"bucket long, row long, id {kind}, n_tokens long, log_p double, gain double, tokens binary")


def bucket_gains(blobs: list[bytes], first_rows: list[int], share: float, totals: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, gains) of one bucket's tokens in cells that hold others; `totals` of the cells if they are common ones."""
    cells, hashes, logs, rows = unpacked(blobs)
    rows = rows + np.repeat(np.array(first_rows, dtype=np.int64), [len(b) // _BYTES for b in blobs])

    def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted values: each one's run, and the runs' lengths."""
        new = np.r_[True, x[1:] != x[:-1]]
        return np.cumsum(new) - 1, np.diff(np.r_[np.flatnonzero(new), len(x)])

    order = np.argsort(cells)
    run, lengths = runs(cells[order])
    of = (lengths if totals is None else totals[cells[order[np.r_[0, np.cumsum(lengths)[:-1]]]]])[run]
    order, run, of = order[of > 1], run[of > 1], of[of > 1]
    if not len(order):
        return rows[:0], np.zeros(0)
    pairs = (run.astype(np.uint64) << np.uint64(32)) | hashes[order]
    again = np.argsort(pairs)
    pair, lengths = runs(pairs[again])
    order, of = order[again], of[again]
    return rows[order], gains(lengths[pair], of, logs[order].astype(np.float64), share)


def group_of(rows: np.ndarray, groups: int) -> np.ndarray:
    return ((rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)


def memory_gains(scored: DataFrame, buckets: int, share: float = SHARE, common: CommonCells | None = None, most_held: int = 1 << 20) -> DataFrame:
    """(group, row, id, n_tokens, value, gains) of `network_scores`: what the memory adds is counted bucket by bucket.

    Documents pass, in their group; the other rows hold a group's (row, gain) pairs, packed.
    """
    kind, groups = scored.schema["id"].dataType.simpleString(), buckets // 8 or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bucket, blobs, first_rows, held, count = ["group", "row", "id", "n_tokens", "value", "gains"], None, [], [], [], 0
        id_type = None

        def closed() -> int:
            if blobs:
                held.append(bucket_gains(blobs, first_rows, share, common.of if bucket >= buckets else None))
                blobs.clear()
                first_rows.clear()
                return len(held[-1][0])
            return 0

        def sums() -> pa.RecordBatch:
            rows, at = np.unique(np.concatenate([r for r, _ in held]), return_inverse=True)
            values = np.bincount(at, np.concatenate([g for _, g in held]), len(rows)).astype(np.float32)
            held.clear()
            group = group_of(rows, groups)
            order = np.argsort(group, kind="stable")
            group, rows, values = group[order], rows[order], values[order]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(rows) else np.zeros(0, dtype=np.int64)
            planes = np.concatenate([x.view(np.uint8).reshape(len(rows), x.itemsize).T for x in (rows, values)])
            packs, k = [planes[:, a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(rows)])], len(starts)
            empty = [pa.nulls(k, kind) for kind in (pa.int64(), id_type, pa.int64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(group[starts]), *empty, pa.array(packs, pa.binary())], names)

        for batch in batches:
            id_type = batch.column(2).type
            docs = batch.filter(pc.is_null(batch.column(6)))
            if docs.num_rows:
                group = pa.array(group_of(docs.column(1).to_numpy(), groups))
                value = pc.add(docs.column(4), docs.column(5))
                yield pa.RecordBatch.from_arrays([group, *docs.columns[1:4], value, pa.nulls(docs.num_rows, pa.binary())], names)
            packs = batch.filter(pc.is_valid(batch.column(6)))
            for b, row, blob in zip(packs.column(0).to_pylist(), packs.column(1).to_pylist(), packs.column(6)):
                if b != bucket:
                    count += closed()
                    bucket = b
                    if count > most_held:
                        yield sums()
                        count = 0
                blobs.append(blob.as_py())
                first_rows.append(row)
        closed()
        if held:
            yield sums()

    listed = scored.repartition(shuffle_partitions(scored.sparkSession), "bucket").sortWithinPartitions("bucket")
    return map_arrow(listed, run, f"group long, row long, id {kind}, n_tokens long, value double, gains binary")


def totals(parts: DataFrame) -> DataFrame:
    """(id, n_tokens, log_likelihood) of `memory_gains`: each document with its gains, group by group."""
    kind = parts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, docs, packs = None, [], []

        def closed() -> Iterator[pa.RecordBatch]:
            planes = [np.frombuffer(p, dtype=np.uint8).reshape(12, -1) for p in packs]
            rows = np.concatenate([np.ascontiguousarray(x[:8].T).view(np.int64).ravel() for x in planes] or [np.zeros(0, np.int64)])
            gain = np.concatenate([np.ascontiguousarray(x[8:].T).view(np.float32).ravel() for x in planes] or [np.zeros(0, np.float32)])
            own = np.concatenate([d.column(1).to_numpy() for d in docs] or [np.zeros(0, np.int64)])
            order = np.argsort(own)
            value = np.zeros(len(own))
            if len(rows):
                value[order] = np.bincount(np.searchsorted(own[order], rows), gain, len(own))
            at = 0
            for d in docs:
                added = pc.add(d.column(4), pa.array(value[at : at + d.num_rows]))
                at += d.num_rows
                yield pa.RecordBatch.from_arrays([d.column(2), d.column(3), added], ["id", "n_tokens", "log_likelihood"])
            docs.clear()
            packs.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if keys[a] != group:
                    yield from closed()
                    group = keys[a]
                part = batch.slice(a, b - a)
                docs.append(part.filter(pc.is_null(part.column(5))))
                packs += part.column(5).drop_null().to_pylist()
        yield from closed()

    listed = parts.repartition(shuffle_partitions(parts.sparkSession), "group").sortWithinPartitions("group")
    return map_arrow(listed, run, f"id {kind}, n_tokens long, log_likelihood double")


def score(docs: DataFrame, words: Vocabulary, net: Network, id_col: str = "doc_id", text_col: str = "text",
          cells: int = CELLS, share: float = SHARE, common: CommonCells | None = None) -> DataFrame:
    """(id, n_tokens, log_likelihood) of every row: the sum over all its tokens.

    `common` may be the network's, if it was trained on these very documents;
    otherwise the common cells are counted here.
    """
    common = common or common_cells(docs, words, text_col)
    docs.sparkSession.sparkContext._jvm.System.gc()  # lets Spark remove the shuffles of the vocabulary and the training first
    scored = network_scores(docs, words, net, id_col, text_col, cells, share, common)
    return totals(memory_gains(scored, words.buckets(), share, common)).select(F.col("id").alias(id_col), "n_tokens", "log_likelihood")
