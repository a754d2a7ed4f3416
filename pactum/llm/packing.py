"""Hierarchical packing of tokenised documents into windows of several lengths.

Each task packs its own documents in one pass, so nothing is shuffled.  A
document's full longest windows are cut off first.  The rest is routed to the
tier of the shortest window that holds it.  Tiers are packed from the longest
down: a window opens with a document of its tier, whole documents of shorter
tiers fill its gap, best fit first, and the last gap takes the beginning of one
more, whose rest is routed anew.  So every window is full.  What a task has left
at its end is cut into windows of falling powers of two; only a rest below the
shortest of them is padded, at most once per task.

Windows of a size are dealt to step groups that hold the same number of tokens:
a step has step_tokens / window windows of one size.  Windows are numbered over
all tasks, by the counts of the tasks before, so each size has one part-filled
step group at most, whatever the number of tasks.

Defined results
---------------
* Null and empty texts are one token, the end id.
* Texts of any length are cut into windows; no token is lost or repeated.
* Rows are packed one by one: repeated rows and null ids are rows like others.
* Other columns are not carried, so their names cannot clash; an empty table
  gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow

VOCABULARY, END_ID = "word_bpe_49k.json", 1
TIERS = (2048, 1024, 512, 256)
SHORTEST, STEP_TOKENS = 64, 16 * 2048
TASK_SHIFT, MOST_BROADCAST = 40, 100_000
SCHEMA = (
    "start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long, window int, number long"
)
#: Characters for which lower-casing, NFC and the splitting pattern are the plain ones used by WordTokens.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xc0-\xff–—‘-”…]")
#: The vocabulary's splitting pattern over those characters, lower-cased.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")


_LOADED: dict[str, "WordTokens"] = {}


class WordTokens:
    """Token ids as little-endian unsigned 32-bit bytes.  The vocabulary merges
    inside words only, so words are encoded once and remembered; texts with
    characters outside _PLAIN go to the library whole."""

    def __init__(self, path: str, most_words: int = 300_000):
        import numpy as np
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.ends_word = np.zeros(max(self.library.get_vocab().values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.most_words = most_words

    @classmethod
    def of(cls, path: str) -> "WordTokens":
        """One per Python worker, so that tasks after the first find its words known."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _ids(self, text: str):
        import numpy as np

        return np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")  # without offsets

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word: all are encoded as one text, and each ends at its token with a word end."""
        ids = self._ids(" ".join(words))
        ends = [0, *(4 * (self.ends_word[ids].nonzero()[0] + 1)).tolist()]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if _PLAIN.search(t) else _PIECES.findall(t.lower()) for t in texts]
        if len(self.known) > self.most_words:
            self.known.clear()
        new = list({p for pieces in split if pieces for p in pieces}.difference(self.known))
        self.known.update(zip(new, self._words(new), strict=True))
        word = self.known.__getitem__
        return [b"".join(map(word, p)) if p is not None else self._ids(t).tobytes() for t, p in zip(texts, split)]


class Piece:
    """Tokens [start, start + length) of a document; `data` holds the whole document's ids."""

    __slots__ = ("doc", "data", "total", "start", "length")

    def __init__(self, doc, data: bytes, total: int, start: int, length: int):
        self.doc, self.data, self.total, self.start, self.length = doc, data, total, start, length

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (
            Piece(self.doc, self.data, self.total, self.start, n),
            Piece(self.doc, self.data, self.total, self.start + n, self.length - n),
        )


class Packer:
    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, shortest: int = SHORTEST):
        self.tiers, self.shortest = sorted(tiers, reverse=True), shortest
        self.base, self.made, self.dealt = task << TASK_SHIFT, 0, {}
        # per tier, pieces sorted by length (the counter breaks ties)
        self.waiting: dict[int, list[tuple[int, int, Piece]]] = {w: [] for w in self.tiers}
        self.count, self.rows = 0, []

    def add(self, doc, data: bytes) -> None:
        piece = Piece(doc, data, len(data) // 4, 0, len(data) // 4)
        while piece.length >= self.tiers[0]:
            full, piece = piece.cut(self.tiers[0])
            self._emit([full], self.tiers[0])
        self._route(piece)

    def _route(self, piece: Piece) -> None:
        if piece.length:
            tier = min(w for w in self.tiers if w >= piece.length)
            self.count += 1
            insort(self.waiting[tier], (piece.length, self.count, piece))

    def _emit(self, pieces: list[Piece], window: int) -> None:
        number = self.dealt[window] = self.dealt.get(window, -1) + 1  # among the task's windows of this size
        offset = 0
        for p in pieces:
            ids = p.data[4 * p.start : 4 * (p.start + p.length)]
            self.rows.append((p.doc, p.start, p.length, ids, p.total, self.base | self.made, offset, window, number))
            offset += p.length
        self.made += 1

    def _fitting(self, tiers: list[int], gap: int) -> Piece | None:
        """The longest waiting piece of these tiers that fits, else the shortest one, to be cut."""
        for w in tiers:
            at = bisect_right(self.waiting[w], gap, key=lambda x: x[0])
            if at:
                return self.waiting[w].pop(at - 1)[2]
        for w in reversed(tiers):
            if self.waiting[w]:
                return self.waiting[w].pop(0)[2]
        return None

    def pack(self, last: bool = False) -> None:
        """Fills windows as long as there are tokens for full ones; `last` packs all that is left."""
        for k, window in enumerate(self.tiers):
            own = self.waiting[window]
            while own:
                pieces, gap = [own.pop()[2]], window
                gap -= pieces[0].length
                while gap:
                    p = self._fitting(self.tiers[k + 1 :], gap) or self._fitting([window], gap)
                    if p is None:
                        break
                    if p.length > gap:
                        p, rest = p.cut(gap)
                        self._route(rest)
                    pieces.append(p)
                    gap -= p.length
                if not gap:
                    self._emit(pieces, window)
                elif last:
                    self._powers(pieces)
                else:
                    for p in pieces:
                        self._route(p)
                    break

    def _powers(self, pieces: list[Piece]) -> None:
        """Windows of falling powers of two; the rest below the shortest is padded."""
        left = sum(p.length for p in pieces)
        while left:
            window = 1 << (left.bit_length() - 1)
            if window < self.shortest:
                return self._emit(pieces, self.tiers[0])
            head, need = [], window
            while need:
                p = pieces.pop(0)
                if p.length > need:
                    p, rest = p.cut(need)
                    pieces.insert(0, rest)
                head.append(p)
                need -= p.length
            self._emit(head, window)
            left -= window

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
            tiers: tuple[int, ...] = TIERS, shortest: int = SHORTEST) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, window
    (its sequence's length when full) and number (of the sequence among its task's windows of that size)."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = WordTokens.of(path), Packer(TaskContext.get().partitionId(), tiers, shortest)

        def out(id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*packer.taken())) or [[]] * 9
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", "number"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, data in zip(part.column(0).to_pylist(), tokens.encode(texts)):
                    packer.add(doc, data + end)
                packer.pack()
                yield out(id_type)
        if id_type is not None:
            packer.pack(last=True)
            yield out(id_type)

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, {SCHEMA}")


def step_groups(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """`pieces` of `windows` with step_group in place of number; they are stored, as tasks are counted first."""
    pieces = cut(pieces.withColumn("task", F.shiftright("sequence_id", TASK_SHIFT)))
    tasks = pieces.groupBy("task", "window").agg((F.max("number") + 1).alias("n"))
    before = Window.partitionBy("window").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    firsts = tasks.select("task", "window", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if tasks.count() <= MOST_BROADCAST:  # a row per task and size
        firsts = F.broadcast(firsts)
    place = F.col("first") + F.col("number")
    group = F.shiftleft(F.col("window").cast("long"), 44) + F.floor(place / F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("window"))))
    return pieces.join(firsts, ["task", "window"]).withColumn("step_group", group).select(*[c for c in pieces.columns if c not in ("task", "number")], "step_group")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
         tiers: tuple[int, ...] = TIERS, shortest: int = SHORTEST, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """The pieces of `windows`, with step_group in place of number."""
    return step_groups(windows(docs, id_col, text_col, vocabulary, tiers, shortest), step_tokens)
