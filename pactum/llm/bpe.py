"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until its parts are small; leaves are encoded at once, and two
neighbours join by encoding a window around their boundary again.  The window
grows on both sides until it ends at stable cuts.  A cut before position p is
stable if the character at p - 1 is a letter or a number and the one at p is of
another kind: no match of the splitting pattern can hold both, whatever stands
around, and no lookahead reaches across.  So

    encode(t[a:b]) = encode(t[a:p]) + encode(t[p:b])

holds for every stable p, tokens outside the window are final, and the join is
associative.  Where a side has no stable cut its whole half is encoded again.
Decoding concatenates the halves' bytes up the tree.

Defined results
---------------
* Null and empty texts have no tokens and decode to no bytes.
* Special tokens' strings are ordinary text.
* Long texts without stable cuts are still exact, at n log n cost.
* Repeated rows are encoded one by one; other columns are not carried, so their
  names cannot clash; empty tables give empty results.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MULTILINGUAL = "byte_bpe_multi_50k.tiktoken"
LEAF_CHARS, LEAF_IDS = 1024, 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache  # one per Python worker, for all its tasks
def _ranks(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """The ranks, and the bytes of each token."""
    ranks = read_ranks(path)
    token_bytes = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        token_bytes[rank] = token
    return ranks, token_bytes


@cache
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path)[0], special_tokens={}).encode_ordinary


class TreeCodec:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, leaf_chars: int = LEAF_CHARS):
        self.path, self.pattern, self.leaf_chars = path, pattern, max(2, leaf_chars)
        self.token_bytes = _ranks(path)[1]

    def leaf(self, text: str) -> list[int]:
        return _encoder(self.path, self.pattern)(text)  # decoding alone builds none

    def encode(self, text: str) -> list[int]:
        return self._span(text, 0, len(text))

    def _span(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf_chars:
            return self.leaf(text[start:end])
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self._span(text, start, middle), self._span(text, middle, end))

    def join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The tokens of text[start:end] from those of its halves."""
        low, high = stable_before(text, start, middle), stable_after(text, middle, end)
        again = self.leaf(text[low:high])
        if low == start and high == end:
            return again
        head = left[: len(left) - len(self.leaf(text[low:middle]))]
        head += again
        head += right[len(self.leaf(text[middle:high])) :]
        return head

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.token_bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _stable(text: str, p: int) -> bool:
    kind = unicodedata.category(text[p - 1])[0]
    return kind in "LN" and unicodedata.category(text[p])[0] != kind


def stable_before(text: str, start: int, middle: int) -> int:
    """The last stable cut before `middle`; `start` if there is none."""
    return next((q for q in range(middle - 1, start, -1) if _stable(text, q)), start)


def stable_after(text: str, middle: int, end: int) -> int:
    """The first stable cut after `middle`; `end` if there is none."""
    return next((q for q in range(middle + 1, end) if _stable(text, q)), end)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None,
           pattern: str = public_tokenizers.PATTERN, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(id, ids array<int>) of every row."""
    path = ranks_path or public_tokenizers.path(MULTILINGUAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec(path, pattern, leaf_chars)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [codec.encode(t) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """(id, ids, decoded binary) of every row."""
    path = ranks_path or public_tokenizers.path(MULTILINGUAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = [codec.decode(x) if x else b"" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], [id_col, "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_arrow(encoded.select(id_col, F.col(ids_col).alias("ids")), run, f"`{id_col}` {kind}, ids array<int>, decoded binary")
