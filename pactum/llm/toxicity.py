"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence with features of total weight w has
the probability

    p = 1 - (1 + exp(bias)) / (1 + exp(bias + w)) if w > 0, and else 0,

a logistic score less what a sentence without features has, and noisy-or with a
leak for the document combines them:

    P(toxic) = 1 - (1 - leak) * product over sentences of (1 - p(sentence)).

A long document gains nothing from many plain sentences.  Training on document
labels alone finds which sentences make a document toxic, and the fitted model
points at them.  A sentence's features are its lower-cased words and their
proper beginnings of 4 to 7 letters.

The model is fitted on the driver, in numpy, on a bounded sample of labelled
documents: at most `most_toxic` and `most_clean` of them (by a hash of the id,
whatever the order of rows), and of each class whole texts of `most_bytes` at
most, in that order and one at least, reweighted to the shares that all labelled
documents have.  The `most_features` features most associated with the label
are used, so the model that is sent to the executors is small and bounded.
Every document's whole text is scored.

Defined results
---------------
* A null or empty text has no sentence and scores the leak.
* Rows with a null label or id are not learnt from; without both classes among
  the labels only a small leak remains, and nothing is predicted toxic.
* A label table with several rows for one id counts as toxic if any row is.
* Repeated rows get equal scores; columns other than id and text are not
  carried by `score`, so their names cannot clash; an empty table gives an
  empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_arrow

MOST_TOXIC, MOST_CLEAN, MOST_FEATURES, MOST_BYTES = 1500, 3000, 4000, 64 << 20
PREFIXES = (4, 5, 6, 7)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id's text divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    bias: float
    leak: float = 0.0025
    weights: dict[str, float] = field(default_factory=dict)

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer(dict):
    """A model in use; remembers the weight of each word it has met."""

    MOST_WORDS = 300_000

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > self.MOST_WORDS:
            self.clear()
        value = self[word] = sum(self.model.weights.get(f, 0.0) for f in features(word))
        return value

    def score(self, text: str) -> tuple[float, list[dict]]:
        """Noisy-or of the sentences, and those with a probability of at least one half."""
        log_clean, found, bias = float(np.log1p(-self.model.leak)), [], self.model.bias
        for m in _SENTENCE.finditer(text):
            w = sum(map(self.__getitem__, _WORD.findall(m.group().lower())))
            if w > 0:
                log_p = float(np.logaddexp(0, bias) - np.logaddexp(0, bias + w))
                log_clean += log_p
                if log_p <= -np.log(2):
                    found.append({"start": m.start(), "end": m.end(), "score": float(-np.expm1(log_p))})
        return float(-np.expm1(log_clean)), found


def fit(texts: list[str], labels: list[int], weights: list[float] | None = None, most_features: int = MOST_FEATURES,
        rounds: int = 150, rate: float = 0.15, shrink: float = 3e-4, refit: float = 2e-5) -> Model:
    """Penalised maximum likelihood of the noisy-or model by Adam on all bags at once.

    Weights are shrunk towards zero by a constant each round, so most features
    drop out; those that stay are fitted again, hardly shrunk.
    """
    y = np.asarray(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(bias=-5.0)
    sample = np.ones(len(y)) if weights is None else np.asarray(weights, dtype=float)
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, labels):
        seen[int(label)].update({f for w in set(_WORD.findall(text.lower())) for f in features(w)})
    # two-proportion z score of each feature that enough documents have
    n0, n1 = float((y == 0).sum()), float((y == 1).sum())
    least = max(5, n1 / 50)
    names = sorted(f for f in seen[0].keys() | seen[1].keys() if seen[0][f] + seen[1][f] >= least)
    c0, c1 = (np.array([s[f] for f in names], dtype=float) for s in seen)
    p = (c0 + c1) / (n0 + n1)
    z = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n0 + 1 / n1))
    chosen = [names[i] for i in np.argsort(-np.abs(z), kind="stable")[:most_features]]
    del seen, names
    place = {f: i for i, f in enumerate(chosen)}
    at: dict[str, list[int]] = {}
    doc_of, sentence, column, s = [], [], [], 0
    for d, text in enumerate(texts):
        for m in _SENTENCE.finditer(text):
            for w in _WORD.findall(m.group().lower()):
                if w not in at:
                    at[w] = [place[f] for f in features(w) if f in place]
                if at[w]:
                    sentence += [s] * len(at[w])
                    column += at[w]
            doc_of.append(d)
            s += 1
    doc_of, sentence, column = (np.array(v, dtype=np.int32) for v in (doc_of, sentence, column))
    x, bias = np.zeros(len(chosen) + 1), -5.0
    x[-1] = -4.0  # log of the leak's hazard
    base = np.logaddexp(0, bias)
    stays = np.ones(len(x))
    for penalty in (shrink, refit):
        mean, square = np.zeros_like(x), np.zeros_like(x)
        for step in range(1, rounds + 1):
            w = np.clip(np.bincount(sentence, x[column], s), -50, 50)
            hazard = np.maximum(np.logaddexp(0, bias + w) - base, 0)
            total = np.bincount(doc_of, hazard, len(y)) + np.exp(x[-1])  # -log(1 - P)
            slope = sample * np.where(y == 1, -1 / np.expm1(np.minimum(total, 50)), 1.0)
            dw = slope[doc_of] / (1 + np.exp(-(bias + w))) * (w >= 0)
            grad = np.append(np.bincount(column, dw[sentence], len(chosen)), slope.sum() * np.exp(x[-1])) / sample.sum()
            grad[:-1] += penalty * np.sign(x[:-1])
            mean = 0.9 * mean + 0.1 * grad
            square = 0.99 * square + 0.01 * grad * grad
            x -= stays * rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        stays[:-1] = np.abs(x[:-1]) > 0.25
        x[:-1] *= stays[:-1]
    weights = {f: float(v) for f, v in zip(chosen, x) if abs(v) > 0.25}
    return Model(bias, float(-np.expm1(-np.exp(x[-1]))), weights)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_bytes: int = MOST_BYTES) -> Model:
    """Fits the model on labelled rows outside the held-out fold; see the module's text for the bounds."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(label_col).cast("int").alias("y"))
        .join(docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.coalesce(F.max(F.octet_length(text_col)), F.lit(0)).alias("size")), "id")
    )
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    classes = ((1, most_toxic), (0, most_clean))
    picked = []
    for y, n in classes:
        held = 0
        for r in hash_sample(known.where(F.col("y") == y), "id", n, counts[y]) if y in counts else ():
            if held + r.size <= most_bytes or not held:
                picked.append((r.id, r.y))
            held += r.size
    if not picked:
        return fit([], [])
    ids = docs.sparkSession.createDataFrame(picked, "id long, y int")  # at most most_toxic + most_clean rows, 2 * most_bytes of text
    rows = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(ids), "id")
        .collect()
    )
    rows = sorted({r.id: (r.id, r.text, r.y) for r in sorted(rows)}.values())
    taken = Counter(y for _, _, y in rows)
    weight = {y: counts[y] / taken[y] for y in taken}
    return fit([t for _, t, _ in rows], [y for _, _, y in rows], [weight[y] for _, _, y in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, offending) of every row; `offending` locates sentences as code-point spans."""
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [scorer.score(t or "") for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], spans)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "score", "offending"])

    out = f"`{id_col}` {kind}, score double, offending array<struct<start:int,end:int,score:double>>"
    return map_arrow(docs.select(id_col, text_col), run, out)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all their columns, that score below `threshold`.

    Rows are filtered where they are scored, so nothing is joined or shuffled.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                keep = [scorer.score(t or "")[0] < threshold for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
