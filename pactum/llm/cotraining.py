"""A quality classifier by co-training of two views.

* Text view: the share of each pair of neighbouring character kinds (lower and
  upper letters, digits, spaces, line ends, marks ...), and of repeated words.
* Page view: metadata only - source, language, size, layout of lines, and the
  address of the page with the document's id, hashed into a fixed number of slots.

Each view has a logistic classifier.  In every round both classifiers score all
unlabelled documents, where these lie.  Of the documents that a classifier is
sure of, a fresh sample by hash, of the whole table and in the proportions of
the true labels, joins the other view's training set with its labels, in place
of the former round's.  Then each view's scores are calibrated on labelled
documents that neither view learnt from (Platt scaling), and a logistic
combination of the calibrated views, fitted on the same documents, scores every
document.

Fits are in numpy on the driver: over at most `most_labelled` labelled documents
and, per view and round, `most_added` pseudo-labelled ones.  The unlabelled
documents' features are computed once and stored as compact rows (half-precision
shares and slot numbers).  Scoring covers every row's whole text.

Defined results
---------------
* A null or empty text has no character kinds and no repeats; null metadata are
  a value of their own.  Documents without a page have no address.
* Rows with a null label or id are not learnt from; several labels of one id
  count as the lowest.  Without both classes the prior alone is the score.
* Repeated rows get equal scores; several pages of one id count as the one with
  the smallest address.
* Other columns are not carried, so their names cannot clash; an empty table
  gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_sample, map_arrow
from .toxicity import held_out

MOST_LABELLED, MOST_ADDED, ROUNDS, SURE = 4000, 1000, 5, 0.9
KINDS, SLOTS = 16, 256
N_TEXT = KINDS * KINDS + 3


def _kinds() -> np.ndarray:
    """A kind per byte of UTF-8: lower, upper, digit, space, line end, nine sorts of marks, other ASCII, beyond ASCII."""
    kind = np.full(256, 14, dtype=np.uint8)
    kind[128:] = 15
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "!?", "'\"", "#*", "$%&", "|", "<>", "()[]{}", "-_/\\"]
    for i, chars in enumerate(groups):
        kind[np.frombuffer(chars.encode(), dtype=np.uint8)] = i
    return kind


KIND = _kinds()


def text_view(text: str) -> np.ndarray:
    out = np.zeros(N_TEXT, dtype=np.float32)
    data = KIND[np.frombuffer(text.encode(), dtype=np.uint8)].astype(np.int32)
    if len(data) > 1:
        pairs = np.bincount(data[:-1] * KINDS + data[1:], minlength=KINDS * KINDS)
        out[: KINDS * KINDS] = np.log1p(1000 * pairs / (len(data) - 1))
    words = text.split()
    if words:
        out[-3] = 5 * sum(map(eq, words, words[1:])) / len(words)
        out[-2] = 5 * sum(map(eq, words, words[2:])) / len(words)
        out[-1] = len(set(words)) / len(words)
    return out


def page_slots(source: str | None, lang: str | None, n_chars: int, n_lines: int, url: str | None) -> list[int]:
    """The slots of a document's metadata, one per fact."""
    size, lines = int(n_chars).bit_length(), int(n_lines).bit_length()
    facts = [f"source={source}", f"lang={lang}", f"size={size}", f"lines={lines}", f"line={int(n_chars / max(1, n_lines)).bit_length()}"]
    if url is not None:
        scheme, _, rest = url.partition("://")
        host, _, path = rest.partition("/")
        facts += [f"scheme={scheme}", f"query={'?' in path}", f"depth={path.count('/')}"]
        facts += [f"host={x}" for label in host.split(".") for x in label.split("-")]
    return [zlib.crc32(f.encode()) % SLOTS for f in facts]


def page_matrix(slots: list) -> np.ndarray:
    """The page views of documents, from their slots."""
    sizes = [len(x) for x in slots]
    cell = np.repeat(np.arange(len(slots)) * SLOTS, sizes) + np.concatenate([*slots, np.zeros(0)]).astype(np.int64)
    return np.bincount(cell, minlength=len(slots) * SLOTS).reshape(len(slots), SLOTS).astype(np.float64)


@dataclass
class Logistic:
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 200, rate: float = 0.1) -> "Logistic":
        w, mean, square = np.zeros(x.shape[1] + 1), 0.0, 0.0
        w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        for step in range(1, rounds + 1):
            d = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40))) - y
            g = np.append(x.T @ d / len(y) + decay * w[:-1], d.mean())
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            w = w - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        return cls(w.astype(np.float64))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]


@dataclass
class Model:
    """The views' classifiers, their calibrations (slope, shift) and the combination of calibrated logits."""

    text: Logistic
    page: Logistic
    calibration: tuple[tuple[float, float], tuple[float, float]]
    combined: Logistic

    def scores(self, text_logit: np.ndarray, page: np.ndarray) -> np.ndarray:
        (a, b), (c, d) = self.calibration
        both = np.stack([a * text_logit + b, c * self.page.logit(page) + d], axis=1)
        return 1 / (1 + np.exp(-np.clip(self.combined.logit(both), -40, 40)))


def sure_rows(models: list[Logistic], text: np.ndarray, page: np.ndarray, sure: float) -> dict[tuple[int, int], np.ndarray]:
    """Per (view that learns, label) the rows whose label the other view is sure of."""
    p = [1 / (1 + np.exp(-np.clip(m.logit(x), -40, 40))) for m, x in zip(models, (text, page))]
    return {(v, label): (p[1 - v] >= sure if label else p[1 - v] <= 1 - sure) for v in (0, 1) for label in (0, 1)}


def quotas(found: dict[tuple[int, int], int], prior: float, most_added: int) -> dict[tuple[int, int], int]:
    """How many of the sure rows each view learns from, in the true labels' proportions."""
    out = {}
    for v in (0, 1):
        want = {1: most_added * prior, 0: most_added * (1 - prior)}
        scale = min(1.0, *(found.get((v, k), 0) / max(want[k], 1e-9) for k in (0, 1)))
        out |= {(v, k): int(scale * want[k]) for k in (0, 1)}
    return out


class ArrayPool:
    """Unlabelled documents in memory; each call returns (features, labels) per view."""

    def __init__(self, text: np.ndarray, page: np.ndarray, sure: float = SURE, most_added: int = MOST_ADDED):
        self.views, self.sure, self.most_added = (text, page), sure, most_added

    def __call__(self, models: list[Logistic], turn: int, prior: float) -> list[tuple[np.ndarray, np.ndarray]]:
        rows = {k: np.flatnonzero(m) for k, m in sure_rows(models, *self.views, self.sure).items()}
        most = quotas({k: len(r) for k, r in rows.items()}, prior, self.most_added)
        rng = np.random.default_rng(turn)
        picked = {k: np.sort(rng.permutation(r)[: most[k]]) for k, r in rows.items()}
        return [(np.concatenate([self.views[v][picked[v, k]] for k in (0, 1)]), np.repeat([0.0, 1.0], [most[v, 0], most[v, 1]])) for v in (0, 1)]


class TablePool:
    """Unlabelled documents of a stored table (id, text binary, slots binary); a round scores all of them where they lie.

    A round takes two passes: the first counts the sure rows, the second fetches
    those of them whose hash, another one each round, is below the share that
    the quotas leave; some more are fetched, and the smallest hashes are taken.
    """

    SPACE = 1 << 62

    def __init__(self, table: DataFrame, sure: float = SURE, most_added: int = MOST_ADDED):
        self.table, self.sure, self.most_added = table, sure, most_added

    def __call__(self, models: list[Logistic], turn: int, prior: float) -> list[tuple[np.ndarray, np.ndarray]]:
        sure, place = self.sure, F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(self.SPACE)).alias("place")
        rows = self.table.select("text", "slots", place)

        def scored(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                if batch.num_rows:
                    text, slots = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                    marks = sure_rows(models, *features(text, slots), sure)
                    yield batch, text, slots, batch.column(2).to_numpy(zero_copy_only=False), marks

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for *_, marks in scored(batches):
                yield pa.RecordBatch.from_pylist([{"v": v, "label": k, "n": int(m.sum())} for (v, k), m in marks.items()], pa.schema([("v", pa.int32()), ("label", pa.int32()), ("n", pa.int64())]))

        found = {(r.v, r.label): r.n for r in map_arrow(rows, count, "v int, label int, n long").groupBy("v", "label").agg(F.sum("n").alias("n")).collect()}
        most = quotas(found, prior, self.most_added)
        # about sqrt(n) more than asked for, so that hardly ever one is missing
        below = {k: int(self.SPACE * min(1.0, (n + 4 * n**0.5) / max(1, found.get(k, 0)))) for k, n in most.items()}

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = pa.schema([("v", pa.int32()), ("label", pa.int32()), ("place", pa.int64()), ("x", pa.binary())])
            for _, text, slots, places, marks in scored(batches):
                out = [
                    {"v": v, "label": k, "place": int(places[i]), "x": (text, slots)[v][i]}
                    for (v, k), m in marks.items() for i in np.flatnonzero(m & (places < below[v, k]))
                ]
                yield pa.RecordBatch.from_pylist(out, names)

        got: dict[tuple[int, int], list] = {k: [] for k in most}
        for r in map_arrow(rows, fetch, "v int, label int, place long, x binary").collect():  # at most a few more than 2 * most_added
            got[r.v, r.label].append((r.place, bytes(r.x)))
        out = []
        for v in (0, 1):
            taken = [(x, float(k)) for k in (0, 1) for _, x in sorted(got[v, k])[: most[v, k]]]
            data = [x for x, _ in taken]
            x = features(data, [b""] * len(data))[0] if v == 0 else features([], data)[1]
            out.append((x, np.array([k for _, k in taken])))
        return out


def features(text: list[bytes], slots: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The views of stored rows."""
    x = np.frombuffer(b"".join(text), dtype=np.float16).astype(np.float64).reshape(-1, N_TEXT)
    return x, page_matrix([np.frombuffer(s, dtype=np.uint16) for s in slots])


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, calibrate: np.ndarray, pool=None, rounds: int = ROUNDS) -> Model:
    """`calibrate` marks the labelled rows kept for calibration and combination; `pool` (ArrayPool, TablePool or None)
    returns, for the views' classifiers, each view's pseudo-labelled rows of a round."""
    learn = ~calibrate
    prior = float(y.mean()) if len(y) else 0.5
    if not len(y) or min(y[learn].sum(), (1 - y[learn]).sum(), y[calibrate].sum(), (1 - y[calibrate]).sum()) == 0:
        flat = lambda n: Logistic(np.zeros(n + 1))
        combined = Logistic(np.array([0.0, 0.0, np.log((prior * len(y) + 1) / ((1 - prior) * len(y) + 1))]))
        return Model(flat(text.shape[1]), flat(page.shape[1]), ((1.0, 0.0), (1.0, 0.0)), combined)
    views = (text[learn], page[learn])
    added = [(x[:0], y[:0]) for x in views]
    for turn in range(rounds + 1):
        models = [Logistic.fit(np.concatenate([x, more]), np.concatenate([y[learn], labels])) for x, (more, labels) in zip(views, added)]
        if turn == rounds or pool is None:
            break
        added = pool(models, turn, prior)
    logits, scaled, calibration = [m.logit(x[calibrate]) for m, x in zip(models, (text, page))], [], []
    for z in logits:
        spread = max(float(z.std()), 1e-6)
        fitted = Logistic.fit((z / spread)[:, None], y[calibrate], decay=1e-2).weights
        calibration.append((float(fitted[0] / spread), float(fitted[1])))
        scaled.append(calibration[-1][0] * z + calibration[-1][1])
    combined = Logistic.fit(np.stack(scaled, axis=1), y[calibrate], decay=1e-2)
    return Model(models[0], models[1], (calibration[0], calibration[1]), combined)


def measured(docs: DataFrame, weights: np.ndarray | None, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Compact rows (id, lang, source, n_chars, n_lines, text_logit, and the half-precision text view where `weights` is None)."""
    kind = docs.schema[id_col].dataType.simpleString()
    full = weights is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(3).to_pylist()]
                x = np.stack([text_view(t) for t in texts])
                logit = np.zeros(len(texts)) if full else x @ weights[:-1] + weights[-1]
                columns = [*(part.column(k) for k in range(3)), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 for t in texts], pa.int64()),
                           pa.array(logit, pa.float64()), pa.array([v.tobytes() for v in x.astype(np.float16)] if full else [None] * len(texts), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "source", "n_chars", "n_lines", "text_logit", "text"])

    schema = f"id {kind}, lang string, source string, n_chars long, n_lines long, text_logit double, text binary"
    return map_arrow(docs.select(id_col, lang_col, source_col, text_col), run, schema)


def _with_pages(rows: DataFrame, pages: DataFrame, page_id: str, url_col: str) -> DataFrame:
    urls = pages.where(F.col(page_id).isNotNull()).groupBy(F.col(page_id).alias("page")).agg(F.min(url_col).alias("url"))
    return rows.join(urls.hint("merge"), rows.id == urls.page, "left").drop("page")


def viewed(rows: DataFrame, pages: DataFrame, page_id: str, url_col: str) -> DataFrame:
    """(id, text, slots) of rows of `measured`: both views in their stored form."""
    joined = _with_pages(rows, pages, page_id, url_col).select("id", "text", "source", "lang", "n_chars", "n_lines", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [np.array(page_slots(*facts), dtype=np.uint16).tobytes() for facts in zip(*(batch.column(k).to_pylist() for k in range(2, 7)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.binary())], ["id", "text", "slots"])

    return map_arrow(joined, run, f"id {rows.schema['id'].dataType.simpleString()}, text binary, slots binary")


def train(docs: DataFrame, labels: DataFrame, pages: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", label_col: str = "quality", page_id: str = "page_id", url_col: str = "url",
          most_labelled: int = MOST_LABELLED, most_added: int = MOST_ADDED, rounds: int = ROUNDS) -> Model:
    """Fits on bounded samples; the fold `held_out` is never used, not even unlabelled."""
    ids = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("i"))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("j")).agg(F.min(label_col).cast("int").alias("y"))
    known = ids.join(marks, ids.i == marks.j).select("i", "y")
    picked = {r.i: r.y for r in hash_sample(known, "i", most_labelled, known.count())}
    if not picked:
        return co_train(np.zeros((0, N_TEXT)), np.zeros((0, SLOTS)), np.zeros(0), np.zeros(0, bool))
    views = lambda part: measured(part, None, id_col, text_col, lang_col, source_col)
    # at most most_labelled ids and their features
    chosen = docs.sparkSession.createDataFrame([(i,) for i in picked], f"i {docs.schema[id_col].dataType.simpleString()}")
    rows = viewed(views(docs.join(F.broadcast(chosen), docs[id_col] == chosen.i, "left_semi")), pages, page_id, url_col).collect()
    rows = sorted({r.id: r for r in rows}.values(), key=lambda r: r.id)
    text, page = features([bytes(r.text) for r in rows], [bytes(r.slots) for r in rows])
    y = np.array([picked[r.id] for r in rows], dtype=np.float64)
    calibrate = np.array([zlib.crc32(f"{r.id}/calibrate".encode()) % 3 == 0 for r in rows])
    # labelled rows are left out after their texts are: only compact rows are shuffled, once for both joins, at every size
    others = views(docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))))
    others = others.join(marks.hint("merge"), others.id == marks.j, "left_anti")
    pool = TablePool(cut(viewed(others, pages, page_id, url_col)), most_added=most_added) if rounds else None
    return co_train(text, page, y, calibrate, pool, rounds)


def score(docs: DataFrame, pages: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", page_id: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, text_logit, score) of every row.  Texts are not shuffled: only compact rows meet the pages."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = measured(docs, model.text.weights, id_col, text_col, lang_col, source_col).drop("text")
    joined = _with_pages(rows, pages, page_id, url_col).select("id", "source", "lang", "n_chars", "n_lines", "url", "text_logit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                page = page_matrix([page_slots(*facts) for facts in zip(*(batch.column(k).to_pylist() for k in range(1, 6)))])
                text_logit = batch.column(6).to_numpy(zero_copy_only=False)
                scores = model.scores(text_logit, page)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(6), pa.array(scores, pa.float64())], [id_col, "text_logit", "score"])

    return map_arrow(joined, run, f"`{id_col}` {kind}, text_logit double, score double")
