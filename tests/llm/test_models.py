"""Learnt operators: held-out accuracy, and their behaviour on awkward rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pactum.llm import cotraining, lm_scoring, simhash, toxicity
from pactum.llm.common import hash_sample
from pactum.llm.queries import QUERIES

from .cases import awkward, empty, read

SF = "/root/testdata/sf0.1"


def auc(pairs):
    """pairs: (score, label)."""
    ranked, ties, total, good = sorted(pairs), {}, 0.0, 0
    for rank, (s, _) in enumerate(ranked, 1):
        a, n = ties.get(s, (0, 0))
        ties[s] = (a + rank, n + 1)
    good = sum(y for _, y in ranked)
    total = sum(ties[s][0] / ties[s][1] for s, y in ranked if y)
    return (total - good * (good + 1) / 2) / (good * (len(ranked) - good))


def test_toxicity_held_out(spark):
    truth = {r["doc_id"]: r["toxic"] for r in read(SF, "labels")}
    rows = QUERIES["op3_toxicity"](spark, SF).collect()
    assert len(rows) == len(read(SF, "documents"))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    hits = [(s >= 0.5) == bool(y) for s, y in held]
    assert auc(held) > 0.97 and sum(hits) / len(hits) > 0.97
    false = [s >= 0.5 for s, y in held if not y]
    assert sum(false) / len(false) < 0.01


def test_toxicity_locates_sentences():
    texts = [f"A calm line number{i}. You nasty fool. Another calm line." if i % 2 else f"A calm line number{i}. Another calm one." for i in range(200)]
    model = toxicity.fit(texts, [i % 2 for i in range(200)])
    score, found = model.scorer().score("Calm words here. You nasty fool. Calm again.")
    assert score > 0.9 and [f["start"] for f in found] == [16] and found[0]["end"] == 32
    assert model.scorer().score("Calm words here. Calm again.")[0] < 0.2


def test_toxicity_scores_are_noisy_ors(spark):
    """Every score of the table against plain loops over the fitted weights, from documented formulas."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    got = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, d).collect()}
    spans = {r.doc_id: r.offending for r in toxicity.score(docs, model).collect()}
    for d in read(d, "documents"):
        clean, found = 1 - model.leak, []
        for m in re.finditer(r"[^.!?\n]+[.!?]*", d["text"] or ""):
            words = re.findall(r"[^\W\d_]+", m.group().lower())
            w = sum(model.weights.get(f, 0) for x in words for f in [x, *(x[:n] + "*" for n in (4, 5, 6, 7) if len(x) > n)])
            p = 1 - (1 + math.exp(model.bias)) / (1 + math.exp(model.bias + w)) if w > 0 else 0.0
            clean *= 1 - p
            if p >= 0.5:
                found.append((m.start(), m.end()))
        assert got[d["doc_id"]].score == pytest.approx(1 - clean, abs=1e-9)
        assert [(s.start, s.end) for s in spans[d["doc_id"]]] == found
    assert any(spans.values())


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, *_: taken.append(texts))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long text "), 1000).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    for most, want in ((50_000, 10), (10, 2), (1 << 30, 48)):
        toxicity.train(docs, labels, most_bytes=most)
        assert abs(len(taken[-1]) - want) <= (6 if want == 48 else 0)


def test_texts_of_several_megabytes(spark):
    """Learnt operators take whole texts of any length."""
    long = " ".join(f"word{i % 5000} and you" for i in range(200_000)) + " end."
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, "x" * 3_000_000, "en", "s", 3_000_000), (3, "short text here.", "en", "s", 16)], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([(1, "http://x/y")], "page_id long, url string")
    assert toxicity.score(docs, toxicity.Model(-5.0, weights={"end": 9.0})).where("score > 0.5").count() == 1
    assert cotraining.score(docs, pages, cotraining.train(docs, spark.createDataFrame([(3, 1)], "doc_id long, quality int"), pages)).count() == 3
    words = lm_scoring.vocabulary(docs)
    rows = {r.doc_id: r for r in lm_scoring.score(docs, words, lm_scoring.train(docs, words)).collect()}
    assert rows[1].n_tokens == 600_001 and rows[1].log_likelihood < 0
    copies = docs.select((F.col("doc_id") + 10).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text"), "lang", "source", "n_chars")
    assert sorted(r.doc_id for r in simhash.keep_one(docs.union(copies)).collect()) == [1, 2, 3, 12, 13]


def test_toxicity_awkward(spark):
    docs = awkward(spark, extra=True)
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == pytest.approx(model.leak) and not r.offending for r in rows if r.doc_id in (0, 1, 2))  # no sentence
    assert toxicity.train(docs, labels.where("false")).weights == {}
    kept = toxicity.keep_clean(docs, toxicity.Model(-5.0))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.score(empty(spark), model).count() == 0


def test_toxicity_ignores_held_out_labels(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.when(F.col("id") % 2 == 0, "bad").otherwise("good")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a == b and a.weights


def test_cotraining_held_out(spark):
    truth = {r["doc_id"]: r["quality"] for r in read(SF, "labels")}
    rows = QUERIES["op6_cotraining"](spark, SF).collect()
    assert len(rows) == len(read(SF, "documents")) and all(0 <= r.score <= 1 for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert auc(held) > 0.95
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.95
    # calibrated: the mean score is near the share of good documents
    assert abs(sum(s for s, _ in held) / len(held) - sum(y for _, y in held) / len(held)) < 0.05


def test_cotraining_uses_the_other_views_labels():
    """With few labels, pseudo-labels of the clear view teach the other one: without the exchange it is worse."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000).astype(float)
    text = y[:, None] * 6 + rng.standard_normal((3000, 2))
    page = (2 * y[:, None] - 1) * np.linspace(0, 0.5, 40) + rng.standard_normal((3000, 40))
    lab, pool, test = slice(0, 30), slice(30, 1500), slice(1500, 3000)
    accuracy = []
    for rounds in (0, 3):
        m = cotraining.co_train(text[lab], page[lab], y[lab], np.arange(30) % 3 == 0, cotraining.ArrayPool(text[pool], page[pool]), rounds)
        accuracy.append(((m.page.logit(page[test]) > 0) == y[test]).mean())
        assert ((m.scores(m.text.logit(text[test]), page[test]) > 0.5) == y[test]).mean() > 0.95
    assert accuracy[1] > accuracy[0] + 0.05, accuracy


def test_cotraining_pool_is_the_whole_table(spark):
    """A round scores every stored row; what it returns is the brute-force selection, in the labels' proportions."""
    rng = np.random.default_rng(1)
    n = 3000
    text, slots = rng.standard_normal((n, cotraining.N_TEXT)).astype(np.float16), rng.integers(0, cotraining.SLOTS, (n, 6)).astype(np.uint16)
    table = spark.createDataFrame([(i, bytearray(text[i].tobytes()), bytearray(slots[i].tobytes())) for i in range(n)], "id long, text binary, slots binary").repartition(7)
    models = [cotraining.Logistic(rng.standard_normal(k + 1)) for k in (cotraining.N_TEXT, cotraining.SLOTS)]
    page = cotraining.page_matrix(list(slots))
    assert page.sum() == 6 * n and page[5, slots[5][0]] >= 1
    marks = cotraining.sure_rows(models, text.astype(float), page, 0.9)
    place = {r.id: r.p for r in table.select("id", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1 << 62)).alias("p")).collect()}
    for most in (100, 10**6):
        got = cotraining.TablePool(table, most_added=most)(models, 4, 0.3)
        quota = cotraining.quotas({k: int(m.sum()) for k, m in marks.items()}, 0.3, most)
        assert most == 10**6 or quota == {(0, 0): 70, (0, 1): 30, (1, 0): 70, (1, 1): 30}
        for v, x in enumerate((text.astype(float), page)):
            want = [sorted(np.flatnonzero(marks[v, k]), key=lambda i: place[int(i)])[: quota[v, k]] for k in (0, 1)]
            assert np.array_equal(got[v][0], x[np.concatenate(want)]) and got[v][1].tolist() == [0.0] * len(want[0]) + [1.0] * len(want[1])


def test_cotraining_awkward(spark):
    docs = awkward(spark, extra=True)
    pages = spark.createDataFrame([(1, "http://a.example/x?y"), (1, None), (None, "http://b"), (4, "no scheme")], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (13, None)], "doc_id long, quality int")
    for known in (labels, labels.where("false")):
        rows = cotraining.score(docs, pages, cotraining.train(docs, known, pages)).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    model = cotraining.train(empty(spark), labels, pages)
    assert cotraining.score(empty(spark), pages, model).count() == 0


def brute_network(tokens, words, net):
    """log P(network) of each token, by plain loops over the parameters."""
    table, matrices, bias, u1, c1, u2, c2 = (p.astype(float) for p in net.parts)
    place = {w: i for i, (w, _) in enumerate(words.words)}
    rank = lambda w: place.get(w, len(place) + xxhash.xxh64_intdigest(w.encode()) % lm_scoring.SLOTS)
    soft = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    out = []
    for i, w in enumerate(tokens):
        z = bias.copy()
        for k, o in enumerate(lm_scoring.OFFSETS):
            z += table[rank(tokens[i + o]) if 0 <= i + o < len(tokens) else net.pad] @ matrices[k]
        h, c = np.tanh(z), rank(w) // net.members if w in place else net.classes
        p = soft(h @ u1 + c1)[c]
        if w in place:
            out.append(p + soft(h @ u2[c] + c2[c])[rank(w) % net.members])
        else:
            out.append(p + sum(words.chars.get(x, words.other_char) for x in [*w, ""]))
    return out


def brute_scores(texts, words, net, cells, share):
    """Sums per text of the network mixed with counts of (left, word, right) over all texts."""
    split = [(t or "").lower().split() for t in texts]
    around = lambda x, i: (x[i - 1] if i else None, x[i + 1] if i + 1 < len(x) else None)
    triples = Counter((around(x, i), w) for x in split for i, w in enumerate(x))
    pairs = Counter(around(x, i) for x in split for i in range(len(x)))
    hashed = lambda w: 0 if w is None else xxhash.xxh64_intdigest(w.encode())
    out = []
    for x in split:
        total = 0.0
        for i, (w, p) in enumerate(zip(x, brute_network(x, words, net))):
            left, right = around(x, i)
            line = np.array([hashed(left) if left else 0, 0, hashed(right) if right else 0], dtype=np.uint64)
            key = lm_scoring.cell_keys(np.array([3]), line)[1]
            n, of = triples[(left, right), w], pairs[left, right]
            if of > 1 and int(key) < (1 << 64) // cells:
                p = np.log(share * (n - 1) / (of - 1) + (1 - share) * np.exp(p)) if n > 1 else p + np.log(1 - share)
            total += p
        out.append((len(x), total))
    return out


@pytest.mark.parametrize("hot", [None, 3])
def test_lm_scores_are_sums_of_conditionals(spark, monkeypatch, hot):
    """The whole result against plain loops, with hot cells counted the other way as well."""
    if hot:
        monkeypatch.setattr(lm_scoring, "hot_bound", lambda *_: hot)
        monkeypatch.setattr(lm_scoring, "max", min, raising=False)
    docs = awkward(spark, extra=True).where("length(text) < 4000 or text is null")
    words = lm_scoring.vocabulary(docs, most_words=40)
    net = lm_scoring.train(docs, words, classes=8, members=5, hidden=4)
    for cells in (1, 3):
        got = lm_scoring.score(docs, words, net, cells=cells).collect()
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        want = brute_scores([t for _, t in texts], words, net, cells, lm_scoring.SHARE)
        key = lambda x: (x[0] is None, x[0] or 0, x[1], round(x[2], 3))
        for g, w in zip(sorted([tuple(r) for r in got], key=key), sorted([(i, *w) for (i, _), w in zip(texts, want)], key=key), strict=True):
            assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-3, abs=1e-2)
    assert lm_scoring.score(empty(spark), words, net).count() == 0
    none = lm_scoring.vocabulary(empty(spark))
    assert lm_scoring.train(empty(spark), none).flat.shape == lm_scoring.Network(none).flat.shape


def test_lm_vocabulary_counts_everything(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = Counter(w for r in read(sf_dir, "documents") for w in r["text"].lower().split())
    assert {r.word: r.n for r in lm_scoring.count_words(docs, "text", most_held=100).collect()} == counts
    words = lm_scoring.vocabulary(docs, most_words=500)
    assert words.words == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:500]
    assert words.others == sum(counts.values()) - sum(n for _, n in words.words)


def test_lm_gradient_is_the_losss():
    """Against finite differences, parameter by parameter."""
    words = lm_scoring.Vocabulary([(f"w{i}", 20 - i) for i in range(11)], 7)
    net = lm_scoring.Network(words, classes=4, members=3, hidden=3, seed=2)
    rng = np.random.default_rng(0)
    ranks = np.r_[np.arange(11), 11 + rng.integers(0, lm_scoring.SLOTS, 9)]
    context = rng.choice(np.r_[ranks, net.pad], (20, 4))
    got, flat = net.gradient(context, ranks), net.flat.copy()
    loss = lambda x: -net.load(x).log_p(context, ranks).mean()
    some = np.r_[np.flatnonzero(got)[::7], len(flat) - 40 : len(flat)]
    for i in some:
        a, b = flat.copy(), flat.copy()
        a[i], b[i] = a[i] + 1e-2, b[i] - 1e-2
        assert got[i] == pytest.approx((loss(a) - loss(b)) / 2e-2, abs=2e-3)


def test_lm_training_is_the_plain_one(spark, sf_dir):
    """On one partition: the shipped loop equals plain steps over all tokens in order, and each step lowers the loss overall."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 2000").limit(60).coalesce(1).cache()
    texts = [r.text for r in docs.select("text").collect()]
    words = lm_scoring.vocabulary(docs, most_words=64)
    net = lm_scoring.train(docs, words, classes=8, members=8, hidden=4, batch=512)
    own, look = lm_scoring.Network(words, 8, 8, 4), words.lookup()
    start, squares, context, rank = own.copy(), np.full_like(own.flat, 1e-6), [], []
    for t in texts:
        _, numbers = look.batch([t])
        x = look.rank[numbers].tolist()
        line = [own.pad, own.pad, *x, own.pad, own.pad]
        context += [[line[i + 2 + o] for o in lm_scoring.OFFSETS] for i in range(len(x))]
        rank += x
    context, rank = np.array(context), np.array(rank)
    for a in range(0, len(rank), 512):
        own.step(context[a : a + 512], rank[a : a + 512], 0.05, squares)
    assert len(rank) < 60 * 400 and np.allclose(net.flat, own.flat, atol=1e-4)
    assert net.log_p(context, rank).mean() > start.log_p(context, rank).mean() + 0.01
    docs.unpersist()


def test_lm_prefers_order(spark):
    """The network alone: shuffled words lose, beyond word frequencies, with the shipped settings."""
    docs = spark.createDataFrame([(i, "alpha beta gamma delta " * 300) for i in range(60)], "doc_id long, text string")
    words = lm_scoring.vocabulary(docs)
    net = lm_scoring.train(docs, words)
    pair = spark.createDataFrame([(0, "alpha beta gamma delta " * 20), (1, "delta beta alpha gamma gamma alpha delta beta " * 10)], "doc_id long, text string")
    s = {r.id: r.log_p for r in lm_scoring.network_scores(pair, words, net, "doc_id", "text").collect()}
    assert s[0] > s[1] + 10


def test_lm_knows_documents_that_occur_twice(spark, sf_dir):
    """Of texts that occur once and texts that occur twice, the latter score higher: the memory counts without the token itself."""
    texts = [r["text"] for r in read("/root/testdata/sf0.01", "documents") if 300 < len(r["text"]) < 6000]
    texts = list(dict.fromkeys(texts))[:400]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:40])], "doc_id long, text string")
    words = lm_scoring.vocabulary(docs)
    rows = lm_scoring.score(docs, words, lm_scoring.train(docs, words)).collect()
    mean = {r.doc_id: r.log_likelihood / max(1, r.n_tokens) for r in rows}
    once = sorted(mean[i] for i in range(40, len(texts)))
    bar = once[int(0.9 * len(once))]
    assert sum(mean[i] > bar for i in range(40)) >= 28


def test_lm_lookup(spark):
    words = lm_scoring.Vocabulary([("a", 5), ("b", 3)], 4, {"": -1.0, "x": -2.0}, -3.0)
    look = words.lookup()
    texts = ["a b x xx xxx", "", "A Y1 y2", " ".join(f"q{i}😀" for i in range(70_000)) + " b", "xx a \x85 \x1c İ"]
    sizes, numbers = look.batch(texts)
    flat = [w for t in texts for w in t.lower().split()]
    assert list(sizes) == [len(t.lower().split()) for t in texts] and len(numbers) == len(flat)
    for w, i in list(zip(flat, numbers, strict=True))[::97]:
        if w in ("a", "b"):
            assert (look.rank[i], look.spelt[i]) == ("ab".index(w), 0.0)
        else:
            assert look.rank[i] == 2 + xxhash.xxh64_intdigest(w.encode()) % lm_scoring.SLOTS
            assert look.spelt[i] == pytest.approx(-1.0 + sum(words.chars.get(c, -3.0) for c in w))
        assert look.hash[i] == xxhash.xxh64_intdigest(w.encode())
    look.MOST_WORDS = 50  # forgets, and goes on with the same answers
    for text in ("a b x", "q1 q2 b", " ".join(f"r{i}" for i in range(60)), "x r3 a"):
        _, numbers = look.batch([text])
        assert [look.hash[i] for i in numbers] == [xxhash.xxh64_intdigest(w.encode()) for w in text.split()]
    _, numbers = look.batch(["a b"])
    assert len(look) <= 112 and look.rank[numbers].tolist() == [0, 1]


def test_hash_sample_is_the_start_of_one_order(spark):
    df = spark.range(3000).select(F.col("id").alias("k"))
    whole = [r.k for r in hash_sample(df, "k", 3000, 3000)]
    assert sorted(whole) == list(range(3000)) and [r.k for r in hash_sample(df, "k", 40, 3000)] == whole[:40]
    assert [r.k for r in hash_sample(df, "k", 40, 10**9)] == whole[:40]  # a wrong total costs a second pass only


def test_lm_memory_counts_every_context(spark):
    """As shipped, each context has a cell: a text put in twice gains in each of its contexts, not in a hashed fraction."""
    rnd = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rnd.integers(0, 10**6, 300)) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:3])), "doc_id long, text string")
    words = lm_scoring.vocabulary(docs, most_words=40)
    net = lm_scoring.train(docs, words, classes=8, members=5, hidden=4)
    got = {r.doc_id: r.log_likelihood for r in lm_scoring.score(docs, words, net).collect()}
    for i, (n, p) in enumerate(brute_scores(texts + texts[:3], words, net, 1, lm_scoring.SHARE)):
        assert n == 300 and got[i] == pytest.approx(p, rel=1e-3)
        assert (got[i] > 300 * np.log(lm_scoring.SHARE) - 1) == (i % 6 < 3)  # each token is known to the other copy


@pytest.mark.parametrize("frequent", [0, 3])
def test_lm_common_cells_are_counted_beforehand(spark, monkeypatch, frequent):
    """Cells of frequent words and of the texts' ends, over several buckets: the same scores as by plain loops."""
    monkeypatch.setattr(lm_scoring, "hot_bound", lambda *_: 1)
    monkeypatch.setattr(lm_scoring, "max", lambda a, b: b if a == 1 << 14 else max(a, b), raising=False)
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    rnd = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in np.minimum(rnd.geometric(0.3, rnd.integers(0, 40)), 12)) for _ in range(80)] + ["w1", "w1", "solo", "w1 " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = lm_scoring.vocabulary(docs, most_words=8)
    common = lm_scoring.common_cells(docs, words)
    assert len(common.words) == frequent and words.buckets() == lm_scoring.LEAST_BUCKETS
    net = lm_scoring.train(docs, words, classes=2, members=4, hidden=4)
    got = {r.doc_id: (r.n_tokens, r.log_likelihood) for r in lm_scoring.score(docs, words, net).collect()}
    assert (net.common.counts == common.counts).all()  # counted on the way, too
    for i, (n, p) in enumerate(brute_scores(texts, words, net, 1, lm_scoring.SHARE)):
        assert got[i][0] == n and got[i][1] == pytest.approx(p, rel=1e-3, abs=1e-2)
