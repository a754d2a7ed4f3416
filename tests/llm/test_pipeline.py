"""Each pipeline stage against brute force on its own input."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pactum.llm import simhash, toxicity

from .cases import PROSE, awkward, empty
from .test_layout import check_pieces
from .test_native import brute_lines, brute_measures, sha

D = "/root/testdata/sf0.01"


def rows(df):
    return [r.asDict() for r in df.collect()]


def shingles(text, n=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    w = [x for x in w if x]
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_groups(docs, similarity=0.8):
    """Doc ids by component of all pairs at the similarity."""
    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s or {""}:
            holders[x].append(i)
    for i, s in sets.items():
        shared = Counter(j for x in s or {""} for j in holders[x] if j > i)
        for j, n in shared.items():
            if (not s and not sets[j]) or n >= similarity * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output over the whole table."""
    top, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{D}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, D).write.parquet(f"{top}/{name}")
        out[name] = (docs, spark.read.parquet(f"{top}/{name}"))
        docs = out[name][1]
    return out


def test_columns_pass(stages):
    for name, (given, got) in list(stages.items())[:-1]:
        assert got.columns == given.columns, name


def test_toxicity(spark, stages):
    given, got = stages["toxicity"]
    scorer = toxicity.train(given, spark.read.parquet(f"{D}/labels.parquet")).scorer()
    assert {r["doc_id"] for r in rows(got)} == {r["doc_id"] for r in rows(given) if scorer.score(r["text"])[0] < 0.5}
    assert 0.8 * given.count() < got.count() < given.count()


def test_quality(stages):
    given, got = stages["quality_rules"]
    kept = {r["doc_id"] for r in rows(got)}
    assert all(not brute_measures(r["text"])[-1] for r in rows(got))
    assert len(kept) > 0.6 * given.count()


def test_line_dedup(stages):
    given, got = stages["line_dedup"]
    want = {i: digest for i, _, _, digest in brute_lines(rows(given))}
    assert {r["doc_id"]: sha(r["text"]) for r in rows(got)} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows(got))


def test_near_duplicates(stages):
    given, got = stages["simhash"]
    roots = brute_groups(rows(given))
    assert sorted(r["doc_id"] for r in rows(got)) == sorted(set(roots.values()))


def test_packing(stages):
    given, got = stages["packing"]
    padding, _ = check_pieces(got.collect(), [(r["doc_id"], r["text"]) for r in rows(given)])
    assert padding <= 2048 * given.rdd.getNumPartitions()


@pytest.mark.parametrize("block,most_listed", [(simhash.BLOCK, simhash.MOST_LISTED), (16, simhash.MOST_LISTED), (4, 6)])
def test_near_duplicates_of_a_large_group(spark, block, most_listed):
    base = [f"word{i}" for i in range(120)]
    texts = []
    for k in range(60):
        w = list(base)
        w[(7 * k) % 120] = f"other{k}"
        if k % 3 == 0:
            w[(11 * k + 50) % 120] = f"more{k}"
        texts.append(" ".join(w))
    texts += texts[:20] + [" ".join(f"alone{k}x{i}" for i in range(60)) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.keep_one(docs, block=block, most_listed=most_listed)
    roots = brute_groups(rows(docs))
    assert sorted(r["doc_id"] for r in rows(got)) == sorted(set(roots.values()))


def test_block_rows_grow_linearly_with_a_family(spark, monkeypatch):
    """One family of near copies: rows sent to blocks per text stay about the same as it grows."""
    sent = []
    real = simhash._blocked
    monkeypatch.setattr(simhash, "_blocked", lambda rows, *a: (sent.append(rows.count()), real(rows, *a))[1])
    per_text = []
    for size in (200, 800):
        base = [f"word{i}" for i in range(200)]
        texts = [" ".join(base[:j] + [f"other{k}"] + base[j + 1 :]) for k in range(size) for j in [(7 * k) % 200]]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        sent.clear()
        assert [r.doc_id for r in simhash.keep_one(docs, block=32).collect()] == [0]
        per_text.append(sum(sent) / size)
    assert max(per_text) < 3 and per_text[1] < 1.3 * per_text[0], per_text


@pytest.mark.parametrize("block", [simhash.BLOCK, 24])
def test_near_duplicates_of_loose_variants(spark, block):
    """A family most of whose pairs are below 0.8, whole and in blocks: components are those of all pairs."""
    rnd = random.Random(3)
    base, texts = [f"word{i}" for i in range(150)], []
    for k in range(150):
        w = list(base)
        for _ in range(rnd.randrange(1, 8)):
            w[rnd.randrange(150)] = f"other{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate([" ".join(base), *texts])), "doc_id long, text string")
    roots = brute_groups(rows(docs))
    assert 10 < len(set(roots.values())) < 140
    assert sorted(r["doc_id"] for r in rows(simhash.keep_one(docs, block=block))) == sorted(set(roots.values()))


@pytest.mark.parametrize("way", ["appended", "replaced"])
def test_near_duplicates_with_another_passage(spark, sf_dir, way):
    """Pairs at 0.8 to 0.9 that differ in one block: the whole table's prose, each text with a passage of the next."""
    texts = [d["text"].split() for d in rows(spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 600").orderBy("doc_id").limit(160))]
    docs = []
    for i, (own, other) in enumerate(zip(texts, texts[1:])):
        n = int(len(own) * (0.11 + 0.1 * (i % 10) / 10) / (1 if way == "appended" else 2))
        near = (own if way == "appended" else own[: len(own) - n]) + other[:n]
        docs += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(near))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    roots = brute_groups(rows(frame))
    assert sum(roots[2 * i] == roots[2 * i + 1] for i in range(len(texts) - 1)) > 100
    assert sorted(r["doc_id"] for r in rows(simhash.keep_one(frame))) == sorted(set(roots.values()))


def test_near_duplicates_awkward(spark):
    docs = awkward(spark, extra=True)
    got = rows(simhash.keep_one(docs))
    assert list(got[0]) == docs.columns
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) and 10 in ids and 11 not in ids and 0 in ids and 1 not in ids and 2 not in ids
    assert simhash.keep_one(empty(spark)).count() == 0
    assert any(r["text"] == PROSE for r in got)


def test_stages_take_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), D).count() == 0, name


def test_stages_take_awkward_rows(spark):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
        docs.collect()


def test_near_duplicate_candidates_come_from_the_position_index(spark):
    """Prints are majorities of their shingles' votes, and lists hold exactly the pairs that share a positional value."""
    rnd = np.random.default_rng(4)
    sets = [rnd.integers(0, 1 << 64, n, dtype=np.uint64) for n in (1, 4, 5, 130, 300)]
    for x in sets:
        votes = simhash._mixed(x[:, None] ^ simhash._SALTS).reshape(2 * len(x), -1)
        bits = np.unpackbits(votes.view(np.uint8), axis=1, bitorder="little").reshape(2 * len(x), -1).sum(axis=0) > len(x)
        assert (simhash.wide_simhash(x) == np.packbits(bits, bitorder="little").view(np.uint64)).all()
    prints = {i: simhash.wide_simhash(np.concatenate([sets[4][: 300 - 30 * i], sets[3][: 4 * i]])) for i in range(6)}
    frame = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in prints.items()], "tid long, print binary")
    lists = defaultdict(list)
    for r in simhash.positional_index(frame).collect():
        lists[r.key].append(r.tid)
        assert [r.a, r.b] == prints[r.tid][-2:].view(np.int64).tolist()
    tally = Counter((i, j) for x in lists.values() for i in x for j in x if i < j)
    positions = {i: p[:-2].view(np.uint16) for i, p in prints.items()}
    want = {(i, j): int((positions[i] == positions[j]).sum()) for i in prints for j in prints if i < j}
    assert {k: n for k, n in want.items() if n} == dict(tally) and min(want[i, i + 1] for i in range(5)) >= 1


def test_links_of_short_lists_are_those_of_sweeps():
    rnd = np.random.default_rng(7)
    prints = rnd.integers(0, 1 << 64, (400, 2), dtype=np.uint64)
    prints[1::2] = prints[::2] ^ (np.uint64(1) << rnd.integers(0, 64, (200, 2), dtype=np.uint64))
    keys, ids = np.repeat(np.arange(40), 10), np.arange(400)
    found = {(a, b) for u, v in simhash.short_links(keys, ids, prints, keys % 2 == 0, 41) for a, b in zip(u, v)}
    near = lambda a, b: np.bitwise_count(prints[a] ^ prints[b]).sum() <= 41
    assert found == {(a, b) for a in range(400) for b in range(a + 1, 400) if keys[a] == keys[b] and keys[a] % 2 == 0 and near(a, b)}
    assert len(found) >= 100 and simhash.apart(prints[::2][:5], 10) and not simhash.apart(prints[:4], 41)


@pytest.mark.parametrize("most_held", [20, 1 << 20])
def test_thinned_links_keep_their_components(spark, most_held):
    rnd = random.Random(2)
    pairs = [(10 * g + rnd.randrange(10), 10 * g + rnd.randrange(10)) for g in range(12) for _ in range(60)]
    df = spark.createDataFrame(pairs, "u long, v long").repartition(4)
    got = simhash.thinned(df, most_held)
    assert {tuple(r) for r in simhash.components(got).collect()} == {tuple(r) for r in simhash.components(df).collect()}
    assert got.count() < 300
