"""SimHash classes against all pairs, and the index's exact ways for large lists."""

import random

import numpy as np
import pytest
import xxhash

from pactum.llm import common, simhash
from pactum.llm.queries import QUERIES

from .cases import awkward, empty, read


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(nodes, distance=4):
    """nodes: values; the smallest member's index by union over all pairs."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    values = sorted(nodes)
    arr = np.array(values, dtype=np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= distance):
            a, b = sorted((root(v), root(values[i + 1 + j])))
            parent[b] = a
    return {n: root(n) for n in nodes}


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = read(d, "documents")
    fps = {r["doc_id"]: brute_print(r["text"]) for r in docs}
    roots = brute_classes(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(least.get(roots[f], i), i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash"](spark, d).collect()}
    assert got == {i: (f"{f:016x}", least[roots[f]]) for i, f in fps.items()}
    assert len({c for _, c in got.values()}) < len(docs)


def clustered(n, seed=7):
    """Fingerprints in dense groups, chains and noise."""
    rnd, out = random.Random(seed), set()
    flip = lambda f, k: f ^ sum(1 << b for b in rnd.sample(range(64), k))
    for size in (n, n // 4, 40, 3):
        base = rnd.getrandbits(64)
        out |= {flip(base, rnd.randrange(0, 6)) for _ in range(size)}
        for _ in range(30):
            out.add(base)
            base = flip(base, 4)
    return out | {rnd.getrandbits(64) for _ in range(n)} | {0, (1 << 64) - 1}


signed = lambda f: f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("most_listed", [8, simhash.MOST_LISTED])
def test_links_keep_every_component(spark, most_listed):
    fps = clustered(400 if most_listed > 8 else 60)
    want = brute_classes(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = simhash.links(df, most_listed=most_listed)
    if most_listed > 100:
        assert found.count() < 70 * len(fps)
    got = {r.node: r.root for r in simhash.components(found).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(signed(f))
    for members in groups.values():
        roots = {got.get(m, m) for m in members}
        assert len(roots) == 1
        assert min(members) in roots


def test_long_chain_has_one_root(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[501] == 500
    assert simhash.components(df.where("false")).count() == 0


def test_tallies_are_plain_counts():
    rnd = random.Random(5)
    values = [rnd.getrandbits(64) for _ in range(50)]
    own = values[0] ^ 0xFF00FF
    values += [own, own ^ 1, own ^ (1 << 63)]
    got = simhash.tallies(np.array(values, dtype=np.uint64).reshape(-1, 1), np.array([own], dtype=np.uint64))
    assert got.tolist() == [sum(v >> 8 * k & 255 == own >> 8 * k & 255 for k in range(8)) for v in values]


def test_index_is_a_plain_tally(spark):
    """The pairs that share a list are those whose tally over posting lists of single bytes reaches four."""
    fps = sorted({f ^ (rnd.getrandbits(64) & 0xFF00FF00FF) for rnd in [random.Random(9)] for f in (random.Random(k % 12).getrandbits(64) for k in range(300))})
    postings = {}
    for f in fps:
        for k in range(8):
            postings.setdefault((k, f >> 8 * k & 255), []).append(f)
    tally = {}
    for members in postings.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                tally[a, b] = tally.get((a, b), 0) + 1
    lists = {}
    for i, m in enumerate(simhash.choices(8, 1, 4)):
        for f in fps:
            lists.setdefault((i, f & (m % (1 << 64))), []).append(f)
    met = {(a, b) for members in lists.values() for i, a in enumerate(members) for b in members[i + 1 :]}
    assert met == {pair for pair, n in tally.items() if n >= 4} and met


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(common, "hot_bound", lambda rows, _: 5)
    star = [(0, i) for i in range(1, 60)] + [(100, 101), (101, 102), (59, 61)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(star, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 60)}, 61: 0, 101: 100, 102: 100}
    prints = spark.createDataFrame([(i, i % 3) for i in range(90)] + [(200, 1 << 40)], "id long, fp long")
    got = {r.id: r.component_id for r in simhash.classes(prints).collect()}
    assert got == {**{i: 0 for i in range(90)}, 200: 0}  # one, two and 2^40 differ from zero in one or two bits


def test_awkward(spark):
    docs = awkward(spark, extra=True)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: brute_print(r.text) for r in docs.collect() if r.doc_id is not None}
    assert all(r.fp % (1 << 64) == by_id[r.id] for r in rows if r.id is not None)
    same = {r.component_id for r in rows if r.id in (0, 1, 2)}
    assert same == {0} and {r.component_id for r in rows if r.id in (10, 11)} == {10}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_majority_over_many_rows():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, (1000, 3), dtype=np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(1000, 3, 8), axis=2, bitorder="little").sum(axis=0) * 2 > 1000
    assert (simhash.majority_bits(hashes) == np.packbits(bits.reshape(3, 64), axis=1, bitorder="little").view(np.uint64).ravel()).all()
