"""The DataFrame-only operators against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pactum.llm import fingerprints, line_dedup, quality_rules
from pactum.llm.queries import QUERIES

from .cases import awkward, empty, read

WS = " \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def low(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def brute_lines(rows):
    key = lambda x: low(x.strip(WS))
    first = {}
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            i = LAST if r["doc_id"] is None else r["doc_id"]
            first[key(x)] = min(first.get(key(x), LAST), i)
    out = []
    for r in rows:
        i = LAST if r["doc_id"] is None else r["doc_id"]
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
        out.append((r["doc_id"], len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def same(a, b):
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_line_dedup_whole_table(spark, sf_dir):
    same(QUERIES["op7_line_dedup"](spark, sf_dir).collect(), brute_lines(read(sf_dir, "documents")))


@pytest.mark.parametrize("least_hot", [0, 3, 2048])
def test_line_dedup_awkward(spark, least_hot):
    docs = awkward(spark, extra=True)
    maps = line_dedup.keep_bitmaps(docs, least_hot=least_hot)
    out = line_dedup.apply_bitmaps(docs, maps)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = [(r.doc_id, r.n_lines, r.n_dropped, sha(r.kept_text)) for r in out.collect()]
    same(got, brute_lines([r.asDict() for r in docs.collect()]))


def test_line_dedup_buckets_follow_the_partitions():
    """An average bucket stays below the bound of a hot hash, a quarter of a partition's share of lines."""
    for parts in (1, 8, 2000, 16_384, 200_000):
        assert line_dedup.bucket_count(parts) >= 16 * 4 * parts or parts < 1025 and line_dedup.bucket_count(parts) >= 1 << 16


def test_line_dedup_refuses_reserved_names(spark):
    with pytest.raises(ValueError, match="reserved"):
        line_dedup.dedup_lines(awkward(spark).withColumn("__doc", F.lit(1)))


def test_line_dedup_empty(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def brute_measures(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    win = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if win[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if x.strip(WS):
            dup += x in seen
            seen.add(x)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_measures(spark, sf_dir):
    for docs in (awkward(spark, extra=True), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        for r in quality_rules.judge(docs).collect():
            want = brute_measures(r.text)
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
            assert got == want, r.doc_id
            assert not (r.kept and r.base_failed)


def test_quality_sketch_merges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = quality_rules.sketches(quality_rules.measure(docs))
    parts = [quality_rules.sketches(quality_rules.measure(docs.where(f"doc_id % 2 = {k}"))) for k in (0, 1)]
    keys = ["lang", "source", "measure", "bin"]
    merged = parts[0].union(parts[1]).groupBy(*keys).agg(F.sum("n").alias("n"))
    same(whole.collect(), merged.collect())


def test_quality_bins_are_narrow(spark):
    rows = spark.range(0, 5000).select("id", quality_rules.bin_of(F.col("id")).alias("b")).collect()
    assert all(r.b <= r.id and r.id - r.b <= r.b / 16 for r in rows)


def test_quality_thresholds_follow_their_group(spark):
    """A source whose every document is full of symbols keeps them; a single one elsewhere goes."""
    plain = " ".join(f"word{i}" for i in range(80))
    odd = " ".join(f"word{i}##" for i in range(80))
    rows = [(i, plain, "en", "plain", 0) for i in range(300)] + [(1000 + i, odd, "en", "odd", 0) for i in range(300)] + [(5000, odd, "en", "plain", 0)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not kept.pop(5000) and all(kept.values())


def test_quality_limits_are_the_sketches(spark):
    """On all of sf0.1: limits differ between groups in every measure, and one set of constants does not give the verdicts."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    measured = quality_rules.measure(docs).drop("text").cache()
    limits = quality_rules.thresholds(quality_rules.sketches(measured)).collect()
    assert len(limits) == measured.select("lang", "source").distinct().count()
    for m in quality_rules.MEASURES:
        assert len({r[m.replace("q_", "q_max_")] for r in limits}) > 5, m
    assert len({r.q_min_word_chars for r in limits}) > 8
    kept = {r.doc_id: r.kept for r in QUERIES["op4_quality_rules"](spark, d).select("doc_id", "kept").collect()}
    fixed = (F.col("q_symbols") <= 30) & (F.col("q_dup_lines") <= 500) & (F.col("q_repeats") <= 350) & (F.col("q_word_chars") <= 800) & (F.col("q_upper") <= 280)
    constants = {r.doc_id: r.k for r in measured.select("doc_id", (~F.col("base_failed") & fixed).alias("k")).collect()}
    assert sum(kept[i] != constants[i] for i in kept) > 20
    # thresholds against plain Python, from all values
    rows = measured.where(~F.col("base_failed")).select("lang", "source", *quality_rules.MEASURES).collect()
    for r in limits[::9]:
        for m in quality_rules.MEASURES:
            most, least = brute_limits(rows, r.lang, r.source, m)
            assert r[m.replace("q_", "q_max_")] == most
            assert r[m.replace("q_", "q_min_")] == (least if m in quality_rules.TWO_SIDED else None)
    measured.unpersist()


def brute_limits(rows, lang, source, m):
    short = lambda v: v >> max(v.bit_length() - 5, 0) << max(v.bit_length() - 5, 0)
    every, of_lang, own = (Counter(short(r[m]) for r in rows if f(r)) for f in (lambda r: True, lambda r: r.lang == lang, lambda r: (r.lang, r.source) == (lang, source)))
    mixed = lambda a, b: {k: 100 * a.get(k, 0) + n * 10_000 // sum(b.values()) for k, n in b.items()}

    def moments(w):
        total, seen = sum(w.values()), 0
        for mid in sorted(w):
            seen += w[mid]
            if 2 * seen >= total:
                break
        return mid, *(int(100 * sum(n * max(s * (k - mid), 0) for k, n in w.items()) / total) for s in (1, -1))

    wide = mixed(of_lang, every)
    (_, la, lb), (mid, a, b) = moments(wide), moments(mixed(own, wide))
    return mid + int(4 * min(a, 2 * la) / 100), mid - int(4 * min(b, 2 * lb) / 100)


def test_quality_junk_heavy_source_cannot_lift_its_limits(spark):
    plain, junk = " ".join(f"word{i}" for i in range(80)), " ".join(f"wo{i}##$$&&||" for i in range(80))
    rows = [(i, plain, "en", f"s{i % 4}", 0) for i in range(800)] + [(1000 + i, junk, "en", "s0", 0) for i in range(90)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(kept[i] for i in range(800)) and not any(kept[1000 + i] for i in range(90))


def test_quality_refuses_reserved_names(spark):
    with pytest.raises(ValueError, match="reserved"):
        quality_rules.judge(awkward(spark).withColumn("q_w", F.lit(1)))


def test_quality_empty(spark):
    assert quality_rules.judge(empty(spark)).count() == 0


def test_quality_keeps_clean_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = quality_rules.judge(docs).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    rates = {r.quality: r.rate for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates[1] > 0.97 and rates[0] < 0.1, rates


def test_fingerprints_whole_table(spark, sf_dir):
    rows = sorted(read(sf_dir, "documents"), key=lambda r: -r["doc_id"])
    want = {}
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        t, k = r["text"] or "", len(r["text"] or "") // 2
        want[r["doc_id"]] = (len(t), sha(t[: len(t) - k] + (nxt["text"] or "")[:k]), nxt["doc_id"])
    got = {r.doc_id: r for r in QUERIES["op8_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    sets = {i: {int(r.fingerprint[k : k + 16], 16) for k in range(0, len(r.fingerprint), 16)} for i, r in got.items()}
    by_text = defaultdict(set)
    error = []
    for i, r in got.items():
        n, digest, nxt = want[i]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        by_text[texts[i]].add(r.fingerprint)
        assert r.near_next == pytest.approx(len(sets[i] & sets[nxt]) / len(sets[i] | sets[nxt]))
        a, b = shingles(texts[i]), shingles(texts[i][: n - n // 2] + texts[nxt][: n // 2])
        error.append(r.near_edited - len(a & b) / max(1, len(a | b)))
        if len(a) > 8 and all(h >> 61 == 0 for h in sets[i]):
            assert len(sets[i]) < len(a) / 2 + 8
    assert all(len(v) == 1 for v in by_text.values())
    assert abs(sum(error) / len(error)) < 0.05 and sum(abs(e) for e in error) / len(error) < 0.12


def test_fingerprints_hold_every_hash_below_the_bound(spark):
    """The sketch against xxHash: a shingle's hash chains its words' XXH64 as seeds."""
    import xxhash

    d = "/root/testdata/sf0.01"
    bound, empty_or_one = (1 << 64) // fingerprints.SCALE, 0
    texts = {r["doc_id"]: r["text"] for r in read(d, "documents")}
    for r in QUERIES["op8_fingerprints"](spark, d).collect():
        hashes = set()
        for s in shingles(texts[r.doc_id]):
            h = 42
            for w in s.split(" "):
                h = xxhash.xxh64_intdigest(w.encode(), seed=h)
            hashes.add(h)
        low = {h for h in hashes if h < bound}
        empty_or_one += not low
        want = sorted(low or ({min(hashes)} if hashes else ()), key=lambda h: h - (1 << 64) if h >> 63 else h)
        assert r.fingerprint == "".join(f"{h:016X}" for h in want)
    assert empty_or_one < 200


def test_next_in_order_with_hashed_ids(spark):
    """Random 64-bit ids: blocks hold near equal shares, and the order is complete."""
    docs = spark.range(20_000).select(F.when(F.col("id") % 500 > 0, F.xxhash64("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = fingerprints.next_in_order(docs).collect()
    order = sorted(((r.id, -r.h) for r in rows), reverse=True)
    assert {(r.id, r.h): (r.next_id, r.next_h) for r in rows} == {(i, -h): (j, -k) for (i, h), (j, k) in zip(order, order[1:] + order[:1])}
    plan = docs.select(*fingerprints._identity("doc_id", "text")).repartitionByRange(8, F.col("id").desc(), "h")
    assert max(r["count"] for r in plan.groupBy(F.spark_partition_id()).count().collect()) < 2 * 20_000 / 8


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_awkward(spark):
    docs = awkward(spark, extra=True)
    out = fingerprints.with_edited(docs).collect()
    assert len(out) == docs.count()
    one = fingerprints.with_edited(docs.where("doc_id = 10")).collect()[0]
    assert one.edited[: len(one.edited) // 2] == one.text[: len(one.edited) // 2] and one.next_sketch == one.sketch
    assert all(list(r.sketch) == [] for r in out if not (r.text or "").strip(WS))
    assert all(r.sketch for r in out if (r.text or "").strip(WS))
    assert fingerprints.with_edited(empty(spark)).count() == 0


def test_fingerprints_merge_and_contain(spark):
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"b{i}" for i in range(4000))
    s = lambda t: fingerprints.sketch(F.lit(t))
    whole = a + " " + b
    r = spark.range(1).select(
        fingerprints.containment(s(a), s(whole)).alias("inside"),
        fingerprints.containment(s(whole), s(a)).alias("outside"),
        fingerprints.merge(s(a), s(b)).alias("merged"), s(whole).alias("whole"),
        fingerprints.from_string(fingerprints.to_string(s(a))).alias("back"), s(a).alias("a"),
    ).first()
    assert r.inside == 1.0 and 0.02 < r.outside < 0.25
    assert set(r.merged) <= set(r.whole) and len(set(r.whole) - set(r.merged)) <= 4
    assert r.back == r.a
