"""Sharding, packing and BPE against plain Python and the public libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pactum.llm import bpe, packing, sharding
from pactum.llm.queries import QUERIES

from .cases import AWKWARD, awkward, empty, read


def check_shards(rows, texts, shards, slack):
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    slots, sizes = defaultdict(list), Counter()
    by_id = defaultdict(list)
    for i, t in texts:
        by_id[i].append(t)
    for r in rows:
        assert r.size in {len((t or "").encode()) + 1 for t in by_id[r.doc_id]}
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    fair = sum(sizes.values()) / shards
    assert all(abs(sizes[s] - fair) <= slack for s in range(shards)), sizes
    return sizes


def test_sharding_whole_table(spark, sf_dir):
    docs = read(sf_dir, "documents")
    rows = QUERIES["op1_sharding"](spark, sf_dir).collect()
    check_shards(rows, [(d["doc_id"], d["text"]) for d in docs], 8, max(len(d["text"].encode()) for d in docs) + 1)
    crc = {d["doc_id"]: zlib.crc32(d["text"].encode()) for d in docs}
    assert all(r.text_crc32 == crc[r.doc_id] and r.law == "bytes" and r.grown_shard is None for r in rows)


def test_sharding_divides_a_hot_group(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    rows = sharding.shard(docs, 5, task_bytes=4096).collect()
    sizes = check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 5, 60)
    assert max(sizes.values()) / min(sizes.values()) < 1.01
    shards = defaultdict(set)
    for r in rows:
        shards[r.text].add(r.shard)
    assert sum(len(v) for v in shards.values()) <= len(shards) + 4  # only splitters divide equal texts


def test_sharding_gathers_counts_of_splitters_only(spark):
    """With thousands of partitions and tiny texts neither the driver nor a broadcast holds more than the splitters' intervals."""
    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    keyed = docs.select(sharding.sort_key("doc_id", "text").alias("__key"), sharding.size_of(F.col("text")).alias("__size")).cache()
    splitters, gathered = sharding.histogram_rounds(keyed, 8, 1e-6)
    assert len(gathered) > 1 and gathered[0] <= 1 << 12 and all(n <= 7 << 12 for n in gathered[1:])
    order = sorted((r[0] % (1 << 64), r[1]) for r in keyed.collect())
    for s in splitters:
        below = [size for k, size in order if k < s.key]
        assert (sum(below), len(below)) == (s.size, s.rows)
    keyed.unpersist()
    for total in (0, 1, 10**6, 10**14, 10**17):
        assert total / (1 << sharding.bucket_bits(total, 64 << 20)) <= max(64 << 20, total / (1 << 24))


def test_sharding_is_in_key_order(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    for parts in ("8", "4096"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", parts)
        try:
            rows = sharding.shard(docs, 4).withColumn("k", sharding.sort_key("doc_id", "text")).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        order = sorted((r.shard, r.slot, r.k % (1 << 64)) for r in rows)
        assert [k for _, _, k in order] == sorted(k for _, _, k in order)
        check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 4, 60)


def test_sharding_refuses_reserved_names(spark):
    with pytest.raises(ValueError, match="reserved"):
        sharding.shard(awkward(spark).withColumn("__key", F.lit(1)))


def test_sharding_awkward(spark):
    docs = awkward(spark, extra=True)
    out = sharding.shard(docs, 4)
    assert out.columns == [*docs.columns, "size", "shard", "slot"]
    check_shards(out.collect(), [(r.doc_id, r.text) for r in docs.collect()], 4, 80_000)
    assert sharding.shard(empty(spark), 4).count() == 0


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    t.encode_special_tokens = True
    return t


def check_pieces(rows, texts):
    """rows: (doc_id, start, length, ids, doc_tokens, sequence_id, offset); texts: unique (doc_id, text)."""
    tokens, pieces, sequences = library(), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {i for i, _ in texts}
    for i, t in texts:
        want = [*tokens.encode(t or "", add_special_tokens=False).ids, 1]
        got = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in got] == list(np.cumsum([0, *(r.length for r in got)])[:-1])
        assert b"".join(bytes(r.ids) for r in got) == np.array(want, "<u4").tobytes()
        assert all(r.doc_tokens == len(want) and r.length * 4 == len(r.ids) > 0 for r in got)
    padding = 0
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == list(np.cumsum([0, *(r.length for r in rs)])[:-1])
        n = sum(r.length for r in rs)
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    return padding, sequences


def test_packing_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs).collect()
    padding, sequences = check_pieces(rows, [(d["doc_id"], d["text"]) for d in read(sf_dir, "documents")])
    assert padding <= 2048 * docs.rdd.getNumPartitions()
    assert len({r.window for r in rows}) >= 3
    check_steps(sequences)
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in QUERIES["op2_packing"](spark, sf_dir).collect()}
    assert digest == {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in rows}


def check_steps(sequences, step_tokens=packing.STEP_TOKENS):
    """All step groups of a window size hold the same number of tokens, but one at most."""
    steps, sizes = Counter(), {}
    for rs in sequences.values():
        assert len({(r.step_group, r.window) for r in rs}) == 1
        steps[rs[0].step_group] += rs[0].window
        assert sizes.setdefault(rs[0].step_group, rs[0].window) == rs[0].window
    short = Counter(sizes[g] for g, n in steps.items() if n < step_tokens)
    assert max(steps.values()) == step_tokens and max(short.values(), default=0) <= 1, short


def test_packing_balances_steps_over_tasks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(13)
    rows = packing.pack(docs, step_tokens=4 * 2048).collect()
    assert len({r.sequence_id >> packing.TASK_SHIFT for r in rows}) == 13
    _, sequences = check_pieces(rows, [(d["doc_id"], d["text"]) for d in read(sf_dir, "documents")])
    check_steps(sequences, 4 * 2048)


def test_packing_awkward(spark):
    docs = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    check_pieces(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert packing.pack(awkward(spark, extra=True)).where("doc_id is null").count() >= 1
    assert packing.pack(empty(spark)).count() == 0


def test_word_tokens_are_the_librarys():
    words = packing.WordTokens(public_tokenizers.path(packing.VOCABULARY))
    tokens, rnd = library(), random.Random(1)
    odd = ["don't we'll it's 'tis", "'s's 'LL' x'", "12 3a4b", "É ÇA ß ÿ × ÷", "a_b-c…", "<|endoftext|> x", "ﬁ Å ΑΣ", "`code` ’tis “q”", "µ ª º ¼ ²"]
    odd += ["".join(rnd.choices("ab'sl d1.é\n\t$É’ ", k=40)) for _ in range(500)]
    texts = [*odd, *(t or "" for t in AWKWARD)]
    assert words.encode(texts) == [np.array(tokens.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def tiktoken_encoding():
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path(bpe.MULTILINGUAL))
    return tiktoken.Encoding("reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_whole_table(spark, sf_dir):
    enc, got = tiktoken_encoding(), {r.doc_id: r for r in QUERIES["op5_bpe"](spark, sf_dir).collect()}
    docs = read(sf_dir, "documents")
    assert len(got) == len(docs)
    for d in docs:
        ids = enc.encode_ordinary(d["text"])
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest())
        r = got[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


@pytest.mark.parametrize("leaf", [2, 3, 7, 64])
def test_bpe_joins_are_exact(leaf):
    codec, enc, rnd = bpe.TreeCodec(public_tokenizers.path(bpe.MULTILINGUAL), leaf_chars=leaf), tiktoken_encoding(), random.Random(leaf)
    texts = ["".join(rnd.choices("ab'sltredvm  \n1é漢́.😀 \x1c", k=rnd.randrange(1, 90))) for _ in range(1500)]
    for t in [*texts, *(t[:3000] for t in AWKWARD if t)]:
        ids = codec.encode(t)
        assert ids == enc.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_bpe_awkward(spark):
    docs = awkward(spark, extra=True)
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert Counter(bytes(r.decoded).decode() for r in rows) == Counter(r.text or "" for r in docs.collect())
    assert bpe.decode(bpe.encode(empty(spark))).count() == 0
