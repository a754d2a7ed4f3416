"""Extra columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from pactum.llm import bpe, cotraining, fingerprints, line_dedup, lm_scoring, packing, quality_rules, sharding, simhash, toxicity

from .cases import awkward

NAMES = (
    "id h k k1 k2 i j t u v fp key keys print prints root node lo hi tid first_id one class rows count line lines doc pos version drop_runs first_doc kept_text n_lines n_dropped n_words word_chars n_symbols "
    "n_dup_lines n_repeat_words base_failed kept measure bin n total most size shard slot row next block place need stays begin sketch edited score offending predicted y view url page text_logit ids decoded start "
    "length offset window step_group sequence_id words word log_likelihood n_tokens flat stays part a b p r"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).where("length(text) < 5000 or text is null").select("*", *[F.lit(f"extra {n}").alias(n) for n in dict.fromkeys(NAMES)])


def test_passed_columns_are_untouched(spark, docs):
    n = docs.count()
    results = {
        "shard": (sharding.shard(docs, 3), {"size", "shard", "slot"}, n),
        "dedup": (line_dedup.dedup_lines(docs), {"kept_text", "n_lines", "n_dropped"}, n),
        "judge": (quality_rules.judge(docs), {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, n),
        "toxic": (toxicity.keep_clean(docs, toxicity.Model(-5.0)), set(), n),
        "near": (simhash.keep_one(docs), set(), None),
    }
    for name, (out, replaced, rows) in results.items():
        got = out.collect()
        assert rows is None or len(got) == rows, name
        assert set(docs.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns)), name
        assert all(r[c] == f"extra {c}" for r in got for c in set(NAMES) - replaced), name


def test_other_operators_do_not_mind(spark, docs):
    n = docs.count()
    pages = spark.createDataFrame([(1, "http://x")], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)], "doc_id long, toxic int, quality int")
    words = lm_scoring.vocabulary(docs)
    outs = [
        bpe.decode(bpe.encode(docs)), simhash.near_duplicates(docs), fingerprints.with_edited(docs), toxicity.score(docs, toxicity.train(docs, labels)),
        cotraining.score(docs, pages, cotraining.train(docs, labels, pages)), lm_scoring.score(docs, words, lm_scoring.train(docs, words)),
    ]
    assert [o.count() for o in outs] == [n] * len(outs)
    assert packing.pack(docs).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
