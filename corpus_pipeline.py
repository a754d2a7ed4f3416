"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept, and is written as Parquet and read again as the next one's documents.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions.checkpoints import shared_folder
from pactum.llm import line_dedup, packing, quality_rules, simhash, toxicity
from pactum.llm.common import table

#: SQL can express neither the learnt stage nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model scores 0.5 or higher go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or exceed their group's adaptive thresholds go."""
    return quality_rules.judge(docs).where("kept").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; documents stay."""
    deduped = line_dedup.dedup_lines(docs)
    changed = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return deduped.withColumns({c: x for c, x in changed.items() if c in docs.columns}).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the first stays."""
    return simhash.keep_one(docs, n_words=5, similarity=0.8).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with the ids of each piece."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("packing", pack_sequences),
]


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a stage's table was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def run(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """Applies all stages to `documents`; stages meet in Parquet in the cluster's shared folder.

    A `root` folder of an earlier run over the same documents resumes it: tables
    of stages that were written to their end are read, not made again.
    """
    root = root or f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        if not _complete(spark, f"{root}/{name}"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
