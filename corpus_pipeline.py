"""Training corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's documents. All but the last keep the columns
of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sievework.llm import decontaminate, jaccard, packing, pii, toxicity
from sievework.llm.common import release_memory, saved
from sievework.session import raw_table

VOCABULARY = "word_bpe_49k.json"


def _aside(docs: DataFrame, work) -> DataFrame:
    """``work`` on the documents with all columns but id and text under neutral
    names, so that no column made on the way clashes with one of theirs."""
    names = {c: f"_column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = work(docs.withColumnsRenamed(names))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    model = toxicity.fit_toxicity(docs, raw_table(spark, sf_dir, "labels"))
    return _aside(docs, lambda d: toxicity.score_toxicity(d, model).where("score < 0.5"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the least id."""
    # What fitting the model before took of the driver.
    release_memory()
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    items = raw_table(spark, sf_dir, "benchmark")
    return _aside(docs, lambda d: decontaminate.decontaminate(d, items).where("n_hit = 0"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become the names of their kinds; n_chars follows the text."""
    out = _aside(docs, lambda d: pii.redact(pii.find_pii(d)))
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 4096."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pii", redact_personal),
    ("packing", pack),
]
# Learned scores and spans have no SQL form; tests compare the stages with plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's result written and read again."""
    docs = raw_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
