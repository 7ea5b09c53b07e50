"""Corpus pipeline: toxicity, near-duplicates, repeated passages, secrets, packing.

Each stage is a function of (spark, docs, sf_dir) whose docs are what the stage
before it kept; all but the last return the columns of documents.  Rejected
documents go, of each near-duplicate class one document stays, repeated passages
are cut out, secrets are masked, and the last stage packs what is left.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from readweaver.llm import orderhash, packing, secrets, substring, toxicity
from readweaver.llm.common import discard, durable, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars that of the text as it is now."""
    return docs.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the classifier that the labelled ones among docs train."""
    return toxicity.keep_clean(docs.select(*COLUMNS), toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest doc_id."""
    return orderhash.representatives(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that start earlier; a document that loses all its words goes."""
    return _counted(substring.rewrite(docs.select(*COLUMNS)))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mask."""
    rest = tuple(c for c in COLUMNS if c != "text")
    found = secrets.scan(docs, secrets.train(secrets.default_samples(spark)), rest)
    return _counted(found.withColumn("text", secrets.redact(F.col("secret_text"), F.col("secret_spans"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their places in sequences of 4096."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Stages with a classifier, alignment and a tokenizer have no SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
            discard(before)
    return docs
