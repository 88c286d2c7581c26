"""A corpus pipeline over `documents`: toxic texts go, one of each group of near-duplicates
stays, secrets are masked, sources are mixed to target weights, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the packed
pieces. Between stages the rows are written as Parquet and read again. Null texts, repeated rows and
columns beside those of documents pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import mixing, neardup, packing, secrets, toxicity
from larkspur.llm.common import materialise, quoted, spare


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = spare(docs, "score")
    return toxicity.score(docs, model, into=score).filter(F.col(score) < toxicity.THRESHOLD).select(*map(quoted, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.without_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked."""
    base, spans = spare(docs, "base", "spans")
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(spark)), into=(base, spans))
    text = F.when(F.size(spans) == 0, F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col(spans)))
    n_chars = F.when(F.size(spans) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return found.withColumn("text", text).withColumn("n_chars", n_chars).select(*map(quoted, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, shard by shard in the order of positions: a row for each time that a document, or some blocks of it, are used."""
    return mixing.in_mixed_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.packed_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages use a fitted classifier, signatures and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held: tuple[DataFrame, ...] = ()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name, drop=held)
            held = (docs,)
    return docs
