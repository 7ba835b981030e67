"""Cleans and packs a document corpus: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder and reads back
as the next stage's docs. All stages but the last return the columns of documents.

Every stage takes null and empty texts as empty ones, null ids as ids like others, repeated rows each for itself (the
fourth keeps one of them) and an empty table as an empty result; other columns of docs, whatever their names, stay as
they are. Without labels the classifiers score 0.5: all documents count as good and as toxic, so none remain.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.llm import catalog, packing, quality, simhash, templates, toxicity
from strideline.llm.common import Scratch, materialize, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble scores under 0.3."""
    return quality.keep_good(docs, catalog.quality_model(spark, sf_dir))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the counterfactual-regularised classifier scores 0.3 or more."""
    return toxicity.drop_toxic(docs, catalog.toxicity_model(spark, sf_dir))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines whose templates recur across texts out of all but their first document; n_chars follows the text."""
    out = templates.line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose fingerprints (512 bits over sets of five-word shingles) are 0.8 similar or more."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good_quality),
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("simhash near-dedup", keep_one_of_near_duplicates),
    ("packing", pack),
]

#: The classifiers, fingerprints and tokens have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. A stage's scratch tables go when its result is written, and that goes when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with Scratch(spark) as scratch:
            docs, path = materialize(stage(spark, docs, sf_dir), "stage")
        scratch.drop(keep=path)
        if before:
            before.drop()
        before = scratch
    return docs
