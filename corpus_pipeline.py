"""A training corpus from raw documents: language, quality, near-duplicates, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs; every stage works on all that the one before kept. Decisions take effect: rejected documents go, one document of each
near-duplicate group stays, documents come as often as the mixture takes them, and the last stage returns piece ids.
Labels are read from sf_dir. Null, empty and repeated rows behave as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import common, langid, mixing, nearcopies, pieces, quality


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the filters know."""
    return langid.keep(docs, langid.fit(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the quality rules."""
    return quality.keep(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts linked at Jaccard 0.8 or more over five-word shingles: SimHash classes, checked on the
    whole shingle sets, then an exact search for the links that lie beyond any useful SimHash radius."""
    return nearcopies.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents as often as the target weights of their sources take them."""
    return mixing.repeat_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document."""
    return pieces.encode_documents(docs, pieces.model_path(), ids=True, remembered=100_000)


STAGES = [
    ("language ID", language),
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", encoding),
]

#: Fitted models, XXH64 and piece lattices are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, written = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if written is not None:  # the stage before is read no more
            common.drop_scratch(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
