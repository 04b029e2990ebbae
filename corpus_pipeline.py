"""From raw documents to encoded training text, in five stages.

Each stage takes what the one before kept, as Parquet, and its decisions take
effect: documents without a known language go, of near-duplicates (five-word
shingles, similarity 0.8 or more) the one with the smallest id stays, live credentials are replaced in the text, sources are
mixed to their target weights (whole documents, repeated by epoch), and what is
left is encoded and decoded. All stages but the last return the columns of
``documents``; the last gives the digests of :func:`signalmill.llm.bpe.round_trip`.

Null, empty, repeated and very long texts, ties, empty tables and extra columns
are treated as the operators' modules say. Rows that share an id stand or fall
together in the second stage, which keeps one of exact repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signalmill.llm import bpe, langid, mixing, secrets, similar
from signalmill.llm.common import new_folder, table, tune

#: SQL can't express the network, the fingerprints' links or the merges; the
#: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known."""
    tune(spark)
    return langid.confident(docs, langid.fitted(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group whose five-word shingles
    are similar to 0.8 or more, by SimHash and multi-index hashing."""
    tune(spark)
    return similar.without_similar(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live credentials in the texts; no document goes."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents until every source has its share of the token budget."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left."""
    import public_tokenizers

    tune(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's rows are written to the
    shared folder and read again, so a lost executor costs a part of one stage."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
