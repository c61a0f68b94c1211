"""A corpus pipeline of five stages over the table documents: language, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last one with the columns of documents. Null and empty texts have no language and
leave at the first stage; an empty table gives an empty table at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import exact_dedup, language_id, ngram_join, packing, pii
from nearfield.llm.common import free_name, stash
from nearfield.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Those without a letter go, and all if nothing tells what a language looks like."""
    prototypes = language_id.learn(docs.where(~language_id.held_out_split(docs)).select("text", "lang"))
    lang, score = (free_name(docs.columns, name) for name in ("found_lang", "found_score"))
    found = language_id.identify(docs, prototypes, lang_col=lang, score_col=score)
    return found.where(F.col(lang) != language_id.UNDETERMINED).select(*(F.col(f"`{c}`") for c in docs.columns))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (lower-cased A-Z), that with the largest doc_id."""
    with exact_dedup.DigestIndex(spark) as index:
        return index.filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones, that with the smallest doc_id."""
    return ngram_join.Join(docs).filter(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind in brackets; n_chars follows the text."""
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: SQL can't express the learned stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
