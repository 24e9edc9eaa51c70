"""A training-corpus pipeline over ``documents``: language ID, line dedup, near-dedup, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of documents; other
columns of ``docs`` are not looked at and go. Texts are taken whole, of any length. Repeated rows are judged alike, and
an empty table gives an empty one. Each stage says what becomes of nulls and ties.
"""

from __future__ import annotations

from noteql.llm import bpe, language_id, line_dedup, mixing, simhash
from noteql.llm.common import WORD_RE, materialize
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is told by less than this score are rejected, as are those without a letter. With two
#: classes a level no text with a letter scores less, so only those without one are.
MIN_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language the model knows, texts as they are. Null and empty texts and those without a letter
    go; a null doc_id or lang is no matter."""
    told = language_id.predict(docs, language_id.train(docs), keep=COLUMNS)
    return told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated and nearly repeated lines out of the texts; documents of nothing else go. Of equal lines the one of
    the least doc_id stays, null first, then of the least line number; rows that share a doc_id keep theirs alike. Null
    and empty texts stay as they are."""
    kept = line_dedup.dedup(docs, keep=COLUMNS)
    kept = kept.where((F.col("n_removed") == 0) | F.col("kept_text").rlike("\\S"))
    return kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of every SimHash component; rows that share its doc_id stay with it. Null and
    empty texts are alike, so one of them stays. A row without doc_id goes if its component has one with, and stays
    else."""
    near = simhash.near_duplicates(docs)
    kept = near.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    # Rows without an id are told by their texts' fingerprints.
    alone = materialize(near.where("doc_id is null and component_id is null").select("fp").distinct())
    nameless = docs.where("doc_id is null")
    named = docs.join(kept, "doc_id", "left_semi").select(COLUMNS)
    return named if alone.isEmpty() else named.unionByName(_with_fingerprint(nameless, alone).select(COLUMNS))


def _with_fingerprint(rows: DataFrame, fps: DataFrame) -> DataFrame:
    """Rows whose text has one of the fingerprints."""
    numbered = materialize(rows.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    found = simhash.fingerprints(numbered, "row").join(fps, "fp", "left_semi").select(F.col("doc_id").alias("row"))
    return numbered.join(found, "row", "left_semi")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every document as often as the mix takes it; where a budget ends within a document, its first words. Null
    texts and those without a word are never taken; a null source is one of its own; a null doc_id is no matter."""
    mixed = mixing.mix_sources(docs, keep=COLUMNS).where("taken > 0")
    passes = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
    left = F.col("taken") - (F.col("pass") - 1) * F.col("size")
    words = F.regexp_extract_all("text", F.lit(f"[\\x20\\x09-\\x0D]*{WORD_RE}"), F.lit(0))
    text = F.when(left >= F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), ""))
    mixed = mixed.withColumn("pass", passes).withColumn("text", text)
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the text they decode to; a null text has none."""
    return bpe.digests(docs, with_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", token_stage),
]
#: Models, fingerprints and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
