"""A corpus pipeline over documents: each stage works on all that the stage before it kept, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import stored, table
from kinfold.llm.lines import NEAR_CHARS, drop_lines, repeated_lines
from kinfold.llm.minhash import drop_near
from kinfold.llm.packing import pack
from kinfold.llm.suffixes import PASSAGE_WORDS, cut_repeats
from kinfold.llm.toxicity import drop_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Empty or null texts have nothing toxic and stay."""
    return drop_toxic(spark, docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals, or equals but for one edit, go; every document stays, with what is left of it."""
    return _documents(drop_lines(docs, repeated_lines(spark, docs, min_chars=NEAR_CHARS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; documents without words all stay."""
    return drop_near(spark, docs).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages of 400 bytes, and words of passages of over 50 words, that stand anywhere else too go; every document stays, with what is left of it."""
    return _documents(cut_repeats(spark, docs, count=PASSAGE_WORDS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in training sequences."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]
#: Minhash, suffix arrays and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
