"""Corpus pipeline: stages in order, each over all that its predecessor kept.

Language identification drops documents without a language, line deduplication takes out repeated lines (and documents of
which nothing is left), the n-gram join keeps the first document of each group, decontamination cuts benchmark passages out
of the texts, and the last stage encodes every text and decodes it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenflux.llm import common, contamination, jaccard, langid, lines, spm

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with the text of another column and its length."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(F.col(text)).cast("long").alias("n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts and texts without a letter go. Learned from the labels of two thirds."""
    model = langid.train(docs, where=common.crc_mod(F.col("doc_id"), 3) != 1)
    return langid.predict(docs, model, keep=tuple(COLUMNS)).where(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are alike to earlier ones; a document that loses all its lines goes."""
    out = lines.without(docs, lines.removed(docs))
    return _with_text(out.where("not (__gone > 0 and __left = 0)"), "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies (five-word shingles, 0.8); texts without words stay."""
    found = jaccard.join(docs, percent=80, width=5)
    kept = found.where(F.col("doc_id").isNull() | (F.col("component_id") == F.col("doc_id"))).select("doc_id").distinct()
    return docs.join(kept.withColumnRenamed("doc_id", "__id"), docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi").select(*COLUMNS)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that benchmark items hold (windows of ten words)."""
    benchmark = common.table(spark, sf_dir, "benchmark")
    found = contamination.find(docs, benchmark, keep=("doc_id", "lang", "source"), clean=True)
    return _with_text(found, "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids``, ``n_tokens`` and whether decoding gave the text back."""
    out = spm.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("sentencepiece", encode),
]

#: SQL cannot express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents are written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
