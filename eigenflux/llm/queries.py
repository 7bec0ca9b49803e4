"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenflux.llm import contamination, fingerprint, jaccard, langid, lines, quality, repeats, secret_scan, sharding, spm
from eigenflux.llm.common import crc_mod, materialize, new_path, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document with the forest's score; the value itself only as a digest."""
    forest = secret_scan.train(secret_scan.default_findings(spark))
    found = secret_scan.scan(table(spark, sf_dir, "documents"), forest)
    return found.select(
        "doc_id", "start", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret"
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that go because an earlier line is alike (Jaccard 0.8 or more, through any chain)."""
    gone = lines.removed(table(spark, sf_dir, "documents"))
    return gone.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", F.col("digest").alias("text_md5"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard.join(table(spark, sf_dir, "documents"), percent=90, width=3)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third of the ids is held out of training (null ids are neither learned from nor held out)."""
    docs = table(spark, sf_dir, "documents")
    third = crc_mod(F.col("doc_id"), 3)
    model = langid.train(docs, where=third != 1)
    return langid.predict(docs, model).select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and its verified class of equal canonical texts."""
    docs = table(spark, sf_dir, "documents")

    def each(text: str, after: str) -> tuple:
        half = len(text) // 2
        put = after[:half]
        edited = text[: len(text) - half] + put
        own, changed, beside = (fingerprint.canonical(t) for t in (text, edited, after))
        return (
            len(text),
            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            fingerprint.digest(own),
            fingerprint.digest(changed),
            float(own == changed),
            float(own == beside),
        )

    kind = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = materialize(fingerprint.with_next(docs, each, kind), "op5")
    members = fingerprint.classes(docs, rows.select("doc_id", "fingerprint"))
    return rows.join(members, ["doc_id", "fingerprint"], "left").select(
        *rows.columns, F.coalesce("class_id", "doc_id").alias("class_id")
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a fifth of the ids is held out of training (null ids are neither learned from nor held out)."""
    docs, fifth = table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5)
    model = quality.train(docs, table(spark, sf_dir, "labels"), where=fifth != 0)
    return quality.predict(docs, model).select(
        "doc_id", F.coalesce(fifth == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that start earlier in the corpus."""
    out = repeats.remove(table(spark, sf_dir, "documents"), length=100)
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    out = spm.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside any 10-word window of a benchmark item."""
    found = contamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        contamination.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended in six arrivals, compacted, and read back by the last manifest."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardedDataset(spark, new_path(spark, "shards"))
    store.append(docs, F.pmod(F.xxhash64("doc_id"), F.lit(6)).cast("int"))
    while store.merge():
        store.vacuum(keep=1, age=0)  # nobody else writes to or reads from a store made here
    rows = store.read(schema=docs.schema)
    return rows.select(
        "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.lit(store.version()).cast("long").alias("version"), "shard", "shard_bytes"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_line_dedup": op2_line_dedup,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_language_id": op4_language_id,
        "op5_fingerprint": op5_fingerprint,
        "op6_quality": op6_quality,
        "op7_repeats": op7_repeats,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_contamination": op9_contamination,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {}
