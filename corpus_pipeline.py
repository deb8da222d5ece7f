"""Corpus pipeline: toxicity, language ID, near-duplicates, decontamination, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import bpe, decontam, langid, neardup, registry, toxicity
from quillrank.llm._common import fold
from quillrank.runtime import materialise, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Null and empty texts score as the labels' share has it and stay; very long texts
    are scored whole; equal texts, also in repeated rows, meet the same fate; without labels of both kinds every row stays.
    All columns come along, whatever their names."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0), "doc_id", "text", "toxic")
    return toxicity.without_toxic(docs, "text", model)


def reject_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, null and empty ones among them, or whose language scores below 0.5, go; equal scores take
    the language that comes first. Very long texts are scored whole, repeated rows meet the same fate, and if nothing can be
    learned (no row with a language) every row goes. All columns come along, whatever their names."""
    model = langid.fit(docs, "doc_id", "text", "lang", fold("doc_id", 3) != 1, public_tokenizers.path(registry.PIECES))
    return langid.identified(docs, "text", model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least id. Null and blank texts are in no group and
    stay; a row without an id is a document of its own; of rows that share the id that stays, the one with the least text
    does. Texts of any length count whole, an empty table stays empty, and all columns come along."""
    return neardup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item's words in common passages go. Null and empty texts or items
    share nothing; equally long passages are taken in the order of the item; repeated rows meet the same fate; an empty
    benchmark lets every row stay. Texts of any length are read whole, and all columns come along."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, with digests of the ids and of the bytes that they decode to. A null text is
    empty: no ids. Rows are independent, repeated ones come out repeated, texts of any length are encoded whole, and an empty
    table gives an empty one; other columns than doc_id and text end here."""
    got = bpe.encode_decode(docs, "doc_id", "text", public_tokenizers.path(registry.BPE_RANKS), public_tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("language_id", reject_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", tokenise),
]

#: Two of the stages are learned models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
