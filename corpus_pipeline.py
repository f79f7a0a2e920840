"""Stages that turn documents into clean, mixed, tokenized training data.

Every stage takes documents with any further columns, whatever their names, and all but the last
give the same columns back. A null text counts as an empty one; an empty table stays empty. The tests
hold each stage against a plain version on a small table with nulls, repeats, ties and clashing names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.llm import langid, mixing, neardup, quality, sentencepiece_codec
from kgspark.llm.common import crc_mod, free_name, staged

#: SQL has neither the models nor the tokenizer.
ORACLE_SQL = None
#: Percent of similarity at which near_duplicates links; op5's own is higher.
PERCENT = 80


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that look like one of the languages learned from the labelled ones (crc32(doc_id) mod 3 is not 1).

    Documents without a letter go, and those whose cosine with every prototype is 0 or less. Where nothing is labelled, all with a letter stay.
    Repeated rows are judged alike; a tie between languages keeps a document.
    """
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = langid.learn(docs.where(~held).select(F.col("lang").cast("string"), F.col("text").cast("string")))
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = free_name("lang_pred", docs.columns), free_name("score", docs.columns)
    own = langid.predict(docs, model, docs.columns, names)
    return own.where((F.col(names[0]) != "und") & (F.col(names[1]) > 0)).select(*_columns(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more, that value included. Without usable labels all scores are 0.5 and all documents stay.

    Repeated rows have equal scores; an empty text has one too.
    """
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name("score", docs.columns)
    return quality.predict(docs, model, docs.columns, name).where(F.col(name) >= quality.THRESHOLD).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, one with the smallest doc_id; of rows of that doc_id the first by text.

    Rows of equal doc_id are one document. Documents without words are near nothing and stay, once for each doc_id. Rows without a
    doc_id are held against each other by their whole text only: of equal ones the first stays.
    """
    place = free_name("place", docs.columns)
    key = F.col("doc_id")
    first = lambda rows, by: rows.withColumn(place, F.row_number().over(Window.partitionBy(by).orderBy("text"))).where(F.col(place) == 1).drop(place)
    kept = neardup.near_duplicates(docs, PERCENT).where("kept and doc_id is not null").select("doc_id").distinct()
    one = first(docs.where(key.isNotNull()), key)
    none = first(docs.where(key.isNull()), F.sha2(F.coalesce("text", F.lit("")), 256))
    return one.join(kept, "doc_id", "left_semi").select(*_columns(docs)).unionByName(none)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 times, equal rows alike. A null source is a source of its own."""
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, ids_crc32, parity and the ids (pieces) of each row; an empty text has no ids."""
    return sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "source"])


STAGES = [("language_id", language_id), ("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
