"""A training-corpus pipeline over `documents`: language, boilerplate, near-duplicates, source mix, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, materialize, read, resting, ship
from tallyspark.llm.langid import UNKNOWN, learned, predict
from tallyspark.llm.lines import dedup_lines
from tallyspark.llm.mixing import mix_sources, number_copies, quality_weight, repeat_rows, row_hash, with_quality, word_count
from tallyspark.llm.neardup import keep_one, near_duplicates
from tallyspark.llm.pieces import encode_documents

#: Documents whose language is less likely than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: A source's line is boilerplate if over this share of its documents, and at least so many, hold it; near copies count as one.
LINE_RATIO, LINE_DOCUMENTS = 0.03, 3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null text among them) or of no clear language."""
    ship(spark)
    rows = predict(docs, learned(docs), keep=docs.columns)
    return rows.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that are common in their source out of texts, and drops documents of which nothing is left by that.

    Documents that drop_near_duplicates would find alike count as one, so that a group of copies does not make boilerplate of
    its own lines: it gets there whole, and one of it stays."""
    ship(spark)
    found = near_duplicates(docs)
    page = F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.xxhash64("text_key"))
    alike = materialize(found.select("doc_id", "text_key", page.alias("page")).distinct())
    discard(found)
    cut = dedup_lines(docs, site=F.col("source"), text=F.col("text"), ratio=LINE_RATIO, min_pages=LINE_DOCUMENTS, alike=alike)
    discard(alike)
    rows = cut.filter((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return resting(rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns]), cut)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity of 0.8 or more stays."""
    ship(spark)
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; documents labelled as good are likelier to be drawn. Rows without words are
    never taken; null sources are one source; an empty table stays empty."""
    sized = docs.withColumns({"__size": word_count(F.col("text")), "__tie": row_hash(docs)})  # before the join, of which keys then need no texts
    rated = with_quality(sized, read(spark, sf_dir, "labels"), output="__quality")
    mixed = mix_sources(rated, size=F.col("__size"), weight=quality_weight(F.col("__quality")), tie=F.col("__tie"))
    return resting(repeat_rows(mixed, docs.columns), mixed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as piece ids. Copies of a document (rows of the same key and text) are numbered and each is drawn
    anew, so that later epochs see other segmentations. Null texts have no ids, empty ones an empty list."""
    ship(spark)
    return encode_documents(number_copies(docs), copy="copy")


STAGES = [("language_id", identify_language), ("line_dedup", drop_boilerplate), ("near_dedup", drop_near_duplicates), ("mix_sources", mix), ("sentencepiece", encode)]
#: SQL cannot express the language, similarity and sampling stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each written and read again; what a stage has read goes."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        step = stage(spark, docs, sf_dir)
        before, docs = docs, materialize(step)
        discard(before, step)
    return docs
