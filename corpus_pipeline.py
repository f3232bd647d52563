"""Corpus pipeline: stages over the documents table, each written and read again by run().

Every stage takes all rows its predecessor kept; all but the last return the
columns of documents.  Rows may be repeated; rows without an id are judged like
others, by a row number.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracetide.llm import decontam, jaccard_join, langid, packing, suffix_dedup
from tracetide.llm.common import doc_crc, stored

ORACLE_SQL = None  # trained models and byte-level matches; compared with brute force in tests/llm

TOKENIZER = "byte_bpe_50k.json"
REPEATED_BYTES, GRAM_BYTES = 250, 100  # a passage of over 50 words of four letters is longer; anchors about 75 bytes apart


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; texts that are null or have no letter go."""
    model = langid.fit(docs.where(F.coalesce(doc_crc() % 4 != 2, F.lit(False))))
    out = langid.identify(docs, model, keep=tuple(docs.columns), names=("__lang", "__score"))
    return out.where(F.col("__lang") != langid.UNDETERMINED).select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``: the doc_id, or where one is missing a number of the row, written once, in every row."""
    if docs.where("doc_id is null").isEmpty():
        return docs.withColumn("__row", F.col("doc_id"))
    return stored(docs.withColumn("__row", F.monotonically_increasing_id()))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one of smallest id, or any if none has an id.

    Of rows with one id and one text, one stays.
    """
    rows = _numbered(docs)
    groups = jaccard_join.jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text"))
    member = rows.select("__row", "doc_id").join(groups.select(F.col("doc_id").alias("__row"), "component_id"), "__row")
    first = member.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))["__row"].alias("__row"))
    rows = rows.join(first.select("__row"), "__row", "left_semi")
    rows = rows.withColumn("__copy", F.row_number().over(Window.partitionBy("__row", "text").orderBy("source", "lang", "n_chars")))
    return rows.where("__copy = 1").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings of REPEATED_BYTES; characters that were cut through go too."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = suffix_dedup.deduplicate(_numbered(docs), doc_id="__row", length=REPEATED_BYTES, gram=GRAM_BYTES, keep=tuple(rest))
    out = out.select(F.col("kept_text").alias("text"), *[F.col(f"__keep_{c}").alias(c) for c in rest])
    out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; rows without an id are judged one by one."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = stored(decontam.find_matches(docs.where("doc_id is not null"), items)).select(F.col("doc_id").alias("__found")).distinct()
    named = docs.where("doc_id is not null").join(found, F.col("doc_id") == F.col("__found"), "left_anti")
    if docs.where("doc_id is null").isEmpty():
        return named
    rows = stored(docs.where("doc_id is null").withColumn("__row", F.monotonically_increasing_id()))  # an id that is written once
    found = stored(decontam.find_matches(rows, items, doc_id="__row")).select(F.col("doc_id").alias("__found")).distinct()
    return named.unionByName(rows.join(found, F.col("__row") == F.col("__found"), "left_anti").select(*docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        out = stored(stage(spark, out, sf_dir))
    return out
