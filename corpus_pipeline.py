"""A corpus from documents to packed sequences in five stages; each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom.llm import linededup, neardup, packing, pii, quality
from byteloom.llm.common import delete, new_path, scratch, table, unused
from byteloom.llm.queries import pii_key
from byteloom.session import ship

#: Documents with a lower quality go.
THRESHOLD = 0.3


def _columns(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now is."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = quality.trained(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "score")
    return quality.score(docs, model, keep=docs.columns, name=name).where(F.col(name) >= THRESHOLD).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(docs, linededup.dedup_lines(docs, counts=False))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.without_near_duplicates(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(docs, pii.anonymise(docs, pii_key(spark), count=None))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII surrogates", replace_personal_data),
    ("best-fit packing", pack),
]

#: A trained classifier and a tokenizer aren't SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written before the next; its intermediate tables and the stage before it are deleted then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
