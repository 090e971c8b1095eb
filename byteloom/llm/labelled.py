"""Labelled samples of bounded size, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(modulus: int, fold: int, key: str = "doc_id"):
    """Whether a row is kept from fitting: crc32 of its key as text, by the modulus."""
    return F.crc32(F.col(key).cast("string")) % modulus == fold


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, fold: int, rows: tuple[int, int], longest: int) -> list[tuple[str, int]]:
    """(text, label) of at most `rows` rows of label 0 and of label 1, texts of up to `longest` characters, never of the held-out fold.

    Rows are taken by a hash of their key, so the choice doesn't depend on the order or layout of the tables. Null labels are left out; of
    repeated labels the largest counts, of repeated keys any text."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & ~held_out(modulus, fold)).groupBy("doc_id").agg(F.max("label").alias("label"))
    short = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= longest))
    order = F.xxhash64("doc_id")
    chosen = None
    for k in (0, 1):
        part = known.where(F.col("label") == k).orderBy(order, "doc_id").limit(rows[k])
        chosen = part if chosen is None else chosen.unionByName(part)
    found = short.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").collect()
    return [(r.text, r.label) for r in sorted(found, key=lambda r: (r.doc_id, r.text))]
