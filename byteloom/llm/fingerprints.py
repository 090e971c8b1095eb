"""Document fingerprints (operator 9): threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch holds the 64-bit hashes of all shingles that fall below a fixed fraction of the range, and the smallest hash in any case, so that a short
text's isn't empty. Sketches of any two texts are samples by the same rule: their union (by the rule) is the sketch of both texts, and
shares within them estimate resemblance, and containment between very unequal texts.

Words are runs of other characters than blanks and \\t to \\r, in lower case; a text of fewer words than a shingle is one shingle; texts without words,
and null texts, have the empty sketch, which is like (1.0) only another empty one. Equal texts have equal sketches.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS, PART = 5, 8
_SPACE = " \t\n\x0b\f\r"


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all shingles of a text, in order, with repetitions; null is empty."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SPACE))

    def of(h):
        each = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words))))
        return F.when(F.size(h) >= words, each).otherwise(F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " "))))

    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<bigint>")).otherwise(let(F.transform(F.split(t, r"[ \t-\r]+"), lambda w: F.xxhash64(w)), of)))


def below(part: int = PART) -> int:
    return -(1 << 63) + (1 << 64) // part


def thin(hashes: Column, part: int = PART) -> Column:
    """The sketch of hashes: the distinct ones below the fraction and the smallest, in order."""
    return let(hashes, lambda h: F.array_sort(F.array_distinct(F.concat(F.filter(h, lambda x: x < F.lit(below(part))), F.when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(F.array().cast("array<bigint>"))))))


def sketch(text: Column, words: int = WORDS, part: int = PART) -> Column:
    return thin(shingle_hashes(text, words), part)


def merged(a: Column, b: Column, part: int = PART) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    return let(F.array_union(a, b), lambda u: F.array_sort(F.filter(u, lambda x: (x < F.lit(below(part))) | (x == F.array_min(u)))))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of either text that both have."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(let(both, lambda n: n / (F.size(a) + F.size(b) - n)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of a's text that b's text has; 1.0 of an empty one."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def written(s: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", rows: int = 500, most: int = 1000) -> DataFrame:
    """Adds next_<column> of the row after, by descending key; after the last comes the first. Ties go by a hash of the first column, the largest first.

    Rows are dealt into ranges of about `rows` keys, and the first row of each range is also sent to the range before it, so that the order is never made in one task: each row
    moves once. Ranges are made in two steps, at most `most` by percentiles of all keys and at most `most` within each, so up to a million; a key that many rows repeat is dealt by
    the hash into 1,024. The first keys of ranges are all that is gathered or broadcast. Null keys come last."""
    keys = docs.where(F.col(key).isNotNull()).select(key)
    wanted = -(-keys.count() // rows)
    coarse = max(2, min(most, wanted))
    fine = max(2, min(most, -(-wanted // coarse)))
    cuts = keys.agg(F.percentile_approx(key, [i / coarse for i in range(1, coarse)], 10_000).alias("c")).first().c or []
    heavy = sorted(b for b, n in Counter(cuts).items() if n > 1)
    cuts = sorted({*cuts, *(b + 1 for b in heavy)})
    under = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col(key))).cast("int")
    listed = F.expr(f"array({', '.join(f'{b}L' for b in cuts)})") if cuts else F.array().cast("array<bigint>")
    many = F.coalesce(F.col(key).isin(heavy), F.lit(False)) if heavy else F.lit(False)
    tie = F.when(many, F.xxhash64(columns[0])).otherwise(F.lit(0).cast("long")) if heavy else F.lit(0).cast("long")
    inner = keys.withColumn("__c", under(listed)).groupBy("__c").agg(F.percentile_approx(key, [i / fine for i in range(1, fine)], 1000).alias("__cuts"))

    def placed(df):
        within = F.when(many, F.shiftright("__h", 54).cast("int") + 512).otherwise(under(F.col("__cuts")))
        dealt = df.withColumns({"__c": under(listed), "__h": tie}).join(F.broadcast(inner), "__c", "left")
        return dealt.withColumn("__b", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.col("__c") * 1024 + within)).drop("__c", "__cuts")

    heads = placed(docs.select(key, columns[0]) if heavy else docs.select(key)).groupBy("__b").agg(F.max(F.struct(F.col(key).alias("k"), F.col("__h").alias("h"))).alias("head"))
    by = Window.partitionBy(F.lit(0)).orderBy("__b")
    whole = Window.partitionBy(F.lit(0))
    # the range above a range sees the lower one's first row; the lowest one sees the first row of all
    targets = heads.select("head", F.lead("__b").over(by).alias("above"), F.min("__b").over(whole).alias("lowest"), (F.col("__b") == F.max("__b").over(whole)).alias("top"))
    targets = targets.select(F.col("head.k").alias("__key"), F.col("head.h").alias("__tie"), F.coalesce("above", F.when(F.col("top"), F.col("lowest"))).alias("__target"))
    own = placed(docs.select(key, *columns))
    sent = own.join(F.broadcast(targets), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__h") == F.col("__tie")), "left")
    mine, guest = F.struct(F.col("__b").alias("b"), F.lit(0).alias("guest")), F.struct(F.col("__target").alias("b"), F.lit(1).alias("guest"))
    copies = sent.withColumn("__to", F.explode(F.when(F.col("__target").isNull(), F.array(mine)).otherwise(F.array(mine, guest))))
    order = Window.partitionBy("__to.b").orderBy("__to.guest", F.col(key).desc_nulls_last(), F.xxhash64(columns[0]).desc())
    return copies.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where("__to.guest = 0").select(key, *columns, *(f"next_{c}" for c in columns))


def edit_and_compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; see the queries' contract."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sketch", sketch(F.col("text")))
    seen = with_next(own, ["text", "sketch"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    found = seen.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    found = found.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited")).alias("changed"))
    return found.select("doc_id", "n_chars", "edited_sha256", written(F.col("sketch")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("changed")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
