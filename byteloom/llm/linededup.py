"""Line deduplication (operator 6) by overlapping windows of three lines, in DataFrame functions.

Three consecutive lines are hashed at every line (128 bits); a text of fewer lines has one window, of all of them. The first occurrence of a window, by
doc_id and position, stays; the lines that later occurrences cover are merged and removed, within a document as across documents. Windows of
blank lines alone don't count.

Null and empty texts stay as they are. Rows that repeat both doc_id and text count as one occurrence and are treated alike; null doc_ids come last in order.
A text of which all lines are removed becomes empty. Windows with very many occurrences are counted by partial sums, and the join that finds them again can be split by adaptive
execution, so no window meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byteloom.llm.common import stored, unused
from byteloom.llm.fingerprints import let

LINES = 3


def windows(text: Column, lines: int = LINES) -> Column:
    """array<struct<pos, len, h1, h2>> of a text's windows."""

    def of(ls):
        def one(i):
            n = F.least(F.lit(lines), F.size(ls))
            part = F.slice(ls, i + 1, n)
            joined = F.array_join(part, "\n")
            return let(joined, lambda j: F.when(F.trim(F.regexp_replace(j, r"\s", "")) != "", F.struct(i.alias("pos"), n.alias("len"), F.xxhash64(j, n).alias("h1"), F.xxhash64(F.lit("again"), n, j).alias("h2"))))

        return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(ls) - lines)), one), lambda w: w.isNotNull())

    return let(F.split(F.coalesce(text, F.lit("")), "\n"), of)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", lines: int = LINES, counts: bool = True) -> DataFrame:
    """docs with repeated passages taken out of its text column; counts: also n_lines and n_removed, in place of any columns of these names."""
    at, tag, covered_ = (unused(docs, x) for x in ("key", "tag", "covered"))
    tagged = docs.withColumns({at: F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)), tag: F.xxhash64(text)})
    found = tagged.select(F.col(at).alias("k"), F.col(tag).alias("t"), F.explode(windows(F.col(text), lines)).alias("w")).select("k", "t", "w.*")
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("k", "t", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # rows that repeat key and text are one occurrence: such windows are dropped below, as each equals the first
    first = stored(first.select("h1", "h2", "first"), "windows")
    later = found.join(first, ["h1", "h2"]).where(F.struct("k", "t", "pos") != F.col("first"))
    covered = later.select(F.col("k").alias(at), F.col("t").alias(tag), F.explode(F.sequence("pos", F.col("pos") + F.col("len") - 1)).alias("line")).groupBy(at, tag).agg(F.collect_set("line").alias(covered_))
    joined = tagged.join(covered, [at, tag], "left")

    def left(ls):
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(covered_)), lambda i: F.get(ls, i)), "\n")

    cleaned = F.when(F.col(covered_).isNull(), F.col(text)).otherwise(let(F.split(F.col(text), "\n"), left))
    numbers = [F.when(F.length(text) > 0, F.size(F.split(F.col(text), "\n"))).otherwise(0).alias("n_lines"), F.when(F.col(covered_).isNull(), 0).otherwise(F.size(covered_)).alias("n_removed")] if counts else []
    return joined.select(*(cleaned.alias(c) if c == text else F.col(c) for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))), *numbers)


#: The same in SQL, for whole documents with distinct ids: windows are compared by their text.
SQL = """WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(greatest(1, len(ls) - 2))) AS p FROM d),
x AS (SELECT doc_id, p, least(3, len(ls)) AS k, array_to_string(ls[p + 1 : p + least(3, len(ls))], chr(10)) AS j FROM w),
y AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(p) OVER o AS fp FROM x WHERE regexp_replace(j, '\\s', '', 'g') <> '' WINDOW o AS (PARTITION BY j ORDER BY doc_id, p)),
c AS (SELECT doc_id, list(DISTINCT line) AS gone FROM (SELECT doc_id, unnest(range(p, p + k)) AS line FROM y WHERE doc_id <> fd OR p <> fp) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda s, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text,
CAST(CASE WHEN length(text) > 0 THEN len(ls) ELSE 0 END AS INTEGER) AS n_lines, CAST(coalesce(len(gone), 0) AS INTEGER) AS n_removed FROM d LEFT JOIN c USING (doc_id)"""
