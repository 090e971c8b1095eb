"""Content-addressed snapshots: a binary format, a store of files, and tables of what is in it."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom.functions.algebra import cheapest
from byteloom.session import ship

#: Fixed values of the format.
MAGIC, VERSION, HEADER = bytes([0x4D, 0x52, 0x43, 0x32]), (2, 0), 29
FLAGS = {"chromosome": 1, "cycles": 2, "extended": 4, "tag": 8}
GRAPH, CYCLES, CHROMOSOME, HISTORY = 0x02, 0x03, 0x04, 0x05
MOST_HISTORY, HISTORY_BYTES = 1000, 60


class SnapshotError(ValueError):
    """A snapshot that can't be read, or isn't there."""


def rules_bytes(rules: list[tuple[int, int, int]]) -> bytes:
    """Count, then (a, b, op_id, 0) for each rule; operands aren't stored."""
    return struct.pack(">I", len(rules)) + b"".join(bytes([a, b, op, 0]) for a, b, op in rules)


def history_bytes(rows: list[tuple]) -> bytes:
    """The last 1,000 rows of (generation, ts_ms, best, average, variance, operators, corpus bytes)."""
    return struct.pack(">I", len(rows[-MOST_HISTORY:])) + b"".join(struct.pack(">qqdddiqq", *r, 0) for r in rows[-MOST_HISTORY:])


def cycle_bytes(cycles: list[tuple]) -> bytes:
    """Count (2 bytes), then for each (nodes, op_ids, total weight, gain): length, nodes, operators, two doubles; operands aren't stored."""
    return struct.pack(">H", len(cycles)) + b"".join(bytes([len(nodes), *nodes, *ops]) + struct.pack(">dd", weight, gain) for nodes, ops, weight, gain in cycles)


def serialize(generation: int, ts_ms: int, tag: str | None = None, rules: list | None = None, history: list | None = None, cycles: list | None = None) -> bytes:
    """Magic, version, flags, generation, time, CRC-32 of all after the first 29 bytes, the tag's length in bytes, tag, section table, sections. The graph's section is empty."""
    sections = [(GRAPH, struct.pack(">I", 0))] + ([(CYCLES, cycle_bytes(cycles))] if cycles else []) + ([(CHROMOSOME, rules_bytes(rules))] if rules is not None else []) + ([(HISTORY, history_bytes(history))] if history else [])
    flags = FLAGS["chromosome"] * (rules is not None) | FLAGS["cycles"] * bool(cycles) | FLAGS["tag"] * (tag is not None)
    name = (tag or "").encode()
    at = HEADER + len(name) + 2 + 9 * len(sections)
    table = struct.pack(">H", len(sections))
    for kind, data in sections:
        table += struct.pack(">BII", kind, at, len(data))
        at += len(data)
    rest = name + table + b"".join(d for _, d in sections)
    return MAGIC + bytes(VERSION) + bytes([flags]) + struct.pack(">qqIH", generation, ts_ms, zlib.crc32(rest), len(name)) + rest


def snapshot_id(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def stored(spark: SparkSession, root: str) -> DataFrame:
    """The store's rows (prefix, id, domain, content); none before the first publication."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    schema = "id string, domain string, content binary, prefix string"
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root)


def exists(spark: SparkSession, root: str, snapshot: str) -> bool:
    return not stored(spark, root).where((F.col("prefix") == snapshot[:2]) & (F.col("id") == snapshot)).isEmpty()


def publish(spark: SparkSession, root: str, contents: DataFrame) -> DataFrame:
    """Adds (domain, content) rows to a store of parquet files, once for each content, under its first domain by name; returns the new (id, domain)."""
    new = contents.groupBy(F.sha2("content", 256).alias("id")).agg(F.min("domain").alias("domain"), F.first("content").alias("content"))
    before = stored(spark, root).select("id")
    batch = F.substring("id", 1, 2).alias("prefix")
    found = new.join(before, "id", "left_anti").select("id", "domain", "content", batch)
    # written apart first: the store then takes, and the caller sees, the same rows
    staged = f"{root.rstrip('/')}.new/{uuid.uuid4().hex}"
    found.write.parquet(staged)
    added = spark.read.schema(found.schema).parquet(staged)
    added.write.mode("append").partitionBy("prefix").parquet(root)
    return added.select("id", "domain")


def publish_rules(spark: SparkSession, root: str, rules: DataFrame, domain: str, generation: int, ts_ms: int) -> DataFrame:
    """Publishes chromosomes (chrom_id, rule_no, a, b, op_id, operand), a snapshot each; rules of operators that the container can't name are left out. A chromosome fits a row."""

    def run(frames):
        for pdf in frames:
            pdf["content"] = [serialize(generation, ts_ms, domain, [(r["a"], r["b"], r["op_id"]) for r in found]) for found in pdf.found]
            yield pdf[["domain", "content"]]

    ship(spark)
    named = rules.groupBy("chrom_id").agg(F.array_sort(F.collect_list(F.when(F.col("op_id").between(0, 13), F.struct("rule_no", "a", "b", "op_id")))).alias("found"))
    return publish(spark, root, named.select(F.lit(domain).alias("domain"), "found").mapInPandas(run, "domain string, content binary"))


def publish_stream(contents: DataFrame, root: str):
    """A streaming writer that publishes rows (domain, content) of each micro-batch; a batch that is run again adds nothing, as contents have one id."""
    return contents.writeStream.foreachBatch(lambda batch, _: publish(batch.sparkSession, root, batch) and None)


def load(spark: SparkSession, root: str, snapshot: str) -> bytes:
    row = stored(spark, root).where((F.col("prefix") == snapshot[:2]) & (F.col("id") == snapshot)).select("content").first()
    if row is None:
        raise SnapshotError(f"no snapshot {snapshot}")
    return bytes(row.content)


def by_domain(index: DataFrame, domain: str) -> DataFrame:
    return index.where(F.col("domain") == domain).select("id").distinct()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, domain) of a tab-separated index; a missing tab means no domain."""
    return spark.read.schema("id string, domain string").option("sep", "\t").csv(path).select("id", F.coalesce("domain", F.lit("")).alias("domain"))


def _number(column, at: int, n: int):
    return F.conv(F.hex(F.substring(column, at + 1, n)), 16, 10).cast("long")


def manifests(rows: DataFrame, content: str = "content") -> DataFrame:
    """Header fields of snapshots in a binary column, and whether the checksum holds; content that isn't one raises."""
    c = F.col(content)
    checked = F.when(F.substring(c, 1, 4) == F.lit(MAGIC), F.when(_number(c, 4, 1) == VERSION[0], c).otherwise(F.raise_error(F.lit("an incompatible version")).cast("binary"))).otherwise(F.raise_error(F.lit("this is no snapshot")).cast("binary"))
    r = rows.withColumn("__c", checked)
    c = F.col("__c")
    return r.select(*[x for x in rows.columns if x != content], _number(c, 4, 1).alias("major"), _number(c, 5, 1).alias("minor"), _number(c, 6, 1).alias("flags"), _number(c, 7, 8).alias("generation"), _number(c, 15, 8).alias("ts_ms"), _number(c, 23, 4).alias("crc"), F.expr("cast(substring(__c, 30, cast(conv(hex(substring(__c, 28, 2)), 16, 10) as int)) as string)").alias("tag"), (F.crc32(F.expr("substring(__c, 30)")) == _number(c, 23, 4)).alias("crc_ok"))


def _sections(rows: DataFrame, kind: int, content: str) -> DataFrame:
    """(id, d): the bytes of the sections of a kind of snapshots (id, content)."""
    tag = "cast(conv(hex(substring(c, 28, 2)), 16, 10) as int)"
    n = f"cast(conv(hex(substring(c, 30 + {tag}, 2)), 16, 10) as int)"
    table = f"transform(filter(sequence(0, {n}), i -> i < {n}), i -> substring(c, 32 + {tag} + 9 * i, 9))"
    each = rows.select("id", F.col(content).alias("c")).select("id", "c", F.explode(F.expr(table)).alias("s")).where(_number(F.col("s"), 0, 1) == kind)
    return each.select("id", F.expr("substring(c, cast(conv(hex(substring(s, 2, 4)), 16, 10) as int) + 1, cast(conv(hex(substring(s, 6, 4)), 16, 10) as int))").alias("d"))


def chromosomes(rows: DataFrame, content: str = "content") -> DataFrame:
    """(id, rule_no, a, b, op_id, operand) of snapshots (id, content); operands are worked out again."""
    section = _sections(rows, CHROMOSOME, content)
    rules = section.select("id", F.posexplode(F.expr("filter(transform(sequence(0, greatest(0, length(d) div 4 - 2)), i -> substring(d, 5 + 4 * i, 4)), r -> length(r) = 4)")).alias("rule_no", "r"))
    rules = rules.select("id", "rule_no", _number(F.col("r"), 0, 1).cast("int").alias("a"), _number(F.col("r"), 1, 1).cast("int").alias("b"))
    return rules.withColumn("o", cheapest(F.col("a"), F.col("b"))).select("id", "rule_no", "a", "b", "o.op_id", "o.operand")


def _read(rows: DataFrame, kind: int, content: str, parse, schema: str) -> DataFrame:
    """Sections parsed to rows; a section fits a row, and its parser yields tuples after the id."""
    import pandas as pd

    ship(rows.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(i, *x) for i, d in zip(pdf["id"], pdf["d"]) for x in parse(bytes(d))], columns=names)

    return _sections(rows, kind, content).mapInPandas(run, schema)


def _parsed_cycles(d: bytes):
    (count,), at = struct.unpack_from(">H", d), 2
    for k in range(count):
        n = d[at]
        weight, gain = struct.unpack_from(">dd", d, at + 1 + 2 * n)
        yield k, list(d[at + 1 : at + 1 + n]), list(d[at + 1 + n : at + 1 + 2 * n]), weight, gain
        at += 17 + 2 * n


def _parsed_history(d: bytes):
    (count,) = struct.unpack_from(">I", d)
    for k in range(count):
        yield struct.unpack_from(">qqdddiq", d, 4 + HISTORY_BYTES * k)


def cycles(rows: DataFrame, content: str = "content") -> DataFrame:
    """(id, cycle_no, nodes, op_ids, total_weight, gain) of snapshots (id, content)."""
    return _read(rows, CYCLES, content, _parsed_cycles, "id string, cycle_no int, nodes array<int>, op_ids array<int>, total_weight double, gain double")


def history(rows: DataFrame, content: str = "content") -> DataFrame:
    """(id, generation, ts_ms, best_fitness, avg_fitness, variance, unique_operators, corpus_bytes) of snapshots (id, content)."""
    return _read(rows, HISTORY, content, _parsed_history, "id string, generation long, ts_ms long, best_fitness double, avg_fitness double, variance double, unique_operators int, corpus_bytes long")


def loaded(rows: DataFrame) -> dict[str, DataFrame]:
    """All tables of snapshots (id, content)."""
    return {"manifest": manifests(rows), "cycles": cycles(rows), "chromosome": chromosomes(rows), "history": history(rows)}
