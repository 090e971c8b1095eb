"""Byte streams as rows (stream_id, pos, v): v is 0 to 255, pos counts from 0 within its stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from byteloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def as_byte(value: Column) -> Column:
    return F.floor(value).cast("long").bitwiseAND(255).cast("int")


def numbered(rows: DataFrame, stream: str, order: str, value: Column, width: int = 1 << 16) -> DataFrame:
    """Dense positions by a whole-number order that is unique in its stream. Streams are cut into ranges of the order and the ranges' counts added up, so that even
    a single stream is spread over tasks."""
    cut = rows.select(F.col(stream).cast("string").alias("stream_id"), F.col(order).cast("long").alias("ord"), value.alias("v")).withColumn("part", F.floor(F.col("ord") / width))
    counts = cut.groupBy("stream_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("stream_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("stream_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("stream_id", "part").orderBy("ord")
    return cut.withColumn("at", F.row_number().over(within) - 1).join(shift, ["stream_id", "part"]).select("stream_id", (F.col("at") + F.col("shift")).cast("long").alias("pos"), "v")


def ordered(rows: DataFrame, stream: str, order: list[str], value: Column) -> DataFrame:
    """Positions by any columns, for tables of many short streams."""
    w = Window.partitionBy(stream).orderBy(*order)
    return rows.select(F.col(stream).cast("string").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), value.alias("v"))


def exploded(rows: DataFrame, stream: Column, payload: Column) -> DataFrame:
    """The bytes of a binary column; null and empty payloads have no rows."""
    pairs = F.split(F.hex(payload), r"(?<=\G..)")
    return rows.where(F.octet_length(payload) > 0).select(stream.cast("string").alias("stream_id"), F.posexplode(pairs).alias("pos", "h")).where("h != ''").select("stream_id", F.col("pos").cast("long").alias("pos"), F.conv("h", 16, 10).cast("int").alias("v"))


def collected(bytes_: DataFrame) -> DataFrame:
    """(stream_id, payload): the bytes of each stream in order, for streams that fit a row."""
    items = F.array_sort(F.collect_list(F.struct("pos", "v")))
    text = F.array_join(F.transform(items, lambda x: F.lpad(F.hex(x["v"].cast("long")), 2, "0")), "")
    return bytes_.groupBy("stream_id").agg(F.unhex(text).alias("payload"))


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "events"), "event_type", "event_id", as_byte(F.col("value")))


def event_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in four levels of value: runs are frequent here."""
    return numbered(table(spark, sf_dir, "events"), "event_type", "event_id", F.floor(F.col("value") / 8).cast("long").bitwiseAND(3).cast("int"))


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], as_byte(F.col("value")))


def lineitem_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    return ordered(table(spark, sf_dir, "lineitem"), "l_suppkey", order, F.col("l_quantity").cast("int").bitwiseAND(255))


def orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], as_byte(F.col("o_totalprice")))


def document_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(table(spark, sf_dir, "documents"), F.col("doc_id"), F.encode("text", "UTF-8"))


def document_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, payload) of documents, for what can be counted within a row."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stream_id"), F.encode("text", "UTF-8").alias("payload"))


def page_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(table(spark, sf_dir, "pages"), F.col("page_id"), F.encode("html", "UTF-8"))


def turn_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(table(spark, sf_dir, "conversations"), F.concat_ws("/", "conv_id", "turn"), F.encode("text", "UTF-8"))


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """The bytes of whole files, a stream each; unreadable ones are skipped."""
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(list(paths))
    return exploded(found, F.col("path"), F.col("content"))


def seed(spark: SparkSession, n: int = 4096) -> DataFrame:
    """The default corpus: 0 to 255 over and over."""
    return spark.range(n).select(F.lit("seed").alias("stream_id"), F.col("id").alias("pos"), (F.col("id") % 256).cast("int").alias("v"))


def window(bytes_: DataFrame, capacity: int) -> DataFrame:
    """The last `capacity` bytes of each stream, renumbered from 0, oldest first."""
    ends = bytes_.groupBy("stream_id").agg(F.max("pos").alias("last"))
    start = F.greatest(F.lit(0), F.col("last") + 1 - capacity)
    return bytes_.join(ends, "stream_id").where(F.col("pos") >= start).select("stream_id", (F.col("pos") - start).alias("pos"), "v")


def generated(spark: SparkSession, kind: str, n: int, seed: int = 42, step: int = 1, frequency: float = 0.05) -> DataFrame:
    """Synthetic streams: uniform, lcg, gaussian, arithmetic, sine. Draws come from a hash of the position, so any part can be made anywhere."""
    i = F.col("id")
    u = lambda salt: (F.pmod(F.xxhash64(i, F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    if kind == "lcg":
        # the state after i steps, by doubling the affine map: x -> 1664525 x + 1013904223 modulo 2^32
        a, c, rounds = 1664525, 1013904223, []
        for bit in range(max(1, n.bit_length())):
            rounds.append(F.struct(F.lit(1 << bit).alias("bit"), F.lit(a).cast("decimal(20,0)").alias("a"), F.lit(c).cast("decimal(20,0)").alias("c")))
            a, c = a * a % (1 << 32), (a * c + c) % (1 << 32)
        wide = "decimal(38,0)"
        x = F.aggregate(F.array(*rounds), F.lit(seed).cast(wide), lambda s, r: F.when((i + 1).bitwiseAND(r["bit"].cast("long")) != 0, ((s.cast("decimal(12,0)") * r["a"] + r["c"]) % F.lit(1 << 32).cast("decimal(12,0)")).cast(wide)).otherwise(s))
        value = x.cast("long").bitwiseAND(255)
    else:
        value = {
            "uniform": lambda: F.floor(u(1) * 256),
            "gaussian": lambda: F.least(F.lit(255), F.greatest(F.lit(0), F.round(128 + 30 * F.sqrt(-2 * F.log(u(1))) * F.cos(6.283185307179586 * u(2))))),
            "arithmetic": lambda: F.pmod(i * step, F.lit(256)),
            "sine": lambda: F.round(127.5 + 127.5 * F.round(F.sin(6.283185307179586 * frequency * i), 9)),
        }[kind]()
    return spark.range(n).select(F.lit(kind).alias("stream_id"), i.alias("pos"), value.cast("int").alias("v"))
