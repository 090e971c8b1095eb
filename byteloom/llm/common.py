"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom.session import ship

#: Bits of the filter before rows move: it bounds what is broadcast (a row for each 64).
FILTER_BITS = 1 << 23
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only a local session, whose executors are the driver, may do without: it takes the warehouse folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/byteloom/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored within are deleted at its end; what is to stay must have been written to a path from before."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df hasn't, so that a caller's columns of any name can't clash with an operator's own."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def possible(rows: DataFrame, wanted: DataFrame, key: str, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among the wanted, and the others: a filter of a fixed number of bits, whatever the input's size, keeps most others from moving.
    Where the wanted are far more than the bits, all pass; results are the same, and more rows move."""
    word, mask = unused(rows, "word"), unused(rows, "mask")
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {bits}L) & 63 as int))")
    words = wanted.groupBy(F.floor(at / 64).alias(word)).agg(F.bit_or(bit).alias(mask))
    marked = rows.join(F.broadcast(words), F.floor(at / 64) == F.col(word), "left")
    hit = F.coalesce(F.col(mask).bitwiseAND(bit) != 0, F.lit(False))
    return tuple(marked.where(test).drop(word, mask) for test in (hit, ~hit))
