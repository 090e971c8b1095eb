"""Arithmetic runs (constant steps modulo 256): detection, patterns, and the greedy parse of the run-length container.

Both scans depend on islands of equal steps and on one parity bit: a run that ends takes the first byte of the next island with it. So they are windows over
islands rather than loops over bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from byteloom.functions.algebra import BREAK_EVEN, LITERAL_TOKEN_BITS, RUN_TOKEN_BITS
from byteloom.operators.graph import CHUNK, with_neighbours, with_next

LONGEST, MOST_STEPS, HEADER_BYTES = 65535, 255, 9


def steps(bytes_: DataFrame) -> DataFrame:
    """(stream_id, pos, v, st): the step to the next byte, modulo 256."""
    return with_next(bytes_).where(F.col("nxt").isNotNull()).select("stream_id", "pos", "v", (F.col("nxt") - F.col("v")).bitwiseAND(255).alias("st"))


def triples(bytes_: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(stream_id, pos, before, v, after) of bytes that have both neighbours."""
    w = Window.partitionBy("stream_id", "c").orderBy("pos")
    near = with_neighbours(bytes_, 1, 1, chunk).withColumns({"before": F.lag("v").over(w), "after": F.lead("v").over(w)})
    return near.where("own and before is not null and after is not null").select("stream_id", "pos", "before", "v", "after")


def islands(bytes_: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(stream_id, isl, st, p0, m, v0): maximal stretches of m equal steps from byte p0, numbered from 1.

    Each byte moves once, with its chunk; from there on only stretches' first bytes and streams' last ones go on. They are numbered by parts of positions, and the parts'
    counts and first positions added up, so a single long stream is spread over tasks."""
    w = Window.partitionBy("stream_id", "c").orderBy("pos")
    near = with_neighbours(bytes_, 1, 1, chunk).withColumns({"st": (F.lead("v").over(w) - F.col("v")).bitwiseAND(255), "was": (F.col("v") - F.lag("v").over(w)).bitwiseAND(255)})
    marks = near.where(F.col("own") & (F.col("st").isNull() | (F.col("pos") == 0) | (F.col("st") != F.col("was")))).select("stream_id", F.col("c").alias("part"), "pos", "st", F.col("v").alias("v0"))
    parts = marks.groupBy("stream_id", "part").agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    order = Window.partitionBy("stream_id").orderBy("part")
    spine = parts.select("stream_id", "part", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"), F.lead("at").over(order).alias("beyond"))
    within = Window.partitionBy("stream_id", "part").orderBy("pos")
    held = marks.withColumns({"to": F.lead("pos").over(within), "isl": F.row_number().over(within)}).where("st is not null").join(spine, ["stream_id", "part"])
    return held.select("stream_id", (F.col("isl") + F.col("shift")).cast("long").alias("isl"), "st", F.col("pos").alias("p0"), (F.coalesce("to", "beyond") - F.col("pos")).cast("long").alias("m"), "v0")


def _last(isl: DataFrame, value: Column, chunk: int) -> DataFrame:
    """Adds `last`: the greatest value of the islands before, null if there is none. Values rise with isl, so the greatest is the latest; parts of islands carry theirs on."""
    cut = isl.withColumns({"part": F.floor(F.col("isl") / chunk), "mark": value})
    order = Window.partitionBy("stream_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spine = cut.groupBy("stream_id", "part").agg(F.max("mark").alias("most")).select("stream_id", "part", F.max("most").over(order).alias("carried"))
    within = Window.partitionBy("stream_id", "part").orderBy("isl").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("own", F.max("mark").over(within)).join(spine, ["stream_id", "part"]).withColumn("last", F.coalesce("own", "carried")).drop("part", "mark", "own", "carried")


def detected(isl: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Runs of four bytes and more as a sequential scan finds them: (stream_id, st, start, len)."""
    odd = _last(isl, F.when(F.col("m") >= 2, F.col("isl")), chunk).withColumn("sw", F.when(F.col("last").isNull(), (F.col("isl") - 1) % 2).otherwise(1 - (F.col("isl") - 1 - F.col("last")) % 2))
    return odd.where(F.col("m") - F.col("sw") + 1 >= BREAK_EVEN).select("stream_id", "st", (F.col("p0") + F.col("sw")).alias("start"), (F.col("m") - F.col("sw") + 1).alias("len"))


def patterns(runs: DataFrame) -> DataFrame:
    """(stream_id, st, run_bytes, run_count, saving) of steps that save bits; long runs take a token for every 65,535 bytes."""
    tokens = F.ceil(F.col("len") / LONGEST)
    return runs.groupBy("stream_id", "st").agg(F.sum("len").alias("run_bytes"), F.count("*").alias("run_count"), (F.sum("len") * LITERAL_TOKEN_BITS - RUN_TOKEN_BITS * F.sum(tokens)).cast("long").alias("saving")).where("saving > 0")


def top_patterns(pats: DataFrame, k: int) -> DataFrame:
    """The k best of each stream by saving, then step."""
    w = Window.partitionBy("stream_id").orderBy(F.desc("saving"), "st")
    return pats.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def signed(step: Column) -> Column:
    return F.when(step > 127, step - 256).otherwise(step)


def label(step: Column) -> Column:
    s = signed(step)
    return F.when(step == 0, "repeat(0)").when(s == 1, "seq(+1)").when(s == -1, "seq(-1)").otherwise(F.format_string("arith(%+d)", s))


def parsed(isl: DataFrame, table: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Runs as the container's greedy parse takes them, for the steps of a table (stream_id, st): (stream_id, st, start, len, v0)."""
    known = table.select("stream_id", "st").withColumn("known", F.lit(True))
    e = isl.join(known, ["stream_id", "st"], "left")
    kind = F.when(F.col("known") & (F.col("m") >= 4), 1).when(F.col("known") & (F.col("m") == 3), 2).otherwise(0)
    # islands of three known steps take turns from the last other one on; that one's taking a byte too many is its being long
    e = _last(e.withColumn("kind", kind), F.when(F.col("kind") != 2, F.struct("isl", "kind")), chunk)
    turns = (F.col("isl") - 1 - F.coalesce(F.col("last.isl"), F.lit(0))) % 2
    taken = F.coalesce(F.col("last.kind"), F.lit(0))
    e = e.withColumn("c", F.when(turns == 0, taken).otherwise(1 - taken))
    hit = (F.col("kind") == 1) | ((F.col("kind") == 2) & (F.col("c") == 0))
    return e.where(hit).select("stream_id", "st", (F.col("p0") + F.col("c")).alias("start"), (F.col("m") + 1 - F.col("c")).alias("len"), ((F.col("v0") + F.col("c") * F.col("st")).bitwiseAND(255)).cast("int").alias("v0"))


def sizes(bytes_: DataFrame, pats: DataFrame, runs: DataFrame) -> DataFrame:
    """Per stream: n, literals, run_tokens, steps, bits, encoded bytes and ratio of the run-length container; an empty stream has no row."""
    n = bytes_.groupBy("stream_id").agg(F.count("*").alias("n"))
    t = runs.groupBy("stream_id").agg(F.sum("len").alias("covered"), F.sum(F.ceil(F.col("len") / LONGEST)).alias("tokens"))
    s = pats.groupBy("stream_id").agg(F.least(F.count("*"), F.lit(MOST_STEPS)).alias("steps"))
    j = n.join(t, "stream_id", "left").join(s, "stream_id", "left").na.fill(0, ["covered", "tokens", "steps"])
    literals = F.col("n") - F.col("covered")
    bits = literals * LITERAL_TOKEN_BITS + F.col("tokens") * RUN_TOKEN_BITS
    size = HEADER_BYTES + F.col("steps") + F.ceil(bits / 8)
    return j.select("stream_id", "n", literals.cast("long").alias("literals"), F.col("tokens").cast("long").alias("run_tokens"), F.col("steps").cast("long").alias("steps"), bits.cast("long").alias("bits"), size.cast("long").alias("encoded_bytes"), (size / F.col("n")).alias("ratio"))


def step_table(pats: DataFrame) -> DataFrame:
    """(stream_id, st, idx): the 255 best steps of a stream, numbered by saving."""
    return top_patterns(pats, MOST_STEPS).select("stream_id", "st", (F.col("rank") - 1).cast("int").alias("idx"))
