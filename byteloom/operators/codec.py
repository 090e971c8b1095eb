"""The containers: sizes by windows, bytes by packing tokens, and the decoders.

Magic numbers, versions and token layouts are fixed values of the formats.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from byteloom.functions import algebra
from byteloom.operators import runs
from byteloom.operators.graph import CHUNK, digrams, edges, with_next
from byteloom.session import ship

PREFIX = bytes([0x4D, 0x52, 0x43])
V3_CONNECTED, V3_STANDALONE, V3_HEADER = 0, 1, 41
CYCLE_FLAG_BITS, REPEAT_BITS, MOST_CYCLES = 3, 16, 255
TIERS = {"LITERAL": ("0", 1), "RELATIONAL": ("10", 2), "CYCLE": ("110", 3), "ARITH_RUN": ("1", 1)}


class FormatError(ValueError):
    """Encoded data that can't be decoded."""


# -- sizes


def _v1_sizes(counted: DataFrame) -> DataFrame:
    """Of rows (stream_id, n, relational)."""
    bits = 7 * F.col("relational") + 9 * (F.col("n") - F.col("relational"))
    size = runs.HEADER_BYTES + F.ceil(bits / 8)
    return counted.select("stream_id", "n", F.col("relational").cast("long").alias("relational"), (F.col("n") - F.col("relational")).cast("long").alias("literals"), bits.cast("long").alias("bits"), size.cast("long").alias("encoded_bytes"), (size / F.col("n")).alias("ratio"))


def v1_tiers(bytes_: DataFrame) -> DataFrame:
    """Per stream of the cycle container without cycles: n, relational and literal tokens, bits, encoded bytes, ratio.

    A byte is relational if the cheapest operator from the one before costs less than 8; so counts of pairs decide."""
    hit = F.col("cost") < algebra.WORTH_BELOW
    r = edges(digrams(bytes_)).groupBy("stream_id").agg(F.sum(F.when(hit, F.col("freq")).otherwise(0)).alias("relational"))
    n = bytes_.groupBy("stream_id").agg(F.count("*").alias("n"))
    return _v1_sizes(n.join(r, "stream_id", "left").na.fill(0, ["relational"]))


def v1_payload_tiers(payloads: DataFrame) -> DataFrame:
    """The same of rows (stream_id, payload), one stream each: relational bytes are counted in the row, without a shuffle. Null and empty payloads have no row."""
    import pyarrow as pa

    x = np.arange(256)
    cheap = np.zeros((256, 256), bool)
    for op in _SMALL:
        if op.kind.cost < algebra.WORTH_BELOW:
            cheap[x, [op(int(v)) for v in x]] = True

    def run(batches):
        for b in batches:
            n, hits = [], []
            for p in b.column(1):
                v = np.frombuffer(p.as_buffer(), np.uint8) if p.is_valid else np.empty(0, np.uint8)
                n.append(len(v))
                hits.append(int(cheap[v[:-1], v[1:]].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.int64())], names=["stream_id", "n", "relational"])

    return _v1_sizes(payloads.select("stream_id", "payload").mapInArrow(run, "stream_id string, n long, relational long").where("n > 0"))


def v2_tokens(bytes_: DataFrame) -> DataFrame:
    """(stream_id, pos, tier, nbits, value) of the run-length container; long runs are split every 65,535 bytes. value holds the token's bits."""
    isl = runs.islands(bytes_)
    pats = runs.patterns(runs.detected(isl))
    table = runs.step_table(pats)
    found = runs.parsed(isl, table)
    chunks = found.join(table, ["stream_id", "st"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("len") / runs.LONGEST) - 1)))
    start = F.col("start") + F.col("k") * runs.LONGEST
    length = F.least(F.lit(runs.LONGEST), F.col("len") - F.col("k") * runs.LONGEST)
    value = (F.col("v0") + F.col("k") * runs.LONGEST * F.col("st")).bitwiseAND(255)
    run = chunks.select("stream_id", start.alias("pos"), F.lit("ARITH_RUN").alias("tier"), F.lit(33).alias("nbits"), (F.lit(1 << 32) + value * (1 << 24) + F.col("idx") * (1 << 16) + length).cast("long").alias("value"))
    # bytes outside of runs: +1 where a run starts, -1 after it ends, in each chunk that it crosses, summed along the chunk
    last = F.col("start") + F.col("len")
    crossed = found.select("stream_id", "start", last.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / CHUNK), F.floor((last - 1) / CHUNK))).alias("c"))
    opens = crossed.select("stream_id", "c", F.greatest(F.col("start"), F.col("c") * CHUNK).alias("pos"), F.lit(None).cast("int").alias("v"), F.lit(1).alias("d"))
    closes = crossed.where(F.col("end") < (F.col("c") + 1) * CHUNK).select("stream_id", "c", F.col("end").alias("pos"), F.lit(None).cast("int").alias("v"), F.lit(-1).alias("d"))
    cut = bytes_.select("stream_id", F.floor(F.col("pos") / CHUNK).alias("c"), "pos", "v", F.lit(0).alias("d"))
    w = Window.partitionBy("stream_id", "c").orderBy("pos")  # rows of one position count together
    free = cut.unionByName(opens).unionByName(closes).withColumn("in_run", F.sum("d").over(w)).where("in_run = 0 and v is not null")
    literal = free.select("stream_id", "pos", F.lit("LITERAL").alias("tier"), F.lit(9).alias("nbits"), F.col("v").cast("long").alias("value"))
    return run.unionByName(literal)


def offsets(tokens: DataFrame) -> DataFrame:
    """Adds the bit at which each token starts in its stream's body: the tokens' bits before it, by chunks of positions and the chunks' totals."""
    cut = tokens.withColumn("c", F.floor(F.col("pos") / CHUNK))
    order = Window.partitionBy("stream_id").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    spine = cut.groupBy("stream_id", "c").agg(F.sum("nbits").alias("bits")).select("stream_id", "c", F.coalesce(F.sum("bits").over(order), F.lit(0)).alias("shift"))
    within = Window.partitionBy("stream_id", "c").orderBy("pos")
    return cut.withColumn("at", F.sum("nbits").over(within) - F.col("nbits")).join(spine, ["stream_id", "c"]).withColumn("bit_offset", F.col("at") + F.col("shift")).drop("c", "at", "shift")


def summary(sizes: DataFrame) -> DataFrame:
    """(stream_id, original_bits, compressed_bits, ratio, saving, line) of rows (stream_id, n, encoded_bytes); an empty stream has no ratio."""
    bits, to = F.col("n") * 8, F.col("encoded_bytes") * 8
    ratio = to / F.nullif(bits, F.lit(0)).cast("double")
    r = sizes.select("stream_id", bits.cast("long").alias("original_bits"), to.cast("long").alias("compressed_bits"), ratio.alias("ratio"), (1 - ratio).alias("saving"))
    return r.withColumn("line", F.format_string("%s: %d -> %d bits, ratio %.4f, saving %.2f%%", "stream_id", "original_bits", "compressed_bits", "ratio", F.col("saving") * 100))


def packed(tokens: DataFrame) -> DataFrame:
    """(stream_id, body): tokens in order of pos as bits, the highest first, filled up with zeros to whole bytes."""
    items = F.array_sort(F.collect_list(F.struct("pos", "nbits", "value")))
    bits = F.array_join(F.transform(items, lambda t: F.lpad(F.bin(t["value"]), t["nbits"], "0")), "")
    full = F.rpad(bits, (F.ceil(F.length(bits) / 8) * 8).cast("int"), "0")
    return tokens.groupBy("stream_id").agg(full.alias("bits")).select("stream_id", F.unhex(F.array_join(F.transform(F.split("bits", r"(?<=\G.{8})"), lambda b: F.when(b != "", F.lpad(F.conv(b, 2, 16), 2, "0")).otherwise("")), "")).alias("body"))


def encode_v2(bytes_: DataFrame) -> DataFrame:
    """(stream_id, encoded): the run-length container of each stream, header and body; for streams that fit a row."""
    isl = runs.islands(bytes_)
    table = runs.step_table(runs.patterns(runs.detected(isl)))
    head = table.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("idx", "st"))).alias("steps"))
    n = bytes_.groupBy("stream_id").agg(F.count("*").alias("n"))
    j = n.join(packed(v2_tokens(bytes_)), "stream_id").join(head, "stream_id", "left")
    byte = lambda c, w=2: F.lpad(F.hex(c.cast("long")), w, "0")
    listed = F.coalesce(F.array_join(F.transform("steps", lambda s: byte(s["st"])), ""), F.lit(""))
    header = F.concat(F.lit(PREFIX.hex() + "02"), byte(F.coalesce(F.size("steps"), F.lit(0))), listed, byte(F.col("n"), 8))
    return j.select("stream_id", F.concat(F.unhex(header), F.col("body")).alias("encoded"))


# -- whole containers in Python, for rows of bytes


class Bits:
    """Writes and reads bits, the highest first."""

    def __init__(self, data: bytes = b""):
        self.data, self.at, self.out = data, 0, []

    def put(self, value: int, n: int) -> None:
        self.out.append((value & (1 << n) - 1, n))

    def done(self) -> bytes:
        text = "".join(f"{v:0{n}b}" for v, n in self.out if n)
        text += "0" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""

    def get(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise FormatError("the data ends within a token")
        first, last = self.at // 8, (self.at + n + 7) // 8
        value = int.from_bytes(self.data[first:last], "big") >> 8 * last - self.at - n & (1 << n) - 1
        self.at += n
        return value


def _cheap(a: int, b: int, rules=None) -> algebra.Op:
    best = next((op for op in _SMALL if op(a) == b), None)
    own = (rules or {}).get((a, b))
    if own is not None and (best is None or own.operand_bits <= best.operand_bits):
        return own
    return best or algebra.Op(0, b - a & 255)


_SMALL = [algebra.Op(i) for i in (10, 11, 12, 13)]


def encode_v1(data: bytes, cycles: list[list[int]] = (), rules=None) -> bytes:
    """The cycle container. A position takes, in this order, two or more repeats of a cycle that starts with its byte, an operator that costs less than 8 from the byte before, or a literal."""
    cycles = [list(c) for c in cycles]
    width = max(1, (len(cycles) - 1).bit_length()) if cycles else 1
    starts: dict[int, list[int]] = {}
    for i, c in enumerate(cycles):
        starts.setdefault(c[0], []).append(i)
    bits = Bits()
    for b in (*PREFIX, 1, min(len(cycles), MOST_CYCLES)):
        bits.put(b, 8)
    for c in cycles[:MOST_CYCLES]:
        bits.put(len(c), 8)
        for x in c:
            bits.put(x, 8)
        for x, y in zip(c, c[1:] + c[:1]):
            op = _full(x, y)
            bits.put(op.op_id, 8)
            if op.operand_bits:
                bits.put(op.operand, op.operand_bits)
    bits.put(len(data), 32)
    at = 0
    while at < len(data):
        taken = 0
        for i in starts.get(data[at], ()):
            c = bytes(cycles[i])
            n = 0
            while n < runs.LONGEST and data[at + n * len(c) : at + (n + 1) * len(c)] == c:
                n += 1
            if n >= 2 and CYCLE_FLAG_BITS + width + REPEAT_BITS < 9 * len(c) * n:
                bits.put(0b110, 3)
                bits.put(i, width)
                bits.put(n, REPEAT_BITS)
                taken = n * len(c)
                break
        if not taken:
            op = _cheap(data[at - 1], data[at], rules) if at else None
            if op is not None and op.kind.cost < algebra.WORTH_BELOW:
                bits.put(0b10, 2)
                bits.put(op.op_id, 5)
            else:
                bits.put(data[at], 9)
            taken = 1
        at += taken
    return bits.done()


def _full(a: int, b: int) -> algebra.Op:
    op = _cheap(a, b)
    if op.op_id != 0:
        return op
    return next((algebra.Op(i, k) for i in (8, 9) for k in range(1, 8) if algebra.Op(i, k)(a) == b), op)


def encode_v2_row(data: bytes) -> bytes:
    """The run-length container of one row's bytes; the windows' twin for rows, and its oracle in tests."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    saved: dict[int, list[int]] = {}
    at = 0
    while at + 1 < len(x):
        st, end = int(x[at + 1] - x[at]) & 255, at + 1
        while end + 1 < len(x) and int(x[end + 1] - x[end]) & 255 == st:
            end += 1
        n = end - at + 1
        if n >= algebra.BREAK_EVEN:
            s = saved.setdefault(st, [0])
            s[0] += n * 9 - 33 * math.ceil(n / runs.LONGEST)
        at = end + 1 if n >= 2 else at + 1
    steps = [st for st, (s,) in sorted(saved.items(), key=lambda i: (-i[1][0], i[0])) if s > 0][: runs.MOST_STEPS]
    index = {st: i for i, st in enumerate(steps)}
    bits = Bits()
    for b in (*PREFIX, 2, len(steps), *steps):
        bits.put(b, 8)
    bits.put(len(x), 32)
    at = 0
    while at < len(x):
        n = 1
        if at + 1 < len(x) and (st := int(x[at + 1] - x[at]) & 255) in index:
            n = 2
            while at + n < len(x) and int(x[at + n] - x[at + n - 1]) & 255 == st:
                n += 1
        if n >= algebra.BREAK_EVEN:
            for s in range(0, n, runs.LONGEST):
                bits.put(1, 1)
                bits.put(int(x[at] + s * st) & 255, 8)
                bits.put(index[st], 8)
                bits.put(min(runs.LONGEST, n - s), 16)
            at += n
        else:
            bits.put(int(x[at]), 9)
            at += 1
    return bits.done()


def decode(data: bytes) -> bytes:
    """The bytes of either container; FormatError for what isn't one."""
    if len(data) < 5 or data[:3] != PREFIX:
        raise FormatError("this is no container")
    bits = Bits(data)
    bits.get(24)
    version, count = bits.get(8), bits.get(8)
    out = bytearray()
    if version == 1:
        cycles = []
        for _ in range(count):
            nodes = [bits.get(8) for _ in range(bits.get(8))]
            for _ in nodes:
                kind = algebra.KINDS.get(bits.get(8))
                if kind is None:
                    raise FormatError("unknown operator")
                bits.get(kind.operand_bits)
            cycles.append(bytes(nodes))
        n, width = bits.get(32), max(1, (count - 1).bit_length()) if count else 1
        while len(out) < n:
            if not bits.get(1):
                out.append(bits.get(8))
            elif not bits.get(1):
                kind = algebra.KINDS.get(bits.get(5))
                if kind is None or not out:
                    raise FormatError("an operator without a byte to work on, or an unknown one")
                out.append(algebra.Op(kind.op_id, bits.get(kind.operand_bits) if kind.operand_bits else 0)(out[-1]))
            else:
                bits.get(1)
                i, times = bits.get(width), bits.get(REPEAT_BITS)
                if i >= len(cycles):
                    raise FormatError("no such cycle")
                out += cycles[i] * times
        return bytes(out[:n])
    if version == 2:
        steps = [bits.get(8) for _ in range(count)]
        n = bits.get(32)
        while len(out) < n:
            if not bits.get(1):
                out.append(bits.get(8))
                continue
            v, i, times = bits.get(8), bits.get(8), bits.get(16)
            if i >= len(steps):
                raise FormatError("no such step")
            out += bytes((v + k * steps[i]) & 255 for k in range(times))
        return bytes(out)
    raise FormatError(f"version {version} isn't supported")


def encoded(streams: DataFrame, version: int = 2, cycles: dict[str, list[list[int]]] | list[list[int]] | None = None) -> DataFrame:
    """(stream_id, encoded) of rows (stream_id, payload). cycles: by stream, or one list for all streams."""

    def run(frames):
        for pdf in frames:
            pdf["encoded"] = [encode_v2_row(bytes(p)) if version == 2 else encode_v1(bytes(p), cycles if isinstance(cycles, list) else (cycles or {}).get(s, ())) for s, p in zip(pdf.stream_id, pdf.payload)]
            yield pdf[["stream_id", "encoded"]]

    ship(streams.sparkSession)
    return streams.select("stream_id", "payload").mapInPandas(run, "stream_id string, encoded binary")


def decoded(rows: DataFrame) -> DataFrame:
    """(stream_id, payload) of rows (stream_id, encoded)."""

    def run(frames):
        for pdf in frames:
            pdf["payload"] = [decode(bytes(e)) for e in pdf.encoded]
            yield pdf[["stream_id", "payload"]]

    ship(rows.sparkSession)
    return rows.select("stream_id", "encoded").mapInPandas(run, "stream_id string, payload binary")


# -- the wrapper that names or embeds a snapshot


def wrap_v3(body: bytes, snapshot_id: str, snapshot: bytes | None = None) -> bytes:
    """connected (the id alone) or, with a snapshot, standalone: header, the embedded snapshot, body."""
    if len(snapshot_id) != 64:
        raise ValueError("an id has 64 hexadecimal digits")
    head = PREFIX + b"\x33" + bytes([V3_CONNECTED if snapshot is None else V3_STANDALONE]) + bytes.fromhex(snapshot_id) + len(body).to_bytes(4, "big")
    return head + (b"" if snapshot is None else len(snapshot).to_bytes(4, "big") + snapshot) + body


def read_v3(data: bytes, mode: int | None = None) -> tuple[int, str, bytes | None, bytes]:
    """(mode, id, embedded snapshot, decoded bytes)."""
    if data[:4] != PREFIX + b"\x33" or len(data) < V3_HEADER:
        raise FormatError("this is no wrapped container")
    if mode is not None and data[4] != mode:
        raise FormatError("another mode is expected")
    n, at, inner = int.from_bytes(data[37:41], "big"), V3_HEADER, None
    if data[4] == V3_STANDALONE:
        size = int.from_bytes(data[at : at + 4], "big")
        inner, at = data[at + 4 : at + 4 + size], at + 4 + size
    if len(data) < at + n:
        raise FormatError("the body is cut off")
    return data[4], data[5:37].hex(), inner, decode(data[at : at + n])


def wrapped(streams: DataFrame, snapshot_id: str, snapshot: bytes | None = None, store: str | None = None) -> DataFrame:
    """(stream_id, encoded) of rows (stream_id, payload): run-length containers that name a snapshot, or embed it where its bytes are given. store: a folder of snapshots
    that must hold the named one, or an error is raised before anything is encoded."""
    if store is not None:
        from byteloom.sources.snapshots import SnapshotError, exists

        if not exists(streams.sparkSession, store, snapshot_id):
            raise SnapshotError(f"no snapshot {snapshot_id}")

    def run(frames):
        for pdf in frames:
            pdf["encoded"] = [wrap_v3(encode_v2_row(bytes(p)), snapshot_id, snapshot) for p in pdf.payload]
            yield pdf[["stream_id", "encoded"]]

    ship(streams.sparkSession)
    return streams.select("stream_id", "payload").mapInPandas(run, "stream_id string, encoded binary")


def unwrapped(rows: DataFrame, mode: int | None = None) -> DataFrame:
    """(stream_id, mode, snapshot_id, snapshot, payload) of rows (stream_id, encoded); a container of another mode than the one asked for is an error."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame([(i, *read_v3(bytes(e), mode)) for i, e in zip(pdf.stream_id, pdf.encoded)], columns=["stream_id", "mode", "snapshot_id", "snapshot", "payload"])

    ship(rows.sparkSession)
    return rows.select("stream_id", "encoded").mapInPandas(run, "stream_id string, mode int, snapshot_id string, snapshot binary, payload binary")


#: The bounds of the ratio of the cycle container for generated streams (kind, bytes, step, frequency).
BASELINE = {("uniform", 4096): 1.02, ("lcg", 4096): 0.85, ("gaussian", 4096): 0.75, ("arithmetic", 1024): 0.30, ("sine", 1024): 0.50}


def baseline(spark) -> DataFrame:
    """(stream_id, n, ratio, bound, within, equal): generated streams through the cycle container and back, and whether the ratio keeps its bound."""
    from functools import reduce

    from byteloom.sources.streams import collected, generated

    raw = collected(reduce(lambda x, y: x.unionByName(y), (generated(spark, kind, n) for kind, n in BASELINE)))
    coded = encoded(raw, 1)
    back = decoded(coded).withColumnRenamed("payload", "back")
    bounds = spark.createDataFrame([(kind, b) for (kind, _), b in BASELINE.items()], "stream_id string, bound double")
    r = raw.join(coded, "stream_id").join(back, "stream_id").join(bounds, "stream_id")
    ratio = F.octet_length("encoded") / F.octet_length("payload")
    return r.select("stream_id", F.octet_length("payload").cast("long").alias("n"), ratio.alias("ratio"), "bound", (ratio <= F.col("bound")).alias("within"), (F.col("payload") == F.col("back")).alias("equal"))


def v3_headers(rows: DataFrame, column: str = "encoded") -> DataFrame:
    """stream_id, mode, snapshot_id and body length read from wrapped containers, by built-in functions."""
    c = F.col(column)
    ok = F.hex(F.substring(c, 1, 4)) == (PREFIX + b"\x33").hex().upper()
    mode = F.when(ok, F.conv(F.hex(F.substring(c, 5, 1)), 16, 10).cast("int")).otherwise(F.raise_error(F.lit("this is no wrapped container")).cast("int"))
    return rows.select("stream_id", mode.alias("mode"), F.lower(F.hex(F.substring(c, 6, 32))).alias("snapshot_id"), F.conv(F.hex(F.substring(c, 38, 4)), 16, 10).cast("long").alias("body_bytes"))


def relational_share(bytes_: DataFrame) -> DataFrame:
    """Per byte: whether it follows the byte before by a cheap operator."""
    return with_next(bytes_).where("nxt is not null").select("stream_id", "pos", (algebra.cheapest(F.col("v"), F.col("nxt"))["cost"] < algebra.WORTH_BELOW).alias("relational"))
