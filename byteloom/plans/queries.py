"""Named queries over the driver's tables, and SQL twins for another engine. The twins are written apart from the operators: loops become windows or
recursion there as they suit SQL, so that the two check each other."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom.functions import algebra
from byteloom.operators import codec, evolve, graph, profiles, runs
from byteloom.sources import snapshots, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


# -- fragments of the twins

EVENTS = "b AS (SELECT event_type AS stream_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, CAST(floor(value) AS BIGINT) & 255 AS v FROM events)"
LEVELS = "b AS (SELECT event_type AS stream_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, CAST(floor(value / 8) AS BIGINT) & 3 AS v FROM events)"
USERS = "b AS (SELECT CAST(user_id AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CAST(floor(value) AS BIGINT) & 255 AS v FROM events)"
LINES = "b AS (SELECT CAST(l_suppkey AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice, l_quantity) - 1 AS pos, CAST(l_quantity AS BIGINT) & 255 AS v FROM lineitem)"
ORDERS = "b AS (SELECT CAST(o_custkey AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, CAST(floor(o_totalprice) AS BIGINT) & 255 AS v FROM orders)"


def _hex_bytes(table: str, key: str, text: str) -> str:
    return f"b AS (SELECT stream_id, generate_subscripts(h, 1) - 1 AS pos, CAST('0x' || unnest(h) AS BIGINT) AS v FROM (SELECT {key} AS stream_id, regexp_extract_all(hex(encode({text})), '..') AS h FROM {table} WHERE {text} <> ''))"


DOCS = _hex_bytes("documents", "CAST(doc_id AS VARCHAR)", "text")
PAGES = _hex_bytes("pages", "CAST(page_id AS VARCHAR)", "html")
TURNS = _hex_bytes("conversations", "conv_id || '/' || turn", "text")
PAIRS = "p AS (SELECT stream_id, pos, v AS a, lead(v) OVER (PARTITION BY stream_id ORDER BY pos) AS b FROM b)"
COUNTED = "d AS (SELECT stream_id, a, b, count(*) AS freq FROM p WHERE b IS NOT NULL GROUP BY ALL)"
_LEFT = " ".join(f"WHEN ((a << {k}) & 255) = b THEN {{l{k}}}" for k in range(1, 8))
_RIGHT = " ".join(f"WHEN (a >> {k}) = b THEN {{r{k}}}" for k in range(1, 8))


def _case(no: str, inc: str, dec: str, same: str, left, right, other: str) -> str:
    shifts = _LEFT.format(**{f"l{k}": left(k) for k in range(1, 8)}) + " " + _RIGHT.format(**{f"r{k}": right(k) for k in range(1, 8)})
    return f"CASE WHEN 255 - a = b THEN {no} WHEN (a + 1) % 256 = b THEN {inc} WHEN (a + 255) % 256 = b THEN {dec} WHEN a = b THEN {same} {shifts} ELSE {other} END"


OP = _case("10", "11", "12", "13", lambda k: "8", lambda k: "9", "0")
OPERAND = _case("0", "0", "0", "0", str, str, "(b - a) & 255")
COST = _case("5", "5", "5", "5", lambda k: "8", lambda k: "8", "13")
EDGES = f"e AS (SELECT stream_id, a, b, freq, CAST({OP} AS BIGINT) AS op_id, CAST({OPERAND} AS BIGINT) AS operand, CAST({COST} AS BIGINT) AS cost, CAST(freq * (8 - ({COST})) AS DOUBLE) AS weight FROM d)"
EDGE_CHAIN = f"WITH {EVENTS}, {PAIRS}, {COUNTED}, {EDGES}"
ISLANDS = """d AS (SELECT stream_id, pos, v, ((lead(v) OVER (PARTITION BY stream_id ORDER BY pos)) - v) & 255 AS st FROM b),
f AS (SELECT *, CASE WHEN st = lag(st) OVER (PARTITION BY stream_id ORDER BY pos) THEN 0 ELSE 1 END AS chg FROM d WHERE st IS NOT NULL),
g AS (SELECT *, sum(chg) OVER (PARTITION BY stream_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl FROM f),
i AS (SELECT stream_id, isl, st, min(pos) AS p0, count(*) AS m, arg_min(v, pos) AS v0 FROM g GROUP BY stream_id, isl, st)"""
DETECTED = """j AS (SELECT *, max(CASE WHEN m >= 2 THEN isl END) OVER (PARTITION BY stream_id ORDER BY isl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last2 FROM i),
k AS (SELECT *, CASE WHEN last2 IS NULL THEN (isl - 1) % 2 ELSE 1 - ((isl - 1 - last2) % 2) END AS sw FROM j),
r AS (SELECT stream_id, st, p0 + sw AS start, m - sw + 1 AS len FROM k WHERE m - sw + 1 >= 4)"""
PATTERNS = "pat AS (SELECT stream_id, st, sum(len) AS run_bytes, count(*) AS run_count, sum(len) * 9 - 33 * sum((len + 65534) // 65535) AS saving FROM r GROUP BY stream_id, st HAVING sum(len) * 9 - 33 * sum((len + 65534) // 65535) > 0)"
PARSED = """x AS (SELECT i.*, coalesce(pat.st IS NOT NULL AND m = 3, false) AS tog, coalesce(pat.st IS NOT NULL AND m >= 4, false) AS big FROM i LEFT JOIN pat USING (stream_id, st)),
y AS (SELECT *, max(CASE WHEN NOT tog THEN isl END) OVER (PARTITION BY stream_id ORDER BY isl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastn FROM x),
z AS (SELECT y.*, CASE WHEN (y.isl - 1 - coalesce(y.lastn, 0)) % 2 = 0 THEN coalesce(q.big, false)::INT ELSE 1 - coalesce(q.big, false)::INT END AS prev FROM y LEFT JOIN x q ON q.stream_id = y.stream_id AND q.isl = y.lastn),
tok AS (SELECT stream_id, st, p0 + prev AS start, m + 1 - prev AS len, (v0 + prev * st) & 255 AS v0 FROM z WHERE big OR (tog AND prev = 0))"""
RUN_CHAIN = f"WITH {LEVELS}, {ISLANDS}, {DETECTED}, {PATTERNS}"


# -- sources


def _summary(b: DataFrame) -> DataFrame:
    return b.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"), F.sum((F.col("pos") % 997 + 1) * F.col("v")).cast("long").alias("weighted"), F.max("pos").cast("long").alias("last"))


_SUMMARY = "SELECT stream_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum((pos % 997 + 1) * v) AS BIGINT) AS weighted, CAST(max(pos) AS BIGINT) AS last FROM b GROUP BY stream_id"
for _name, _make, _sql in (
    ("bytes_from_events", streams.events_by_type, EVENTS),
    ("bytes_from_users", streams.events_by_user, USERS),
    ("bytes_from_lineitem", streams.lineitem_by_supplier, LINES),
    ("bytes_from_orders", streams.orders_by_customer, ORDERS),
    ("bytes_from_documents", streams.document_bytes, DOCS),
    ("bytes_from_pages", streams.page_bytes, PAGES),
    ("bytes_from_conversations", streams.turn_bytes, TURNS),
):
    query(_name, f"WITH {_sql} {_SUMMARY}")(lambda s, d, make=_make: _summary(make(s, d)))


@query("seed_corpus", "SELECT CAST(v AS BIGINT) AS v, count(*) AS n FROM (SELECT range % 256 AS v FROM range(4096)) GROUP BY v")
def seed_corpus(spark, sf_dir):
    return _long(streams.seed(spark).groupBy("v").agg(F.count("*").alias("n")), "v")


@query("corpus_window", f"WITH {EVENTS}, w AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY pos DESC) AS k FROM b) SELECT stream_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(min(pos) AS BIGINT) AS first FROM w WHERE k <= 1024 GROUP BY stream_id")
def corpus_window(spark, sf_dir):
    b = streams.events_by_type(spark, sf_dir)
    ends = b.groupBy("stream_id").agg(F.max("pos").alias("end"))
    held = streams.window(b, 1024)
    return held.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"), F.max("pos").alias("held")).join(ends, "stream_id").select("stream_id", "n", "total", (F.col("end") - F.col("held")).alias("first"))


@query("generated_streams", "WITH RECURSIVE l(i, x) AS (SELECT 0, (1664525 * 1::HUGEINT + 1013904223) % 4294967296 UNION ALL SELECT i + 1, (1664525 * x + 1013904223) % 4294967296 FROM l WHERE i < 1023), g AS (SELECT 'lcg' AS stream_id, i AS pos, CAST(x % 256 AS BIGINT) AS v FROM l UNION ALL SELECT 'arithmetic', range, range * 3 % 256 FROM range(1024) UNION ALL SELECT 'sine', range, CAST(round(127.5 + 127.5 * round(sin(6.283185307179586 * 0.05 * range), 9)) AS BIGINT) FROM range(1024)) SELECT stream_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (pos % 31 + 1)) AS BIGINT) AS weighted FROM g GROUP BY stream_id")
def generated_streams(spark, sf_dir):
    g = streams.generated(spark, "lcg", 1024, seed=1).unionByName(streams.generated(spark, "arithmetic", 1024, step=3)).unionByName(streams.generated(spark, "sine", 1024))
    return g.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"), F.sum(F.col("v") * (F.col("pos") % 31 + 1)).cast("long").alias("weighted"))


# -- algebra

_SQL_OPS = {"Add": "(x + k) & 255", "Sub": "(x - k) & 255", "Mul": "(x * k) & 255", "Div": "x // k", "Mod": "x % k", "Xor": "xor(x, k)", "And": "x & k", "Or": "x | k", "ShiftLeft": "(x << k) & 255", "ShiftRight": "x >> k", "Not": "255 - x", "Inc": "(x + 1) & 255", "Dec": "(x + 255) & 255", "Identity": "x", "RotateLeft": "((x << k) | (x >> (8 - k))) & 255", "RotateRight": "((x >> k) | (x << (8 - k))) & 255", "BitReverse": "((x & 1) << 7) | ((x & 2) << 5) | ((x & 4) << 3) | ((x & 8) << 1) | ((x & 16) >> 1) | ((x & 32) >> 3) | ((x & 64) >> 5) | (x >> 7)", "NibbleSwap": "((x << 4) | (x >> 4)) & 255"}


def _op_table(names) -> str:
    rows = []
    for n in names:
        ks = algebra.BY_NAME[n].operands
        rows.append(f"SELECT '{n}' AS name, x, k, CAST({_SQL_OPS[n]} AS BIGINT) AS y FROM xs, (SELECT range AS k FROM range({ks.start if ks else 0}, {ks.stop if ks else 1})) ks")
    return "WITH xs AS (SELECT range AS x FROM range(256)), t AS (" + " UNION ALL ".join(rows) + ") SELECT name, count(*) AS n, CAST(sum(y) AS BIGINT) AS total, CAST(sum(y * (x * 7 + k * 13 + 1)) AS BIGINT) AS weighted FROM t GROUP BY name"


def _ops(spark, names) -> DataFrame:
    xs = spark.range(256).select(F.col("id").cast("int").alias("x"))
    parts = []
    for n in names:
        kind = algebra.BY_NAME[n]
        if kind.operand_bits == 8:
            rows = xs.withColumn("k", F.explode(F.sequence(F.lit(kind.operands.start), F.lit(255))))
            parts.append(rows.select(F.lit(n).alias("name"), "x", F.struct("k", kind.apply(F.col("x"), F.col("k")).cast("long").alias("y")).alias("o")))
        else:  # shifts take their operand as a constant
            y = F.array(*(F.struct(F.lit(k).alias("k"), kind.apply(F.col("x"), k).cast("long").alias("y")) for k in (kind.operands or [0])))
            parts.append(xs.select(F.lit(n).alias("name"), "x", F.explode(y).alias("o")))
    t = reduce(DataFrame.unionByName, parts)
    return t.groupBy("name").agg(F.count("*").alias("n"), F.sum("o.y").alias("total"), F.sum(F.col("o.y") * (F.col("x") * 7 + F.col("o.k") * 13 + 1)).cast("long").alias("weighted"))


_BASE = [k.name for k in algebra.BASE]
_MORE = ["RotateLeft", "RotateRight", "BitReverse", "NibbleSwap"]
query("base_operators", _op_table(_BASE))(lambda s, d: _ops(s, _BASE))
query("extended_operators", _op_table(_MORE))(lambda s, d: _ops(s, _MORE))
for _n in _BASE:
    query(f"op_{_n.lower()}", _op_table([_n]))(lambda s, d, n=_n: _ops(s, [n]))


@query("formula_operators", "WITH t AS (SELECT 'polynomial' AS name, a, c, x, (a * x * x + c) & 255 AS y FROM (SELECT range AS a FROM range(16)), (SELECT range AS c FROM range(16)), (SELECT range AS x FROM range(256)) UNION ALL SELECT 'linear', a, c, x, (a * x + c) & 255 FROM (SELECT range AS a FROM range(1, 256, 2)), (SELECT range AS c FROM range(256)), (SELECT range AS x FROM range(256))) SELECT name, a, CAST(sum(y) AS BIGINT) AS total, CAST(sum(y * (c * 3 + x)) AS BIGINT) AS weighted FROM t GROUP BY name, a")
def formula_operators(spark, sf_dir):
    def made(name, a, square):
        y = algebra.Formula(F.col("a").cast("int"), F.col("c").cast("int"), square)(F.col("x").cast("int"))
        return a.select(F.lit(name).alias("name"), "a", F.explode(F.sequence(F.lit(0), F.lit(15 if square else 255))).alias("c")).select("name", "a", "c", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("x")).withColumn("y", y)

    t = made("polynomial", spark.range(16).withColumnRenamed("id", "a"), True).unionByName(made("linear", spark.range(1, 256, 2).withColumnRenamed("id", "a"), False))
    return t.groupBy("name", "a").agg(F.sum("y").cast("long").alias("total"), F.sum(F.col("y") * (F.col("c") * 3 + F.col("x"))).cast("long").alias("weighted"))


_OP = algebra.Op
for _name, _sql, _op in (
    ("table_operator", "(x * 7 + 3) % 256", algebra.Table(tuple((v * 7 + 3) % 256 for v in range(256)))),
    ("composite_operator", "(xor((x + 5) & 255, 90) << 1) & 255", algebra.Composite((_OP(0, 5), _OP(5, 90), _OP(8, 1)))),
    ("iterated_operator", "(x * 243) & 255", algebra.iterated(_OP(2, 3), 5)),
    ("fixed_point_operator", "x // 8", algebra.fixed_point(_OP(3, 2), 3)),
    ("conjugate_operator", "xor((xor(x, 85) + 1) & 255, 85)", algebra.conjugate(_OP(11), _OP(5, 85))),
):
    query(_name, f"SELECT x, CAST({_sql} AS BIGINT) AS y FROM (SELECT range AS x FROM range(256))")(lambda s, d, op=_op: s.range(256).select(F.col("id").alias("x"), op(F.col("id").cast("int")).cast("long").alias("y")))


_SCAN = " UNION ALL ".join(f"SELECT {k.op_id} AS op_id, k AS operand, {k.cost} AS cost, {i} * 1000 + k AS ord, x AS a, CAST({_SQL_OPS[k.name]} AS BIGINT) AS b FROM xs, (SELECT range AS k FROM range({k.operands.start if k.operands else 0}, {k.operands.stop if k.operands else 1})) ks" for i, k in enumerate([algebra.KINDS[i] for i in (10, 11, 12, 13, *range(10))]))


@query("op_lut_summary", f"WITH xs AS (SELECT range AS x FROM range(256)), t AS ({_SCAN}), best AS (SELECT a, b, arg_min(op_id, cost * 100000 + ord) AS op_id, arg_min(operand, cost * 100000 + ord) AS operand, min(cost) AS cost FROM t GROUP BY a, b) SELECT CAST(op_id AS BIGINT) AS op_id, CAST(cost AS BIGINT) AS cost, count(*) AS cells, CAST(sum(operand) AS BIGINT) AS operands FROM best GROUP BY op_id, cost")
def op_lut_summary(spark, sf_dir):
    """Its twin scans every operator for every pair."""
    return _long(algebra.lookup(spark).groupBy("op_id", "cost").agg(F.count("*").alias("cells"), F.sum("operand").cast("long").alias("operands")), "op_id", "cost")


_ROT = f"SELECT 35 AS op_id, k AS operand, 9 AS cost, 2 * 100000 + k AS ord, x AS a, CAST({_SQL_OPS['RotateLeft']} AS BIGINT) AS b FROM xs, (SELECT range AS k FROM range(1, 8)) ks"
_REV = f"SELECT 37 AS op_id, 0 AS operand, 6 AS cost, 50000 AS ord, x AS a, CAST({_SQL_OPS['BitReverse']} AS BIGINT) AS b FROM xs UNION ALL SELECT 38, 0, 6, 50001, x, CAST({_SQL_OPS['NibbleSwap']} AS BIGINT) FROM xs"


@query("op_lut_ext_summary", f"WITH xs AS (SELECT range AS x FROM range(256)), t AS (SELECT op_id, operand, cost + 1 AS cost, ord, a, b FROM ({_SCAN}) UNION ALL {_ROT} UNION ALL {_REV}), best AS (SELECT a, b, arg_min(op_id, cost * 1000000 + ord) AS op_id, min(cost) AS cost FROM t GROUP BY a, b) SELECT CAST(op_id AS BIGINT) AS op_id, CAST(cost AS BIGINT) AS token_cost, count(*) AS cells FROM best GROUP BY op_id, cost")
def op_lut_ext_summary(spark, sf_dir):
    return algebra.lookup(spark, extended=True).groupBy(F.col("op_id").cast("long").alias("op_id"), (F.col("cost") + 1).cast("long").alias("token_cost")).agg(F.count("*").alias("cells"))


@query("op_catalogue", "SELECT * FROM (VALUES " + ", ".join(f"({k.op_id}::BIGINT, '{k.name}', {k.operand_bits}::BIGINT, {k.cost}::BIGINT, {len(k.operands) or 1}::BIGINT)" for k in algebra.BASE) + ") AS t(op_id, name, operand_bits, cost, members)")
def op_catalogue(spark, sf_dir):
    c = algebra.catalogue(spark).where("op_id <= 13")
    return c.select(F.col("op_id").cast("long").alias("op_id"), "name", F.col("operand_bits").cast("long").alias("operand_bits"), (F.col("operand_bits") + 5).cast("long").alias("cost"), (F.col("max_operand") - F.col("min_operand") + 1).cast("long").alias("members"))


# -- graphs


@query("digrams", f"WITH {EVENTS}, {PAIRS}, {COUNTED} SELECT stream_id, a, b, freq FROM d")
def q_digrams(spark, sf_dir):
    return _long(graph.digrams(streams.events_by_type(spark, sf_dir)), "a", "b")


@query("document_digrams", f"WITH {DOCS}, {PAIRS} SELECT a, b, count(*) AS freq FROM p WHERE b IS NOT NULL GROUP BY a, b")
def document_digrams(spark, sf_dir):
    return _long(graph.payload_digrams(streams.document_payloads(spark, sf_dir), per_stream=False), "a", "b", "freq")


def _edges(spark, sf_dir):
    return _long(graph.edges(graph.digrams(streams.events_by_type(spark, sf_dir))), "a", "b", "op_id", "operand", "cost")


query("edges", f"{EDGE_CHAIN} SELECT * FROM e")(_edges)


@query("document_edges_by_operator", f"WITH {DOCS}, {PAIRS}, d AS (SELECT '' AS stream_id, a, b, count(*) AS freq FROM p WHERE b IS NOT NULL GROUP BY a, b), {EDGES} SELECT op_id, count(*) AS n_edges, CAST(sum(freq) AS BIGINT) AS pairs, CAST(sum(weight) AS DOUBLE) AS weight FROM e GROUP BY op_id")
def document_edges_by_operator(spark, sf_dir):
    d = graph.payload_digrams(streams.document_payloads(spark, sf_dir), per_stream=False).withColumn("stream_id", F.lit(""))
    return _long(graph.edges(d).groupBy("op_id").agg(F.count("*").alias("n_edges"), F.sum("freq").alias("pairs"), F.sum("weight").alias("weight")), "op_id", "pairs")


@query("graph_stats", f"{EDGE_CHAIN} SELECT stream_id, count(DISTINCT a) AS node_count, count(*) AS edge_count, round(avg(weight), 6) AS average_weight, CAST(sum((cost < 8)::INT) AS BIGINT) AS compressing, round(sum((cost < 8)::INT) / count(*), 6) AS compressing_share FROM e GROUP BY stream_id")
def graph_stats(spark, sf_dir):
    return _rounded(graph.statistics(_edges(spark, sf_dir)), "average_weight", "compressing_share")


@query("edge_cost_hist", f"{EDGE_CHAIN} SELECT stream_id, cost, count(*) AS n, CAST(sum(freq) AS BIGINT) AS pairs FROM e GROUP BY stream_id, cost")
def edge_cost_hist(spark, sf_dir):
    return graph.cost_histogram(_edges(spark, sf_dir))


@query("top_edges", f"{EDGE_CHAIN}, t AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY weight DESC, a, b) AS rank FROM e) SELECT * FROM t WHERE rank <= 10")
def q_top_edges(spark, sf_dir):
    return _long(graph.top_edges(_edges(spark, sf_dir)), "rank")


@query("in_out_degree", f"{EDGE_CHAIN}, o AS (SELECT stream_id, a AS node, count(*) AS od FROM e GROUP BY ALL), i AS (SELECT stream_id, b AS node, count(*) AS id FROM e GROUP BY ALL) SELECT stream_id, node, coalesce(od, 0) AS out_degree, coalesce(id, 0) AS in_degree FROM o FULL JOIN i USING (stream_id, node)")
def in_out_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query("best_edges_from_to", f"{EDGE_CHAIN} SELECT stream_id, count(*) FILTER (a = 1 AND b = 2) AS best, count(*) FILTER (a = 1) AS from_1, count(*) FILTER (b = 2) AS to_2 FROM e GROUP BY stream_id")
def best_edges_from_to(spark, sf_dir):
    e = _edges(spark, sf_dir)
    n = lambda df, c: df.groupBy("stream_id").agg(F.count("*").alias(c))
    return e.select("stream_id").distinct().join(n(graph.best_edge(e, 1, 2), "best"), "stream_id", "left").join(n(graph.edges_from(e, 1), "from_1"), "stream_id", "left").join(n(graph.edges_to(e, 2), "to_2"), "stream_id", "left").na.fill(0)


@query("edge_override", f"{EDGE_CHAIN}, r AS (SELECT range AS a, (range * 2) & 255 AS b, 2 AS op_id, 2 AS operand, 13 AS cost FROM range(256)) SELECT stream_id, a, b, CAST(coalesce(r.op_id, e.op_id) AS BIGINT) AS op_id, CAST(coalesce(r.operand, e.operand) AS BIGINT) AS operand, CAST(coalesce(r.cost, e.cost) AS BIGINT) AS cost, CASE WHEN r.op_id IS NULL THEN freq ELSE 0 END AS freq, CASE WHEN r.op_id IS NULL THEN weight ELSE 0.0 END::DOUBLE AS weight FROM e LEFT JOIN r USING (a, b)")
def edge_override(spark, sf_dir):
    rules = spark.range(256).select(F.col("id").alias("a"), (F.col("id") * 2).bitwiseAND(255).alias("b"), F.lit(2).alias("op_id"), F.lit(2).alias("operand"), F.lit(13).alias("cost"))
    return _long(graph.overridden(_edges(spark, sf_dir), rules), "op_id", "operand", "cost", "freq")


@query("dominated_edges", f"{EDGE_CHAIN} SELECT stream_id, a, b, cost FROM e WHERE cost < 9")
def dominated_edges(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.dominates(e, e.withColumn("cost", F.lit(9))).select("stream_id", "a", "b", "cost")


#: A small graph in the four levels of event values, so that recursion stays small in the twin.
_SMALL = f"WITH RECURSIVE {LEVELS}, {PAIRS}, {COUNTED}, {EDGES}"


def _small_edges(spark, sf_dir):
    return _long(graph.edges(graph.digrams(streams.event_levels(spark, sf_dir))), "a", "b", "op_id", "operand", "cost")


_REACH = "t(stream_id, x, y) AS (SELECT stream_id, a, b FROM e UNION SELECT t.stream_id, t.x, e.b FROM t JOIN e ON e.stream_id = t.stream_id AND e.a = t.y), nodes AS (SELECT stream_id, a AS node FROM e UNION SELECT stream_id, b FROM e)"


@query("scc", f"{_SMALL}, {_REACH}, s AS (SELECT n.stream_id, n.node, m.node AS other FROM nodes n JOIN nodes m USING (stream_id) WHERE n.node = m.node OR (EXISTS (SELECT 1 FROM t WHERE t.stream_id = n.stream_id AND t.x = n.node AND t.y = m.node) AND EXISTS (SELECT 1 FROM t WHERE t.stream_id = n.stream_id AND t.x = m.node AND t.y = n.node))) SELECT stream_id, node, min(other) AS root, count(*) AS size FROM s GROUP BY stream_id, node")
def scc(spark, sf_dir):
    return _long(graph.strong_components(_small_edges(spark, sf_dir)), "node", "root", "size")


_CYCLES = """c(stream_id, nodes, cost, weight) AS (SELECT stream_id, [a, b], cost, weight FROM e WHERE a < b UNION ALL SELECT c.stream_id, list_append(nodes, e.b), c.cost + e.cost, c.weight + e.weight FROM c JOIN e ON e.stream_id = c.stream_id AND e.a = nodes[-1] WHERE e.b > nodes[1] AND NOT list_contains(nodes, e.b) AND len(nodes) < 4),
k AS (SELECT c.stream_id, nodes, len(nodes) AS len, c.weight + e.weight AS total_weight, CAST(8 * len(nodes) - c.cost - e.cost AS DOUBLE) AS gain FROM c JOIN e ON e.stream_id = c.stream_id AND e.a = nodes[-1] AND e.b = nodes[1]),
u AS (SELECT *, row_number() OVER (PARTITION BY stream_id, list_sort(nodes) ORDER BY nodes) AS r FROM k),
cy AS (SELECT stream_id, array_to_string(nodes, '-') AS path, nodes, len, total_weight, gain FROM u WHERE r = 1)"""


def _cycles(spark, sf_dir, **more):
    return graph.cycles(_small_edges(spark, sf_dir), 4, **more)


@query("cycles", f"{_SMALL}, {_CYCLES} SELECT stream_id, path, CAST(len AS BIGINT) AS len, total_weight, gain FROM cy")
def q_cycles(spark, sf_dir):
    return _cycles(spark, sf_dir).select("stream_id", F.array_join(F.col("nodes").cast("array<string>"), "-").alias("path"), F.col("len").cast("long").alias("len"), "total_weight", "gain")


@query("cycle_hist", f"{_SMALL}, {_CYCLES} SELECT stream_id, CAST(len AS BIGINT) AS len, count(*) AS n FROM cy GROUP BY stream_id, len")
def cycle_hist(spark, sf_dir):
    return _long(_cycles(spark, sf_dir).groupBy("stream_id", "len").agg(F.count("*").alias("n")), "len")


@query("cycles_by_node", f"{_SMALL}, {_CYCLES} SELECT stream_id, node, count(*) AS n_cycles FROM (SELECT stream_id, unnest(nodes) AS node FROM cy) GROUP BY stream_id, node")
def q_cycles_by_node(spark, sf_dir):
    return graph.cycles_by_node(_cycles(spark, sf_dir))


@query("top_cycles", f"{_SMALL}, {_CYCLES}, t AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY gain DESC, len, nodes) AS rank FROM cy WHERE gain > 0) SELECT stream_id, path, gain, rank FROM t WHERE rank <= 10")
def q_top_cycles(spark, sf_dir):
    return _long(graph.top_cycles(_cycles(spark, sf_dir)).select("stream_id", F.array_join(F.col("nodes").cast("array<string>"), "-").alias("path"), "gain", "rank"), "rank")


@query("graph_coverage", f"{_SMALL}, {_CYCLES}, h AS (SELECT DISTINCT stream_id, unnest(nodes) AS a FROM cy), n AS (SELECT DISTINCT stream_id, a FROM e) SELECT n.stream_id, round(avg((h.a IS NOT NULL)::INT), 6) AS node_coverage, round((SELECT avg((cost < 8)::INT) FROM e WHERE e.stream_id = n.stream_id), 6) AS edge_coverage FROM n LEFT JOIN h USING (stream_id, a) GROUP BY n.stream_id")
def graph_coverage(spark, sf_dir):
    e = _small_edges(spark, sf_dir)
    return _rounded(graph.coverage(e, graph.cycles(e, 4)), "node_coverage", "edge_coverage")


# the same over the whole transition graph of the events' bytes; recursion over it is too slow in a twin, so tests hold these against brute force. All cycles are
# listed to four nodes, as their number grows with a power of the degree; gaining ones to eight


def _byte_cycles(spark, sf_dir):
    return graph.cycles(_edges(spark, sf_dir), 4)


def _byte_cycle_counts(spark, sf_dir):
    return graph.cycle_counts(_edges(spark, sf_dir), 4)


def _paths(df):
    return df.withColumn("path", F.array_join(F.col("nodes").cast("array<string>"), "-"))


@query("scc_events")
def scc_events(spark, sf_dir):
    return _long(graph.strong_components(_edges(spark, sf_dir)), "node", "root", "size")


@query("cycles_events")
def cycles_events(spark, sf_dir):
    return _long(_paths(_byte_cycles(spark, sf_dir)).select("stream_id", "path", "len", "total_weight", "gain"), "len")


@query("cycle_hist_events")
def cycle_hist_events(spark, sf_dir):
    return _long(graph.cycle_lengths(_byte_cycle_counts(spark, sf_dir)), "len")


@query("cycles_by_node_events")
def cycles_by_node_events(spark, sf_dir):
    return graph.visits(_byte_cycle_counts(spark, sf_dir))


@query("top_cycles_events")
def top_cycles_events(spark, sf_dir):
    return _long(_paths(graph.best_cycles(_edges(spark, sf_dir), 8)).select("stream_id", "path", "gain", "rank"), "rank")


@query("graph_coverage_events")
def graph_coverage_events(spark, sf_dir):
    return _rounded(graph.coverage(_edges(spark, sf_dir), _byte_cycle_counts(spark, sf_dir)), "node_coverage", "edge_coverage")


_TEXT = "CASE op_id WHEN 0 THEN 'x + ' || operand WHEN 8 THEN 'x << ' || operand WHEN 9 THEN 'x >> ' || operand WHEN 10 THEN '~x' WHEN 11 THEN 'x+1' WHEN 12 THEN 'x-1' ELSE 'x' END"


@query("expr_text", f"{EDGE_CHAIN} SELECT {_TEXT} AS expr, count(*) AS n FROM e GROUP BY 1")
def expr_text(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy(algebra.expression(F.col("op_id"), F.col("operand")).alias("expr")).agg(F.count("*").alias("n"))


@query("dot_export_lines", f"{EDGE_CHAIN}, w AS (SELECT *, max(freq) OVER (PARTITION BY stream_id) AS most FROM e WHERE weight > 0) SELECT stream_id, weight, a, b, printf('  n%d -> n%d [label=\"%s\\ncost=%db freq=%d\" penwidth=\"%.2f\"];', a, b, {_TEXT}, cost, freq, round(1.0 + 4.0 * freq / most, 2)) AS line FROM w")
def dot_export_lines(spark, sf_dir):
    return graph.dot_lines(_edges(spark, sf_dir))


# -- runs


def _islands(spark, sf_dir):
    return runs.islands(streams.event_levels(spark, sf_dir))


@query("deltas", f"WITH {EVENTS}, {PAIRS} SELECT stream_id, (b - a) & 255 AS st, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL")
def deltas(spark, sf_dir):
    return _long(runs.steps(streams.events_by_type(spark, sf_dir)).groupBy("stream_id", "st").agg(F.count("*").alias("n")), "st")


@query("delta_islands", f"WITH {LEVELS}, {ISLANDS} SELECT stream_id, CAST(isl AS BIGINT) AS isl, st, p0, m, v0 FROM i")
def delta_islands(spark, sf_dir):
    return _long(_islands(spark, sf_dir), "st", "v0")


@query("runs_detected", f"WITH {LEVELS}, {ISLANDS}, {DETECTED} SELECT stream_id, st, CAST(start AS BIGINT) AS start, CAST(len AS BIGINT) AS len FROM r")
def runs_detected(spark, sf_dir):
    return _long(runs.detected(_islands(spark, sf_dir)), "st", "start", "len")


@query("patterns", f"{RUN_CHAIN} SELECT stream_id, st, CAST(run_bytes AS BIGINT) AS run_bytes, run_count, CAST(saving AS BIGINT) AS saving FROM pat")
def q_patterns(spark, sf_dir):
    return _long(runs.patterns(runs.detected(_islands(spark, sf_dir))), "st", "run_bytes")


@query("top_patterns", f"{RUN_CHAIN}, t AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY saving DESC, st) AS rank FROM pat) SELECT stream_id, st, CAST(saving AS BIGINT) AS saving, rank FROM t WHERE rank <= 2")
def q_top_patterns(spark, sf_dir):
    return _long(runs.top_patterns(runs.patterns(runs.detected(_islands(spark, sf_dir))), 2).select("stream_id", "st", "saving", "rank"), "st", "rank")


@query("pattern_label", "SELECT range AS st, CASE WHEN range > 127 THEN range - 256 ELSE range END AS signed_step, CASE WHEN range = 0 THEN 'repeat(0)' WHEN range = 1 THEN 'seq(+1)' WHEN range = 255 THEN 'seq(-1)' WHEN range > 127 THEN 'arith(' || (range - 256) || ')' ELSE 'arith(+' || range || ')' END AS label FROM range(256)")
def pattern_label(spark, sf_dir):
    return spark.range(256).select(F.col("id").alias("st"), runs.signed(F.col("id")).alias("signed_step"), runs.label(F.col("id")).alias("label"))


@query("v2_runs", f"{RUN_CHAIN}, {PARSED} SELECT stream_id, st, CAST(start AS BIGINT) AS start, CAST(len AS BIGINT) AS len, CAST(v0 AS BIGINT) AS v0 FROM tok")
def v2_runs(spark, sf_dir):
    isl = _islands(spark, sf_dir)
    return _long(runs.parsed(isl, runs.step_table(runs.patterns(runs.detected(isl)))), "st", "start", "len", "v0")


@query("v2_size", f"{RUN_CHAIN}, {PARSED}, n AS (SELECT stream_id, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT stream_id, sum(len) AS covered, sum((len + 65534) // 65535) AS tokens FROM tok GROUP BY ALL), s AS (SELECT stream_id, count(*) AS steps FROM pat GROUP BY ALL), q AS (SELECT n.stream_id, n, n - coalesce(covered, 0) AS literals, coalesce(tokens, 0) AS run_tokens, coalesce(steps, 0) AS steps FROM n LEFT JOIN t USING (stream_id) LEFT JOIN s USING (stream_id)) SELECT stream_id, n, CAST(literals AS BIGINT) AS literals, CAST(run_tokens AS BIGINT) AS run_tokens, CAST(steps AS BIGINT) AS steps, CAST(9 * literals + 33 * run_tokens AS BIGINT) AS bits, CAST(9 + steps + (9 * literals + 33 * run_tokens + 7) // 8 AS BIGINT) AS encoded_bytes, round((9 + steps + (9 * literals + 33 * run_tokens + 7) // 8) / n, 6) AS ratio FROM q")
def v2_size(spark, sf_dir):
    b = streams.event_levels(spark, sf_dir)
    isl = runs.islands(b)
    pats = runs.patterns(runs.detected(isl))
    return _rounded(runs.sizes(b, pats, runs.parsed(isl, runs.step_table(pats))), "ratio")


@query("v2_tiers", f"{RUN_CHAIN}, {PARSED} SELECT stream_id, 'ARITH_RUN' AS tier, count(*) AS n FROM tok GROUP BY stream_id UNION ALL SELECT b.stream_id, 'LITERAL', count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM tok WHERE tok.stream_id = b.stream_id AND b.pos >= start AND b.pos < start + len) GROUP BY b.stream_id")
def v2_tiers(spark, sf_dir):
    return codec.v2_tokens(streams.event_levels(spark, sf_dir)).groupBy("stream_id", "tier").agg(F.count("*").alias("n"))


_V1 = f"WITH {{src}}, {PAIRS}, {COUNTED}, {EDGES}, n AS (SELECT stream_id, count(*) AS n FROM b GROUP BY ALL), h AS (SELECT stream_id, sum(freq) FILTER (cost < 8) AS rel FROM e GROUP BY ALL), q AS (SELECT n.stream_id, n, coalesce(rel, 0) AS r FROM n LEFT JOIN h USING (stream_id)) SELECT stream_id, n, CAST(r AS BIGINT) AS relational, CAST(n - r AS BIGINT) AS literals, CAST(9 * n - 2 * r AS BIGINT) AS bits, CAST(9 + (9 * n - 2 * r + 7) // 8 AS BIGINT) AS encoded_bytes, round((9 + (9 * n - 2 * r + 7) // 8) / n, 6) AS ratio FROM q"
for _name, _make, _sql in (("v1_size", streams.events_by_type, EVENTS), ("v1_size_lineitem", streams.lineitem_by_supplier, LINES)):
    query(_name, _V1.format(src=_sql))(lambda s, d, make=_make: _rounded(codec.v1_tiers(make(s, d)), "ratio"))


@query("v1_size_documents", _V1.format(src=DOCS))
def v1_size_documents(spark, sf_dir):
    return _rounded(codec.v1_payload_tiers(streams.document_payloads(spark, sf_dir)), "ratio")


@query("v2_roundtrip", f"WITH {LEVELS} SELECT stream_id, count(*) AS n, true AS equal FROM b GROUP BY stream_id")
def v2_roundtrip(spark, sf_dir):
    """Encoded by windows and bit packing, decoded by the row decoder, compared with the input and with the row encoder's bytes."""
    b = streams.event_levels(spark, sf_dir)
    raw = streams.collected(b)
    made = codec.encode_v2(b)
    rows = codec.encoded(raw).withColumnRenamed("encoded", "by_row")
    back = codec.decoded(made).withColumnRenamed("payload", "back")
    j = raw.join(back, "stream_id").join(made, "stream_id").join(rows, "stream_id")
    return j.select("stream_id", F.octet_length("payload").cast("long").alias("n"), ((F.col("payload") == F.col("back")) & (F.col("encoded") == F.col("by_row"))).alias("equal"))


@query("v1_cycle_roundtrip", f"WITH {USERS} SELECT stream_id, count(*) AS n, true AS equal FROM b GROUP BY stream_id")
def v1_cycle_roundtrip(spark, sf_dir):
    raw = streams.collected(streams.events_by_user(spark, sf_dir))
    back = codec.decoded(codec.encoded(raw, 1, [[50, 100], [1, 2, 3]])).withColumnRenamed("payload", "back")
    return raw.join(back, "stream_id").select("stream_id", F.octet_length("payload").cast("long").alias("n"), (F.col("payload") == F.col("back")).alias("equal"))


@query("v3_header", "SELECT event_type AS stream_id, 0::BIGINT AS mode, sha256(event_type) AS snapshot_id, CAST(strlen(event_type) AS BIGINT) AS body_bytes FROM events GROUP BY event_type")
def v3_header(spark, sf_dir):
    e = streams.table(spark, sf_dir, "events").select("event_type").distinct()
    head = F.concat(F.lit(codec.PREFIX + b"\x33\x00"), F.unhex(F.sha2("event_type", 256)), F.unhex(F.lpad(F.hex(F.octet_length("event_type").cast("long")), 8, "0")), F.encode("event_type", "UTF-8"))
    return _long(codec.v3_headers(e.select(F.col("event_type").alias("stream_id"), head.alias("encoded"))), "mode")


# -- fingerprints

_FP = """m AS (SELECT stream_id, pos, abs(lead(v) OVER (PARTITION BY stream_id ORDER BY pos) - v) AS d FROM b),
s AS (SELECT *, lag(d) OVER w AS l1, """ + ", ".join(f"lag(d, {k}) OVER w AS l{k}" for k in range(2, 9)) + """ FROM m WHERE d IS NOT NULL WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
en AS (SELECT stream_id, sum(-(c / t) * log2(c / t)) / 8 AS f0 FROM (SELECT stream_id, v, count(*) AS c, sum(count(*)) OVER (PARTITION BY stream_id) AS t FROM b GROUP BY stream_id, v) GROUP BY stream_id),
st AS (SELECT stream_id, count(*) AS m, sum((d = l1)::INT) AS eq, sum(CASE WHEN pos >= 8 AND (""" + " OR ".join(f"d = l{k}" for k in range(1, 9)) + """) THEN 1 ELSE 0 END) AS late, """ + ", ".join(f"sum((least(d // 32, 7) = {i})::INT) AS h{i}" for i in range(8)) + """, sum(d) AS total FROM s GROUP BY stream_id),
fp AS (SELECT en.stream_id, round(f0, 6) AS f0, round(coalesce(eq / nullif(m - 1, 0), 0.0), 6) AS f1, round(coalesce(late / nullif(greatest(m - 8, 0), 0), 0.0), 6) AS f2, """ + ", ".join(f"round(coalesce(h{i} / m, 0.0), 6) AS f{i + 3}" for i in range(8)) + """, round(coalesce(total / m / 255.0, 0.0), 6) AS f11 FROM en LEFT JOIN st USING (stream_id))"""
_FEATURES = [f"f{i}" for i in range(profiles.SIZE)]
for _name, _make, _sql in (("fingerprint", streams.events_by_type, EVENTS), ("fingerprint_orders", streams.orders_by_customer, ORDERS), ("fingerprint_lineitem", streams.lineitem_by_supplier, LINES)):
    query(_name, f"WITH {_sql}, {_FP} SELECT * FROM fp")(lambda s, d, make=_make: _rounded(profiles.fingerprints(make(s, d)), *_FEATURES))


_VEC = "[" + ", ".join(_FEATURES) + "]"
_KNOWN = "kn(domain, vec) AS (VALUES " + ", ".join(f"('{t}', {list(next(v for ws, v in profiles.DOMAINS if any(w in t for w in ws)))}::DOUBLE[])" for t in profiles.SEARCHED) + ")"


@query("fingerprint_cosine", f"WITH {EVENTS}, {_FP} SELECT x.stream_id AS a, y.stream_id AS b, round(list_cosine_similarity([" + ", ".join(f"x.{f}" for f in _FEATURES) + "], [" + ", ".join(f"y.{f}" for f in _FEATURES) + "]), 5) AS cosine FROM fp x JOIN fp y ON x.stream_id < y.stream_id")
def fingerprint_cosine(spark, sf_dir):
    fp = _rounded(profiles.fingerprints(streams.events_by_type(spark, sf_dir)), *_FEATURES).select("stream_id", profiles.vector().alias("vec"))
    return fp.alias("x").join(fp.alias("y"), F.col("x.stream_id") < F.col("y.stream_id")).select(F.col("x.stream_id").alias("a"), F.col("y.stream_id").alias("b"), F.round(profiles.cosine(F.col("x.vec"), F.col("y.vec")), 5).alias("cosine"))


@query("rank_domains", f"WITH {EVENTS}, {_FP}, {_KNOWN} SELECT stream_id, domain, round(list_cosine_similarity({_VEC}::DOUBLE[], vec), 5) AS score FROM fp, kn")
def rank_domains(spark, sf_dir):
    fp = _rounded(profiles.fingerprints(streams.events_by_type(spark, sf_dir)), *_FEATURES)
    return profiles.ranked(fp, profiles.known_domains(spark)).select("stream_id", "domain", F.round("score", 5).alias("score"))


# -- evolution: rules made by a rule that both engines follow

_RULES = "ru AS (SELECT 'c' || c AS chrom_id, k AS rule_no, (c * 37 + k * 11) & 255 AS a, CASE k % 3 WHEN 0 THEN (c * 37 + k * 11 + 1) & 255 WHEN 1 THEN (c * 37 + k * 11) & 255 ELSE (c * 53 + k * 29) & 255 END AS b, CASE k % 3 WHEN 0 THEN 11 WHEN 1 THEN 13 ELSE 0 END AS op_id, CASE WHEN k % 3 = 2 THEN ((c * 53 + k * 29) - (c * 37 + k * 11) + c % 2) & 255 ELSE 0 END AS operand FROM (SELECT range AS c FROM range(20)), (SELECT range AS k FROM range(24)) WHERE k < c + 4)"


def _rules(spark) -> DataFrame:
    """20 chromosomes; those of odd number have additions that miss."""
    r = spark.range(20).withColumnRenamed("id", "c").withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.lit(23), F.col("c").cast("int") + 3))))
    c, k = F.col("c"), F.col("k")
    a, other = c * 37 + k * 11, c * 53 + k * 29
    return r.select(F.concat(F.lit("c"), c.cast("string")).alias("chrom_id"), k.alias("rule_no"), a.bitwiseAND(255).cast("int").alias("a"), F.when(k % 3 == 0, (a + 1).bitwiseAND(255)).when(k % 3 == 1, a.bitwiseAND(255)).otherwise(other.bitwiseAND(255)).cast("int").alias("b"), F.when(k % 3 == 0, 11).when(k % 3 == 1, 13).otherwise(0).alias("op_id"), F.when(k % 3 == 2, (other - a + c % 2).bitwiseAND(255)).otherwise(0).cast("int").alias("operand"))


_FIT = f"WITH {EVENTS}, {PAIRS}, d AS (SELECT '' AS stream_id, a, b, count(*) AS freq FROM p WHERE b IS NOT NULL GROUP BY a, b), {EDGES}, {_RULES}, n AS (SELECT count(*) AS n FROM b), sv AS (SELECT sum(freq) AS s FROM e WHERE cost < 8), pr AS (SELECT chrom_id, count(*) AS n_rules, coalesce(sum(e.freq) FILTER (e.cost >= 8 AND ru.op_id BETWEEN 10 AND 13), 0) AS more FROM ru LEFT JOIN e ON e.a = ru.a AND e.b = ru.b GROUP BY chrom_id), ft AS (SELECT chrom_id, n_rules, CAST(9 + (9 * n - 2 * (s + more) + 7) // 8 AS BIGINT) AS encoded_bytes, greatest(0.0, 1 - (9 + (9 * n - 2 * (s + more) + 7) // 8) / n::DOUBLE - 0.001 * n_rules) AS fitness FROM pr, n, sv)"


def _scored(spark, sf_dir):
    b = streams.events_by_type(spark, sf_dir)
    d = graph.digrams(b).groupBy("a", "b").agg(F.sum("freq").alias("freq"))
    return evolve.fitness(_rules(spark), d, b.count())


@query("population_fitness", f"{_FIT} SELECT chrom_id, n_rules, encoded_bytes, round(fitness, 6) AS fitness FROM ft")
def population_fitness(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir), "fitness")


@query("population_stats", f"{_FIT} SELECT round(max(fitness), 6) AS best_fitness, round(avg(fitness), 6) AS avg_fitness, round(var_pop(fitness), 6) AS variance, count(*) AS population_size, (SELECT count(DISTINCT (op_id, operand)) FROM ru) AS unique_operators FROM ft")
def population_stats(spark, sf_dir):
    return _rounded(evolve.population_statistics(_scored(spark, sf_dir), _rules(spark)), "best_fitness", "avg_fitness", "variance")


@query("select_elite", f"{_FIT} SELECT chrom_id FROM ft ORDER BY fitness DESC, chrom_id LIMIT 5")
def select_elite(spark, sf_dir):
    return evolve.elite(_scored(spark, sf_dir), 5).select("chrom_id")


@query("batch_fitness", f"{_FIT} SELECT chrom_id, round((fitness * 1000 + 0.5 * 3000) / 4000, 6) AS fitness FROM ft")
def batch_fitness(spark, sf_dir):
    s = _scored(spark, sf_dir).select("chrom_id", F.explode(F.array(F.struct(F.lit(1000).alias("n"), F.col("fitness").alias("f")), F.struct(F.lit(3000).alias("n"), F.lit(0.5).alias("f")))).alias("x"))
    return _rounded(evolve.batch_fitness(s.select("chrom_id", "x.n", F.col("x.f").alias("fitness"))), "fitness")


@query("validate_rules", f"WITH {_RULES} SELECT chrom_id, count(*) AS rules, bool_and(CASE op_id WHEN 11 THEN (a + 1) & 255 WHEN 13 THEN a ELSE (a + operand) & 255 END = b) AS valid FROM ru GROUP BY chrom_id")
def validate_rules(spark, sf_dir):
    return evolve.validity(_rules(spark))


@query("repair_rules", f"WITH {_RULES}, t AS (SELECT *, CASE op_id WHEN 11 THEN (a + 1) & 255 WHEN 13 THEN a ELSE (a + operand) & 255 END = b AS ok, {OP} AS op2, {OPERAND} AS operand2 FROM ru) SELECT chrom_id, CAST(rule_no AS BIGINT) AS rule_no, a, b, CAST(CASE WHEN ok THEN op_id ELSE op2 END AS BIGINT) AS op_id, CAST(CASE WHEN ok THEN operand ELSE operand2 END AS BIGINT) AS operand FROM t")
def repair_rules(spark, sf_dir):
    return _long(evolve.repaired(_rules(spark)), "rule_no", "a", "b", "op_id", "operand")


@query("crossover_aware", f"WITH {_RULES} SELECT a, b, CAST(op_id AS BIGINT) AS op_id FROM ru WHERE chrom_id = 'c9'")
def crossover_aware(spark, sf_dir):
    """Parents of the same pairs, one of additions alone: each shared pair takes the cheaper operator, the first parent's among equals (its additions, as the other's)."""
    right = _rules(spark).where("chrom_id = 'c9'").withColumn("chrom_id", F.lit("k"))
    left = right.withColumns({"op_id": F.lit(0), "operand": (F.col("b") - F.col("a")).bitwiseAND(255)})
    return _long(evolve.crossed(left, right).select("a", "b", "op_id"), "a", "b", "op_id")


_HISTORY = "hi AS (SELECT range AS generation, floor(range / 7) % 40 / 100.0 + range / 100000.0 AS best_fitness FROM range(600))"


def _history(spark):
    g = F.col("id")
    return spark.range(600).select(g.alias("generation"), (F.floor(g / 7) % 40 / 100.0 + g / 100000.0).alias("best_fitness"))


@query("convergence_rate", f"WITH {_HISTORY} SELECT generation, round(CASE WHEN generation = 0 THEN 0.0 ELSE (best_fitness - first(best_fitness) OVER w) / (count(*) OVER w - 1) END, 6) AS convergence_rate FROM hi WINDOW w AS (ORDER BY generation ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def convergence_rate(spark, sf_dir):
    return _rounded(evolve.convergence(_history(spark)).select("generation", "convergence_rate"), "convergence_rate")


@query("converged", f"WITH {_HISTORY}, g AS (SELECT *, best_fitness - lag(best_fitness) OVER (ORDER BY generation) AS gain FROM hi) SELECT (SELECT count(*) FROM hi) >= 500 AND NOT EXISTS (SELECT 1 FROM g WHERE generation > 600 - 500 AND gain >= 1e-4) AS converged")
def q_converged(spark, sf_dir):
    return evolve.converged(_history(spark))


@query("fitness_hist", f"WITH {_HISTORY} SELECT CAST(least(9, greatest(0, trunc(best_fitness * 10))) AS BIGINT) AS bin, count(*) AS n FROM hi GROUP BY 1")
def fitness_hist(spark, sf_dir):
    return _long(evolve.fitness_histogram(_history(spark)), "bin")


@query("peak_generation", f"WITH {_HISTORY} SELECT count(*) AS generations, round(arg_min(best_fitness, generation), 6) AS start_fitness, round(arg_max(best_fitness, generation), 6) AS end_fitness, round(max(best_fitness), 6) AS peak_fitness, (SELECT generation FROM hi ORDER BY best_fitness DESC, generation LIMIT 1) AS peak_generation FROM hi")
def peak_generation(spark, sf_dir):
    return _rounded(evolve.report(_history(spark)), "start_fitness", "end_fitness", "peak_fitness")


@query("adaptive_replay", "WITH RECURSIVE a(g, p, s) AS (SELECT 0::BIGINT, 0.05::DOUBLE, 0 UNION ALL SELECT g + 1, (CASE WHEN s = 29 THEN least(0.4, p * 1.2) ELSE p END) + (0.05 - (CASE WHEN s = 29 THEN least(0.4, p * 1.2) ELSE p END)) * 0.005, CASE WHEN s = 29 THEN 0 ELSE s + 1 END FROM a WHERE g < 200) SELECT g AS generation, round(p, 6) AS rule_probability FROM a WHERE g > 0")
def adaptive_replay(spark, sf_dir):
    """200 generations of stall."""
    control = evolve.Adaptive(0.05, 0.02)
    return _rounded(spark.createDataFrame([(g + 1, control.tick(0.0)[0]) for g in range(200)], "generation long, rule_probability double"), "rule_probability")


@query("adaptive_damping", "WITH RECURSIVE a(g, p, s) AS (SELECT 0::BIGINT, 0.05::DOUBLE, 0 UNION ALL SELECT g + 1, (CASE WHEN s = 9 THEN greatest(0.005, p * 0.9) ELSE p END) + (0.05 - (CASE WHEN s = 9 THEN greatest(0.005, p * 0.9) ELSE p END)) * 0.005, CASE WHEN s = 9 THEN 0 ELSE s + 1 END FROM a WHERE g < 200) SELECT g AS generation, round(p, 6) AS rule_probability FROM a WHERE g > 0")
def adaptive_damping(spark, sf_dir):
    """200 generations of fast growth."""
    control = evolve.Adaptive(0.05, 0.02)
    return _rounded(spark.createDataFrame([(g + 1, control.tick(0.01)[0]) for g in range(200)], "generation long, rule_probability double"), "rule_probability")


# -- snapshots


def _by_hand() -> bytes:
    """A snapshot laid out byte by byte after the format: a tag of seven bytes in four characters, two cycles, two rules, one generation."""
    from zlib import crc32

    cycles = "0002" "02" "0102" "0b0c" "4000000000000000" "4018000000000000" "01" "07" "0d" "3ff0000000000000" "4008000000000000"
    rules = "00000002" "01020b00" "02020d00"
    history = "00000001" "0000000000000005" "0000000000000009" "3fe0000000000000" "3fd0000000000000" "3fc0000000000000" "00000003" "0000000000000400" "0000000000000000"
    table, at = "0003", 29 + 7 + 2 + 27
    for kind, section in (("03", cycles), ("04", rules), ("05", history)):
        table += f"{kind}{at:08x}{len(section) // 2:08x}"
        at += len(section) // 2
    rest = bytes.fromhex("c3a9e282ac7461" + table + cycles + rules + history)
    return bytes.fromhex("4d524332" "0200" "0b" "0000000000000007" "0000000000000001") + crc32(rest).to_bytes(4, "big") + b"\x00\x07" + rest


def _hand_rows(spark) -> DataFrame:
    return spark.createDataFrame([("h", _by_hand())], "id string, content binary")


@query("snapshot_by_hand", "SELECT 'h' AS id, 2::BIGINT AS major, 7::BIGINT AS generation, 'é€ta' AS tag, true AS crc_ok")
def snapshot_by_hand(spark, sf_dir):
    return snapshots.manifests(_hand_rows(spark)).select("id", "major", "generation", "tag", "crc_ok")


@query("snapshot_cycles", "SELECT * FROM (VALUES ('h', 0::BIGINT, '1-2', '11-12', 2.0::DOUBLE, 6.0::DOUBLE), ('h', 1, '7', '13', 1.0, 3.0)) t(id, cycle_no, nodes, op_ids, total_weight, gain)")
def snapshot_cycles(spark, sf_dir):
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), "-").alias(c)
    return snapshots.cycles(_hand_rows(spark)).select("id", F.col("cycle_no").cast("long").alias("cycle_no"), joined("nodes"), joined("op_ids"), "total_weight", "gain")


@query("snapshot_history", "SELECT 'h' AS id, 5::BIGINT AS generation, 9::BIGINT AS ts_ms, 0.5::DOUBLE AS best_fitness, 0.25::DOUBLE AS avg_fitness, 0.125::DOUBLE AS variance, 3::BIGINT AS unique_operators, 1024::BIGINT AS corpus_bytes")
def snapshot_history(spark, sf_dir):
    return _long(snapshots.history(_hand_rows(spark)), "unique_operators")


@query("snapshot_rules", "SELECT * FROM (VALUES ('h', 0::BIGINT, 1::BIGINT, 2::BIGINT, 11::BIGINT), ('h', 1, 2, 2, 13)) t(id, rule_no, a, b, op_id)")
def snapshot_rules(spark, sf_dir):
    return _long(snapshots.chromosomes(_hand_rows(spark)).select("id", "rule_no", "a", "b", "op_id"), "rule_no", "a", "b", "op_id")


@query("snapshot_ids", "SELECT doc_id, sha256(text) AS id, source AS domain FROM documents")
def snapshot_ids(spark, sf_dir):
    return streams.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("id"), F.col("source").alias("domain"))


@query("snapshot_dedup", "SELECT sha256(text) AS id, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def snapshot_dedup(spark, sf_dir):
    return streams.table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("id")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("index_by_domain", "SELECT source AS domain, count(DISTINCT sha256(text)) AS ids FROM documents GROUP BY source")
def index_by_domain(spark, sf_dir):
    d = streams.table(spark, sf_dir, "documents").select(F.col("source").alias("domain"), F.sha2("text", 256).alias("id"))
    return d.distinct().groupBy("domain").agg(F.count("*").alias("ids"))


@query("snapshot_manifest", "SELECT 'a' AS name, 7::BIGINT AS generation, 'arithmetic' AS tag, true AS crc_ok, 3::BIGINT AS rules UNION ALL SELECT 'b', 9, '', true, 0")
def snapshot_manifest(spark, sf_dir):
    made = [("a", snapshots.serialize(7, 1, "arithmetic", [(1, 2, 11), (2, 2, 13), (3, 9, 0)])), ("b", snapshots.serialize(9, 2, "", history=[(0, 1, 0.1, 0.1, 0.0, 3, 10)]))]
    rows = spark.createDataFrame(made, "id string, content binary")
    n = snapshots.chromosomes(rows).groupBy("id").agg(F.count("*").alias("rules"))
    return snapshots.manifests(rows).join(n, "id", "left").na.fill(0, ["rules"]).select(F.col("id").alias("name"), "generation", "tag", "crc_ok", "rules")


@query("crc_check")
def crc_check(spark, sf_dir):
    """CRC-32 of every text; the other engine has no such function."""
    return streams.table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc"))


# -- extensions that the relational engine gives for nothing


@query("operators_by_grouping_sets", f"{EDGE_CHAIN} SELECT stream_id, op_id, CAST(sum(freq) AS BIGINT) AS pairs FROM e GROUP BY GROUPING SETS ((stream_id, op_id), (stream_id), (op_id), ())")
def operators_by_grouping_sets(spark, sf_dir):
    return _edges(spark, sf_dir).cube("stream_id", "op_id").agg(F.sum("freq").cast("long").alias("pairs"))


@query("shared_pairs", f"WITH {EVENTS}, {PAIRS}, {COUNTED} SELECT a, b, count(*) AS streams FROM d GROUP BY a, b HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)")
def shared_pairs(spark, sf_dir):
    d = graph.digrams(streams.events_by_type(spark, sf_dir))
    n = d.select("stream_id").distinct().agg(F.count("*").alias("all"))
    per = d.groupBy("a", "b").agg(F.count("*").alias("streams"))
    return _long(per.join(n, per.streams == n["all"]).drop("all"), "a", "b")


@query("events_daily_statistics", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(avg(CAST(floor(value) AS BIGINT) & 255), 6) AS mean_byte FROM events GROUP BY 1, 2")
def events_daily_statistics(spark, sf_dir):
    from byteloom.streaming import daily_statistics

    return _rounded(daily_statistics(streams.table(spark, sf_dir, "events")).select(F.col("start").alias("day"), "event_type", "n", "mean_byte"), "mean_byte")


def _streamed(spark, sf_dir, make, name):
    """Runs a stream over the event bytes, in two files of halves by position, to its end."""
    from uuid import uuid4

    base = f"{spark.conf.get('spark.checkpoint.dir', spark.conf.get('spark.sql.warehouse.dir'))}/{name}-{uuid4().hex}"
    b = streams.event_levels(spark, sf_dir)
    for half in (0, 1):
        b.where((F.col("pos") >= 1000) == bool(half)).coalesce(1).write.parquet(f"{base}/in/part={half}")
    source = spark.readStream.schema("stream_id string, pos long, v int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    q = make(source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("stream_digrams", f"WITH {LEVELS}, {PAIRS}, {COUNTED} SELECT stream_id, a, b, freq FROM d")
def q_stream_digrams(spark, sf_dir):
    from byteloom.streaming import stream_digrams

    out = _streamed(spark, sf_dir, stream_digrams, "digrams")
    return _long(out.groupBy("stream_id", "a", "b").agg(F.sum("n").alias("freq")), "a", "b")




# -- selection as a service, accessors, logs and wrappers


def _shared(spark, name: str) -> str:
    from uuid import uuid4

    return f"{spark.conf.get('spark.checkpoint.dir', spark.conf.get('spark.sql.warehouse.dir'))}/{name}-{uuid4().hex}"


_PLACES = "[" + ", ".join(f"'{t}'" for t in profiles.SEARCHED) + "]"


@query("select_snapshot", f"""WITH {EVENTS}, {_FP}, {_KNOWN}, sc AS (SELECT stream_id, domain, 'domain-' || (list_position({_PLACES}, domain) - 1) AS id, list_cosine_similarity({_VEC}::DOUBLE[], vec) AS score FROM fp, kn),
be AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY round(score, 9) DESC, id) AS k FROM sc)
SELECT stream_id, 200::BIGINT AS status, '{{"snapshot_id":"' || id || '","score":' || printf('%.4f', score) || ',"domain":"' || domain || '"}}' AS body FROM be WHERE k = 1
UNION ALL SELECT * FROM (VALUES ('!health', 200, '{{"status":"ok"}}'), ('!get', 405, '{{"error":"method_not_allowed"}}'), ('!empty', 400, '{{"error":"empty_body"}}'), ('!null', 400, '{{"error":"empty_body"}}')) t(stream_id, status, body)""")
def select_snapshot(spark, sf_dir):
    """Requests with the bytes of events, and some that select nothing."""
    asked = streams.collected(streams.events_by_type(spark, sf_dir)).select("stream_id", F.lit("POST").alias("method"), F.lit("/select").alias("path"), "payload")
    others = spark.createDataFrame([("!health", "GET", "/health", None), ("!get", "GET", "/select", b"x"), ("!empty", "POST", "/select", b""), ("!null", "POST", "/select", None)], asked.schema)
    return _long(profiles.responses(asked.unionByName(others), profiles.known_domains(spark)), "status")


@query("v2_offsets", f"{RUN_CHAIN}, {PARSED}, tk AS (SELECT stream_id, start + 65535 * k AS pos, 33 AS nbits FROM (SELECT *, unnest(range((len + 65534)::BIGINT // 65535)) AS k FROM tok) UNION ALL SELECT b.stream_id, b.pos, 9 FROM b WHERE NOT EXISTS (SELECT 1 FROM tok WHERE tok.stream_id = b.stream_id AND b.pos >= start AND b.pos < start + len)) SELECT stream_id, CAST(pos AS BIGINT) AS pos, CAST(nbits AS BIGINT) AS nbits, CAST(sum(nbits) OVER (PARTITION BY stream_id ORDER BY pos) - nbits AS BIGINT) AS bit_offset FROM tk")
def v2_offsets(spark, sf_dir):
    return _long(codec.offsets(codec.v2_tokens(streams.event_levels(spark, sf_dir))).select("stream_id", "pos", "nbits", "bit_offset"), "pos", "nbits", "bit_offset")


@query("compression_summary", _V1.format(src=EVENTS).replace("SELECT stream_id, n, CAST(r AS BIGINT)", "SELECT stream_id, n * 8 AS original_bits, 8 * CAST(9 + (9 * n - 2 * r + 7) // 8 AS BIGINT) AS compressed_bits, round(1 - (9 + (9 * n - 2 * r + 7) // 8) / n, 6) AS saving FROM (SELECT stream_id, n, CAST(r AS BIGINT)").replace(" AS ratio FROM q", " AS ratio, r FROM q)"))
def compression_summary(spark, sf_dir):
    return _rounded(codec.summary(codec.v1_tiers(streams.events_by_type(spark, sf_dir))).select("stream_id", "original_bits", "compressed_bits", "saving"), "saving")


@query("v3_roundtrip", f"WITH {USERS} SELECT stream_id, count(*) AS n, 1::BIGINT AS mode, true AS equal, true AS embedded FROM b GROUP BY stream_id")
def v3_roundtrip(spark, sf_dir):
    raw, inner = streams.collected(streams.events_by_user(spark, sf_dir)), _by_hand()
    back = codec.unwrapped(codec.wrapped(raw, snapshots.snapshot_id(inner), inner), codec.V3_STANDALONE).withColumnRenamed("payload", "back")
    return _long(raw.join(back, "stream_id").select("stream_id", F.octet_length("payload").cast("long").alias("n"), "mode", (F.col("payload") == F.col("back")).alias("equal"), (F.sha2("snapshot", 256) == F.col("snapshot_id")).alias("embedded")), "mode")


@query("baseline_suite")
def baseline_suite(spark, sf_dir):
    return codec.baseline(spark)


@query("cycle_phases", f"{_SMALL}, {_CYCLES} SELECT stream_id, path, CAST(coalesce(list_position(nodes, 1), 0) - 1 AS BIGINT) AS phase, list_contains(nodes, 2) AS has_two FROM cy")
def cycle_phases(spark, sf_dir):
    found = graph.cycles(_small_edges(spark, sf_dir))
    return _long(found.select("stream_id", F.array_join(F.transform("nodes", lambda n: n.cast("string")), "-").alias("path"), graph.phase_of(F.col("nodes"), F.lit(1)).alias("phase"), graph.contains_node(F.col("nodes"), F.lit(2)).alias("has_two")), "phase")


@query("value_clusters", "SELECT range AS v, abs(range - 100) <= 3 AS near, 1::BIGINT AS own FROM range(256)")
def value_clusters(spark, sf_dir):
    """Which values lie within three of 100, and in how many clusters of a partition each lies."""
    parts = spark.createDataFrame(algebra.clusters(5), "centroid int, radius int")
    v = spark.range(256).withColumnRenamed("id", "v")
    own = v.join(parts, algebra.clustered(F.col("v"), F.col("centroid"), F.col("radius"))).groupBy("v").agg(F.count("*").alias("own"))
    return v.join(own, "v").select("v", algebra.clustered(F.col("v"), F.lit(100), F.lit(3)).alias("near"), "own")


@query("second_deltas", f"WITH {EVENTS}, t AS (SELECT stream_id, lag(v) OVER w AS x, v AS y, lead(v) OVER w AS z FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY pos)) SELECT stream_id, ((z - y) - (y - x)) & 255 AS change, count(*) AS n FROM t WHERE x IS NOT NULL AND z IS NOT NULL GROUP BY ALL")
def second_deltas(spark, sf_dir):
    near = runs.triples(streams.events_by_type(spark, sf_dir))
    return _long(near.groupBy("stream_id", algebra.second_delta(F.col("before"), F.col("v"), F.col("after")).alias("change")).agg(F.count("*").alias("n")), "change")


@query("select_elite_fallback", f"{_FIT} SELECT row_number() OVER (ORDER BY fitness DESC, chrom_id) - 1 AS slot, chrom_id FROM ft ORDER BY fitness DESC, chrom_id LIMIT 3")
def select_elite_fallback(spark, sf_dir):
    return evolve.elite_then(_scored(spark, sf_dir), 3, 5, 2)


@query("chromosome_dominates", _FIT.replace(EVENTS, LEVELS) + " SELECT chrom_id FROM ft WHERE round(fitness, 9) > (SELECT round(fitness, 9) FROM ft WHERE chrom_id = 'c10')")
def chromosome_dominates(spark, sf_dir):
    """Chromosomes that are fitter than one of them on the levels of events."""
    b = streams.event_levels(spark, sf_dir)
    counted = graph.digrams(b).groupBy("a", "b").agg(F.sum("freq").alias("freq"))
    s = evolve.fitness(_rules(spark), counted, b.count()).withColumn("fitness", F.round("fitness", 9)).withColumn("against", F.lit("c10"))
    return evolve.dominating(s, s.where("chrom_id = 'c10'"), "against").select("chrom_id")


@query("generation_log", f"WITH {_HISTORY} SELECT generation, generation || ',0,0,' || printf('%.6f', best_fitness::DOUBLE) || ',0.000000,0.000000,0,0,0,0,0.000000' AS csv FROM hi")
def generation_log(spark, sf_dir):
    return evolve.log_lines(_history(spark)).select("generation", "csv")


@query("fitness_sparkline", f"WITH {_HISTORY}, m AS (SELECT greatest(1, count(*) // {evolve.PARTS}) AS step, min(best_fitness)::DOUBLE AS lo, max(best_fitness)::DOUBLE AS hi FROM hi) SELECT string_agg(substr('{evolve.MARKS}', 1 + least(7, trunc((best_fitness - lo) / (hi - lo) * 7))::BIGINT, 1), '' ORDER BY generation) AS line, round(any_value(lo), 6) AS least, round(any_value(m.hi), 6) AS most FROM hi, m WHERE generation % step = 0")
def fitness_sparkline(spark, sf_dir):
    return _rounded(evolve.sparkline(_history(spark)), "least", "most")


@query("publish_rules", f"WITH {_RULES} SELECT a, b, count(*) AS n FROM ru GROUP BY a, b")
def publish_rules(spark, sf_dir):
    """Chromosomes published to a new store, and their pairs read back from it."""
    root = _shared(spark, "published")
    snapshots.publish_rules(spark, root, _rules(spark), "arithmetic", 7, 9)
    return _long(snapshots.chromosomes(snapshots.stored(spark, root)).groupBy("a", "b").agg(F.count("*").alias("n")), "a", "b")


@query("events_sliding_statistics", "SELECT date_trunc('day', ts) - k * INTERVAL 1 DAY AS day, event_type, count(*) AS n, round(avg(CAST(floor(value) AS BIGINT) & 255), 6) AS mean_byte FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def events_sliding_statistics(spark, sf_dir):
    from byteloom.streaming import daily_statistics

    return _rounded(daily_statistics(streams.table(spark, sf_dir, "events"), size="2 days", slide="1 day").select(F.col("start").alias("day"), "event_type", "n", "mean_byte"), "mean_byte")


@query("event_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    from byteloom.streaming import session_statistics

    return session_statistics(streams.table(spark, sf_dir, "events"))
