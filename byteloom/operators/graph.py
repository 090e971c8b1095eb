"""Transition graphs of byte streams: digrams, edges, statistics, strong components, bounded cycles, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from byteloom.functions import algebra
from byteloom.operators import cyclesearch

CHUNK = 1 << 16
#: Edges of a stream's graph for each task that searches it.
SHARE = 1024


def with_next(bytes_: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds the next byte, null at a stream's end. Streams are cut into chunks; a chunk's first byte is also dealt to the chunk before, so one long stream is spread
    over tasks and each row moves once."""
    own = F.floor(F.col("pos") / chunk)
    dealt = bytes_.withColumn("c", F.explode(F.when((F.col("pos") % chunk == 0) & (F.col("pos") > 0), F.array(own, own - 1)).otherwise(F.array(own))))
    w = Window.partitionBy("stream_id", "c").orderBy("pos")
    return dealt.withColumn("nxt", F.lead("v").over(w)).where(F.col("c") == own).drop("c")


def with_neighbours(bytes_: DataFrame, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """Rows by chunk c: a chunk's own (`own`), and with them the last `before` of the chunk before and the first `after` of the next, for windows by (stream_id, c)."""
    c, at = F.floor(F.col("pos") / chunk), F.col("pos") % chunk
    to = F.array_compact(F.array(c, F.when(at >= chunk - before, c + 1), F.when((at < after) & (c > 0), c - 1)))
    return bytes_.withColumn("c", F.explode(to)).withColumn("own", F.col("c") == c)


def digrams(bytes_: DataFrame) -> DataFrame:
    """(stream_id, a, b, freq)."""
    return with_next(bytes_).where(F.col("nxt").isNotNull()).groupBy("stream_id", F.col("v").alias("a"), F.col("nxt").alias("b")).agg(F.count("*").alias("freq"))


def payload_digrams(payloads: DataFrame, per_stream: bool = True) -> DataFrame:
    """(stream_id, a, b, freq) of rows (stream_id, payload), or (a, b, freq) of all together: pairs are counted where the row lies, so at most 65,536 counts a row or a task are
    shuffled, and no byte. Null payloads and those of one byte have no pairs. Rows of one stream aren't joined to each other."""
    import numpy as np
    import pyarrow as pa

    def codes(x):
        v = np.frombuffer(x.as_buffer(), np.uint8).astype(np.int64)
        return v[:-1] * 256 + v[1:]

    def table(keys, freq, names=None):
        cols = [pa.array(keys // 256, pa.int32()), pa.array(keys % 256, pa.int32()), pa.array(freq, pa.int64())]
        return pa.RecordBatch.from_arrays([*([pa.array(names, pa.string())] if per_stream else []), *cols], names=["stream_id", "a", "b", "freq"][not per_stream :])

    def each(batches):
        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1)):
                if x.is_valid:
                    keys, freq = np.unique(codes(x), return_counts=True)
                    yield table(keys, freq, [name] * len(keys))

    def together(batches):
        total, held, size = np.zeros(65536, np.int64), [], 0
        for b in batches:
            for x in b.column(0):
                if x.is_valid:
                    held.append(codes(x))
                    size += len(held[-1])
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=65536)
                    held, size = [], 0
        total += np.bincount(np.concatenate([*held, np.empty(0, np.int64)]), minlength=65536)
        keys = np.flatnonzero(total)
        yield table(keys, total[keys])

    if per_stream:
        return payloads.select("stream_id", "payload").mapInArrow(each, "stream_id string, a int, b int, freq long")
    return payloads.select("payload").mapInArrow(together, "a int, b int, freq long").groupBy("a", "b").agg(F.sum("freq").alias("freq"))


def edges(counted: DataFrame) -> DataFrame:
    """Digrams with their cheapest operator, its cost, and the weight freq * (8 - cost)."""
    o = counted.withColumn("o", algebra.cheapest(F.col("a"), F.col("b"))).select(*counted.columns, "o.*")
    return o.withColumn("weight", (F.col("freq") * (8 - F.col("cost"))).cast("double"))


def overridden(edge_rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges with the operator of a rule (a, b, op_id, operand, cost) where one exists; replaced edges have frequency and weight 0."""
    r = rules.select("a", "b", F.col("op_id").alias("r_op"), F.col("operand").alias("r_operand"), F.col("cost").alias("r_cost"))
    j = edge_rows.join(r, ["a", "b"], "left")
    got = F.col("r_op").isNotNull()
    return j.select("stream_id", "a", "b", F.coalesce("r_op", "op_id").alias("op_id"), F.coalesce("r_operand", "operand").alias("operand"), F.coalesce("r_cost", "cost").alias("cost"), F.when(got, 0).otherwise(F.col("freq")).alias("freq"), F.when(got, 0.0).otherwise(F.col("weight")).alias("weight"))


def statistics(edge_rows: DataFrame) -> DataFrame:
    """Per stream: nodes with an edge out, edges, mean weight, edges that compress, and their share."""
    good = F.sum((F.col("cost") < algebra.WORTH_BELOW).cast("long"))
    return edge_rows.groupBy("stream_id").agg(F.countDistinct("a").alias("node_count"), F.count("*").alias("edge_count"), F.avg("weight").alias("average_weight"), good.alias("compressing"), (good / F.count("*")).alias("compressing_share"))


def cost_histogram(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.groupBy("stream_id", "cost").agg(F.count("*").alias("n"), F.sum("freq").alias("pairs"))


def top_edges(edge_rows: DataFrame, k: int = 10) -> DataFrame:
    """The heaviest edges of each stream; ties by a, then b."""
    w = Window.partitionBy("stream_id").orderBy(F.desc("weight"), "a", "b")
    return edge_rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def degrees(edge_rows: DataFrame) -> DataFrame:
    out = edge_rows.groupBy("stream_id", F.col("a").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edge_rows.groupBy("stream_id", F.col("b").alias("node")).agg(F.count("*").alias("in_degree"))
    return out.join(into, ["stream_id", "node"], "full").select("stream_id", "node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def best_edge(edge_rows: DataFrame, a: int, b: int) -> DataFrame:
    return edge_rows.where((F.col("a") == a) & (F.col("b") == b))


def edges_from(edge_rows: DataFrame, a: int) -> DataFrame:
    return edge_rows.where(F.col("a") == a)


def edges_to(edge_rows: DataFrame, b: int) -> DataFrame:
    return edge_rows.where(F.col("b") == b)


def dominates(x: DataFrame, y: DataFrame) -> DataFrame:
    """Edges of x that cost less than y's edge between the same bytes."""
    other = y.select("stream_id", "a", "b", F.col("cost").alias("other"))
    return x.join(other, ["stream_id", "a", "b"]).where(F.col("cost") < F.col("other")).drop("other")


# -- strong components and cycles: a stream's graph has at most 256 nodes, so each stream is one group of at most 65,536 edges


def _components(nodes: list[int], out: dict[int, list[int]]) -> list[list[int]]:
    """Strong components, without recursion: forward order, then backward sweeps."""
    seen, finished = set(), []
    for start in nodes:
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(out.get(start, ())))]
        while stack:
            x, rest = stack[-1]
            y = next((y for y in rest if y not in seen), None)
            if y is None:
                finished.append(x)
                stack.pop()
            else:
                seen.add(y)
                stack.append((y, iter(out.get(y, ()))))
    into: dict[int, list[int]] = {}
    for x, ys in out.items():
        for y in ys:
            into.setdefault(y, []).append(x)
    left, found = set(seen), []
    for root in reversed(finished):
        if root in left:
            left.discard(root)
            part, todo = [], [root]
            while todo:
                x = todo.pop()
                part.append(x)
                for y in into.get(x, ()):
                    if y in left:
                        left.discard(y)
                        todo.append(y)
            found.append(sorted(part))
    return found


def strong_components(edge_rows: DataFrame) -> DataFrame:
    """(stream_id, node, root, size): root is the smallest node of the strong component."""

    def run(pdf):
        import pandas as pd

        out: dict[int, list[int]] = {}
        for a, b in zip(pdf.a.tolist(), pdf.b.tolist()):
            out.setdefault(a, []).append(b)
        nodes = sorted({*pdf.a.tolist(), *pdf.b.tolist()})
        rows = [(pdf.stream_id.iloc[0], x, part[0], len(part)) for part in _components(nodes, out) for x in part]
        return pd.DataFrame(rows, columns=["stream_id", "node", "root", "size"])

    return edge_rows.select("stream_id", "a", "b").groupBy("stream_id").applyInPandas(run, "stream_id string, node int, root int, size int")


def _by_graph(edge_rows: DataFrame, work, columns: str, share: int | None = None) -> DataFrame:
    """(stream_id, columns) of work(nodes, a, b, cost, weight, part, parts) over whole graphs: a, b are arrays of places in `nodes`, and it yields Arrow columns. With a share,
    a stream of more than so many edges goes to up to 32 tasks, a part each; each gets the whole graph, of at most 65,536 edges."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for rows in batches:
            for i in range(rows.num_rows):
                stream, part, parts = (rows.column(k)[i].as_py() for k in (0, 1, 2))
                a, b, cost, weight = (rows.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (3, 4, 5, 6))
                nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                for made in work(nodes, at[: len(a)], at[len(a) :], cost, weight, part, parts):
                    out = [pa.repeat(pa.scalar(stream, pa.string()), len(made[0])), *made]
                    yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"stream_id string, {columns}"
    names = [x.split()[0] for x in schema.split(", ")]
    parts = F.lit(1) if share is None else F.least(F.lit(32), F.ceil(F.size("e") / share).cast("int"))
    e = edge_rows.where("a != b").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", F.col("cost").cast("int").alias("cost"), F.col("weight").cast("double").alias("weight")))).alias("e"))
    dealt = e.withColumn("parts", parts).select("stream_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", "e.a", "e.b", "e.cost", "e.weight")
    return dealt.repartition(4 * edge_rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)


def _node_type(edge_rows: DataFrame) -> str:
    return edge_rows.schema["a"].dataType.simpleString()


def _cycle_rows(edge_rows: DataFrame, search, share: int | None) -> DataFrame:
    """(stream_id, nodes, len, total_weight, gain) of the arrays of cycles, one length each, that search(n, a, b, cost, part, parts) gives."""
    import numpy as np
    import pyarrow as pa

    kind = _node_type(edge_rows)
    ints = pa.int64() if kind == "bigint" else pa.int32()

    def work(nodes, a, b, cost, weight, part, parts):
        n = len(nodes)
        weights, costs = np.zeros((n, n)), np.zeros((n, n), np.int64)
        weights[a, b], costs[a, b] = weight, cost
        for every in search(n, a, b, cost, part, parts):
            for found in np.split(every, range(1 << 16, len(every), 1 << 16)):
                k, size = found.shape[1], len(found)
                steps = [(found[:, i], found[:, (i + 1) % k]) for i in range(k)]
                total, gain = sum(weights[s] for s in steps), 8.0 * k - sum(costs[s] for s in steps)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * k + 1, k), pa.int32()), pa.array(nodes[found.ravel()], ints))
                yield lists, pa.repeat(pa.scalar(k, pa.int32()), size), pa.array(total), pa.array(gain)

    return _by_graph(edge_rows, work, f"nodes array<{kind}>, len int, total_weight double, gain double", share)


def cycles(edge_rows: DataFrame, longest: int = 4, gaining: bool = False) -> DataFrame:
    """Simple cycles of 2 to `longest` nodes: (stream_id, nodes, len, total_weight, gain).

    A cycle starts at its smallest node; of several orders of one set of nodes the lexically smallest stays. To four nodes they are found within the matrix of a graph, whose
    first nodes are dealt over tasks, so no path is shuffled. gaining: only cycles of positive gain, of several orders the lexically smallest that gains, found without
    those paths that can't reach one."""
    if gaining:
        return _cycle_rows(edge_rows, lambda n, a, b, cost, part, parts: (c for c, _ in cyclesearch.all_gaining(cyclesearch.savings(n, a, b, cost), range(part, n, parts), longest)), SHARE)
    if longest <= 4:
        return _cycle_rows(edge_rows, lambda n, a, b, cost, part, parts: cyclesearch.listed(cyclesearch.matrix(n, a, b), range(part, n, parts), longest), SHARE)
    return _joined_cycles(edge_rows, longest)


def cycle_counts(edge_rows: DataFrame, longest: int = 4) -> DataFrame:
    """(stream_id, len, node, n): how many of `cycles` visit a node, by length. To four nodes they are counted within the matrix and not listed."""
    import numpy as np
    import pyarrow as pa

    if longest > 4:
        return cycles(edge_rows, longest).select("stream_id", "len", F.explode("nodes").alias("node")).groupBy("stream_id", "len", "node").agg(F.count("*").alias("n"))
    kind = _node_type(edge_rows)

    def work(nodes, a, b, cost, weight, part, parts):
        n = cyclesearch.counted(cyclesearch.matrix(len(nodes), a, b), range(part, len(nodes), parts), longest)
        k, x = np.nonzero(n)
        if len(k):
            yield pa.array(k, pa.int32()), pa.array(nodes[x], pa.int64() if kind == "bigint" else pa.int32()), pa.array(n[k, x], pa.int64())

    return _by_graph(edge_rows, work, f"len int, node {kind}, n long", SHARE).groupBy("stream_id", "len", "node").agg(F.sum("n").alias("n"))


def cycle_lengths(counted: DataFrame) -> DataFrame:
    """(stream_id, len, n) of counts by node: a cycle of k nodes is counted k times there."""
    return counted.groupBy("stream_id", "len").agg(F.sum("n").alias("n")).withColumn("n", F.expr("n div len"))


def visits(counted: DataFrame) -> DataFrame:
    """What `cycles_by_node` gives, from counts."""
    return counted.groupBy("stream_id", "node").agg(F.sum("n").alias("n_cycles"))


def _joined_cycles(edge_rows: DataFrame, longest: int) -> DataFrame:
    """Cycles of any length within strong components. Paths grow by one edge a round, as joins."""
    e = edge_rows.select("stream_id", "a", "b", F.col("cost").cast("long").alias("cost"), "weight")
    parts = strong_components(edge_rows).where("size > 1").select("stream_id", "node", "root")
    inner = e.join(parts.withColumnRenamed("node", "a").withColumnRenamed("root", "ra"), ["stream_id", "a"]).join(parts.withColumnRenamed("node", "b").withColumnRenamed("root", "rb"), ["stream_id", "b"]).where("ra = rb and a != b").select("stream_id", "a", "b", "cost", "weight")
    step = inner.select("stream_id", F.col("a").alias("last"), F.col("b").alias("to"), F.col("cost").alias("c"), F.col("weight").alias("w"))
    path = inner.where("b > a").select("stream_id", F.array("a", "b").alias("nodes"), F.col("b").alias("last"), F.col("cost").alias("cost"), F.col("weight").alias("total_weight"))
    found = None
    for n in range(2, longest + 1):
        closed = path.join(step, ["stream_id", "last"]).where(F.col("to") == F.col("nodes")[0]).select("stream_id", "nodes", F.lit(n).alias("len"), (F.col("total_weight") + F.col("w")).alias("total_weight"), (8 * n - F.col("cost") - F.col("c")).cast("double").alias("gain"))
        found = closed if found is None else found.unionByName(closed)
        if n < longest:
            path = path.join(step, ["stream_id", "last"]).where((F.col("to") > F.col("nodes")[0]) & ~F.array_contains("nodes", F.col("to"))).select("stream_id", F.concat("nodes", F.array("to")).alias("nodes"), F.col("to").alias("last"), (F.col("cost") + F.col("c")).alias("cost"), (F.col("total_weight") + F.col("w")).alias("total_weight"))
    w = Window.partitionBy("stream_id", F.array_sort("nodes")).orderBy("nodes")
    return found.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def top_cycles(found: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("stream_id").orderBy(F.desc("gain"), "len", "nodes")
    return found.where("gain > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_cycles(edge_rows: DataFrame, longest: int = 8, k: int = 10) -> DataFrame:
    """`top_cycles` of the gaining cycles of up to `longest` nodes, each stream's searched from the largest gain down, as far as the k first are settled."""

    def search(n, a, b, cost, part, parts):
        import numpy as np

        return [np.array([nodes]) for nodes, _ in cyclesearch.best_gaining(cyclesearch.savings(n, a, b, cost), longest, k)]

    return top_cycles(_cycle_rows(edge_rows, search, None), k)


def cycles_by_node(found: DataFrame) -> DataFrame:
    return found.select("stream_id", F.explode("nodes").alias("node")).groupBy("stream_id", "node").agg(F.count("*").alias("n_cycles"))


def cycle_text(nodes, ops) -> object:
    """`10 --(x + 3)--> 13 ...` from arrays of nodes and of operator texts."""
    return F.concat(F.array_join(F.zip_with(nodes, ops, lambda n, o: F.concat(n.cast("string"), F.lit(" --("), o, F.lit(")--> "))), ""), F.get(nodes, F.lit(0)).cast("string"))


def phase_of(nodes, v):
    """The place of a value in a cycle, -1 if it isn't in it."""
    return (F.array_position(nodes, v) - 1).cast("int")


def contains_node(nodes, v):
    return F.array_contains(nodes, v)


def coverage(edge_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Per stream: the share of nodes with an edge out that some cycle visits, and of edges that compress. found: cycles, or counts of them by node."""
    on = found.select("stream_id", (F.explode("nodes") if "nodes" in found.columns else F.col("node")).alias("a")).distinct().withColumn("hit", F.lit(1))
    nodes = edge_rows.select("stream_id", "a").distinct().join(on, ["stream_id", "a"], "left").groupBy("stream_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("node_coverage"))
    return nodes.join(statistics(edge_rows).select("stream_id", F.col("compressing_share").alias("edge_coverage")), "stream_id")


def dot_lines(edge_rows: DataFrame) -> DataFrame:
    """Graphviz statements of edges with positive weight: (stream_id, weight, a, b, line)."""
    seen = edge_rows.where("weight > 0")
    most = Window.partitionBy("stream_id")
    pen = F.round(1.0 + 4.0 * F.col("freq") / F.max("freq").over(most), 2)
    label = F.concat(algebra.expression(F.col("op_id"), F.col("operand")), F.format_string("\\ncost=%db freq=%d", "cost", "freq"))
    line = F.concat(F.format_string("  n%d -> n%d [label=\"", "a", "b"), label, F.format_string("\" penwidth=\"%.2f\"];", pen))
    return seen.select("stream_id", "weight", "a", "b", line.alias("line"))


def export_dot(edge_rows: DataFrame, stream_id: str, path: str | None) -> None:
    """Writes one stream's graph, of at most 256 nodes, as a single text file."""
    if not path:
        raise ValueError("no export directory is set")
    lines = dot_lines(edge_rows.where(F.col("stream_id") == stream_id)).orderBy(F.desc("weight"), "a", "b").collect()
    nodes = list(dict.fromkeys(n for r in lines for n in (r.a, r.b)))
    text = ["digraph bytes {", "  graph [rankdir=LR];", "  node  [shape=circle];", *(f'  n{n} [label="0x{n:02X}"];' for n in nodes), *(r.line for r in lines), "}"]
    spark: SparkSession = edge_rows.sparkSession
    spark.createDataFrame([("\n".join(text),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def profile(edge_rows: DataFrame, found: DataFrame) -> dict[str, DataFrame]:
    """The tables of a graph's profile."""
    return {"statistics": statistics(edge_rows), "edge_costs": cost_histogram(edge_rows), "top_edges": top_edges(edge_rows), "cycle_lengths": found.groupBy("stream_id", "len").agg(F.count("*").alias("n")), "top_cycles": top_cycles(found), "coverage": coverage(edge_rows, found)}
