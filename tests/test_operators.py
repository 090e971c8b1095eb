import itertools
import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from byteloom.functions import algebra as A
from byteloom.operators import codec, evolve, graph, runs
from byteloom.sources import snapshots, streams


def table_of(spark, named):
    return spark.createDataFrame([(k, i, v) for k, d in named.items() for i, v in enumerate(d)], "stream_id string, pos long, v int")


STREAMS = {
    "zeros": [0] * 256,
    "same": [137] * 256,
    "count": list(range(256)) * 4,
    "alternating": [50, 100] * 256,
    "overlap": [1, 2, 4, 6, 8, 10],
    "signs": [127, 128, 255, 0, 1, 0, 255],
    "single": [42],
    "pair": [1, 2],
    "two_patterns": [1, 2, 3] * 170 + [5, 6],
    "random": [random.Random(5).randrange(256) for _ in range(1024)],
    "levels": [random.Random(6).randrange(3) for _ in range(1500)],
    "parity": [0, 1, 3, 6, 8, 10, 13, 16, 19, 20, 21, 22, 23, 30, 37, 44, 51],
}


def test_cheapest_agrees_with_a_scan():
    lib = A.library()
    assert len(lib) == 2064
    for a in range(0, 256, 5):
        best = {}
        for op in [A.Op(i) for i in (10, 11, 12, 13)] + lib:
            b = op(a)
            if b not in best or op.kind.cost < best[b].kind.cost:
                best[b] = op
        for b in range(256):
            got = codec._full(a, b)
            assert got(a) == b and got.kind.cost == best[b].kind.cost


def test_errors_of_the_algebra():
    for bad in (lambda: A.Op(3, 0), lambda: A.Op(4, 0), lambda: A.Op(8, 8), lambda: A.Op(99), lambda: A.Composite((A.Op(10),)), lambda: A.clusters(0), lambda: A.Table((1, 2))):
        with pytest.raises(ValueError):
            bad()


def test_fusion_and_tables():
    assert A.optimised([A.Op(0, 3), A.Op(0, 5)]) == A.Op(0, 8)
    assert A.optimised([A.Op(0, 3), A.Op(1, 3)]) == A.Op(0, 0)
    assert A.optimised([A.Op(10), A.Op(10)]) == A.Op(0, 0)
    assert A.optimised([A.Op(8, 5), A.Op(8, 4)]) == A.Op(6, 0)
    assert A.optimised([A.Op(5, 7), A.Op(5, 3)]) == A.Op(5, 4)
    assert A.optimised([A.Op(0, 1), A.Op(5, 1)]).steps == (A.Op(0, 1), A.Op(5, 1))
    assert A.Composite((A.Op(0, 3), A.Op(10))).text() == "~x + 3"
    assert A.iterated(A.Op(11), 5)(254) == 3
    assert A.fixed_point(A.Op(9, 1), 20)(200) == 0
    assert A.conjugate(A.Op(11), A.Op(10))(7) == 6
    assert A.token_cost(A.Op(10)) == 6 and A.better_than_literal(A.Op(10)) and not A.better_than_literal_token(A.Op(8, 1))


@given(st.lists(st.sampled_from([A.Op(0, 7), A.Op(1, 9), A.Op(10), A.Op(5, 33), A.Op(6, 60), A.Op(7, 5), A.Op(8, 2), A.Op(9, 3)]), min_size=2, max_size=4))
def test_fusion_keeps_the_function(steps):
    f = A.optimised(steps)
    for x in range(0, 256, 3):
        y = x
        for s in steps:
            y = s(y)
        assert f(x) == y


@given(st.binary(max_size=300) | st.lists(st.integers(0, 3), max_size=300).map(bytes))
@settings(deadline=None)
def test_containers_round_trip(data):
    assert codec.decode(codec.encode_v2_row(data)) == data
    assert codec.decode(codec.encode_v1(data, [[1, 2], [0, 3, 1]])) == data
    mode, name, inner, back = codec.read_v3(codec.wrap_v3(codec.encode_v2_row(data), "ab" * 32, b"snapshot"))
    assert (mode, name, inner, back) == (1, "ab" * 32, b"snapshot", data)


def test_known_sizes():
    assert len(codec.encode_v2_row(bytes((10 + 3 * i) & 255 for i in range(409600)))) == 39
    assert len(codec.encode_v2_row(bytes([0x2A]) * 102400)) == 19


def test_bad_containers():
    for bad in (b"", b"XYZ\x02\x00", codec.PREFIX + b"\x07\x00\x00\x00\x00\x00", codec.encode_v2_row(b"abcdef")[:-3]):
        with pytest.raises(codec.FormatError):
            codec.decode(bad)
    with pytest.raises(codec.FormatError):
        codec.read_v3(codec.wrap_v3(codec.encode_v2_row(b"a"), "00" * 32), codec.V3_STANDALONE)


def test_windows_agree_with_rows(spark):
    b = table_of(spark, STREAMS)
    made = {r.stream_id: bytes(r.encoded) for r in codec.encode_v2(b).collect()}
    for k, d in STREAMS.items():
        assert made[k] == codec.encode_v2_row(bytes(d)), k
    n = {r.stream_id: r.encoded_bytes for r in codec.v1_tiers(b).collect()}
    assert all(n[k] == len(codec.encode_v1(bytes(d))) for k, d in STREAMS.items())


def test_long_runs_split(spark):
    b = spark.range(70000).select(F.lit("long").alias("stream_id"), F.col("id").alias("pos"), F.lit(9).alias("v"))
    t = codec.v2_tokens(b).collect()
    assert sorted((r.tier, r.pos) for r in t) == [("ARITH_RUN", 0), ("ARITH_RUN", 65535)]


def test_chunks_do_not_change_pairs(spark):
    b = table_of(spark, STREAMS)
    f = lambda c: sorted(map(tuple, graph.with_next(b, c).collect()), key=repr)
    assert f(7) == f(1 << 16)


def test_graph_of_a_cycle(spark):
    e = graph.edges(graph.digrams(table_of(spark, {"c": [10, 13, 16, 10, 13, 16, 10], "up": list(range(1, 9))})))
    c = graph.cycles(e, 4).collect()
    assert [(r.stream_id, r.nodes, r.gain) for r in c] == [("c", [10, 13, 16], -15.0)]
    assert {r.node for r in graph.strong_components(e).where("size > 1").collect()} == {10, 13, 16}
    with pytest.raises(ValueError):
        graph.export_dot(e, "c", None)
    assert set(graph.profile(e, graph.cycles(e, 3))) == {"statistics", "edge_costs", "top_edges", "cycle_lengths", "top_cycles", "coverage"}


def test_gaining_cycles_by_pruned_search(spark):
    rnd = random.Random(3)
    e = graph.edges(graph.digrams(table_of(spark, {"r": [rnd.choice([0, 1, 2, 255, 254]) for _ in range(400)]})))
    key = lambda df: sorted((tuple(r.nodes), r.gain) for r in df.collect())
    assert {n for n, _ in key(graph.cycles(e, 4, gaining=True))} >= {n for n, g in key(graph.cycles(e, 4)) if g > 0}


def _random_edges(spark, n, share, seed):
    rnd = random.Random(seed)
    rows = [("g", a, b, rnd.choice([5, 8, 13]), float(rnd.randrange(50))) for a in range(n) for b in range(n) if rnd.random() < share]
    return rows, spark.createDataFrame(rows, "stream_id string, a int, b int, cost int, weight double")


def _cycles_by_hand(rows, longest):
    """Of each set of nodes all orders that are cycles, lexically: (nodes, weight, gain)."""
    known = {(a, b): (c, w) for _, a, b, c, w in rows}
    nodes, found = sorted({x for e in known for x in e}), []
    for n in range(2, longest + 1):
        for chosen in itertools.combinations(nodes, n):
            orders = [(chosen[0], *p) for p in itertools.permutations(chosen[1:])]
            closed = [(w, [known.get(e) for e in zip(w, (*w[1:], w[0]))]) for w in orders]
            found.append([(list(w), sum(x[1] for x in es), 8.0 * n - sum(x[0] for x in es)) for w, es in closed if all(es)])
    return [x for x in found if x]


@pytest.mark.parametrize("share", [0.3, 0.7])
def test_cycles_within_the_matrix(spark, share):
    """All lengths against a search by hand; to four nodes, no path is joined, sorted or shuffled."""
    rows, e = _random_edges(spark, 11, share, 5)
    key = lambda df: sorted((r.nodes, r.total_weight, r.gain) for r in df.collect())
    for longest in (2, 3, 4, 5):
        assert key(graph.cycles(e, longest)) == sorted(x[0] for x in _cycles_by_hand(rows, longest))
    plan = graph.cycles(e, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


@pytest.mark.parametrize("share", [0.3, 0.7])
def test_cycle_counts(spark, share):
    rows, e = _random_edges(spark, 11, share, 6)
    for longest in (2, 4, 5):
        want = Counter((len(x[0][0]), n) for x in _cycles_by_hand(rows, longest) for n in x[0][0])
        counted = graph.cycle_counts(e, longest)
        assert {(r.len, r.node): r.n for r in counted.collect()} == want
        assert {r.len: r.n for r in graph.cycle_lengths(counted).collect()} == Counter(len(x[0][0]) for x in _cycles_by_hand(rows, longest))


def test_cycle_counts_of_a_full_graph(spark):
    """Of 256 nodes that all lead to each other: every set of nodes is a cycle."""
    e = spark.range(65536).select(F.lit("g").alias("stream_id"), F.floor(F.col("id") / 256).alias("a"), (F.col("id") % 256).alias("b"), F.lit(13).alias("cost"), F.lit(1.0).alias("weight"))
    counted = graph.cycle_counts(e).cache()
    assert {r.len: r.n for r in graph.cycle_lengths(counted).collect()} == {k: math.comb(256, k) for k in (2, 3, 4)}
    assert {(r.len, r.n) for r in counted.collect()} == {(k, math.comb(255, k - 1)) for k in (2, 3, 4)}
    assert {r.n_cycles for r in graph.visits(counted).collect()} == {sum(math.comb(255, k - 1) for k in (2, 3, 4))}
    assert [r.node_coverage for r in graph.coverage(e, counted).collect()] == [1.0]


def test_coverage_from_counts(spark):
    rows, e = _random_edges(spark, 11, 0.1, 8)
    visited = {n for x in _cycles_by_hand(rows, 4) for n in x[0][0]}
    out = {r[1] for r in rows}
    for found in (graph.cycles(e), graph.cycle_counts(e)):
        r = graph.coverage(e, found).first()
        assert 0 < r.node_coverage < 1 and r.node_coverage == len(visited & out) / len(out)


@pytest.mark.parametrize("share", [0.4, 1.0])
def test_best_cycles(spark, share):
    rows, e = _random_edges(spark, 8, share, 7)
    gains = [[x for x in orders if x[2] > 0] for orders in _cycles_by_hand(rows, 7)]
    first = sorted((-x[0][2], len(x[0][0]), x[0][0], x[0][1]) for x in gains if x)
    assert sorted((-r.gain, r.len, r.nodes, r.total_weight) for r in graph.cycles(e, 7, gaining=True).collect()) == first
    for k in (1, 10, 1000):
        assert [(-r.gain, r.len, r.nodes, r.total_weight) for r in graph.best_cycles(e, 7, k).orderBy("rank").collect()] == first[:k]


def test_best_cycles_of_a_full_graph(spark):
    """All 65,536 edges: no cycle of eight saves more than three bits an edge, and ten do."""
    e = graph.edges(A.lookup(spark).select(F.lit("g").alias("stream_id"), "a", "b", F.lit(1).alias("freq")))
    got = graph.best_cycles(e).orderBy("rank").collect()
    assert [(r.nodes, r.gain) for r in got] == [([*range(x, x + 4), *range(252 - x, 256 - x)], 24.0) for x in range(10)]


def test_graph_of_event_bytes(spark, sf):
    """Components and cycles of the whole byte graph against a search by hand."""
    from byteloom.plans.queries import QUERIES

    got = {n: QUERIES[n + "_events"](spark, sf).toPandas() for n in ("scc", "cycles", "cycle_hist", "cycles_by_node", "top_cycles", "graph_coverage")}
    near, edges = {}, {}
    for r in QUERIES["edges"](spark, sf).collect():
        near.setdefault((r.stream_id, r.a), []).append(r.b)
        edges[r.stream_id, r.a, r.b] = (r.cost, r.weight)
    names = sorted({k[0] for k in edges})
    reach, found = {}, {4: {}, 8: {}}
    for s, x in {(k[0], n) for k in edges for n in k[1:]}:
        reach[s, x], todo = {x}, [x]
        while todo:
            new = set(near.get((s, todo.pop()), ())) - reach[s, x]
            reach[s, x] |= new
            todo += new
        walks = [[x]]
        while walks:
            w = walks.pop()
            for y in near.get((s, w[-1]), ()):
                if y == x and len(w) > 1:
                    es = [edges[s, a, b] for a, b in zip(w, w[1:] + [x])]
                    gain, weight = 8 * len(w) - sum(c for c, _ in es), sum(v for _, v in es)
                    for longest in (4, 8):
                        if len(w) <= longest and (longest == 4 or gain > 0):
                            key = (s, frozenset(w))
                            found[longest][key] = min(found[longest].get(key, (w, weight, gain)), (w, weight, gain))
                elif y > x and y not in w and len(w) < 8:
                    walks.append(w + [y])
    text = lambda w: "-".join(map(str, w))
    same = {k: sorted(y for y in v if k[1] in reach.get((k[0], y), ())) for k, v in reach.items()}
    assert {(r.stream_id, r.node): (r.root, r.size) for r in got["scc"].itertuples()} == {k: (v[0], len(v)) for k, v in same.items()}
    all_ = [(k[0], *v) for k, v in found[4].items()]
    assert sorted((r.stream_id, r.path, r.len, r.total_weight, r.gain) for r in got["cycles"].itertuples()) == sorted((s, text(w), len(w), v, g) for s, w, v, g in all_)
    count = lambda keys: {k: keys.count(k) for k in set(keys)}
    assert {(r.stream_id, r.len): r.n for r in got["cycle_hist"].itertuples()} == count([(s, len(w)) for s, w, _, _ in all_])
    assert {(r.stream_id, r.node): r.n_cycles for r in got["cycles_by_node"].itertuples()} == count([(s, x) for s, w, _, _ in all_ for x in w])
    for s in names:
        best = sorted((-g, len(w), w) for (t, _), (w, _, g) in found[8].items() if t == s)[:10]
        assert [(r.path, r.gain) for r in got["top_cycles"].query("stream_id == @s").sort_values("rank").itertuples()] == [(text(w), -g) for g, _, w in best]
        out = {a for t, a in near if t == s}
        costs = [c for (t, _, _), (c, _) in edges.items() if t == s]
        r = got["graph_coverage"].query("stream_id == @s").iloc[0]
        assert (r.node_coverage, r.edge_coverage) == (round(len({x for t, w, _, _ in all_ if t == s for x in w} & out) / len(out), 6), round(sum(c < 8 for c in costs) / len(costs), 6))


def test_every_stream_takes_cycles(spark, monkeypatch):
    from byteloom.plans.queries import QUERIES

    made, encoded = [], codec.encoded
    monkeypatch.setattr(codec, "encoded", lambda *a: made.append(encoded(*a)) or made[0])
    monkeypatch.setattr(streams, "events_by_user", lambda spark, sf: spark.range(1200 * 16).select((F.col("id") / 16).cast("int").cast("string").alias("stream_id"), (F.col("id") % 16).alias("pos"), F.when(F.col("id") % 2 == 0, 50).otherwise(100).alias("v")))
    assert QUERIES["v1_cycle_roundtrip"](spark, "").where("equal and n = 16").count() == 1200
    assert {bytes(r.encoded)[4] for r in made[0].collect()} == {2}  # the number of cycles in the header


def test_snapshots(spark, tmp_path):
    s = snapshots.serialize(7, 123, "arith", [(1, 2, 11), (2, 2, 13)], [(i, i, 0.5, 0.4, 0.1, 3, 10) for i in range(1200)])
    broken = s[:-1] + bytes([s[-1] ^ 1])
    rows = spark.createDataFrame([("a", s), ("b", broken)], "id string, content binary")
    m = {r.id: r for r in snapshots.manifests(rows).collect()}
    assert (m["a"].generation, m["a"].tag, m["a"].crc_ok, m["b"].crc_ok) == (7, "arith", True, False)
    assert [(r.a, r.b, r.op_id) for r in snapshots.chromosomes(rows.where("id = 'a'")).orderBy("rule_no").collect()] == [(1, 2, 11), (2, 2, 13)]
    with pytest.raises(Exception, match="no snapshot"):
        snapshots.manifests(spark.createDataFrame([("x", b"nothing at all, and more than thirty bytes")], "id string, content binary")).collect()
    root = str(tmp_path / "store")
    c = spark.createDataFrame([("arith", s), ("arith", s)], "domain string, content binary")
    assert snapshots.publish(spark, root, c).count() == 1 and snapshots.publish(spark, root, c).count() == 0
    assert snapshots.load(spark, root, snapshots.snapshot_id(s)) == s
    with pytest.raises(snapshots.SnapshotError):
        snapshots.load(spark, root, "0" * 64)


def test_snapshot_sections(spark):
    cycles = [([1, 2, 3], [11, 11, 0], 2.5, 6.0), ([9, 8], [12, 11], 1.0, 3.0)]
    past = [(i, 10 * i, 0.5, 0.25, 0.125, 3, 1024) for i in range(1500)]
    s = snapshots.serialize(3, 9, "é€tag", [(1, 2, 11)], past, cycles)
    t = snapshots.loaded(spark.createDataFrame([("a", s), ("b", snapshots.serialize(0, 0))], "id string, content binary"))
    assert {(r.id, r.major, r.tag, r.crc_ok) for r in t["manifest"].collect()} == {("a", 2, "é€tag", True), ("b", 2, "", True)}
    assert [(r.nodes, r.op_ids, r.total_weight, r.gain) for r in t["cycles"].orderBy("cycle_no").collect()] == [tuple(c) for c in cycles]
    assert [tuple(r)[1:] for r in t["history"].orderBy("generation").collect()] == past[-1000:] and t["chromosome"].count() == 1


def test_payload_counts_are_those_of_bytes(spark):
    rows = spark.createDataFrame([("x", b"abcabc\xff\x00"), ("y", b"a"), ("z", b""), ("n", None), ("w", bytes(range(256)) * 5)], "stream_id string, payload binary")
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    exploded = streams.exploded(rows, F.col("stream_id"), F.col("payload"))
    want = graph.digrams(exploded)
    assert rows_of(graph.payload_digrams(rows)) == rows_of(want)
    assert rows_of(graph.payload_digrams(rows, per_stream=False)) == rows_of(want.groupBy("a", "b").agg(F.sum("freq").alias("freq")))
    assert rows_of(codec.v1_payload_tiers(rows)) == rows_of(codec.v1_tiers(exploded))
    assert graph.payload_digrams(rows.limit(0), per_stream=False).count() == 0


def test_rank_selection_by_brute_force(spark):
    s = spark.createDataFrame([(f"c{i:03d}", i / 10) for i in range(37)], "chrom_id string, fitness double")
    n, order = 37, [f"c{i:03d}" for i in range(36, -1, -1)]
    spans = [name for k, name in enumerate(order) for _ in range(k + 1)]
    draws = spark.range(500).select("id", F.floor(evolve.draw(4, "id") * (n * (n + 1) / 2)).alias("at")).collect()
    got = {r.slot: r.chrom_id for r in evolve.rank_selection(s, 500, 4).collect()}
    assert got == {r.id: spans[r["at"]] for r in draws}


def test_search_runs(spark, tmp_path):
    b = streams.seed(spark, 512)
    seen = []
    best, history = evolve.search(b, evolve.Config(population=6, generations=3, window=512, first_rules=4), path=str(tmp_path), on_generation=seen.append)
    assert len(history) == len(seen) == 3 and best.count() > 0
    assert history[0]["best_fitness"] == pytest.approx(1 - (9 + (9 * 512 - 2 * 511 + 7) // 8) / 512 - 0.004, abs=0.003)
    with pytest.raises(ValueError):
        evolve.search(streams.seed(spark, 100))
    with pytest.raises(ValueError):
        evolve.Config(window=10)


def test_variation(spark):
    r = evolve.random_population(spark, 4, 40, 3)
    assert evolve.validity(r).where("valid").count() == 4
    for kind in ("SINGLE_POINT", "TWO_POINT", "UNIFORM", "OPERATOR_AWARE"):
        x, y = (r.where(F.col("chrom_id") == c).withColumn("chrom_id", F.lit("k")) for c in ("c0000", "c0001"))
        child = evolve.crossed(x, y, kind, 1)
        assert 20 <= child.count() <= 80 and evolve.validity(child).first().valid
    m = evolve.mutated(r, 0.2, 30, 5)
    assert m.groupBy("chrom_id").count().agg(F.max("count")).first()[0] <= 30 and evolve.validity(m).where("valid").count() == 4
    s = r.groupBy("chrom_id").agg((F.count("*") / 100).alias("fitness"))
    assert evolve.tournament(s, 8, 3).count() == 8 and evolve.rank_selection(s, 8).count() == 8


def test_streamed_runs(spark, tmp_path):
    from byteloom.streaming import stream_runs

    d = [random.Random(9).randrange(2) for _ in range(300)] + [0, 7]
    b = table_of(spark, {"s": d})
    for k in range(3):
        b.where((F.col("pos") / 101).cast("int") == k).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    src = spark.readStream.schema("stream_id string, pos long, v int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stream_runs(src).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {(r.st, r.start, r.len) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.st, r.start, r.len) for r in runs.detected(runs.islands(b)).collect()}
    assert got == want


def test_sources(spark, tmp_path):
    p = tmp_path / "x.bin"
    p.write_bytes(bytes([0, 255, 7]))
    assert [r.v for r in streams.files(spark, str(p)).orderBy("pos").collect()] == [0, 255, 7]
    assert bytes(streams.collected(streams.files(spark, str(p))).first().payload) == bytes([0, 255, 7])
    for kind in ("uniform", "gaussian", "lcg", "arithmetic", "sine"):
        r = streams.generated(spark, kind, 500).agg(F.min("v"), F.max("v"), F.count("*")).first()
        assert 0 <= r[0] <= r[1] <= 255 and r[2] == 500


def test_borders_of_chunks_change_nothing(spark, monkeypatch):
    from byteloom.operators import profiles

    b = table_of(spark, STREAMS)
    whole = {}
    for chunk in (1 << 16, 16, 9):
        isl = runs.islands(b, chunk)
        found = runs.detected(isl, chunk)
        table = runs.step_table(runs.patterns(found))
        monkeypatch.setattr(profiles, "CHUNK", chunk)
        monkeypatch.setattr(codec, "CHUNK", chunk)
        made = [isl, found, runs.parsed(isl, table, chunk), profiles.fingerprints(b), codec.offsets(codec.v2_tokens(b))]
        got = [sorted(map(repr, df.collect())) for df in made]
        assert whole.setdefault("first", got) == got


def test_bit_offsets_follow_on_each_other(spark):
    for name, rows in _by_stream(codec.offsets(codec.v2_tokens(table_of(spark, STREAMS)))).items():
        at = 0
        for r in sorted(rows, key=lambda r: r.pos):
            assert r.bit_offset == at, name
            at += r.nbits


def _by_stream(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.stream_id, []).append(r)
    return out


def test_mutation_changes_what_it_says(spark):
    rules = evolve.random_population(spark, 40, 6, 3).cache()
    same = evolve.mutated(rules, 0.0, 64, 1, 0.0)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, rules.select(same.columns).collect()))
    pairs = lambda df: {(r.chrom_id, r.a, r.b) for r in df.collect()}
    before, more, fewer = pairs(rules), pairs(evolve.mutated(rules, 0.0, 64, 1, 1.0)), pairs(evolve.mutated(rules, 1.0, 64, 1, 0.0))
    assert before <= more and 30 <= len(more) - len(before) <= 40  # one each, but where the pair is there already
    assert fewer <= before and 5 <= len(before) - len(fewer) <= 35  # half the chromosomes lose one
    wrong = rules.withColumns({"op_id": F.lit(0), "operand": (F.col("b") - F.col("a")).bitwiseAND(255)})
    cheap = evolve.mutated(wrong, 1.0, 64, 2, 0.0)
    assert cheap.withColumn("o", A.cheapest(F.col("a"), F.col("b"))).where("o.op_id != op_id").count() == 0
    assert max(r["n"] for r in evolve.mutated(rules, 0.0, 4, 1, 1.0).groupBy("chrom_id").agg(F.count("*").alias("n")).collect()) == 4


def test_elite_with_its_fallback(spark):
    scored = spark.createDataFrame([(f"c{i}", float(i)) for i in range(9)], "chrom_id string, fitness double")
    got = {r.slot: r.chrom_id for r in evolve.elite_then(scored, 6, 2, 3, 1).collect()}
    assert sorted(got) == list(range(6)) and [got[0], got[1]] == ["c8", "c7"] and set(got.values()) <= {f"c{i}" for i in range(9)}
    assert evolve.elite_then(scored, 1, 2, 3, 1).collect()[0].chrom_id == "c8"


def test_harness_stops_and_reports(spark, tmp_path):
    seen, bests = [], []
    h = evolve.Harness(streams.seed(spark, 512), evolve.Config(population=4, generations=50, elite=1, first_rules=4), 1, str(tmp_path / "s"), on_best=bests.append, on_generation=lambda r: seen.append(r) or (len(seen) == 2 and h.stop()))
    rules = h.start().join(120)
    assert len(seen) == len(h.history) == 2 and len(bests) >= 1 and rules.count() >= 1
    with pytest.raises(RuntimeError):
        h.start()
    text = evolve.report_text(spark.createDataFrame(h.history), h.control, "x", 2.0)
    assert "Total generations  : 2" in text and "Gen/sec            : 1.0" in text and "Domain             : x" in text
    assert "No generations" in evolve.report_text(spark.createDataFrame([], "generation long, best_fitness double"))
    bad = evolve.Harness(streams.seed(spark, 10), evolve.FAST).start()
    with pytest.raises(ValueError):
        bad.join(60)


def test_sparkline_of_a_flat_and_of_a_rising_run(spark):
    flat = spark.createDataFrame([(g, 0.5) for g in range(3)], "generation long, best_fitness double")
    up = spark.createDataFrame([(g, g / 7) for g in range(8)], "generation long, best_fitness double")
    assert evolve.sparkline(flat).first().line == evolve.MARKS[3] * 3
    assert evolve.sparkline(up).first().line == evolve.MARKS
    assert evolve.sparkline(up.limit(0)).count() == 0


def test_wrapped_containers_want_a_known_snapshot(spark, tmp_path):
    raw = spark.createDataFrame([("x", bytes(range(200)))], "stream_id string, payload binary")
    content = snapshots.serialize(1, 2, "t", [(1, 2, 11)])
    snapshots.publish(spark, str(tmp_path / "store"), spark.createDataFrame([("t", content)], "domain string, content binary"))
    key = snapshots.snapshot_id(content)
    r = codec.unwrapped(codec.wrapped(raw, key, store=str(tmp_path / "store")), codec.V3_CONNECTED).first()
    assert (r.mode, r.snapshot_id, r.snapshot, bytes(r.payload)) == (0, key, None, bytes(range(200)))
    with pytest.raises(snapshots.SnapshotError):
        codec.wrapped(raw, "0" * 64, store=str(tmp_path / "store"))


def _stream(spark, folder, batches, make, tmp_path):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "stream_id string, pos long, v int").coalesce(1).write.parquet(f"{folder}/in/part={i}")
    source = spark.readStream.schema("stream_id string, pos long, v int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    q = make(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_streamed_runs_end_with_their_stream(spark, tmp_path):
    from byteloom.streaming import stream_runs

    batches = [[("s", i, 10 + 2 * i) for i in range(3)], [("s", i, 10 + 2 * i) for i in range(3, 6)], [("s", 6, None)]]
    got = _stream(spark, str(tmp_path), batches, stream_runs, tmp_path).collect()
    assert [tuple(r) for r in got] == [("s", 2, 0, 6)]


def test_late_bytes_are_an_error(spark, tmp_path):
    from byteloom.streaming import stream_digrams

    with pytest.raises(Exception, match="late, missing or repeated"):
        _stream(spark, str(tmp_path), [[("s", 0, 1), ("s", 1, 2)], [("s", 1, 3)]], stream_digrams, tmp_path)


def test_snapshots_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("d", b"x"), ("e", b"x"), ("d", b"y")], "domain string, content binary").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("domain string, content binary").parquet(str(tmp_path / "in"))
    snapshots.publish_stream(source, str(tmp_path / "store")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.domain for r in snapshots.stored(spark, str(tmp_path / "store")).collect()) == ["d", "d"]


def test_arity_and_second_deltas():
    assert A.arity(A.Op(0, 1)) == "UNARY" and A.arity(A.Op(39)) == "BINARY"


def test_ranking_scores_unreadable_snapshots_zero(spark):
    from byteloom.operators import profiles

    index = spark.createDataFrame([("a", "audio", True), ("b", "zeros", False), ("c", "zeros", True)], "id string, domain string, readable boolean")
    sample = profiles.fingerprints(table_of(spark, {"zeros": [0] * 256}))
    got = [(r.id, r.rank) for r in profiles.ranked(sample, index).orderBy("rank").collect()]
    assert got == [("c", 1), ("a", 2), ("b", 3)] and profiles.ranked(sample, index).where("id = 'b'").first().score == 0
    assert profiles.best(sample, index).first().id == "c"
