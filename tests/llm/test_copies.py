"""Line dedup, near-dedup and fingerprints against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from byteloom.llm import fingerprints, linededup, neardup
from byteloom.llm.components import components

RND = random.Random(4)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingle_set(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, percent):
    up = {d: d for d, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {d: shingle_set(t, n) for d, t in docs}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus():
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of"] * 40
    base = [" ".join(RND.choices(vocabulary, k=RND.randint(20, 150))) for _ in range(40)]
    texts = list(base)
    for t in base[:15] + [base[0]] * 60:  # one large group of near copies
        w = t.split()
        for _ in range(RND.randint(0, 4)):
            w[RND.randrange(len(w))] = f"edit{RND.randrange(1000)}"
        texts.append(" ".join(w))
    texts += [base[1]] * 30 + ["", None, "one", "one two", "ONE  two", "\x00 É é", "a b c"]
    return list(enumerate(texts))


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, monkeypatch, n, percent):
    monkeypatch.setattr(neardup, "_dealt", lambda m, g, b, most=0, f=neardup._dealt: f(m, g, 16, 4000))  # several blocks
    docs = corpus()
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in docs], "doc_id long, text string, sig int, root int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, n, percent).collect()}
    assert got == brute(docs, n, percent)


def test_links_that_pivots_miss(spark, monkeypatch):
    """Chains, in which neighbours are similar and others aren't, and a passage that many texts share: what no pivot confirms is found in blocks."""
    monkeypatch.setattr(neardup, "_dealt", lambda m, g, b, most=0, f=neardup._dealt: f(m, g, 4, 4000))
    rnd = random.Random(8)
    words = [f"c{i}" for i in range(400)]
    chain = [" ".join(words[8 * i : 8 * i + 130]) for i in range(30)]
    passage = " ".join(f"p{i}" for i in range(100))
    shared = [passage + " " + " ".join(f"q{rnd.randrange(10**6)}" for _ in range(rnd.choice([18, 25, 40]))) for _ in range(25)]
    docs = list(enumerate(rnd.sample(chain + shared, 55)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 3, 85).collect()}
    assert got == brute(docs, 3, 85)


def test_one_id_with_two_texts(spark):
    """Each of two texts under one id keeps its own links, however the table lies."""
    base = [" ".join(f"{x}{i}" for i in range(200)) for x in "ab"]
    docs = [(5, base[0]), (5, base[1]), (6, base[1] + " more"), (7, base[0] + " more"), (9, "alone with some words"), (-3, base[1] + " less")]
    for parts in (1, 4):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, 3, 85).collect())
        assert got == [(-3, 199, -3, True), (5, 198, -3, False), (5, 198, 5, True), (6, 199, -3, False), (7, 199, 5, False), (9, 2, 9, True)]


def test_chance_of_a_miss():
    import math

    tail = lambda m, p: sum(math.comb(48, i) * p**i * (1 - p) ** (48 - i) for i in range(m))
    for percent in (80, 85):
        m = neardup.least_matches(percent)
        assert tail(m, percent / 100) <= neardup.MISS < tail(m + 1, percent / 100)


def test_near_duplicate_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, "x " * 50_000), (7, None)], "doc_id long, text string")
    rows = neardup.near_duplicates(df, 3, 85).collect()
    assert len(rows) == 5 and all(r.kept for r in rows)
    assert neardup.near_duplicates(df.limit(0), 3, 85).count() == 0
    assert neardup.without_near_duplicates(df, 3, 85).count() == 4


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)}


def test_lines(spark):
    lines = [f"line {i} of the text" for i in range(30)] + ["", " "]
    docs = [(d, "\n".join(RND.choice(lines) for _ in range(RND.randint(0, 4))) + "\n" + "\n".join(lines[k : k + RND.randint(1, 6)])) for d, k in ((d, RND.randrange(28)) for d in range(60))]
    docs += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "same"), (104, "same"), (105, "\n".join(lines[:3] * 50)), (5, docs[5][1])]
    df = spark.createDataFrame([(d, t, 3) for d, t in docs], "doc_id long, text string, pos int")
    got = linededup.dedup_lines(df)
    first = {}

    def windows(t):
        ls = (t or "").split("\n")
        k = min(3, len(ls))
        return ls, [(p, tuple(ls[p : p + k])) for p in range(max(1, len(ls) - 2)) if "".join(ls[p : p + k]).strip()]

    for d, t in sorted(docs, key=lambda x: x[0]):
        for p, w in windows(t)[1]:
            first.setdefault(w, (d, p))
    want = []
    for d, t in docs:
        ls, ws = windows(t)
        gone = {i for p, w in ws if first[w] != (d, p) for i in range(p, p + len(w))}
        want.append((d, None if t is None else "\n".join(x for i, x in enumerate(ls) if i not in gone), 3))
    assert sorted(((r.doc_id, r.text, r.pos) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_fingerprints(spark):
    docs = [(d * 7, " ".join(RND.choices("abcdefgh", k=RND.randint(0, 400)))) for d in range(50)] + [(1000, None), (2000, "é😀 x"), (2001, docs_text := "one two three four five six"), (2002, docs_text)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, sketch int").cache()
    got = {r.doc_id: r for r in fingerprints.edit_and_compare(df).collect()}
    order = sorted(docs, key=lambda x: -x[0])
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 2
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest())
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[2001].fingerprint == got[2002].fingerprint and got[2002].near_next == 1.0
    assert fingerprints.edit_and_compare(df.limit(0)).count() == 0


@pytest.mark.parametrize("ids", ["dense", "sparse", "repeated", "one", "nulls"])
def test_next_over_borders_of_ranges(spark, ids):
    """Small ranges: every row sees its successor, in the order of key and hash, and the last the first."""
    from collections import Counter

    make = {"dense": lambda i: i, "sparse": lambda i: RND.randrange(-(1 << 60), 1 << 60), "repeated": lambda i: 77 if i % 3 == 0 else i * 1000, "one": lambda i: 5, "nulls": lambda i: None if i % 50 == 0 else i % 40}[ids]
    rows = [(make(i), f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]), reverse=True)
    want = Counter((a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1]))
    got = Counter((r.doc_id, r.text, r.next_text) for r in fingerprints.with_next(df, ["text"], rows=4, most=6).collect())
    assert got == want


def _sketch_by_hand(text, part=8, words=5):
    """The sketch with the hash function of this engine's Python twin: shingles as tuples, compared through Spark's own hashes in the test."""
    w = re.findall(r"[^ \t-\r]+", (text or "").lower())
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def test_sketches_by_brute_force(spark):
    """Each shingle hashed alone: a sketch holds those under the threshold and the smallest, and likenesses are those of the sets."""
    texts = [" ".join(RND.choices("abcdefgh", k=RND.randint(0, 200))) for _ in range(12)] + ["", "one two"]
    shingled = [_sketch_by_hand(t) for t in texts]
    flat = sorted({s for x in shingled for s in x})
    df = spark.createDataFrame([(list(s),) for s in flat], "w array<string>")
    each = F.when(F.size("w") == 5, F.xxhash64(*(F.xxhash64(F.get("w", F.lit(i))) for i in range(5)))).otherwise(F.xxhash64(F.array_join(F.transform("w", lambda x: F.xxhash64(x).cast("string")), " ")))
    h = {tuple(r.w): r.h for r in df.select("w", each.alias("h")).collect()}
    want = []
    for s in shingled:
        x = {h[t] for t in s}
        want.append(sorted({y for y in x if y < fingerprints.below()} | ({min(x)} if x else set())))
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", fingerprints.sketch(F.col("text")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == want
    a, b = set(want[0]), set(want[1])
    pair = spark.createDataFrame([(want[0], want[1])], "a array<long>, b array<long>").select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c")).first()
    assert abs(pair.r - len(a & b) / len(a | b)) < 1e-12 and abs(pair.c - len(a & b) / len(a)) < 1e-12


def test_sketch_estimates(spark):
    a = " ".join(f"w{i}" for i in range(4000))
    b = " ".join(f"w{i}" for i in range(1000))
    s = lambda t: fingerprints.sketch(F.lit(t))
    r = spark.range(1).select(fingerprints.containment(s(b), s(a)).alias("c"), fingerprints.resemblance(s(a), s(b)).alias("r"), (fingerprints.merged(s(a), s(b)) == s(a)).alias("m")).first()
    assert r.c > 0.99 and abs(r.r - 0.25) < 0.06 and r.m
