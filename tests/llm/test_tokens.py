import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from byteloom.llm import bpe, packing
from byteloom.llm.queries import TOKENIZER

PATH = public_tokenizers.path(TOKENIZER)
HARD = [None, "", "   ", "Hello  <|endoftext|> it's 123 ünïcode\x00 ﬁ x <|STARTOFTEXT|>y 😀", "ΑΣ ΣΑΣ. İstanbul J̌ x́ Å", "a\x1cb\x1d \x85 c d　e", "日本語テキスト 한국어", "don't we'll I'VE 'S 're", "ﷺ ½ ² ٣ x", "x" * 3000, "ab" * 40 + "!?" * 700]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return bpe.model(PATH)


def test_as_the_library(spark, sf, model, library):
    texts = HARD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t, got in zip(texts, model.encode_all(texts)):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert ids == list(memoryview(got).cast("I")) == model.encode(t)
        d = bpe.Decoder(model, words=False)
        assert d.push(ids[:7]) + d.push(ids[7:]) + d.finish() == library.decode(ids, skip_special_tokens=False)


def _by_rank(model, s):
    """Merges one at a time, each time the lowest rank, the leftmost first."""
    while True:
        ranks = [(model.rank.get(a << bpe._SHIFT | b, bpe._NONE), i) for i, (a, b) in enumerate(zip(s, s[1:]))]
        r, i = min(ranks, default=(bpe._NONE, 0))
        if r == bpe._NONE:
            return s
        s[i : i + 2] = [model.merged[r]]


def test_memory_is_flat():
    """A word of 2 MB takes a window at a time; long words aren't kept, short ones at most for two generations."""
    import tracemalloc

    small = bpe.Bpe(PATH, cache=2000)
    symbols = [small.inner[b] for b in b"abcdefghij"]
    tracemalloc.start()
    n = sum(1 for _ in small.stream(symbols[i % 10] for i in range(200_000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 0 and peak < 2_000_000
    for k in range(40):
        assert len(list(small.encode_all([" ".join(f"w{k}x{i}" for i in range(300)) + " " + "long" * 40 + str(k)]))) == 1
    assert len(small.cache) + len(small.cache.old) < 2 * 4000 and len(small.cache.long) <= 2 and all(len(x) <= 64 for x in small.cache)


def test_transducer_has_enough_lookahead(model):
    rnd = random.Random(1)
    pieces = [t.removesuffix("</w>") for t in model.tokens[600:40000]]
    back = {c: b for b, c in enumerate(bpe.byte_alphabet())}
    small = bpe.Bpe(PATH, block=8)
    for _ in range(6):
        data = [back[c] for c in "".join(rnd.choice(pieces) for _ in range(300)) if c in back]
        symbols = [model.inner[b] for b in data[:-1]] + [model.last[data[-1]]]
        assert list(small.stream(symbols)) == small._merge(list(symbols)) == [x for x in _by_rank(model, list(symbols))]


def test_incremental_decoder(model):
    d = bpe.Decoder(model)
    ids = model.encode("naïve 😀 text")
    assert "".join(d.push([i]) for i in ids) + d.finish() == "naïve 😀 text "


def test_query_rows(spark, model, library):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(HARD)] + [(0, None, 2)], "doc_id long, text string, ids int")
    rows = bpe.round_trip(df, PATH).collect()
    assert len(rows) == len(HARD) + 1
    for r in rows:
        ids = library.encode(HARD[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(df, PATH), PATH).where("doc_id = 7").first().text
    assert back == "don 't we 'll i 've 's 're "


def test_plans_hold_everything():
    rnd = random.Random(2)
    for n in (0, 1, 7, 500, 30000):
        h: dict[int, int] = {}
        for _ in range(n):
            x = min(2048, int(rnd.lognormvariate(6, 1.1)) + 1)
            h[x] = h.get(x, 0) + 1
        plan = packing.solve(h)
        held: dict[int, int] = {}
        for config, times in plan:
            assert sum(x * a for x, a in config) <= 2048
            for x, a in config:
                held[x] = held.get(x, 0) + a * times
        assert held == h
        need = -(-sum(x * k for x, k in h.items()) // 2048)
        assert sum(t for _, t in plan) <= need * 1.01 + 2
    assert sum(t for _, t in packing.solve({1500: 100, 548: 40})) == 100


def _plain_best_fit(histogram, capacity=2048):
    """Sequences that best fit decreasing takes, piece by piece."""
    from bisect import bisect_left, insort

    rooms, n = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            at = bisect_left(rooms, length)
            room = rooms.pop(at) if at < len(rooms) else capacity
            n += room == capacity and 1
            if room > length:
                insort(rooms, room - length)
    return n


@pytest.mark.parametrize("kind", ["uniform", "short", "documents", "halves", "thirds"])
def test_sequences_are_few(kind):
    """Never more than best fit decreasing takes, and at the bound or within a sequence or 1 % of it; thirds, for which the bound is weak, within 4 %."""
    draw = {
        "uniform": lambda r: r.randint(1, 2048), "short": lambda r: r.randint(1, 200), "documents": lambda r: min(2048, int(r.lognormvariate(6, 1.1)) + 1),
        "halves": lambda r: r.choice([r.randint(900, 1150), r.randint(1, 60)]), "thirds": lambda r: r.randint(400, 760),
    }[kind]
    for n in (1000, 5000):
        rnd, h = random.Random(n), {}
        for _ in range(n):
            x = draw(rnd)
            h[x] = h.get(x, 0) + 1
        taken = sum(t for _, t in packing.solve(h))
        wanted = np.zeros(2049, np.int64)
        wanted[list(h)] = list(h.values())
        low = packing.bound(h, weights=packing.program(wanted)[1])
        assert low <= taken <= _plain_best_fit(h) and taken <= (1.04 if kind == 'thirds' else 1.01) * low + 1, (low, taken, _plain_best_fit(h))


def test_large_histograms_take_no_longer():
    h = {x: 10**7 + x for x in range(1, 2049, 3)}
    plan = packing.solve(h)
    assert sum(t for _, t in plan) <= packing.bound(h) * 1.005 and len(plan) < 60_000


def test_packing(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(1).alias("piece"), F.lit(2).alias("rank"))
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, 1, 2), (10**6 + 1, "", 1, 2), (10**6 + 2, "word " * 9000, 1, 2)], docs.schema))
    rows = packing.pack(docs, PATH).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    import zlib

    import numpy as np

    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, ps in by_doc.items():
        ids = library.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        at = 0
        for k, p in enumerate(sorted(ps, key=lambda p: p.piece)):
            assert (p.piece, p.start, p.length) == (k, at, min(2048, len(ids) - at))
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by_seq) <= -(-total // 2048) * 1.02 + 1
    assert packing.pack(docs.limit(0), PATH).count() == 0
