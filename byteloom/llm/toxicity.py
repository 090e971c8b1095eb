"""Toxic spans and document scores (operator 3): a linear-chain conditional random field over words.

Labels are given for documents. Tokens are labelled from them first: in a toxic document, a token counts as toxic if it, or
its beginning, occurs in clearly more toxic than clean documents; all others are clean. The field learns from these tokens: unaries from the
word and its beginnings of 4 to 6 letters (so that unseen inflections are caught), and transitions between labels. A document's score comes from the
forward-backward marginals by a logistic curve over the expected number of toxic tokens, their largest marginal and their share.

Null and empty texts have no tokens and get the curve's value there. Scores use nothing but the text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom.llm import crf
from byteloom.llm.labelled import held_out, sample

#: Bounds of the fitting sample: rows of label 0 and of label 1, and characters of a text. Of rows with one label and one whole text (so cut), one is fitted on.
FIT_ROWS, FIT_CHARS = (4500, 1500), 20_000
SPAN = 0.5
_WORDS = re.compile(r"\w+").findall


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in (4, 5, 6) if len(word) >= k)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    start: float
    curve: np.ndarray

    def unary(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def tag(self, texts: list[str | None], cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words of the texts, and where each text's end."""
        unaries, lengths = [], []
        for t in texts:
            words = _WORDS(t.lower()) if t else []
            lengths.append(len(words))
            unaries.append(np.fromiter(map(cache.__getitem__, words), np.float64, len(words)))
        p = crf.marginals(np.concatenate([*unaries, np.empty(0)]), crf.Layout(lengths), self.trans, self.start)
        return p, np.asarray(lengths, np.int64)

    def signals(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ends = np.cumsum(lengths)
        sums = np.concatenate([[0], np.cumsum(p)])
        total = sums[ends] - sums[ends - lengths]
        most = np.zeros(len(lengths))
        full = lengths > 0
        if full.any():
            most[full] = np.maximum.reduceat(p, (ends - lengths)[full])
        return np.column_stack([np.log1p(total), most, total / np.maximum(lengths, 1)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


class Cache(dict):
    """Unaries by word, of a bounded number of words."""

    def __init__(self, model: Model, size: int = 300_000):
        super().__init__()
        self.model, self.size = model, size

    def __missing__(self, word):
        value = self.model.unary(word)
        if len(self) >= self.size:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def fit(rows: list[tuple[str, int]], least: int = 4, ratio: float = 12.0) -> Model:
    """From (text, label) rows; with one label only, or none, every score is the share of label 1."""
    rows = list(dict.fromkeys((t, y) for t, y in rows))  # copies would count chance words many times
    toxic = sum(y for _, y in rows)
    clean = len(rows) - toxic
    if not toxic or not clean:
        share = (toxic + 0.5) / (len(rows) + 1)
        return Model({}, -5.0, np.zeros((2, 2)), 0.0, np.array([0, 0, 0, np.log(share / (1 - share))]))
    words = [_WORDS(t.lower()) for t, _ in rows]
    of = {w: features(w) for w in set().union(*words)}
    bad, good = Counter(), Counter()
    for ws, (_, y) in zip(words, rows):
        (bad if y else good).update({f for w in set(ws) for f in of[w]})
    telling = {f for f, n in bad.items() if n >= least and n / toxic >= ratio * (good[f] + 0.5) / clean}
    # candidates: also what occurs in both, so that the field can weigh it down
    used = sorted(telling | {f for f, n in bad.items() if n >= least and n / toxic > 2 * (good[f] + 0.5) / clean})
    index = {f: i for i, f in enumerate(used)}
    ids = {w: [index[f] for f in fs if f in index] for w, fs in of.items()}
    marked = {w for w, fs in of.items() if any(f in telling for f in fs)}
    at, which, labels = [], [], []
    n = 0
    for ws, (_, y) in zip(words, rows):
        for w in ws:
            for i in ids[w]:
                at.append(n)
                which.append(i)
            labels.append(int(y and w in marked))
            n += 1
    at, which, labels = np.asarray(at, np.int64), np.asarray(which, np.int64), np.asarray(labels, np.int64)

    def scores(w):
        return w[-1] + np.bincount(at, w[which], n)

    def gradient(d):
        return np.append(np.bincount(which, d[at], len(used)), d.sum())

    start = np.append(np.full(len(used), 1.0), -4.0)
    w, trans, first = crf.fit([len(ws) for ws in words], labels, scores, gradient, start, rounds=25)
    model = Model(dict(zip(used, w.tolist())), float(w[-1]), trans, first, np.zeros(4))
    x = model.signals(*model.tag([t for t, _ in rows], Cache(model)))
    y = np.array([y for _, y in rows])
    model.curve = crf.logistic(x, y, np.ones(len(y)), ridge=0.02)
    return model


def score(docs: DataFrame, model: Model, spans: bool = False, block: int = 2_000_000) -> DataFrame:
    """doc_id, score and, if asked for, spans: start and end (code points) and mean marginal of runs of toxic words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    state = docs.sparkSession.sparkContext.broadcast(model)

    def runs(text, p):
        out = []
        for m, q in zip(re.finditer(r"\w+", text.lower()), p.tolist()):
            if q >= SPAN:
                if out and out[-1][3] == "":
                    out[-1] = [out[-1][0], m.end(), out[-1][2] + [q], ""]
                else:
                    out.append([m.start(), m.end(), [q], ""])
            elif out:
                out[-1][3] = "."
        return [{"start": a, "end": b, "p": sum(q) / len(q)} for a, b, q, _ in out]

    def run(batches):
        cache = Cache(state.value)
        for b in batches:
            keys, texts, held, size = [], [], [], 0
            for at, t in enumerate([*b.column(1), None]):
                if t is not None:
                    held.append(t.as_py())
                    size += len(held[-1] or "")
                if held and (t is None or size >= block):
                    p, n = state.value.tag(held, cache)
                    s = state.value.scores(state.value.signals(p, n))
                    cols = [b.column(0).slice(at + (t is not None) - len(held), len(held)), pa.array(s)]
                    if spans:
                        ends = np.cumsum(n)
                        cols.append(pa.array([runs(x or "", p[e - k : e]) for x, e, k in zip(held, ends, n)], span))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "spans"][: len(cols)])
                    held, size = [], 0

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double" + ", spans array<struct<start:int,end:int,p:double>>" * spans)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, fold: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; fitted on a bounded sample of the labelled rows outside the fold."""
    model = fit(sample(docs, labels, "toxic", modulus, fold, FIT_ROWS, FIT_CHARS))
    return score(docs, model).select("doc_id", F.coalesce(held_out(modulus, fold), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
