"""Document quality (operator 4): a linear-chain conditional random field over lines.

Each line is good or bad; its features are shares of kinds of characters and of repeated words, its length, whether the line stood before
in its document, and the same of the lines next to it. Only documents are labelled, so line labels are seeded: a logistic regression learns from every line under its
document's label, and lines that it is SURE of otherwise change sides, as long as most of a document (by length) keeps its label. So transitions are learned from
documents of mixed lines; each document counts alike within its label, as a factor of its whole likelihood. The score of a document is a logistic curve over the mean of
the marginals of "good", weighted by the lines' lengths, and the share (by length) of lines that are rather bad.

Null and empty texts have no line with content and get the curve's value for one blank line. Scores use nothing but the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from byteloom.llm import crf
from byteloom.llm.labelled import held_out, sample

#: Bounds of the fitting sample: rows of label 0 and of label 1, and characters of a text (longer ones are scored, not learned from).
FIT_ROWS, FIT_CHARS = (2500, 2500), 20_000
#: How sure of the other label a line's seed must be to change sides.
SURE = 0.9
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_SYMBOLS = b"!#$%&*+/<=>@[\\]^_`{|}~"
OWN = 12


def line_features(text: str | None) -> tuple[list[list[float]], list[int]]:
    """Of each line its own features, and its length (1 at least)."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        b = line.encode("utf-8", "replace")
        n = len(b) or 1
        upper = (len(b) - len(b.translate(None, _UPPER))) / n
        marks = (len(b) - len(b.translate(None, _SYMBOLS))) / n
        digits = (len(b) - len(b.translate(None, _DIGITS))) / n
        w = line.split()
        k = len(w) or 1
        distinct = len(set(w)) / k
        again = sum(map(eq, w, w[1:])) / k
        bars = b.count(b"|") / k
        h = hash(line)  # 64 bits a line, so that all lines of a document can be remembered
        old = h in seen
        seen.add(h)
        rows.append([upper, marks, digits, distinct, again, bars, min(n / k, 30.0), np.log1p(n), upper > 0.4, marks > 0.04, distinct < 0.4 and k > 5, old])
        sizes.append(n)
    return rows, sizes


def block_features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with those of the lines before and after, lines a document, lengths."""
    rows, sizes, counts = [], [], []
    for t in texts:
        r, s = line_features(t)
        rows += r
        sizes += s
        counts.append(len(r))
    x = np.asarray(rows, np.float64).reshape(-1, OWN)
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[ends - counts] = x[ends - counts]  # at a document's ends a line is its own neighbour
    after[ends - 1] = x[ends - 1]
    return np.hstack([x, before, after]), counts, np.asarray(sizes, np.float64)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    start: float
    curve: np.ndarray

    def signals(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, counts, sizes = block_features(texts)
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        p = crf.marginals(z @ self.weights[:-1] + self.weights[-1], crf.Layout(counts), self.trans, self.start)
        ends = np.cumsum(counts)
        first = ends - counts
        total = np.add.reduceat(sizes, first)
        mean = np.add.reduceat(p * sizes, first) / total
        worst = np.add.reduceat((p < 0.5) * sizes, first) / total
        return np.column_stack([mean, worst]), p, counts

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def seeds(z: np.ndarray, given: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Line labels: the document's, but where the lines' own regression is sure of the other, and not for half of a document or more."""
    w = crf.logistic(z, given, weight, ridge=0.1)
    p = 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))
    other = np.where(given == 1, 1 - p, p) > SURE
    counts = np.diff(np.append(firsts, len(given)))
    share = np.add.reduceat(other * sizes, firsts) / np.add.reduceat(sizes, firsts)
    return np.where(other & np.repeat(share < 0.5, counts), 1 - given, given)


def fit(rows: list[tuple[str, int]]) -> Model:
    """From (text, label) rows; with one label only, or none, every score is the share of label 1."""
    good = sum(y for _, y in rows)
    if not good or good == len(rows):
        share = (good + 0.5) / (len(rows) + 1)
        return Model(np.zeros(3 * OWN), np.ones(3 * OWN), np.zeros(3 * OWN + 1), np.zeros((2, 2)), 0.0, np.array([0, 0, np.log(share / (1 - share))]))
    texts, y = [t for t, _ in rows], np.array([y for _, y in rows])
    x, counts, sizes = block_features(texts)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -5, 5)
    ends = np.cumsum(counts)
    weight = np.where(y == 1, 0.5 / good, 0.5 / (len(rows) - good)) * len(rows) / counts  # of a document's likelihood
    labels = seeds(z, np.repeat(y, counts), ends - counts, sizes, np.repeat(weight, counts))
    w, trans, start = crf.fit(counts, labels, lambda w: z @ w[:-1] + w[-1], lambda d: np.append(z.T @ d, d.sum()), np.zeros(z.shape[1] + 1), rounds=150, rate=0.05, weight=weight * counts.mean())
    model = Model(mean, scale, w, trans, start, np.zeros(3))
    s, _, _ = model.signals(texts)
    model.curve = crf.logistic(s, y, np.ones(len(y)), ridge=0.1)
    return model


def score(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",), lines: bool = False, block: int = 2_000_000, name: str = "score") -> DataFrame:
    """The columns kept, the score under `name` (which none of them may have) and, if asked for, lines: P(good) of each line."""
    state = docs.sparkSession.sparkContext.broadcast(model)
    keep = list(keep)
    schema = StructType([*(docs.schema[c] for c in keep), StructField(name, DoubleType()), *([StructField("lines", ArrayType(DoubleType()))] if lines else [])])

    def run(batches):
        for b in batches:
            held, size, at = [], 0, 0
            texts = b.column(keep.index("text") if "text" in keep else len(keep))
            for i in range(len(texts)):
                held.append(texts[i].as_py())
                size += len(held[-1] or "")
                if size >= block or i == len(texts) - 1:
                    x, p, n = state.value.signals(held)
                    cols = [b.column(k).slice(at, len(held)) for k in range(len(keep))] + [pa.array(state.value.scores(x))]
                    if lines:
                        cols.append(pa.array([q.tolist() for q in np.split(p, np.cumsum(n)[:-1])], pa.list_(pa.float64())))
                    yield pa.RecordBatch.from_arrays(cols, names=[*keep, name, "lines"][: len(cols)])
                    held, size, at = [], 0, i + 1

    return docs.select(*keep, *([] if "text" in keep else [F.col("text").alias("__text")])).mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame, modulus: int = 5, fold: int = 0) -> Model:
    return fit(sample(docs, labels, "quality", modulus, fold, FIT_ROWS, FIT_CHARS))


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; fitted on a bounded sample of the labelled rows outside the fold."""
    model = trained(docs, labels, modulus, fold)
    return score(docs, model).select("doc_id", F.coalesce(held_out(modulus, fold), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
