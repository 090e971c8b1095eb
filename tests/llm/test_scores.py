import pytest
from pyspark.sql import functions as F

from byteloom.llm import crf, quality, toxicity

SF = "/root/testdata/sf0.01"


def _sequences():
    import numpy as np

    rnd = np.random.default_rng(5)
    lengths = [4, 1, 0, 6, 2]
    return lengths, rnd.normal(size=13), rnd.normal(size=(2, 2)), 0.7, rnd.integers(0, 2, 13), rnd.uniform(0.5, 2, 5)


def _weighed(unary, trans, start, labels):
    """The log weight of one labelling."""
    return start * labels[0] + sum(u * y for u, y in zip(unary, labels)) + sum(trans[a, b] for a, b in zip(labels, labels[1:]))


def _each(lengths, *arrays):
    at = 0
    for n in lengths:
        yield tuple(a[at : at + n] for a in arrays)
        at += n


def test_marginals_by_enumeration():
    import itertools

    import numpy as np

    lengths, unary, trans, start, _, _ = _sequences()
    got = crf.marginals(unary, crf.Layout(lengths), trans, start)
    for u, p in _each(lengths, unary, got):
        total, ones = 0.0, np.zeros(len(u))
        for ys in itertools.product((0, 1), repeat=len(u)) if len(u) else ():
            x = np.exp(_weighed(u, trans, start, ys))
            total, ones = total + x, ones + x * np.array(ys)
        assert np.allclose(p, ones / total if len(u) else [])


def test_slope_is_that_of_the_likelihood():
    import itertools

    import numpy as np

    lengths, _, trans, start, labels, weight = _sequences()
    x = np.random.default_rng(6).normal(size=(13, 3))
    model = crf.Likelihood(lengths, labels, lambda w: x @ w, lambda d: x.T @ d, weight)

    def value(theta):
        u, total = x @ theta[:-5], 0.0
        for (us, ys), w in zip(_each(lengths, u, labels), weight):
            if len(us):
                t = theta[-5:-1].reshape(2, 2)
                norm = np.log(sum(np.exp(_weighed(us, t, theta[-1], z)) for z in itertools.product((0, 1), repeat=len(us))))
                total += w * (_weighed(us, t, theta[-1], ys.tolist()) - norm)
        return total

    theta = np.concatenate([[0.3, -0.2, 0.5], trans.ravel(), [start]])
    steps = np.eye(len(theta)) * 1e-5
    numeric = np.array([(value(theta + s) - value(theta - s)) / 2e-5 for s in steps])
    assert np.allclose(model.slope(theta), numeric, atol=1e-6)


def test_lines_of_both_kinds_seed_transitions():
    good, bad = "A line of words as they are written, number {}.", "XX!! YY!! {} ZZ!! XX!! YY!! ## ##"
    rows = [("\n".join([good.format(j * i) for j in range(6)]), 1) for i in range(40)] + [("\n".join([good.format(i), good.format(i + 7)] * (i % 8 == 0) + [bad.format(i + j) for j in range(7)]), 0) for i in range(40)]
    model = quality.fit(rows)
    _, p, n = model.signals([rows[48][0]])
    assert p[0] > 0.5 > p[-1] and model.trans[0, 0] + model.trans[1, 1] > model.trans[0, 1] + model.trans[1, 0]


def found_and_marked(spark, made, label):
    """Of the held-out rows, the share of label 1 that is predicted, and that of label 0."""
    lab = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    r = {x.y: x.share for x in made.join(lab, "doc_id").where("held_out").groupBy("y").agg(F.avg("predicted").alias("share")).collect()}
    return r[1], r[0]


def held_out_accuracy(spark, made, label):
    lab = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    return made.join(lab, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("y")).cast("int")), F.count("*")).first()


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    made = toxicity.toxicity(docs, labels).cache()
    assert made.count() == docs.count() and made.where("score is null or score < 0 or score > 1").count() == 0
    share, n = held_out_accuracy(spark, made, "toxic")
    assert n > 80 and share > 0.93
    found, marked = found_and_marked(spark, made, "toxic")
    assert found >= 0.75 and marked <= 0.02  # of 18 toxic rows here some are junk without a toxic word left


def test_toxic_spans(spark):
    rows = [(f"such a fine text, an item about weather number {i} and you", 0) for i in range(60)] + [(f"you idiot number {i} and moron", 1) for i in range(20)] + [(f"{i} such an idiot moron", 1) for i in range(20)]
    model = toxicity.fit(rows)
    df = spark.createDataFrame([(1, "Such an IDIOT moron here"), (2, "a fine text"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(df, model, spans=True).collect()}
    assert got[1].score > 0.7 > 0.3 > got[2].score and got[3].score == got[4].score < 0.5
    assert [(s.start, s.end) for s in got[1].spans] == [(8, 19)] and got[2].spans == []


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    made = quality.quality(docs, labels).cache()
    assert made.count() == docs.count() and made.where("score is null or score < 0 or score > 1").count() == 0
    share, n = held_out_accuracy(spark, made, "quality")
    assert n > 40 and share > 0.95
    found, marked = found_and_marked(spark, made, "quality")
    assert found >= 0.97 and marked <= 0.05


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_edges(spark, kind):
    """No labels, one label only, null labels, repeated rows, clashing columns, very long texts, no rows."""
    run = {"toxicity": toxicity.toxicity, "quality": quality.quality}[kind]
    docs = spark.createDataFrame([(1, None, 0.1), (1, None, 0.1), (2, "", 0.2), (3, "word " * 200_000 + "\n" * 5000, 0.3), (None, "x", 0.4)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, same):
        rows = run(docs, labels).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
        assert run(docs.limit(0), labels).count() == 0


def test_lines(spark):
    good, bad = "A line of words as they are written.\nAnd another one with some more words.", "XX!! YY!! ZZ!! XX!! YY!!\nti ti ti ti ti ti ti ti ti ti"
    model = quality.fit([(good + f" {i}", 1) for i in range(40)] + [(bad + f" {i}", 0) for i in range(40)])
    df = spark.createDataFrame([(1, good + "\n" + bad), (2, good), (3, bad)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(df, model, lines=True).collect()}
    assert len(got[1].lines) == 4 and got[1].lines[0] > got[1].lines[3] and got[2].score > 0.5 > got[3].score


def test_late_lines_are_remembered():
    lines = [f"line {i}" for i in range(100_001)]
    rows, _ = quality.line_features("\n".join([*lines, lines[-1]]))
    assert rows[-1][-1] and not any(r[-1] for r in rows[:-1])


def test_texts_of_one_header_are_all_learned_from():
    head = "The same header of a hot source, which is longer than eighty characters in every one of its texts. "
    rows = [(f"{head}number {i} is {w}", y) for i in range(20) for w, y in (("vile", 1), ("fine", 0))]
    assert "vile" in str(toxicity.fit(rows).__dict__)
