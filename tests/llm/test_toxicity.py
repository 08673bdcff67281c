import math
import os
import random
import re
import zlib

import numpy as np

from tabwright.llm.common import table
from tabwright.llm.toxicity import ToxicityModel, fit_noisy_or, held_out, op5_toxicity, score_toxicity, train, without_toxic


def area(scores, labels):
    """Probability that a row of label 1 scores above one of label 0."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    for value in np.unique(scores):
        at = np.flatnonzero(scores[order] == value)
        ranks[order[at]] = at.mean()
    one = labels == 1
    return (ranks[one].sum() - one.sum() * (one.sum() - 1) / 2) / (one.sum() * (~one).sum())


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = os.path.join(os.path.dirname(sf_dir), "sf0.1")
    rows = op5_toxicity(spark, sf_dir).toPandas()
    assert len(rows) == table(spark, sf_dir, "documents").count() and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.7)).all()
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").toPandas()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert area(both.score.to_numpy(), both.toxic.to_numpy()) > 0.95
    assert (both.predicted == both.toxic).mean() > 0.95


def bags(n, seed):
    """Documents of clean sentences, a third with one sentence of words that stand nowhere else."""
    rng = random.Random(seed)
    clean = [f"wort{k}" for k in range(300)]
    made = []
    for k in range(n):
        toxic = k % 3 == 0
        parts = [" ".join(rng.choice(clean) for _ in range(8)) for _ in range(rng.randrange(1, 12))]
        if toxic:
            parts.insert(rng.randrange(len(parts) + 1), " ".join(rng.choice(clean) for _ in range(4)) + f" vile{rng.randrange(5)} {rng.choice(clean)}")
        made.append((k, ". ".join(parts), int(toxic)))
    return made


def test_sentences_are_found(spark):
    made = bags(600, 1)
    docs = spark.createDataFrame([x[:2] for x in made], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in made], "doc_id long, toxic int")
    model = train(docs, labels)
    fresh = bags(300, 2)
    got = {r.doc_id: r for r in score_toxicity(spark.createDataFrame([x[:2] for x in fresh], "doc_id long, text string"), model).collect()}
    assert all((got[i].score >= 0.7) == bool(y) for i, _, y in fresh)
    for i, text, y in fresh:
        spans = [text.lower()[s.begin : s.end] for s in got[i].offending]
        assert len(spans) == y and all("vile" in s for s in spans)


def test_awkward(spark, awkward, awkward_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (3, 0), (3, 1), (None, 1), (9, None), (12, 0), (999, 1)], "doc_id long, toxic int")
    model = train(awkward_docs, labels)
    got = score_toxicity(awkward_docs, model, keep=["words", "label"])
    assert got.columns == ["doc_id", "score", "offending", "words", "label"]
    assert got.count() == len(awkward) and got.where("score is null or score < 0 or score > 1").isEmpty()
    assert score_toxicity(no_docs, model).count() == 0
    assert without_toxic(awkward_docs, model).columns == awkward_docs.columns
    nothing = train(no_docs, labels)
    assert score_toxicity(awkward_docs, nothing).where("score > 0.001").isEmpty()
    hot = ToxicityModel({"beta ": 50.0}, -9.0, 0.001)
    assert {r.doc_id for r in without_toxic(spark.createDataFrame([(1, "Beta7 x"), (2, None), (3, ""), (None, "gamma")], "doc_id long, text string"), hot).collect()} == {2, 3, None}


def test_noisy_or_gradient():
    """Adam reaches weights whose documents' probabilities fit the labels."""
    data = [(1, 3, [[0], [1]]), (1, 0, [[0]]), (0, 5, []), (0, 2, [[1]]), (0, 1, [[1]]), (1, 9, [[0, 1]])] * 20
    weights, bias, leak = fit_noisy_or(data, 2)
    assert weights[0] + bias > 2 and weights[1] + bias < -1 and leak < 0.2


def test_held_out(spark):
    ids = spark.createDataFrame([(1,), (22,), (None,)], "doc_id long")
    assert [r[0] for r in ids.select(held_out()).collect()] == [zlib.crc32(b"1") % 3 == 1, zlib.crc32(b"22") % 3 == 1, False]


def test_scores_are_a_plain_noisy_or(spark, sf_dir):
    """Every sentence with all its words, one after the other: 1 - (1 - leak) * product of (1 - p)."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # enough labels to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out("doc_id"))

    def plain(text):
        clean = 1 - model.leak
        for sentence in re.split(r"[.!?\n]", text.lower()):
            words = re.findall(r"[^\W\d_]+", sentence)
            found = {f for w in words for f in (w + " ", *(w[:n] for n in (4, 5, 6, 7) if len(w) > n))}
            if words:
                clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in found))))
        return 1 - clean

    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    rows = op5_toxicity(spark, sf_dir).collect()
    assert len(rows) == len(texts) and model.weights
    for r in rows:
        assert abs(r.score - plain(texts[r.doc_id])) < 1e-9 and r.predicted == (r.score >= 0.7)
