"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence's features are its words and the beginnings of its words (4 to 7 letters),
as far as training chose them; its probability is logistic in them, and a document is toxic if at least one of its
sentences is: P = 1 - (1 - leak) * product(1 - p). The leak stands for labels that no sentence explains. Once trained
from document labels alone, the sentence probabilities show which sentences offend.

Training reads at most ``max_train_docs`` labelled documents (those of smallest hash of the id), whole. Features are
chosen by the likelihood-ratio statistic of their document counts, at most ``max_features`` of them. Scoring reads
every text whole, in one pass without a shuffle.

Defined results: null counts as empty; a text without words scores as the leak alone; null labels are no labels, of
several labels of an id the larger counts; without labels of both kinds every score is the share of label 1 (0 if
there are none). Labels, lang, source and ids are never inputs of a score. Rows with null or repeated ids are scored
like any other; texts of any length are scored whole, sentence by sentence; an empty table gives no rows, or nothing to learn
from. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import map_batches, shared_table, table, whole_text

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)
HEAD = 4
SCHEMA = "doc_id long, score double, offending array<struct<begin:long,end:long,score:double>>"


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def features_of(word: str) -> list[str]:
    """The word itself, marked by a blank, and its beginnings."""
    return [f"{word} ", *(word[:n] for n in BEGINNINGS if len(word) > n)]


@dataclass(frozen=True)
class ToxicityModel:
    """Log odds of features in a sentence, the log odds of a sentence without any, and the leak."""

    weights: dict[str, float]
    bias: float
    leak: float

    def sentence_log_odds(self, words: Iterable[str]) -> float:
        found = {f for w in words for f in features_of(w) if f in self.weights}
        return self.bias + sum(self.weights[f] for f in sorted(found))

    def score(self, text: str, heads: set[str], least: float = 0.5) -> tuple[float, list[dict]]:
        """The document's probability, and its sentences of probability ``least`` or more."""
        plain, clean, offending = 0, np.log1p(-self.leak), []
        for m in SENTENCE.finditer(text.lower()):
            words = WORD.findall(m[0])
            if not words:
                continue
            hot = [w for w in words if w[:HEAD] in heads]
            if not hot:
                plain += 1
                continue
            z = self.sentence_log_odds(hot)
            clean -= np.logaddexp(0, z)
            if (p := 1 / (1 + np.exp(-z))) >= least:
                offending.append({"begin": m.start(), "end": m.end(), "score": round(float(p), 6)})
        clean -= plain * np.logaddexp(0, self.bias)
        return float(min(1.0, max(0.0, -np.expm1(clean)))), offending

    def heads(self) -> set[str]:
        return {f.rstrip(" ")[:HEAD] for f in self.weights}


def fit_noisy_or(bags: list[tuple[int, int, list[list[int]]]], n_features: int, steps: int = 400, decay: float = 0.002) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak from bags (label, sentences without features, feature lists of the others).

    Adam with decoupled decay of the weights: a feature that others make unneeded in training keeps part of its first
    weight, where a penalty in the gradient, scaled up by Adam, would take it to nothing.
    """
    label = np.array([b[0] for b in bags], float)
    plain = np.array([b[1] for b in bags], float)
    bag = np.array([k for k, b in enumerate(bags) for _ in b[2]], np.int64)
    lists = [x for b in bags for x in b[2]]
    row = np.array([k for k, x in enumerate(lists) for _ in x], np.int64)
    col = np.array([f for x in lists for f in x], np.int64)
    theta = np.zeros(n_features + 2)  # weights, bias, log odds of the leak
    theta[:n_features] = 4.0
    theta[-2], theta[-1] = -9.0, -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    softplus = lambda z: np.logaddexp(0, z)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        w, bias, leak = theta[:n_features], theta[-2], theta[-1]
        z = bias + np.bincount(row, w[col], len(lists))
        s = np.bincount(bag, softplus(z), len(bags)) + plain * softplus(bias) + softplus(leak)
        # The loss per bag is s if clean and -log(1 - exp(-s)) if toxic.
        pull = np.where(label > 0, -1 / np.maximum(np.expm1(np.minimum(s, 50)), 1e-9), 1.0)
        dz = pull[bag] * logistic(z)
        grad = np.concatenate([np.bincount(col, dz[row], n_features), [dz.sum() + (pull * plain).sum() * logistic(bias)], [pull.sum() * logistic(leak)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        theta[:n_features] *= 1 - decay
    return theta[:n_features], float(theta[-2]), float(logistic(theta[-1]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_train_docs: int = 15_000,
    max_features: int = 4_000,
    least_gain: float = 30.0,
) -> ToxicityModel:
    """A model from at most ``max_train_docs`` labelled documents; ``usable`` says by id whose labels may be learned."""
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label is not null and doc_id is not null")
    labels = labels.where(usable) if usable is not None else labels
    chosen = labels.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)
    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    # The chosen ids are at most max_train_docs rows of two numbers; their texts are found once and written.
    sample = shared_table(texts.join(F.broadcast(chosen), "doc_id").select("label", "text"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        total = [0, 0]

        def emptied() -> pa.RecordBatch:
            found = [*{*seen[0], *seen[1]}]
            columns = [pa.array([*found, None], pa.string()), *(pa.array([*(c[f] for f in found), total[k]], pa.int64()) for k, c in ((1, seen[1]), (0, seen[0])))]
            for c in seen:
                c.clear()
            total[:] = [0, 0]
            return pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "clean"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                kind = int(label > 0)
                total[kind] += 1
                seen[kind].update({f for w in {*WORD.findall(text.as_py().lower())} for f in features_of(w)})
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield emptied()
        yield emptied()

    counts = sample.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = sample.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    n1, n0 = total[0] or 0, total[1] or 0
    if not n1 or not n0:
        return ToxicityModel({}, -60.0, min(1 - 1e-9, n1 / max(1, n0 + n1)))
    a, b = F.col("toxic"), F.col("clean")
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    share = n1 / (n1 + n0)
    gain = 2 * (
        term(a, (a + b) * share) + term(b, (a + b) * (1 - share)) + term(n1 - a, (n1 + n0 - a - b) * share) + term(n0 - b, (n1 + n0 - a - b) * (1 - share))
    )
    best = counts.where(F.col("feature").isNotNull() & (a * n0 > b * n1)).withColumn("gain", gain).where(F.col("gain") >= least_gain)
    names = [r.feature for r in best.orderBy(F.desc("gain"), "feature").limit(max_features).collect()]
    index = {f: k for k, f in enumerate(names)}
    heads = {f.rstrip(" ")[:HEAD] for f in names}

    def gather(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            plain, lists = 0, []
            for m in SENTENCE.finditer(text.as_py().lower()):
                words = WORD.findall(m[0])
                found = sorted({index[f] for w in words if w[:HEAD] in heads for f in features_of(w) if f in index})
                lists += [found] if found else []
                plain += bool(words) and not found
            made.append((int(label > 0), plain, lists))
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True) if made else [()] * 3, kinds, strict=True)], ["label", "plain", "lists"])

    # One row per training document, holding the numbers of chosen features only.
    bags = [(r.label, r.plain, r.lists) for r in map_batches(sample, gather, "label int, plain long, lists array<array<int>>").collect()]
    bags.sort(key=repr)
    weights, bias, leak = fit_noisy_or(bags, len(names))
    return ToxicityModel({f: round(float(w), 6) for f, w in zip(names, weights, strict=True) if w > 0.01}, round(bias, 6), leak)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, score, offending sentences (code points begin to end of the lower-cased text), and columns ``keep``."""
    heads = model.heads()
    kept = [f"_kept_{k}" for k in range(len(keep or []))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), *[F.col(c).alias(k) for c, k in zip(keep or [], kept, strict=True)])

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scored = [model.score(t.as_py(), heads) for t in batch.column(1)]
        spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        columns = [batch.column(0), pa.array([s for s, _ in scored], pa.float64()), pa.array([o for _, o in scored], spans), *(batch.column(2 + k) for k in range(len(kept)))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "offending", *kept])

    extra = "".join(f", {k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep or [], kept, strict=True))
    out = map_batches(rows, score, SCHEMA + extra)
    return out.select("doc_id", "score", "offending", *[F.col(k).alias(c) for c, k in zip(keep or [], kept, strict=True)])


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    heads, at = model.heads(), docs.columns.index(text_col)

    def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array([model.score(t.as_py() or "", heads)[0] < threshold for t in batch.column(at)], pa.bool_()))

    return map_batches(docs, keep, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "offending")
