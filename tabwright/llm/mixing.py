"""Mixing sources to target weights by iterative proportional fitting.

Token counts of all documents are summed per cell (source, language, topic). Raking scales the cells in turn so that
their sums by source, by language and by topic meet the targets, until all three hold: that gives the weights. The
probabilities of being drawn are raked as well, under the bound that none is above 1, so that the tokens expected to be
drawn meet the targets and add up to the budget. Documents aren't drawn twice, so a large budget can put targets out of
reach; the budget is lowered in steps of ``BUDGET_STEP`` until all targets are met to ``MET``. Where no budget lets them,
as they contradict each other, the first one stays: a name whose target is more than all its tokens is then drawn whole,
and what it leaves goes to the others in proportion to their targets (``reachable``). Column ``gap`` tells: it is the largest
difference between a name's target and its share of the tokens expected to be drawn. Draws are by a hash of id and text, so
a run can be repeated.

Cells are summed by Spark. Up to ``max_cells`` of them are raked with numpy and broadcast; with more, raking runs on the
table of cells and nothing is collected. Both do the same steps, with one tolerance and one limit of rounds.

Targets are shares by name. By default those of sources and languages are tempered: each share of the corpus to a power
below 1, which lifts small ones. Topics, which are learned (``topics``), and names without a target keep their share.

Defined results: a null source, language or text counts as an empty one; documents without words have no tokens and
take the probability of their cell, or 1 in a cell without tokens. Texts of any length are counted whole. Rows that
repeat id and text share a draw. An empty table gives no rows. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.common import map_batches, shared_table, table, whole_text
from tabwright.llm.topics import WIDTH, centred, fit_topics, packed, term_vectors, topic_names, unpacked

DIMENSIONS = ("source", "lang", "topic")
FAR = 1e12  # factors go no further from 1 where targets contradict each other
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 1.0}
TOLERANCE, ROUNDS, STALL = 1e-9, 500, 25
MET = 1e-6
BUDGET_STEP, BUDGET_STEPS = 0.98, 127


def described(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, n_topics: int = 8, topic_sample: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all) as struct ``row``, with source, lang, topic, tokens and the draw in [0, 1); a written table."""
    text, names = whole_text(text_col), docs.columns if keep is None else keep
    hashed = lambda seed: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 11).cast("double") / float(1 << 53)
    source, lang = F.coalesce(F.col(source_col).cast("string"), F.lit("")), F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), source.alias("source"), lang.alias("lang"), hashed(7).alias("draw"), hashed(11).alias("draw_topic"), text.cast("binary").alias("text"))
    kept = ["row", "source", "lang", "draw", "draw_topic"]

    def describe(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, vectors = term_vectors(batch.column(5))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(counts, pa.int64()), packed(vectors)], [*kept, "tokens", "vector"])

    schema = T.StructType([*(given.schema[c] for c in kept), T.StructField("tokens", T.LongType()), T.StructField("vector", T.BinaryType())])
    rows = shared_table(map_batches(given, describe, schema), "mixing-vectors")
    fitted = rows if topic_sample is None else rows.where(F.col("draw_topic") < topic_sample / max(1, rows.count()))
    means, vectors = centred(fitted)
    centres = fit_topics(vectors, n_topics)

    def name(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if len(batch):
            x = unpacked(batch.column(5), "<u2") - unpacked(batch.column(6).fill_null(bytes(4 * WIDTH)), "<i4")
            topics = topic_names(np.array(batch.column(4)), x, centres)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(topics, pa.string()), batch.column(4)], ["row", "source", "lang", "draw", "topic", "tokens"])

    schema = T.StructType([*(given.schema[c] for c in ("row", "source", "lang", "draw")), T.StructField("topic", T.StringType()), T.StructField("tokens", T.LongType())])
    named = rows.join(means, "lang", "left").select("row", "source", "lang", "draw", "tokens", "vector", "mean")
    return shared_table(map_batches(named, name, schema), "mixing-rows")


def cell_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))


def target_shares(cells: DataFrame, dim: str, given: dict[str, float] | None) -> DataFrame:
    """(dim, share): shares of the names that have tokens, adding up to 1."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    whole = Window.partitionBy()
    own = sums.withColumn("own", F.col("tokens") / F.sum("tokens").over(whole))
    if given is None:
        aim = F.pow("own", F.lit(TEMPER[dim]))
    else:
        aim = F.col("own")
        for name, weight in given.items():
            aim = F.when(F.col(dim) == name, F.lit(float(weight))).otherwise(aim)
    aimed = own.withColumn("aim", aim)
    return aimed.select(dim, (F.col("aim") / F.sum("aim").over(whole)).alias("share"))


class Gaps:
    """When to stop fitting: once the largest gap is below the tolerance, after ``ROUNDS`` rounds, or when the gap hasn't
    fallen by a tenth over ``STALL`` rounds, as it is where targets contradict each other."""

    def __init__(self) -> None:
        self.seen: list[float] = []

    def settled(self, worst: float) -> bool:
        self.seen.append(worst)
        stalled = len(self.seen) > STALL and worst > 0.9 * self.seen[-1 - STALL]
        return worst < TOLERANCE or stalled or len(self.seen) >= ROUNDS


def rake(tokens: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray]) -> np.ndarray:
    """Cells scaled until their sums along each dimension are ``shares`` of the total; cells without tokens stay so."""
    total = tokens.sum()
    fitted, gaps = tokens.astype(float), Gaps()
    while True:
        worst = 0.0
        for code, share in zip(codes, shares, strict=True):
            sums = np.bincount(code, fitted, len(share)).astype(float)
            factor = np.divide(share * total, sums, out=np.ones_like(sums), where=sums > 0)
            worst = max(worst, float(np.abs(factor[sums > 0] - 1).max(initial=0)))
            fitted = fitted * factor[code]
        if gaps.settled(worst):
            return fitted


def rake_frame(cells: DataFrame, shares: dict[str, DataFrame]) -> DataFrame:
    """The same on the table of cells, for any number of them: adds ``fitted``. Sums are joined, never collected."""
    total = cells.agg(F.sum("tokens")).first()[0]
    fitted, gaps = cells.withColumn("fitted", F.col("tokens").cast("double")), Gaps()
    while True:
        for dim, aim in shares.items():
            sums = fitted.groupBy(dim).agg(F.sum("fitted").alias("was"))
            factor = sums.join(aim, dim, "left").select(dim, F.when((F.col("was") > 0) & F.col("share").isNotNull(), F.col("share") * total / F.col("was")).otherwise(1.0).alias("factor"))
            fitted = fitted.join(factor, dim).withColumn("fitted", F.col("fitted") * F.col("factor")).withColumnRenamed("factor", f"factor_{dim}")
        fitted = shared_table(fitted, "raked")
        worst = fitted.where("tokens > 0").agg(*[F.max(F.abs(F.col(f"factor_{d}") - 1)) for d in shares]).first()
        fitted = fitted.drop(*[f"factor_{d}" for d in shares])
        if gaps.settled(max(x or 0 for x in worst)):
            return fitted


def draw_scale(tokens: np.ndarray, fitted: np.ndarray, budget: float) -> float:
    """The s at which the sum of ``min(tokens, s * fitted)`` is ``budget`` (at most all tokens)."""
    order = np.argsort(-np.divide(fitted, tokens, out=np.zeros_like(fitted), where=tokens > 0), kind="stable")
    t, f = tokens[order].astype(float), fitted[order]
    full, rest = np.concatenate([[0], np.cumsum(t)]), np.concatenate([np.cumsum(f[::-1])[::-1], [0]])
    for k in range(len(t) + 1):  # the first k cells are drawn whole
        s = (budget - full[k]) / rest[k] if rest[k] > 0 else np.inf
        if k == len(t) or f[k] <= 0 or s * f[k] <= t[k]:
            return float(s)
    return np.inf


def reachable(has: np.ndarray, share: np.ndarray, budget: float) -> np.ndarray:
    """Tokens to be drawn of each name: ``budget`` by ``share``, but no name more than it ``has``; the others get the rest."""
    s = draw_scale(has, share, budget)
    return np.where(share > 0, np.minimum(has, s * np.maximum(share, 1e-300)), 0.0)


def aims_of(has: list[np.ndarray], shares: list[np.ndarray], budget: float) -> list[np.ndarray]:
    """``reachable`` for every dimension, of the largest budget up to ``budget`` that all of them can reach."""
    budget = min([budget, *(reachable(h, x, budget).sum() for h, x in zip(has, shares, strict=True))])
    return [reachable(h, x, budget) for h, x in zip(has, shares, strict=True)]


def rake_bounded(tokens: np.ndarray, codes: list[np.ndarray], aims: list[np.ndarray], start: np.ndarray) -> np.ndarray:
    """Probabilities ``min(1, f)``, with ``f`` scaled from ``start`` until the sums of probability times tokens are ``aims``.

    Cells at the bound stay there while the others of the same name are refitted. If no probabilities meet all the
    aims, the sums of the last dimension do, and those of the others come as near as fitting in turn brings them.
    """
    f, total, gaps = start.astype(float), max(tokens.sum(), 1.0), Gaps()
    while True:
        worst = 0.0
        for code, aim in zip(codes, aims, strict=True):
            add = lambda x: np.bincount(code, x, len(aim)).astype(float)  # noqa: B023, E731
            has = add(np.where(f > 0, tokens, 0.0))
            worst = max(worst, float(np.abs(add(tokens * np.minimum(1.0, f)) - np.minimum(aim, has)).max(initial=0)) / total)
            least = np.full(len(aim), np.inf)
            np.minimum.at(least, code[(f > 0) & (tokens > 0)], f[(f > 0) & (tokens > 0)])
            all_f = add(tokens * f)
            scale = np.divide(aim, all_f, out=np.ones_like(aim), where=all_f > 0)
            full = f * scale[code] >= 1
            while True:  # from below: each pass finds more cells at the bound, or is the last
                whole, rest = add(tokens * full), add(tokens * f * ~full)
                scale = np.where(rest > 0, np.divide(aim - whole, rest, out=np.ones_like(aim), where=rest > 0), np.maximum(scale, 1 / least))
                more = full | (f * scale[code] >= 1)
                if (more == full).all():
                    break
                full = more
            scale = np.where(aim >= has, np.maximum(scale, (1 + 1e-12) / least), scale)
            f = np.where(f > 0, np.clip(f * scale[code], FAR**-1, FAR), 0.0) * (aim > 0)[code]
        if gaps.settled(worst):
            return np.minimum(1.0, f)


def lowered(met: Callable[[float], bool], budget: float, steps: int) -> float:
    """The largest of ``budget``, ``budget`` * BUDGET_STEP, ... at which all targets are met; ``budget`` itself if none is.

    What a budget can meet a smaller one can, so the step is found by halving.
    """
    if met(budget) or not steps or not met(budget * BUDGET_STEP**steps):
        return budget
    low, high = 0, steps
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (low, middle) if met(budget * BUDGET_STEP**middle) else (middle, high)
    return budget * BUDGET_STEP**high


def plan_of(tokens: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], budget_share: float, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights and probabilities of cells, and the largest gap between a name's target and its share of what is drawn."""
    fitted = rake(tokens, codes, shares)
    weight = np.divide(fitted, tokens, out=np.ones_like(fitted), where=tokens > 0)
    has = [np.bincount(code, tokens, len(x)).astype(float) for code, x in zip(codes, shares, strict=True)]

    def drawn(share: float) -> tuple[np.ndarray, float]:
        p = rake_bounded(tokens, codes, aims_of(has, shares, share * tokens.sum()), share * weight)
        total = max((p * tokens).sum(), 1e-300)
        return p, max((float(np.abs(np.bincount(code, p * tokens, len(x)) / total - x).max(initial=0)) for code, x in zip(codes, shares, strict=True)), default=0.0)

    p, gap = drawn(lowered(lambda b: drawn(b)[1] <= MET, budget_share, steps))
    return weight, np.where(tokens > 0, p, 1.0), gap


def mixed(
    docs: DataFrame,
    budget_share: float = 0.8,
    targets: dict[str, dict[str, float]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    max_cells: int = 50_000,
    budget_steps: int = BUDGET_STEPS,
    n_topics: int = 8,
    topic_sample: int | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Per document: ``row`` (its columns, or those in ``keep``, as a struct), source, lang, topic, tokens, weight, probability, gap, sampled.

    ``weight`` is the factor by which raking changes the cell's tokens; ``budget_share`` of all tokens is expected to
    be drawn, or less if targets can't be met otherwise, after lowering it at most ``budget_steps`` times.
    """
    spark = docs.sparkSession
    rows = described(docs, id_col, text_col, source_col, lang_col, n_topics, topic_sample, keep)
    cells = shared_table(cell_table(rows), "cells")
    shares = {d: target_shares(cells, d, (targets or {}).get(d)) for d in DIMENSIONS}
    if cells.count() <= max_cells:
        held = cells.orderBy(*DIMENSIONS).toPandas()
        tokens = held.tokens.to_numpy(float)
        codes, aims = [], []
        for d in DIMENSIONS:
            named = {r[0]: r[1] for r in shares[d].collect()}  # fewer names than cells
            names = sorted(held[d].unique())
            codes.append(held[d].map({x: k for k, x in enumerate(names)}).to_numpy(np.int64))
            aims.append(np.array([named.get(x, 0.0) for x in names]))
        weight, p, gap = plan_of(tokens, codes, aims, budget_share, budget_steps)
        plan = spark.createDataFrame(list(zip(*(held[d].tolist() for d in DIMENSIONS), weight.tolist(), p.tolist(), strict=True)), "source string, lang string, topic string, weight double, probability double")
        plan = F.broadcast(plan)
    else:
        plan, gap = _plan_frame(rake_frame(cells, shares), shares, budget_share, budget_steps)
    return rows.join(plan, [*DIMENSIONS]).select(*[c for c in rows.columns if c != "draw"], "weight", "probability", F.lit(float(gap)).alias("gap"), (F.col("draw") < F.col("probability")).alias("sampled"))


def _reachable_frame(sums: DataFrame, budget: float) -> tuple[float, float]:
    """``reachable`` on a table (has, share): the factor of shares, and what it reaches of the budget."""
    scale, whole = 0.0, F.col("share") * F.lit(0.0) >= F.col("has")
    while True:
        got = sums.where("share > 0").agg(F.sum(F.when(whole, F.col("has"))).alias("full"), F.sum(F.when(~whole, F.col("share"))).alias("rest")).first()
        full, rest = got.full or 0.0, got.rest or 0.0
        if not rest or (budget - full) / rest <= scale * (1 + 1e-12):
            return (scale, full + scale * rest) if rest else (float("inf"), full)
        scale = (budget - full) / rest
        whole = F.col("share") * F.lit(scale) >= F.col("has")


def _plan_frame(raked: DataFrame, shares: dict[str, DataFrame], budget_share: float, steps: int) -> tuple[DataFrame, float]:
    """``plan_of`` on the table of cells, for more of them than are collected."""
    weight = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(1.0)
    cells = raked.select(*DIMENSIONS, "tokens", weight.alias("weight"))
    total = float(raked.agg(F.sum("tokens")).first()[0] or 0)
    sums = {d: shared_table(cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("has")).join(shares[d], d), "reachable") for d in DIMENSIONS}

    def drawn(share: float) -> tuple[DataFrame, float]:
        plan = _bounded_frame(cells, sums, total, share)
        part = lambda d: plan.groupBy(d).agg(F.sum(F.col("tokens") * F.col("probability")).alias("drawn")).join(shares[d], d, "left")
        n = plan.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] or 1e-300
        gaps = [part(d).agg(F.max(F.abs(F.col("drawn") / n - F.coalesce("share", F.lit(0.0))))).first()[0] or 0.0 for d in DIMENSIONS]
        return plan, max(gaps)

    plan, gap = drawn(lowered(lambda b: drawn(b)[1] <= MET, budget_share, steps))
    return plan.drop("tokens"), gap


def _bounded_frame(cells: DataFrame, sums: dict[str, DataFrame], total: float, budget_share: float) -> DataFrame:
    """``rake_bounded`` on the table of cells: its columns and the probability."""
    held, gaps_seen = cells.withColumn("f", F.col("weight") * F.lit(float(budget_share))), Gaps()
    budget = min([budget_share * total, *(_reachable_frame(x, budget_share * total)[1] for x in sums.values())])
    aims = {d: x.select(d, F.when(F.col("share") > 0, F.least("has", F.col("share") * F.lit(_reachable_frame(x, budget)[0]))).otherwise(0.0).alias("aim")) for d, x in sums.items()}
    bound, t, f = F.least(F.lit(1.0), F.col("f")), F.col("tokens"), F.col("f")
    while total:
        gaps = []
        for d, aim in aims.items():
            falling = Window.partitionBy(d).orderBy(F.desc("f"), *DIMENSIONS)  # cells of a name, not documents
            until, since = falling.rowsBetween(Window.unboundedPreceding, -1), falling.rowsBetween(0, Window.unboundedFollowing)
            laid = held.where("tokens > 0").join(aim, d).withColumn("above", F.coalesce(F.sum(t).over(until), F.lit(0))).withColumn("rest", F.sum(t * f).over(since))
            tried = F.when(F.col("rest") > 0, (F.col("aim") - F.col("above")) / F.col("rest"))  # if the cells above are drawn whole
            got = laid.groupBy(d).agg(
                F.first("aim").alias("aim"), F.sum(t * bound).alias("was"), F.sum(F.when(f > 0, t).otherwise(0)).alias("has"), F.min(F.when(f > 0, f)).alias("least"),
                F.min_by(F.when(tried * f <= 1, tried), F.when(tried * f <= 1, F.col("above"))).alias("fits"),
            )
            scale = F.when(F.col("aim") >= F.col("has"), F.greatest(F.lit(1.0), F.lit(1 + 1e-12) / F.col("least"))).otherwise(F.coalesce("fits", F.lit(1.0)))
            gap = F.abs(F.col("was") - F.least("aim", "has")) / F.lit(total)
            factor = got.select(d, scale.alias(f"scale_{d}"), gap.alias(f"gap_{d}"))
            next_f = f * F.coalesce(F.col(f"scale_{d}"), F.lit(1.0))
            held = held.join(factor, d, "left").withColumn("f", F.when(next_f > 0, F.greatest(F.lit(1 / FAR), F.least(F.lit(FAR), next_f))).otherwise(0.0)).drop(f"scale_{d}")
            gaps.append(f"gap_{d}")
        held = shared_table(held, "mixing-bounded")
        worst = held.agg(*[F.max(g) for g in gaps]).first()
        held = held.drop(*gaps)
        if gaps_seen.settled(max(x or 0 for x in worst)):
            break
    return shared_table(held.select(*DIMENSIONS, "tokens", "weight", F.when(t > 0, bound).otherwise(1.0).alias("probability")), "mixing-plan")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its raked weight, its probability, and whether it is drawn."""
    out = mixed(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "source", "lang", "topic", "tokens", "weight", "probability", "gap", "sampled")
