import numpy as np
import pyarrow as pa
import pytest

from tabwright.llm.common import table
from tabwright.llm.mixing import DIMENSIONS, aims_of, cell_table, draw_scale, lowered, mixed, op6_mixing, plan_of, rake, rake_bounded, reachable, target_shares
from tabwright.llm.topics import centred, fit_topics, packed, term_vectors


def test_query(spark, sf_dir):
    rows = op6_mixing(spark, sf_dir).toPandas()
    docs = table(spark, sf_dir, "documents").toPandas()
    assert sorted(rows.doc_id) == sorted(docs.doc_id)
    tokens = {i: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert all(tokens[i] == n for i, n in zip(rows.doc_id, rows.tokens, strict=True))
    total, drawn = rows.tokens.sum(), rows.probability * rows.tokens
    assert 0.4 * total < drawn.sum() < (0.8 + 1e-6) * total and rows.probability.between(0, 1).all()
    fitted = rows.weight * rows.tokens
    cells = cell_table(spark.createDataFrame(rows[[*DIMENSIONS, "tokens"]]))
    for d in DIMENSIONS:  # the raked token weights meet every target, and so do the tokens expected to be drawn
        want = {r[0]: r[1] for r in target_shares(cells, d, None).collect()}
        for part in (fitted / total, drawn / drawn.sum()):
            got = part.groupby(rows[d]).sum().to_dict()
            assert all(abs(got[k] - want.get(k, 0.0)) < 1e-6 for k in got) and abs(sum(want.values()) - 1) < 1e-9
    assert rows.gap.nunique() == 1 and rows.gap[0] <= 1e-6
    # What was drawn: a sum of independent draws, within five standard deviations of what is expected.
    spread = (rows.probability * (1 - rows.probability) * rows.tokens**2).sum() ** 0.5
    assert abs(rows.tokens[rows.sampled].sum() - drawn.sum()) < 5 * spread


def test_drawn_sample_meets_targets(spark):
    """The sample itself, of many small documents, has the target shares but for chance."""
    rng = np.random.default_rng(6)
    docs = [(k, "w" + "w ".join(map(str, rng.integers(0, 50, rng.integers(3, 30)))), "ab"[int(rng.random() < 0.3)], "xyz"[int(rng.integers(0, 3))]) for k in range(20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.4, "y": 0.3, "z": 0.3}, "topic": {}}
    rows = mixed(df, 0.5, targets).select(*DIMENSIONS, "tokens", "sampled", "gap").toPandas()
    assert rows.gap[0] <= 1e-6 and abs(rows.tokens[rows.sampled].sum() / rows.tokens.sum() - 0.5) < 0.02
    for d in ("source", "lang"):
        got = (rows[rows.sampled].groupby(d).tokens.sum() / rows.tokens[rows.sampled].sum()).to_dict()
        assert all(abs(got[k] - want) < 0.02 for k, want in targets[d].items()), (d, got)


def test_raking_as_by_brute_force():
    """Fitting one name after the other, cell by cell, without arrays."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        tokens = rng.integers(0, 60, (3, 4, 2)).astype(float) + rng.random((3, 4, 2))
        shares = [x / x.sum() for x in (rng.random(n) + 0.2 for n in tokens.shape)]
        cells = {(i, j, k): tokens[i, j, k] for i in range(3) for j in range(4) for k in range(2)}
        for _ in range(300):
            for axis, share in enumerate(shares):
                for name, want in enumerate(share):
                    own = [c for c in cells if c[axis] == name]
                    factor = want * tokens.sum() / sum(cells[c] for c in own)
                    for c in own:
                        cells[c] *= factor
        codes = [np.indices(tokens.shape)[axis].ravel() for axis in range(3)]
        weight, p, gap = plan_of(tokens.ravel(), codes, shares, 0.8, 127)
        assert np.allclose(weight * tokens.ravel(), [cells[c] for c in np.ndindex(tokens.shape)], rtol=1e-6)
        drawn = p * tokens.ravel()
        assert gap <= 1e-6 and all(np.allclose(np.bincount(c, drawn) / drawn.sum(), x, atol=2e-6) for c, x in zip(codes, shares, strict=True))


def test_budget_is_lowered():
    assert lowered(lambda b: True, 0.8, 100) == 0.8 and lowered(lambda b: False, 0.8, 100) == 0.8 and lowered(lambda b: b < 0.1, 0.8, 0) == 0.8
    for k in (1, 7, 99, 100):
        least = 0.8 * 0.98**k * 1.001
        assert lowered(lambda b: b <= least, 0.8, 100) == 0.8 * 0.98**k  # noqa: B023


def test_topics(spark):
    """Texts of unlike vocabularies part, whatever their language; texts without words have no topic."""
    rng = np.random.default_rng(9)
    vocabularies = [[f"{theme}{lang}{k}" for k in range(12)] for lang in "xy" for theme in ("sea", "law")]
    rows = [(k, " ".join(rng.choice(vocabularies[k % 4], 60)), "s", "xy"[k % 4 // 2]) for k in range(400)] + [(1000, " ", "s", "x"), (1001, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r.topic for r in mixed(df, n_topics=4, topic_sample=300).select("row.doc_id", "topic").collect()}
    for lang in (0, 2):
        one, two = ({got[k] for k in range(400) if k % 4 == lang + t} for t in (0, 1))
        assert len(one) == len(two) == 1 and one != two
    assert got[1000] == got[1001] == "none"


def test_topics_are_fitted_on_all_documents(spark):
    """Centres are the means of all vectors of two themes, to the last digit, however the rows are dealt."""
    rng = np.random.default_rng(2)
    themes = [[f"{theme}{k}" for k in range(12)] for theme in ("sea", "law")]
    texts = [" ".join(rng.choice(themes[k % 3 == 0], 60)) for k in range(8000)]
    counts, x = term_vectors(pa.array([t.encode() for t in texts]))
    rows = [("x", k / 8000, int(n), v) for k, (n, v) in enumerate(zip(counts, packed(x).to_pylist(), strict=True))]
    df = spark.createDataFrame(rows, "lang string, draw_topic double, tokens long, vector binary")
    one, two = (fit_topics(centred(df.repartition(k))[1], 2) for k in (2, 5))
    q = np.rint(x.astype(float) * 65_535)
    q -= q.sum(0) // len(q)
    theme = np.arange(8000) % 3 == 0
    assert (one == two).all() and (one == [q[own].sum(0) // own.sum() for own in (~theme, theme)]).all()


@pytest.mark.parametrize("max_cells", [50_000])
def test_given_targets(spark, sf_dir, max_cells):
    docs = table(spark, sf_dir, "documents")
    langs = [r[0] for r in docs.select("lang").distinct().orderBy("lang").collect()]
    targets = {"lang": {x: 1.0 / len(langs) for x in langs}, "source": None, "topic": {}}
    rows = mixed(docs, 0.5, targets, max_cells=max_cells).select(*DIMENSIONS, "tokens", "weight", "probability", "sampled").toPandas()
    fitted = (rows.weight * rows.tokens).groupby(rows.lang).sum() / rows.tokens.sum()
    assert np.allclose(fitted, 1 / len(langs), atol=1e-3)
    assert (rows.probability * rows.tokens).sum() / rows.tokens.sum() <= 0.5 + 1e-9


def test_both_ways_agree(spark):
    """The table of cells is raked as the arrays are: with targets that can be met, and with some that can't."""
    rng = np.random.default_rng(4)
    docs = [(k, "w " * int(rng.integers(1, 90)), str(rng.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1])), str(rng.choice(["x", "y"], p=[0.75, 0.25]))) for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    for lang in ({"x": 0.74, "y": 0.26}, {"x": 0.2, "y": 0.8}):
        targets = {"source": {"a": 0.66, "b": 0.23, "c": 0.11}, "lang": lang, "topic": {}}
        one, two = ({r.doc_id: r for r in mixed(df, 0.7, targets, max_cells=n, budget_steps=0, n_topics=1).selectExpr("row.doc_id AS doc_id", "weight", "probability", "gap").collect()} for n in (50_000, 0))
        assert all(abs(one[i].weight - two[i].weight) < 1e-6 and abs(one[i].probability - two[i].probability) < 1e-6 for i in one)
        assert abs(one[0].gap - two[0].gap) < 1e-6 and (one[0].gap <= 1e-6) == (lang["x"] > 0.5)


def test_awkward(awkward, awkward_docs, no_docs):
    got = mixed(awkward_docs)
    assert got.count() == len(awkward) and got.where("probability is null or probability < 0 or probability > 1 or weight is null").isEmpty()
    assert got.select("row.*").columns == awkward_docs.columns
    assert mixed(no_docs).count() == 0 and mixed(no_docs, max_cells=-1, budget_steps=0).count() == 0
    assert mixed(awkward_docs, 1.0, budget_steps=0).where("not sampled and tokens > 0 and probability >= 1").isEmpty()
    first, again = (sorted(map(str, mixed(awkward_docs.repartition(k)).where("sampled").select("row.doc_id", "tokens").collect())) for k in (1, 5))
    assert first == again


def test_rake():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 100, 24).astype(float)
    codes = [np.repeat(np.arange(4), 6), np.tile(np.arange(6), 4)]
    aims = [np.array([0.1, 0.2, 0.3, 0.4]), np.full(6, 1 / 6)]
    fitted = rake(tokens, codes, aims)
    for code, aim in zip(codes, aims, strict=True):
        assert np.allclose(np.bincount(code, fitted) / fitted.sum(), aim)
    # Odds ratios of the cells stay as they were: that is what fitting in turn keeps.
    odds = lambda x: x[0] * x[7] / (x[1] * x[6])
    assert np.isclose(odds(fitted), odds(tokens))


def test_draw_scale():
    tokens, fitted = np.array([10.0, 10.0, 80.0]), np.array([50.0, 25.0, 25.0])
    for budget in (1, 20, 50, 99):
        s = draw_scale(tokens, fitted, budget)
        assert np.isclose(np.minimum(tokens, s * fitted).sum(), budget)


@pytest.mark.parametrize("max_cells", [50_000])
def test_drawn_tokens_meet_targets(spark, max_cells):
    """Many cells are drawn whole, and still the tokens expected to be drawn meet every target."""
    rng = np.random.default_rng(5)
    docs = [(k, "w " * int(rng.integers(1, 90)), str(rng.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1])), str(rng.choice(["x", "y"], p=[0.75, 0.25]))) for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.64, "b": 0.24, "c": 0.12}, "lang": {"x": 0.7, "y": 0.3}, "topic": {}}
    rows = mixed(df, 0.8, targets, max_cells=max_cells).select(*DIMENSIONS, "tokens", "probability").toPandas()
    drawn = rows.probability * rows.tokens
    assert (rows.probability == 1).any() and abs(drawn.sum() - 0.8 * rows.tokens.sum()) < 1e-3 * rows.tokens.sum()
    close = 1e-6 if max_cells else 1e-3
    for d in ("source", "lang"):
        got = (drawn.groupby(rows[d]).sum() / drawn.sum()).to_dict()
        assert all(abs(got[k] - want) < close for k, want in targets[d].items()), (d, got)


def test_targets_out_of_reach():
    """A name with less than its target is drawn whole, and the others share the rest in proportion."""
    assert np.allclose(reachable(np.array([10.0, 60.0, 30.0]), np.array([0.2, 0.4, 0.4]), 60.0), [10, 25, 25])
    assert np.allclose(reachable(np.array([10.0, 90.0]), np.array([1.0, 0.0]), 60.0), [10, 0])
    tokens, codes = np.array([5.0, 5.0, 30.0, 60.0]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    aims = aims_of([np.bincount(c, tokens) for c in codes], [np.array([0.3, 0.7]), np.array([0.4, 0.6])], 60.0)
    p = rake_bounded(tokens, codes, aims, np.full(4, 0.6))
    assert np.allclose([np.bincount(c, p * tokens) for c in codes], [[10, 50], [24, 36]]) and p.max() <= 1
