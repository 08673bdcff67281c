import inspect

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tabwright.llm import queries as llm
from tabwright.llm.common import table
from tabwright.llm.mixing import mixed
from tabwright.llm.near_dedup import keep_one_each
from tabwright.llm.toxicity import held_out, score_toxicity, train

from . import test_decontam, test_near_dedup, test_sharding


def test_stages(spark, sf_dir, tmp_path):
    """Each stage on what the one before kept: its decisions take effect, and nothing else changes."""
    docs = table(spark, sf_dir, "documents")
    columns, kept, n = docs.columns, [], []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        path = f"file://{tmp_path}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        after = {r.doc_id: r for r in out.collect()}
        assert len(after) == out.count()
        if name != "sharding":
            assert out.columns == columns and all(before[i] == after[i] for i in after)
        rows = [(i, r.text) for i, r in before.items()]
        if name == "toxicity":
            model = train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
            want = {r.doc_id for r in score_toxicity(docs, model).where("score < 0.7").collect()}
        elif name == "near_duplicates":
            want = {eval(x)[0] for x in test_near_dedup.brute(rows) if eval(x)[3]}
        elif name == "decontamination":
            items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
            want = {eval(x)[0] for x in test_decontam.brute(rows, items) if not eval(x)[5]}
        elif name == "mixing":
            want = {r[0] for r in mixed(docs).where("sampled").select("row.doc_id").collect()}
        else:
            want = set(before)
            loads, largest = test_sharding.check(rows, out.collect())
            assert max(loads) - min(loads) <= largest
        assert set(after) == want
        kept.append(name)
        n.append(len(after))
        docs = out
    assert kept == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert n[0] > n[1] > n[2] > n[3] == n[4] > 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() < table(spark, sf_dir, "documents").count()
    assert {"doc_id", "shard", "slot", "text"} <= set(out.columns)


def test_stages_take_awkward_rows(spark, awkward, sf_dir, tmp_path):
    rows = [(i, t, lang, source, None) for i, t, lang, source, *_ in awkward]
    for given in (rows, []):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"file://{tmp_path}/{len(given)}-{k}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() <= len(given)


def test_stages_take_clashing_columns(spark, sf_dir, tmp_path):
    """Columns called as what the stages make on the way come through every stage as they were."""
    names = "bad_id bad_key row row_key own_id own_key shard slot size text_crc32 chunk group_key bytes nth begins kept component_id rep draw probability sampled topic tokens weight score label words n key digest".split()
    docs = table(spark, sf_dir, "documents").limit(60)
    docs = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id")).alias(c) for c in names])
    for k, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        at = {c: f"{c}_given" if stage_name == "sharding" and c in ("shard", "slot", "size", "text_crc32") else c for c in names}
        rows = out.collect()
        assert rows and all(r[at[c]] == f"{c} {r.doc_id}" for r in rows for c in names), stage_name
        docs = out


def test_unlike_rows_of_one_id_stay(spark):
    """Rows of one id that differ in any column stay together; of rows that repeat whole one stays."""
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "en", {"a": 1}), (1, "quite another text of few words here", "en", None), (1, text, "en", {"a": 1}), (1, text, "de", {"a": 1}), (2, text + " end", "en", None), (None, text, "x", None), (None, text, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, m map<string,int>")
    got = keep_one_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r.lang) for r in got.collect()) == sorted([(1, text, "en"), (1, "quite another text of few words here", "en"), (1, text, "de"), (0, text, "x"), (0, text, "x")])


def test_registered():
    names = list(llm.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert set(names) | {"pipeline"} <= set(entry.queries())
    assert all(list(inspect.signature(f).parameters) == ["spark", "sf_dir"] for f in llm.queries().values())


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(llm.oracle_sql()[name]).df()
    got = llm.queries()[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d.notna(), None).values.tolist()))
    assert rows(got) == rows(want)
