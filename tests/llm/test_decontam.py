import hashlib
import random
import re

import duckdb
import pytest

from tabwright.llm import common, decontam
from tabwright.llm.decontam import contamination, op7_decontamination, without_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window=13):
    wins = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[s : s + window]), set()).add(item)
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= got
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def items(awkward):
    passage = next(t for i, *t in ((r[0], r[1]) for r in awkward) if i == 22)[0]
    base = awkward[0][1].split(" ")
    return [(1, passage.upper()), (2, " - ".join(base[:20])), (10, "one, two"), (3, None), (4, ""), (5, "!!"), (None, " ".join(base[40:60])), (6, " ".join(base[40:56])), (1, "word"), (7, "never seen anywhere at all"), (8, "é" * 40 + base[0]), (9, "x " * 40)]


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0}, {"broadcast_bytes": 0}, {"chunk_words": 7}])
def test_awkward(spark, awkward, awkward_docs, no_docs, items, limits):
    table = spark.createDataFrame([(*x, 1, "k") for x in items], "item_id long, text string, doc_id int, words string")
    assert found(contamination(awkward_docs, table, **limits)) == brute([r[:2] for r in awkward], items)
    assert contamination(no_docs, table).count() == 0
    none = contamination(awkward_docs, table.limit(0))
    assert none.count() == len(awkward) and none.where("contaminated or n_hit > 0 or n_items > 0").isEmpty()
    clean = without_contaminated(awkward_docs, table)
    assert clean.columns == awkward_docs.columns
    bad = [r for r in brute([r[:2] for r in awkward], items) if r.endswith("True)")]
    assert clean.count() == len(awkward) - len(bad)


def test_query(spark, sf_dir):
    read = lambda t, k: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect()]
    got = found(op7_decontamination(spark, sf_dir))
    assert got == brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert sorted(str(r) for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({decontam.OP7_SQL})").fetchall()) == got


@pytest.mark.parametrize("shingle", [1, 3, 13])
def test_small_alphabet(spark, shingle):
    """Windows that overlap, repeat, and share most of their tokens."""
    rng = random.Random(shingle)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(k, text(rng.randrange(0, 7))) for k in range(12)]
    rows = [(k, text(rng.randrange(0, 25))) for k in range(60)]
    got = contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4, shingle=shingle)
    assert found(got) == brute(rows, items, 4)


def test_frequent_word_as_an_item(spark):
    """Candidates of a long document come in rows of at most a chunk's places; windows reach over the ends of chunks."""
    rows = [(1, "the " * 9_000), (2, "a b the c"), (3, " ".join(f"w{k}" for k in range(9_000))), (3, "the"), (None, "the end")]
    items = [(1, "the"), (2, "the the the"), (3, " ".join(f"w{k}" for k in range(4_090, 4_110))), (4, "c"), (5, "w8999"), (6, "c d")]
    tables = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    before = len(common.written(spark))
    assert found(contamination(*tables)) == brute(rows, items)
    paths = [p for p in common.written(spark)[before:] if "/candidates-" in p]
    assert spark.read.parquet(*paths).selectExpr("max(size(candidates)) AS n").first().n <= 2 * 4096


def test_bitmap_has_no_false_negatives(spark, monkeypatch):
    """A bitmap that is far too small lets more places through and loses none."""
    monkeypatch.setattr(decontam, "BITMAP_BITS", 1 << 10)
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(90)}" for _ in range(n))
    items = [(k, text(rng.randrange(1, 20))) for k in range(300)]
    rows = [(k, f"{text(9)} {items[k * 7 % 300][1]} {text(9)}") for k in range(60)]
    got = contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == brute(rows, items)


def test_stays_in_the_jvm(spark, sf_dir):
    out = op7_decontamination(spark, sf_dir)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
