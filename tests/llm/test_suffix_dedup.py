import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tabwright.llm.suffix_array import suffix_array
from tabwright.llm.suffix_dedup import _settle, op10_suffix_dedup, remove_repeats, text_names


def brute(rows, length=50):
    """Every window of every document looked up among those of documents with smaller ids."""
    first: dict = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        if i is not None:
            for s in range(len(t) - length + 1):
                w = t[s : s + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        if i is not None:
            for s in range(len(t) - length + 1):
                if first[t[s : s + length]] < i:
                    gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)[:5]) for r in df.collect())


def test_suffix_array():
    rng = random.Random(1)
    for k in range(400):
        symbols = rng.choice([1, 2, 3, 50])
        text = [rng.randrange(1, symbols + 1) for _ in range(rng.randrange(60))] + [0]
        if k % 5 == 0:
            text = text[: max(1, len(text) // 4)][:-1] * 4 + [0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array([0]) == [0]
    assert suffix_array([1] * 3000 + [0]) == list(range(3000, -1, -1))


@pytest.mark.parametrize("most_contexts", [200_000, 2])
def test_awkward(awkward, awkward_docs, no_docs, most_contexts):
    rows = [r[:2] for r in awkward]
    out = remove_repeats(awkward_docs, most_contexts=most_contexts, keep_text=True)
    assert found(out) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out.collect())
    assert remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("most_contexts", [200_000, 3])
def test_passages(spark, most_contexts):
    """Passages of lengths about 50 in many surroundings, runs of one byte, periods, and multi-byte characters."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [noise(n) for n in (48, 49, 50, 51, 60, 200)] + ["ab" * 40, "x" * 130, "é" * 26, noise(30) + "-" * 25]
    rows = []
    for k in range(70):
        text = "".join(noise(rng.randrange(40)) + rng.choice(passages)[rng.randrange(4) :] for _ in range(rng.randrange(4)))
        rows.append((rng.randrange(1000), text))
    rng.shuffle(rows)
    assert found(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), most_contexts=most_contexts)) == brute(rows)


def test_long_text(spark):
    """A passage across the pieces in which long texts are worked off."""
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range((1 << 20) + 3000))
    cut = (1 << 20) - 30
    rows = [(1, long), (2, "z" * 10 + long[cut : cut + 120] + "y" * 10), (3, long[500:560] + "w")]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (120, 1), 3: (60, 1)}


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op10_suffix_dedup(spark, sf_dir)) == brute(rows)


def test_texts_of_one_hash(spark):
    """Texts that share a hash get others until none do; if that never ends, the operator stops."""
    texts = [f"text {k % 40}" for k in range(100)]
    rows = spark.createDataFrame([(k if k % 9 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    weak = lambda seed: F.length("text") if seed == 0 else F.xxhash64(F.lit(seed), "text") % 30 if seed < 3 else F.xxhash64(F.lit(seed), "text")
    named, known = text_names(rows, weak)
    of = {}
    for r in named.where("doc_id is not null").collect():
        assert of.setdefault(r.t, r.text) == r.text
    assert len(of) == 40
    want = {t: min(k for k, x in enumerate(texts) if x == t and k % 9) for t in texts}
    assert {of[r.t]: (r.first, r.n_bytes) for r in known.collect()} == {t: (k, len(t)) for t, k in want.items()}
    with pytest.raises(RuntimeError):
        text_names(rows, lambda seed: F.length("text"))


def test_grams_of_one_hash():
    """Contexts whose anchors have one hash, but not one gram, share nothing."""
    side = b"s" * 30
    one, two = side + b"a" * 20 + side, side + b"b" * 20 + side
    assert list(_settle([(7, one, 30, 1), (7, two, 30, 2)], 50)) == []
    assert list(_settle([(7, one, 30, 1), (7, one[1:], 29, 2)], 50)) == [(7, one[1:], 0, 30)]
