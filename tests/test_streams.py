"""State on streams: what micro-batches find against the batch, over restarts and in any order of arrival."""

import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import types as T

from tabwright.operators.rules import violating_rows
from tabwright.spec import Rule, SpecCollection, SpecError
from tabwright.streaming.unique import KeepsLeast, candidates, stream_duplicates
from tabwright.streaming.windows import stream_summary, window_summary


class Fed:
    """A stream read from a folder to which rows are added, batch by batch; each run goes on from the checkpoint."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/b{self.n:04d}")

    def run(self, made):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in/*")
        query = made(stream).writeStream.format("parquet").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start(f"{self.folder}/out")
        query.awaitTermination()
        return self.spark.read.parquet(f"{self.folder}/out").collect()


@pytest.mark.parametrize("shuffled", [False, True])
def test_duplicates_equal_the_batch(spark, tmp_path, two_partitions, shuffled):
    rng = random.Random(1)
    rows = [(k, "a", rng.choice([None, "x", "y" * 100, "z" * 100, "rare" + str(k // 3)]), rng.choice([1, 2, None])) for k in range(240)]
    rows += [(k, "b", "hot", 1) for k in range(240, 330)]
    given = rng.sample(rows, len(rows)) if shuffled else rows
    schema, rule = "k long, part string, s string, n int", Rule("u", "check_unique", column=("s", "n"))
    fed, made = Fed(spark, str(tmp_path), schema), lambda stream: stream_duplicates(stream, rule, ["part", "k"], salts=3)
    for at in range(0, 220, 110):
        fed.add(given[at : at + 110])
    fed.run(made)
    fed.add(given[220:])  # after a restart from the checkpoint
    got = fed.run(made)
    want = violating_rows(spark.createDataFrame(rows, schema), rule, ["part", "k"]).collect()
    assert sorted((r.part, r.k) for r in got) == sorted((r.part, r.k) for r in want) and {r.rule_id for r in got} == {"u"}


@pytest.fixture
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # with state that expires there would be no end of them
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_state_expires(spark, tmp_path, two_partitions):
    fed, rule = Fed(spark, str(tmp_path), "k long, s string"), Rule("u", "check_unique", column=("s",))
    made = lambda stream: stream_duplicates(stream, rule, ["k"], salts=1, keep_ms=1)
    fed.add([(1, "a"), (2, "a")])
    fed.run(made)
    fed.add([(3, "other")])  # a batch in which "a" is forgotten
    fed.run(made)
    fed.add([(4, "a")])
    assert sorted(r.k for r in fed.run(made)) == [2]


def test_one_call_takes_many_combinations():
    """A group of state holds thousands of combinations; each is looked up and stored once a call, whatever its rows."""
    held, calls = {}, []

    class Handle:
        def getMapState(self, *_):
            return self

        def getValue(self, value):
            calls.append(value)
            return held.get(value)

        def updateValue(self, value, least):
            calls.append(value)
            held[value] = least

    state = KeepsLeast(["k"], T.StructType().add("k", "long"), None)
    state.init(Handle())
    frame = lambda keys: pd.DataFrame({0: keys, 1: [f"v{k % 5000}" for k in keys], 2: 7})
    run = lambda *keys: sorted(k for f in state.handleInputRows((7,), iter(map(frame, keys)), None) for k in f["k"])
    assert run(range(20000, 30000), range(15000, 20000)) == list(range(20000, 30000)) and len(calls) == 10000
    assert run(range(5000)) == list(range(15000, 20000)) and len(calls) == 20000 and held[("v3",)] == (3,)
    assert run(range(10000, 15000)) == list(range(10000, 15000)) and len(calls) == 25000
    hot = next(candidates(["k"])(iter([pd.DataFrame({"k": [5, 3, 4], "_value": ["a"] * 3})])))
    assert hot.k[hot._least].tolist() == [3]


def test_refusals(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(SpecError):
        stream_duplicates(stream, Rule("r", "check_range", column=("value",), range=(1, 2)), ["value"])
    with pytest.raises(SpecError):
        stream_duplicates(stream, Rule("u", "check_unique", column=("none",)), ["value"])


def test_window_summary_counts_late_rows_apart(spark, tmp_path):
    schema, spec = "k long, t timestamp, s string", SpecCollection.from_dicts([{"id": "s", "nullable": False, "values": ["a", "b"]}])
    fed, at = Fed(spark, str(tmp_path), schema), lambda hour, minute=0: datetime(2024, 1, 1, hour, minute)
    run = lambda: stream_summary(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), spec, "k", "t", "1 hour", "30 minutes", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    fed.add([(1, at(1), "x"), (2, at(1, 30), "a"), (3, at(2, 10), "x"), (4, None, "x")])
    fed.add([(5, at(1, 59), "y"), (6, at(3, 29), "a")])  # the watermark is 1:40, the window till 2:00 still open
    run()
    fed.add([(7, at(1, 5), "z"), (8, at(2, 59), "z"), (9, at(3), None)])  # 2:59: the windows till 2:00 are over
    run()
    got = sorted((r.start.hour if r.start else -1, r.keyword, r.late, r.n, r.first_key, r.last_key) for r in window_summary(spark, f"{tmp_path}/out").collect())
    assert got == [(-1, "enum", True, 1, 4, 4), (1, "enum", False, 2, 1, 5), (1, "enum", True, 1, 7, 7), (2, "enum", False, 2, 3, 8), (3, "enum", False, 1, 9, 9), (3, "type", False, 1, 9, 9)]
