"""From raw documents to shards: toxicity, near duplicates, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.

For every stage: a null text counts as empty, texts of any length are read whole, null ids and repeated rows are allowed,
an empty table gives an empty one, and further columns, whatever their names, come out as they went in. Each stage says
below what that means for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import clear_shared, new_folder, table, written
from tabwright.llm.decontam import without_contaminated
from tabwright.llm.mixing import mixed
from tabwright.llm.near_dedup import keep_one_each
from tabwright.llm.sharding import assign_shards
from tabwright.llm.toxicity import held_out, train, without_toxic


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}  # by application id, the folders that the latest stage's result is built on


def tidy(stage: Stage) -> Stage:
    """The stage, deleting first what the stage before left in the shared folder: its result has been stored by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        clear_shared(spark, _left.pop(app, []))
        before = len(written(spark))
        out = stage(spark, docs, sf_dir)
        _left[app] = written(spark)[before:]
        return out

    return run_stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go.

    Each row is scored by itself: rows that are alike stay or go together, rows with null ids too; empty texts score as the
    leak alone. Without labels of both kinds nothing is learned, and all rows score the share of toxic labels.
    """
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.85, the operator's own threshold, stays: that of the smallest id.

    Rows without words are linked with nothing and stay, rows with null ids stay. Rows that share an id are one document and
    stay or go together, but of rows that repeat whole one stays.
    """
    return keep_one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are words of benchmark windows go.

    Rows are told apart by id and text, null ids too; a row without words stays. Without benchmark items all rows stay.
    """
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target weights, as far as a budget of 0.8 of all tokens lets them.

    Null sources and languages are empty ones. Rows without words have the probability of their cell. Rows that repeat id
    and text are drawn together.
    """
    return mixed(docs).where("sampled").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, text_crc32, shard and slot; no row goes.

    Equal texts share a shard. A column of ``docs`` that is called as one of these comes out with ``_given`` after its name.
    """
    return assign_shards(docs, carry=[c for c in docs.columns if c != "doc_id"])


STAGES = [
    ("toxicity", tidy(toxicity)),
    ("near_duplicates", tidy(near_duplicates)),
    ("decontamination", tidy(decontamination)),
    ("mixing", tidy(mixing)),
    ("sharding", tidy(sharding)),
]

#: SQL can express none of: a trained model, registers, raking, scheduling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        clear_shared(spark, before)  # what the stage was made from
        before = [path]
    return docs
