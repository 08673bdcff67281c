"""Exact uniqueness on streams: arbitrary state per combination of values, which emits the duplicates themselves.

Of rows that are alike in a rule's columns all but the one with the smallest key are emitted, as in a batch. The
state of a combination is the smallest key so far; if a smaller one arrives later, the one before is emitted in its place,
so what is emitted in the end doesn't depend on the order of arrival, and a query that starts again from its checkpoint
goes on where it was.

A call of Python for each combination would take longer than all else, so combinations are dealt to a fixed number of groups by
hash; a group's state is a map with the smallest key of each of its combinations, and rows are compared by frames. A combination
that very many rows share would all go to one task. So before the shuffle each frame of rows, which are at most 10,000, keeps
the smallest key of a combination as its candidate; the others can't be the smallest and pass the state by, spread by their
keys. Texts longer than a digest are held as their SHA-256.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tabwright.operators.rules import short_keys
from tabwright.spec import Rule, SpecError

#: Groups of state for each of ``salts``, and combinations of a group whose smallest keys a task holds at once.
GROUPS, HELD = 64, 100_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(frame: pd.DataFrame, names: list[str]) -> list[tuple]:
    return list(zip(*(frame[n].tolist() for n in names), strict=True))


def candidates(names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Marks in each frame the row of the smallest key of a combination (``_least``)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.sort_values(names)
            yield frame.assign(_least=~frame.duplicated("_value"))

    return run


class KeepsLeast(StatefulProcessor):
    """Emits the keys of all rows but that of the smallest key of each combination; a smallest key is emitted once it is replaced."""

    def __init__(self, names: list[str], held: T.StructType, keep_ms: int | None) -> None:
        self.names, self.held, self.keep_ms = names, held, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.least = handle.getMapState("least", T.StructType([T.StructField("value", T.StringType())]), self.held, self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterable[pd.DataFrame]:
        columns = [*self.names, "_value", "_group"]  # frames come with places for names
        if key[0] < 0:
            yield from (frame.set_axis(columns, axis=1)[self.names] for frame in rows)
            return
        seen: dict[str, tuple[tuple | None, tuple]] = {}  # smallest key in the state, and by now
        for frame in rows:
            frame = frame.set_axis(columns, axis=1)
            out = []
            for value, own in zip(frame["_value"].tolist(), _rows(frame, self.names), strict=True):
                if value in seen:
                    before, least = seen[value]
                else:
                    before = self.least.getValue((value,))
                    before = least = None if before is None else tuple(before)
                if least is not None:
                    out.append(max(own, least))
                seen[value] = before, own if least is None else min(own, least)
                if len(seen) >= HELD:
                    self._store(seen)
            if out:
                yield pd.DataFrame({n: [r[k] for r in out] for k, n in enumerate(self.names)})
        self._store(seen)

    def _store(self, seen: dict[str, tuple[tuple | None, tuple]]) -> None:
        for value, (before, least) in seen.items():
            if least != before or self.keep_ms is not None:
                self.least.updateValue((value,), least)
        seen.clear()

    def close(self) -> None:
        pass


def stream_duplicates(stream: DataFrame, rule: Rule, key: list[str], salts: int = 16, keep_ms: int | None = None) -> DataFrame:
    """(key..., rule_id) for each row whose values of a uniqueness rule's columns another row has, but that of the smallest key.

    Keys tell rows apart and hold no null. ``salts`` is the number of groups of state in units of ``GROUPS``; it, like the rule and
    the key, stays the same as long as a checkpoint is used. With ``keep_ms`` a combination is forgotten if no row has had it for so long
    since (by the clock of the machines); without, it is kept for ever, and the result is exact. As
    state that expires asks for batches without data, a query that is to end by itself needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    if rule.type != "check_unique":
        raise SpecError(f"rule {rule.id}: only uniqueness needs state")
    if missing := [c for c in (*rule.column, *key) if c not in stream.columns]:
        raise SpecError(f"rule {rule.id} reads {', '.join(missing)}, which the stream doesn't have")
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    names = [f"_key{i}" for i in range(len(key))]
    values, _ = short_keys(stream, rule.column)
    value = F.to_json(F.struct(*[v.alias(f"_u{i}") for i, v in enumerate(values)]))
    rows = stream.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(key, names, strict=True)], value.alias("_value"))
    held = T.StructType([T.StructField(n, kinds[k]) for k, n in zip(key, names, strict=True)])
    marked = rows.mapInPandas(candidates(names), T.StructType([*rows.schema.fields, T.StructField("_least", T.BooleanType())]))
    to = lambda *c: F.pmod(F.xxhash64(*c), F.lit(GROUPS * salts)).cast("int")
    dealt = marked.select(*names, "_value", F.when(F.col("_least"), to("_value")).otherwise(-1 - to(*names)).alias("_group"))
    mode = "None" if keep_ms is None else "ProcessingTime"
    stream.sparkSession.conf.set(PROVIDER, ROCKSDB)  # the only one that holds such state
    found = dealt.groupBy("_group").transformWithStateInPandas(KeepsLeast(names, held, keep_ms), held, "Append", mode)
    return found.select(*[F.col(n).alias(k) for k, n in zip(key, names, strict=True)], F.lit(rule.id).alias("rule_id"))
