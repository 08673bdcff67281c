"""Datasets: tables with their specification, and agreements: named datasets."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tabwright.operators.validate import ValidationResult, validate
from tabwright.spec import ColumnSpec, Metadata, Rule, SpecCollection


@dataclass(frozen=True)
class ValidatedDataset:
    """Named tables under one specification. Results are lazy; ``table`` gives a table with "" as null."""

    spec: SpecCollection
    results: Mapping[str, ValidationResult]

    @classmethod
    def of(cls, spec: SpecCollection, tables: Mapping[str, DataFrame] | DataFrame, key: list[str] | str, compat: str | None = None, raise_on_failure: bool = False) -> ValidatedDataset:
        tables = {"table1": tables} if isinstance(tables, DataFrame) else tables
        made = cls(spec, {name: validate(df, spec, key, compat) for name, df in tables.items()})
        if raise_on_failure:
            for result in made.results.values():
                result.raise_on_failure()
        return made

    @property
    def labels(self) -> list[str]:
        return list(self.results)

    def result(self, which: str | int = 1) -> ValidationResult:
        """By name, or by position from 1."""
        if isinstance(which, str):
            if which not in self.results:
                raise KeyError(f"table {which!r} not found; there are {', '.join(self.labels)}")
            return self.results[which]
        if isinstance(which, bool) or not isinstance(which, int):
            raise TypeError("a table is named by a string or a position")
        if not 1 <= which <= len(self.results):
            raise IndexError(f"table {which} is out of bounds; there are {len(self.results)}")
        return list(self.results.values())[which - 1]

    def table(self, which: str | int = 1) -> DataFrame:
        return self.result(which).table

    def column(self, column_id: str) -> ColumnSpec | None:
        return self.spec.get(column_id)

    @property
    def metadata(self) -> Metadata:
        return self.spec.metadata

    @property
    def rules(self) -> tuple[Rule, ...]:
        return self.spec.rules


#: The same under the name that makers of containers look for.
make_container = ValidatedDataset.of


@dataclass(frozen=True)
class Agreement:
    """Named datasets and what the agreement says about itself."""

    containers: Mapping[str, ValidatedDataset]
    metadata: Metadata = field(default_factory=Metadata)

    def __post_init__(self) -> None:
        object.__setattr__(self, "metadata", Metadata.from_any(self.metadata))

    def get(self, *names: str) -> dict[str, ValidatedDataset]:
        """All datasets, or those named."""
        if missing := [n for n in names if n not in self.containers]:
            raise KeyError(f"container not found: {', '.join(missing)}")
        return {n: self.containers[n] for n in names or self.containers}
