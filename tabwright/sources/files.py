"""Specifications as YAML, JSON and Python data, and tables from delimited files."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import FROM_TEXT
from tabwright.operators.positions import in_file_order
from tabwright.spec import SpecCollection, SpecError

try:
    import yaml
except ImportError:  # YAML is one of several formats
    yaml = None


def _needs_yaml() -> None:
    if yaml is None:
        raise SpecError("reading and writing YAML needs PyYAML")


def _collection(given: Any, tag: str | None) -> SpecCollection:
    for part in (tag or "").split("/") if tag else ():
        given = given[part]
    given = given or {}
    return SpecCollection.from_dicts(given.get("columns") or [], given.get("rules") or [], given.get("metadata"))


def read_yaml(path: str, tag: str | None = None) -> SpecCollection:
    """From a YAML file; ``tag`` is the path of keys (joined by /) under which the specification stands."""
    _needs_yaml()
    return _collection(yaml.safe_load(Path(path).read_text(encoding="utf-8")), tag)


def read_json(path: str, tag: str | None = None) -> SpecCollection:
    return _collection(json.loads(Path(path).read_text(encoding="utf-8")), tag)


def _filled(spec: SpecCollection) -> dict[str, Any]:
    """Without fields that say nothing."""
    given = spec.to_dict()
    short = lambda rows: [{k: v for k, v in r.items() if v is not None} for r in rows]
    return {"metadata": given["metadata"], "columns": short(given["columns"]), "rules": short(given["rules"])}


def write_yaml(spec: SpecCollection, path: str) -> None:
    _needs_yaml()
    Path(path).write_text(yaml.safe_dump(_filled(spec), sort_keys=False, allow_unicode=True), encoding="utf-8")


def write_json(spec: SpecCollection, path: str, pretty: bool = True) -> None:
    Path(path).write_text(json.dumps(_filled(spec), ensure_ascii=False, indent=2 if pretty else None), encoding="utf-8")


def yaml_to_json(yaml_path: str, json_path: str, pretty: bool = True) -> None:
    """The same data in the other format, whatever it is."""
    _needs_yaml()
    data = yaml.safe_load(Path(yaml_path).read_text(encoding="utf-8"))
    Path(json_path).write_text(json.dumps(data, ensure_ascii=False, indent=2 if pretty else None, default=str), encoding="utf-8")


def read_delimited(spark: SparkSession, path: str, spec: SpecCollection | None = None, sep: str = "\t", row: str | None = None, **options: Any) -> DataFrame:
    """A delimited file with a header, every value as its text. Columns are marked with the types that the specification
    means them to have: validation finds the values that can't be read, rules and ``typed`` read the others. With ``row``
    a column of that name has the rows' numbers in the order of files by name and of lines, from 1."""
    rows = spark.read.options(header=True, sep=sep, nullValue="", **options).csv(path)
    if row is not None:
        rows = in_file_order(rows, row)
    if spec is None:
        return rows
    kinds = {c: T.LongType() if c == row else spec[c].spark_type if c in spec.columns else T.StringType() for c in rows.columns}
    return rows.select(*[F.col(f"`{c}`") if c == row else F.col(f"`{c}`").alias(c, metadata={FROM_TEXT: kind.simpleString()}) for c, kind in kinds.items()])
