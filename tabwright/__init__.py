"""Validation of tabular data against declarative specifications, as Spark expressions and aggregations."""
