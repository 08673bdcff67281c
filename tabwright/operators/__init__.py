"""Validation, rules, datasets and delivery of tables."""
