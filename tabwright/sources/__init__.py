"""Specifications and tables from files, and back."""
