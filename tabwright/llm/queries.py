"""Queries of this subpackage, and DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm.decontam import OP7_SQL, op7_decontamination
from tabwright.llm.elkan import OP12_SQL, op12_clusters
from tabwright.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from tabwright.llm.html_text import op4_html_text
from tabwright.llm.license_scan import op8_license_scan
from tabwright.llm.mixing import op6_mixing
from tabwright.llm.near_dedup import OP3_SQL, op3_near_dedup
from tabwright.llm.ranked_search import OP11_SQL, op11_ranked_search
from tabwright.llm.sharding import OP9_SQL, op9_sharding
from tabwright.llm.suffix_dedup import OP10_SQL, op10_suffix_dedup
from tabwright.llm.toxicity import op5_toxicity
from tabwright.llm.url_filter import OP13_SQL, op13_url_filter
from tabwright.llm.warc import OP1_SQL, op1_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_near_dedup": op3_near_dedup,
        "op4_html_text": op4_html_text,
        "op5_toxicity": op5_toxicity,
        "op6_mixing": op6_mixing,
        "op7_decontamination": op7_decontamination,
        "op8_license_scan": op8_license_scan,
        "op9_sharding": op9_sharding,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_ranked_search": op11_ranked_search,
        "op12_clusters": op12_clusters,
        "op13_url_filter": op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL,
        "op2_exact_dedup": OP2_SQL,
        "op3_near_dedup": OP3_SQL,
        "op7_decontamination": OP7_SQL,
        "op9_sharding": OP9_SQL,
        "op10_suffix_dedup": OP10_SQL,
        "op11_ranked_search": OP11_SQL,
        "op12_clusters": OP12_SQL,
        "op13_url_filter": OP13_SQL,
    }
