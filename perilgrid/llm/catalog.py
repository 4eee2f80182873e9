"""The queries of this subpackage, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from perilgrid.llm.audit import OP12_SQL, op12_filter_audit
from perilgrid.llm.bpe import op9_bpe_codec
from perilgrid.llm.chats import OP11_SQL, op11_chat_format
from perilgrid.llm.decontam import op8_decontaminate
from perilgrid.llm.licenses import op4_license_scan
from perilgrid.llm.lines import OP5_SQL, op5_line_dedup
from perilgrid.llm.phrases import OP10_SQL, op10_suffix_dedup
from perilgrid.llm.quality import op3_quality_rules
from perilgrid.llm.runs import op13_run_detection
from perilgrid.llm.simhash import op7_simhash
from perilgrid.llm.substrings import OP1_SQL, op1_substring_dedup
from perilgrid.llm.tokens import op6_token_counts
from perilgrid.llm.urls import OP2_SQL, op2_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_substring_dedup,
        op2_url_filters,
        op3_quality_rules,
        op4_license_scan,
        op5_line_dedup,
        op6_token_counts,
        op7_simhash,
        op8_decontaminate,
        op9_bpe_codec,
        op10_suffix_dedup,
        op11_chat_format,
        op12_filter_audit,
        op13_run_detection,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_url_filters": OP2_SQL, "op5_line_dedup": OP5_SQL, "op10_suffix_dedup": OP10_SQL, "op11_chat_format": OP11_SQL, "op12_filter_audit": OP12_SQL}
