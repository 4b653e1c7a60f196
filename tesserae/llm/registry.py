"""Queries and SQL of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from . import ann, exact_dedup, line_dedup, mixing, near_dup, packing, quality, secrets, substring, suffix_array

QUERIES = {
    "op1_ann": ann.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_mixing": mixing.query,
    "op4_substring_dedup": substring.query,
    "op5_quality": quality.query,
    "op6_line_dedup": line_dedup.query,
    "op7_jaccard_join": near_dup.query,
    "op8_secrets": secrets.query,
    "op9_suffix_array": suffix_array.query,
    "op10_packing": packing.query,
}

SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op4_substring_dedup": substring.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op7_jaccard_join": near_dup.SQL,
    "op9_suffix_array": suffix_array.SQL,
}
