"""Queries of this subpackage and the SQL that their results are held against."""

from __future__ import annotations

from . import exact_dedup, html, lines, mixing, packing, pii, quality, simhash, topk, toxicity

QUERIES = {
    "op1_lines": lines.op1_lines,
    "op2_html": html.op2_html,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_pii": pii.op4_pii,
    "op5_topk": topk.op5_topk,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": quality.op7_quality,
    "op8_simhash": simhash.op8_simhash,
    "op9_packing": packing.op9_packing,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op5_topk": topk.ORACLE,
}
