"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from . import ann, exact_dedup, license_scan, mixing, packing, simhash, substring_dedup, token_rollup, toxicity, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_token_rollup": token_rollup.op4_token_rollup,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mixing": mixing.op7_mixing,
    "op8_warc": warc.op8_warc,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_ann": ann.op10_ann,
    "instruction_packing": packing.instruction_packing,
}

ORACLE = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op5_license_scan": license_scan.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
}
