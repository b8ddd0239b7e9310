"""Schemas of records that are read or written."""

from __future__ import annotations

FIX_PAIR = "id long, code_before string, code_after string, cwe_type string, cve_id string"
VULNERABILITY = "code_before string, code_after string, `CWE ID` string, trigger_path string"
POSITIONAL = (
    "code_before", "code_after", "focus", "slice_context", "domain", "functionality",
    "before_condition", "after_condition", "before_condition_formula", "after_condition_formula", "premises",
)
KNOWLEDGE = (
    "original_row_index long, cwe_type string, cve_id string, top_parent_cwe string, code_before string, code_after_ground_truth string, "
    "final_llm1_cwe_specific_strategy string, final_llm1_pre_repair_state string, final_llm1_abstract_strategy string, "
    "final_llm1_concrete_strategy string, final_llm1_post_repair_state string, embedding array<float>"
)
NODES = "key string, type string, code string, identifier string, location string, functionId string, childNum string"
EDGES = "start string, end string, type string, var string"
