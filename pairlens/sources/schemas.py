"""Declared schemas of the record kinds; nothing is inferred."""

from __future__ import annotations

OBSERVATION = (
    "task_id STRING, condition STRING, repeat INT, source_dataset STRING, experiment STRING, source_task_id STRING, family_id STRING, model_path STRING, finish_reason STRING, "
    "generated_token_count INT, passed BOOLEAN, rule_a_passed BOOLEAN, rule_b_passed BOOLEAN, rule_a_input_accuracy DOUBLE, rule_b_input_accuracy DOUBLE, common_passed BOOLEAN, "
    "execution_status STRING, official_passed BOOLEAN, heldout_passed BOOLEAN, heldout_counts STRUCT<original:INT,removed:INT,remaining:INT>, visible_passed BOOLEAN, hidden_passed BOOLEAN, evalplus_passed BOOLEAN"
)
TASK = (
    "task_id STRING, source_task_id STRING, source_dataset STRING, protocol_version STRING, prompt STRING, signature STRING, entry_point STRING, reference_code STRING, "
    "condition_tests MAP<STRING,ARRAY<STRING>>, condition_prompts MAP<STRING,STRING>, official_test STRING, heldout_test STRING, evaluation_timeout_seconds INT, family_id STRING, instance INT, "
    "reference_a STRING, reference_b STRING, rule_a STRING, rule_b STRING, candidate_tests ARRAY<STRING>"
)
GENERATION = (
    "task_id STRING, dataset_name STRING, condition STRING, repeat INT, prompt STRING, completion STRING, candidate_code STRING, prompt_tests ARRAY<STRING>, visible_tests ARRAY<STRING>, "
    "hidden_tests ARRAY<STRING>, all_tests ARRAY<STRING>, entry_point STRING, model_path STRING, prompt_format STRING, generation_seed INT, order_seed INT, prompt_token_hash STRING, finish_reason STRING"
)
SUMMARY = (
    "model_path STRING, experiment STRING, dataset STRING, conditions MAP<STRING,STRUCT<observations:BIGINT,tasks:BIGINT,passed:DOUBLE,official_passed:DOUBLE,heldout_passed:DOUBLE>>, "
    "contrasts ARRAY<STRUCT<base:STRING,target:STRING,num_tasks:INT,num_clusters:INT,repeats_per_task:INT,cluster_field:STRING,paired_difference:DOUBLE,ci95:ARRAY<DOUBLE>>>"
)
