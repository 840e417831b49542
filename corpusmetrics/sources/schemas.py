"""Schemas of the records, as DDL."""

from __future__ import annotations

CONTENT = "background STRING, idea STRING, purpose STRING, mechanism STRING, evaluation STRING, probability DOUBLE, random_string STRING"
USAGE = "response_reasoning STRING, has_reasoning_block BOOLEAN, stop_reason STRING, input_tokens BIGINT, output_tokens BIGINT, total_tokens BIGINT"

SAMPLE = (
    "keyword STRING, category STRING, prompt_style STRING, effort STRING, sample_index BIGINT, idea_model STRING, embedding_model STRING, "
    f"idea STRING, full_response STRING, structured_output STRUCT<{CONTENT}>, pydantic_validation_status STRING, pydantic_validation_error STRING, "
    f"{USAGE}, raw_api_response STRING, api_calls STRING, embedding_input_tokens BIGINT, word_count BIGINT, char_count BIGINT, timestamp STRING"
)
ROW_KEY = "category STRING, keyword STRING, prompt_style STRING, effort STRING, sample_index BIGINT"
PAIR = "keyword STRING, effort STRING, sample_i_index BIGINT, sample_j_index BIGINT, embedding_distance DOUBLE, embedding_model STRING, stratum STRING, rank INT"
PAIRWISE = (
    f"request STRUCT<pair: STRUCT<{PAIR}>, order: STRING, judge_model: STRING, prompt_template_version: STRING, idea_text_a: STRING, idea_text_b: STRING>, "
    f"answer STRING, prompt_text STRING, raw_api_response STRING, timestamp TIMESTAMP, {USAGE}"
)
QUALITY = (
    "request STRUCT<target: STRUCT<keyword: STRING, effort: STRING, sample_row_index: BIGINT>, judge_model: STRING, prompt_template_version: STRING, idea_text: STRING, judge_effort: STRING>, "
    "scores STRUCT<analysis: STRING, originality: INT, feasibility: INT, clarity: INT>, system_prompt_text STRING, user_prompt_text STRING, "
    f"raw_api_response STRING, timestamp TIMESTAMP, reasoning_tokens BIGINT, {USAGE}"
)
REASONING_COUNTS = (
    "sample_jsonl_index BIGINT, keyword STRING, effort STRING, sample_index BIGINT, output_tokens BIGINT, visible_answer_tokens_raw BIGINT, "
    "system_overhead BIGINT, has_reasoning_block BOOLEAN, reasoning_tokens_raw BIGINT, reasoning_tokens BIGINT"
)
KEYWORDS = "keyword STRING, category STRING, similarity_score DOUBLE"
