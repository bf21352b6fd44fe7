"""Columns of the tables, as DDL."""

from __future__ import annotations

REPORTS = "report_id string, report_type string, html string"
FAILURE_FIELDS = (
    "test_case_id", "scenario_name", "failed_step_line", "error_message", "failure_image", "video_url",
    "feature_name", "stack_trace", "console_logs", "all_steps",
)
FAILURES = "report_id string, failure_idx long, " + ", ".join(f"{c} string" for c in FAILURE_FIELDS)
REQUEST_FIELDS = (
    "test_name", "feature", "scenario", "failed_step", "error", "stack_trace", "console_logs",
    "failure_image", "video_url", "report_type", "all_steps",
)
ANSWERS = "failure_id string, attempt int, raw_text string, model string, vision boolean, http_ms long, prompt_tokens int, output_tokens int"
RESPONSE_TEXTS = (
    "classification", "root_cause_type", "root_cause", "severity", "recommended_action", "suggested_fix",
    "similar_patterns", "screenshot_observation",
)
RESPONSE_LISTS = ("evidence", "missing_evidence", "steps_to_reproduce", "prevention_tips")
RESPONSE = ", ".join([*(f"{c} string" for c in RESPONSE_TEXTS), "confidence int", *(f"{c} array<string>" for c in RESPONSE_LISTS)])
#: What an AI result writes to the feedback log; a human correction writes human_classification alone.
FEEDBACK_TEXTS = (
    "scenario_name", "feature_name", "failed_step_line", "normalized_step", "normalized_error", "exception_type", "locator",
    "stack_trace_pattern", "ai_classification", "root_cause", "root_cause_type", "severity", "recommended_action",
    "suggested_fix", "similar_patterns", "screenshot_observation", "screenshot_hash", "source",
)
FEEDBACK_AI = (*FEEDBACK_TEXTS, *RESPONSE_LISTS, "confidence")
FEEDBACK_LOG = "failure_id string, kind string, event_time timestamp, seq long, created_at timestamp, human_classification string, " + ", ".join(
    [*(f"{c} string" for c in FEEDBACK_TEXTS), *(f"{c} array<string>" for c in RESPONSE_LISTS), "confidence int"]
)
CORRECTIONS = "failure_id string, human_classification string, event_time timestamp, seq long"
CLASSIFICATIONS = ("AUTOMATION_ISSUE", "APPLICATION_ISSUE", "API_ISSUE", "DATA_ISSUE", "ENVIRONMENT_ISSUE", "NETWORK_ISSUE", "UNKNOWN")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
