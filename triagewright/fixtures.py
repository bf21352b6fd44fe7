"""Failures, history and answers derived from the events table: the same expressions in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FAILURES_SQL = """
SELECT CAST(user_id % 50 AS STRING) AS report_id, event_id AS failure_idx,
  'TC-' || CAST(event_id % 97 AS STRING) AS test_case_id,
  'Scenario ' || event_type AS scenario_name,
  CASE WHEN event_id % 4 = 0 THEN 'And ' WHEN event_id % 4 = 1 THEN 'Then ' WHEN event_id % 4 = 2 THEN 'when   ' ELSE '' END
    || 'user does  "' || event_type || '" step ' || CAST(user_id % 3 AS STRING) AS failed_step_line,
  CASE WHEN event_id % 11 = 0 THEN NULL
    WHEN event_id % 3 = 0 THEN 'org.openqa.selenium.TimeoutException: waiting 30 seconds for By.xpath: //a[@resource-id=' || chr(39) || 'card_click_' || CAST(user_id % 7 + 1000 AS STRING) || chr(39) || ']'
    WHEN event_id % 3 = 1 THEN 'java.lang.AssertionError: expected [' || CAST(event_id AS STRING) || '] but found [0]' || chr(10) || 'second line'
    ELSE 'ERR_CONNECTION_REFUSED for session ' || CAST(event_id AS STRING) END AS error_message,
  CASE WHEN event_id % 5 = 0 THEN 'data:image/png;base64,' || CAST(event_id % 13 AS STRING) ELSE '' END AS failure_image,
  '' AS video_url, 'Feature ' || CAST(user_id % 5 AS STRING) AS feature_name,
  CASE WHEN event_id % 2 = 0 THEN 'at io.cucumber.Runner.run(Runner.java:10)' || chr(10) || 'at app.Steps.go(Steps.java:' || CAST(event_id % 90 AS STRING) || ')' END AS stack_trace,
  '' AS console_logs,
  '1. [PASS] open' || chr(10) || '2. [FAIL] ' || event_type AS all_steps
FROM events
"""

#: An AI result for every third event, as cleaned answers have it; some lack a root cause.
RESPONSES_SQL = """
SELECT event_id AS failure_idx,
  CASE WHEN event_id % 5 = 0 THEN 'APPLICATION_ISSUE' WHEN event_id % 5 = 1 THEN 'AUTOMATION_ISSUE' WHEN event_id % 5 = 2 THEN 'network_issue' WHEN event_id % 5 = 3 THEN 'ODD' ELSE ' ' END AS classification,
  CASE WHEN event_id % 4 = 0 THEN 'CONFIRMED' WHEN event_id % 4 = 1 THEN 'probable' WHEN event_id % 4 = 2 THEN '' ELSE 'MAYBE' END AS root_cause_type,
  CASE WHEN event_id % 7 = 0 THEN ' ' WHEN event_id % 7 = 1 THEN 'The element was not visible yet' ELSE 'Locator of ' || event_type || ' changed while the button is visible' END AS root_cause,
  CASE WHEN event_id % 6 = 0 THEN 'critical' WHEN event_id % 6 = 1 THEN 'HIGH' WHEN event_id % 6 = 2 THEN 'LOW' WHEN event_id % 6 = 3 THEN 'none' ELSE NULL END AS severity,
  'Check the step' AS recommended_action, 'Use another wait' AS suggested_fix, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'none' END AS similar_patterns,
  CASE WHEN event_id % 3 = 0 THEN 'No screenshot was given' WHEN event_id % 3 = 1 THEN '' ELSE 'Gateway page with 502' END AS screenshot_observation,
  CAST(event_id % 130 - 10 AS INT) AS confidence
FROM events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_events(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_events(spark, sf_dir, FAILURES_SQL)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_events(spark, sf_dir, RESPONSES_SQL)
