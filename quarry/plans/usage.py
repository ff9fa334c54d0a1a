"""Queries over the usage log."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.operators import usage as U
from quarry.plans.tables import kb

_COUNTS = "count(*) AS calls, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses"


@query("a01_hit_stats", """SELECT doc_id, count(*) AS served, count(*) FILTER (outcome = 'hit' AND score >= 5) AS hits
FROM (SELECT unnest(served) AS doc_id, outcome, score FROM usage) GROUP BY doc_id""")
def a01(spark, d):
    return U.hit_stats(kb(spark, d, "usage"))


@query("a02_usage_totals", """SELECT count(*) AS total, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses,
count(DISTINCT CAST(ts AS DATE)) AS days, round(avg(score), 6) AS avg_score FROM usage""")
def a02_totals(spark, d):
    return U.usage_totals(kb(spark, d, "usage"))


@query("a02_by_tool", f"SELECT tool_name, {_COUNTS} FROM usage GROUP BY tool_name")
def a02_tool(spark, d):
    return U.usage_by(kb(spark, d, "usage"), "tool_name")


@query("a02_by_day", f"SELECT CAST(ts AS DATE) AS day, {_COUNTS} FROM usage GROUP BY day ORDER BY day DESC LIMIT 20")
def a02_day(spark, d):
    return U.usage_by_day(kb(spark, d, "usage"), 20)


@query("a02_window", """SELECT tool_name, count(*) AS calls, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses FROM usage
WHERE ts >= TIMESTAMP '2024-01-13 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY tool_name""")
def a02_window(spark, d):
    return U.usage_by(U.since(kb(spark, d, "usage"), "2024-01-20 00:00:00", 7), "tool_name")


@query("a02_score_hist", "SELECT score, count(*) AS n FROM usage WHERE score BETWEEN 1 AND 10 GROUP BY score")
def a02_hist(spark, d):
    return U.score_histogram(kb(spark, d, "usage"))


@query("a02_median", "SELECT s[CAST(floor(len(s) / 2) AS BIGINT) + 1] AS median_score FROM (SELECT list(score ORDER BY score) AS s FROM usage WHERE score IS NOT NULL)")
def a02_median(spark, d):
    return U.upper_median_score(kb(spark, d, "usage"))


@query("a02_feedback", "SELECT id, feedback FROM usage WHERE feedback IS NOT NULL ORDER BY ts DESC, id DESC LIMIT 20")
def a02_feedback(spark, d):
    return U.recent_feedback(kb(spark, d, "usage"))


@query("a04_gap_report", """WITH m AS (SELECT *, row_number() OVER (PARTITION BY feedback ORDER BY ts, id) AS r FROM usage WHERE feedback IS NOT NULL AND outcome = 'miss')
SELECT feedback, count(*) AS n, max(ts) AS last_seen, string_agg(CASE WHEN r <= 5 THEN query END, ',' ORDER BY r) AS queries
FROM m GROUP BY feedback ORDER BY n DESC, feedback LIMIT 20""")
def a04(spark, d):
    return U.gap_report(kb(spark, d, "usage"))


@query("a05_low_score_reasons", """WITH l AS (SELECT id, score, trim(regexp_extract(feedback, '^score:[0-9]+ - (.*)$', 1)) AS reason
FROM usage WHERE score <= 5 AND feedback IS NOT NULL ORDER BY id DESC LIMIT 200)
SELECT * FROM l WHERE length(reason) >= 15 AND lower(reason) NOT IN ('bad', 'wrong', 'not useful', 'irrelevant answer')""")
def a05(spark, d):
    return U.low_score_reasons(kb(spark, d, "usage"))


@query("a06_usage_by_doc", """SELECT u.id, served, coalesce(title, '(deleted)') AS title FROM
(SELECT id, count(*) AS served FROM (SELECT unnest(served) AS id FROM usage) GROUP BY id ORDER BY served DESC, id LIMIT 20) u LEFT JOIN docs ON docs.id = u.id""")
def a06(spark, d):
    return U.usage_by_document(kb(spark, d, "usage"), kb(spark, d, "docs"))


@query("a07_low_value", """SELECT id, served FROM (SELECT id, count(*) AS served, count(*) FILTER (outcome = 'hit') AS hits
FROM (SELECT unnest(served) AS id, outcome FROM usage WHERE tool_name <> 'purchase' OR id % 2 = 0) GROUP BY id) WHERE served >= 5 AND hits = 0 AND id IN (SELECT id FROM docs)""")
def a07(spark, d):
    return U.low_value_documents(kb(spark, d, "usage").where("tool_name <> 'purchase' or id % 2 = 0"), kb(spark, d, "docs"))


@query("a08_near_misses", """SELECT word, count(*) AS weight FROM (SELECT unnest(regexp_extract_all(lower(feedback), '[a-z0-9]+')) AS word FROM usage
WHERE outcome = 'miss' AND feedback IS NOT NULL) WHERE length(word) > 3 GROUP BY word ORDER BY weight DESC, word LIMIT 10""")
def a08(spark, d):
    return U.near_misses(kb(spark, d, "usage"))


@query("a09_trends", """SELECT *, round(CASE WHEN hits + misses > 0 THEN hits / (hits + misses) ELSE 0 END, 6) AS hit_rate FROM
(SELECT CAST(ts AS DATE) AS day, count(*) AS calls, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses FROM usage GROUP BY day)""")
def a09(spark, d):
    return U.trends(kb(spark, d, "usage"))


@query("a10_roi", """SELECT minutes, round(cost, 6) AS cost, round(minutes / cost, 6) AS ratio FROM (SELECT CAST(5.0 AS DOUBLE) * count(*) FILTER (outcome = 'hit')
 - CAST(1.0 AS DOUBLE) * count(*) FILTER (outcome = 'miss') AS minutes, count(*) * CAST(0.01 AS DOUBLE) AS cost FROM usage)""")
def a10(spark, d):
    return U.estimate_roi(kb(spark, d, "usage"))


@query("a20_user_rollup", """SELECT query AS actor, count(*) AS questions, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses,
arg_max(tool_name, id) AS name FROM usage GROUP BY query""")
def a20(spark, d):
    return U.per_user(kb(spark, d, "usage").select(F.col("query").alias("actor"), "outcome", F.col("tool_name").alias("name"), F.col("id").alias("pos")))


@query("a21_mean_tokens", "SELECT tool_name, outcome, round(avg(score), 6) AS mean, count(*) AS n FROM usage GROUP BY tool_name, outcome")
def a21(spark, d):
    return U.mean_tokens(kb(spark, d, "usage"), ["tool_name", "outcome"], "score")


@query("a24_snapshot", """WITH t AS (SELECT count(*) AS n, count(*) FILTER (outcome = 'hit') AS h, count(*) FILTER (outcome = 'miss') AS m FROM usage),
d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (outcome = 'hit') AS h, count(*) FILTER (outcome = 'miss') AS m FROM usage GROUP BY 1 ORDER BY day DESC LIMIT 90),
j AS (SELECT string_agg('{"day":"' || day || '","calls":' || n || ',"hits":' || h || ',"misses":' || m || '}', ',' ORDER BY day) AS by_day FROM d)
SELECT '{"total":' || n || ',"hits":' || h || ',"misses":' || m || ',"by_day":[' || by_day || ']}' AS report FROM t, j""")
def a24(spark, d):
    return U.snapshot(kb(spark, d, "usage"))
