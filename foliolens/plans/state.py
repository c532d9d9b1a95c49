"""Queries of state: latest status, sweeps, resets, undo, and event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.plans.registry import query
from foliolens.sources import frames as S
from foliolens.streaming.events import latest_steps, tumbling_counts
from foliolens.sources.frames import with_frames

c = F.col


@query("m3_latest_steps", "SELECT user_id, event_type, max(ts) AS updated, count(*) AS updates FROM events GROUP BY ALL")
def m3(spark, folder):
    return latest_steps(S.table(spark, folder, "events"))


@query("m4_mark_failed", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') AND o_custkey % 10 = 0 THEN 'failed' ELSE o_orderstatus END AS status FROM orders")
def m4(spark, folder):
    return S.table(spark, folder, "orders").select("o_orderkey", F.when(c("o_orderstatus").isin("O", "P") & (c("o_custkey") % 10 == 0), "failed").otherwise(c("o_orderstatus")).alias("status"))


@query("m5_reset_steps", with_frames("job_steps", "SELECT event_id, CASE WHEN step IN ('click', 'view') THEN 'pending' ELSE step END AS status, CASE WHEN step IN ('click', 'view') THEN NULL ELSE started END AS started FROM job_steps"))
def m5(spark, folder):
    again = c("step").isin("click", "view")
    return S.job_steps(spark, folder).select("event_id", F.when(again, "pending").otherwise(c("step")).alias("status"), F.when(~again, c("started")).alias("started"))


@query("m6_abandoned", "SELECT o_orderstatus, count(*) AS swept FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY ALL")
def m6(spark, folder):
    return S.table(spark, folder, "orders").where(c("o_orderstatus").isin("O", "P")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("swept"))


@query("m7_expired", "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30'")
def m7(spark, folder):
    return S.table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen")).where(c("last_seen") < F.lit("2024-01-30").cast("timestamp_ntz"))


@query("u7_not_skipped", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 40 = 0)")
def u7(spark, folder):
    e = S.table(spark, folder, "events")
    return e.join(e.where("event_type = 'error' and event_id % 40 = 0").select("user_id").distinct(), "user_id", "left_anti").select("event_id")


@query("m9_undo", "SELECT conv_id, arg_max(role, turn) FILTER (turn % 3 <> 2) AS state FROM conversations GROUP BY conv_id")
def m9(spark, folder):
    return S.table(spark, folder, "conversations").groupBy("conv_id").agg(F.max_by("role", F.when(c("turn") % 3 != 2, c("turn"))).alias("state"))


@query("m12_unique_keys", "SELECT count(*) AS n, count(DISTINCT doc_id) AS keys, count(*) = count(DISTINCT doc_id) AS is_unique FROM labels")
def m12(spark, folder):
    return S.table(spark, folder, "labels").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("keys"), (F.count(F.lit(1)) == F.count_distinct("doc_id")).alias("is_unique"))


@query("m13_final_status", with_frames("jobs", "SELECT doc_id, CASE WHEN failed THEN 'failed' WHEN compliant AND NOT blocking THEN 'complete' ELSE 'needs_review' END AS status FROM jobs"))
def m13(spark, folder):
    return S.jobs(spark, folder).select("doc_id", F.when(c("failed"), "failed").when(c("compliant") & ~c("blocking"), "complete").otherwise("needs_review").alias("status"))


@query("m15_pending_changes", with_frames("review_tasks", "SELECT task_id, created FROM review_tasks WHERE severity = 'high' AND NOT blocking AND task_type = 'alt_text'"))
def m15(spark, folder):
    return S.review_tasks(spark, folder).where("severity = 'high' and not blocking and task_type = 'alt_text'").select("task_id", "created")


@query("extension_tumbling_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, folder):
    return tumbling_counts(S.table(spark, folder, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")
