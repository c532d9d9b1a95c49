"""Queries of aggregation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.functions import text as T
from foliolens.plans.registry import query
from foliolens.sources import frames as S
from foliolens.sources.frames import with_frames

c = F.col


def rule_backlog(violations):
    """Errors and documents of each rule; documents as user:errors, most errors first, then by id."""
    per_doc = violations.groupBy("rule_id", "doc").agg(F.sum("count").alias("errors"))
    return per_doc.groupBy("rule_id").agg(
        F.sum("errors").alias("total_errors"), F.count(F.lit(1)).alias("documents_affected"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-c("errors")).alias("e"), "doc"))), lambda x: F.concat_ws(":", x["doc"].cast("string"), (-x["e"]).cast("string"))), ",").alias("documents"))


@query("g1_rule_backlog", with_frames("violations", """SELECT rule_id, sum(errors)::BIGINT AS total_errors, count(*) AS documents_affected,
    string_agg(doc::VARCHAR || ':' || errors::VARCHAR, ',' ORDER BY errors DESC, doc) AS documents
    FROM (SELECT rule_id, doc, sum(count)::BIGINT AS errors FROM violations GROUP BY ALL) GROUP BY rule_id"""))
def g1(spark, folder):
    return rule_backlog(S.violations(spark, folder))


@query("s6_rule_scan", "SELECT event_type, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL AND props <> ''")
def s6(spark, folder):
    return S.table(spark, folder, "events").where("props is not null and props <> ''").select("event_type", F.get_json_object("props", "$.k").alias("k"))


@query("g2_review_backlog", with_frames("review_tasks", """SELECT task_type, source, blocking, count(*) AS occurrences, count(DISTINCT job_id) AS documents_affected,
    arg_min(severity, task_id) AS first_severity FROM review_tasks GROUP BY ALL"""))
def g2(spark, folder):
    per_doc = S.review_tasks(spark, folder).groupBy("task_type", "source", "blocking", "job_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("task_id", "severity")).alias("first"))
    return per_doc.groupBy("task_type", "source", "blocking").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents_affected"), F.min("first")["severity"].alias("first_severity"))


@query("g3_aggregate_violations", with_frames("violations", """SELECT rule_id, sum(count)::BIGINT AS total, CASE WHEN bool_or(severity = 'error') THEN 'error' ELSE 'warning' END AS severity,
    arg_min(description, event_id) AS description, arg_min(doc, event_id) FILTER (doc % 7 = 3) AS location FROM violations GROUP BY rule_id"""))
def g3(spark, folder):
    return S.violations(spark, folder).groupBy("rule_id").agg(
        F.sum("count").alias("total"), F.when(F.bool_or(c("severity") == "error"), "error").otherwise("warning").alias("severity"),
        F.min_by("description", "event_id").alias("description"), F.min_by("doc", F.when(c("doc") % 7 == 3, c("event_id"))).alias("location"))


@query("g4_weighted_errors", with_frames("violations", "SELECT doc, coalesce(sum(count) FILTER (severity = 'error'), 0)::BIGINT AS errors, coalesce(sum(count) FILTER (severity = 'warning'), 0)::BIGINT AS warnings FROM violations GROUP BY doc"))
def g4(spark, folder):
    of = lambda s: F.coalesce(F.sum(F.when(c("severity") == s, c("count"))), F.lit(0))
    return S.violations(spark, folder).groupBy("doc").agg(of("error").alias("errors"), of("warning").alias("warnings"))


@query("g49_error_count", with_frames("violations", "SELECT doc, count(*) FILTER (severity = 'error') AS errors FROM violations GROUP BY doc"))
def g49(spark, folder):
    return S.violations(spark, folder).groupBy("doc").agg(F.count_if(c("severity") == "error").alias("errors"))


_CUT = "2024-01-16"


@query("g5_validation_payload", with_frames("violations", f"""SELECT doc, count(*) FILTER (ts < TIMESTAMP '{_CUT}') AS before, count(*) FILTER (ts >= TIMESTAMP '{_CUT}') AS after,
    count(*) FILTER (ts < TIMESTAMP '{_CUT}') - count(*) FILTER (ts >= TIMESTAMP '{_CUT}') AS resolved, count(DISTINCT rule_id) FILTER (ts >= TIMESTAMP '{_CUT}') AS rules_left,
    coalesce(sum(count) FILTER (ts < TIMESTAMP '{_CUT}' AND severity = 'error'), 0)::BIGINT AS errors_before, coalesce(sum(count) FILTER (ts >= TIMESTAMP '{_CUT}' AND severity = 'error'), 0)::BIGINT AS errors_after,
    count(*) FILTER (ts >= TIMESTAMP '{_CUT}' AND severity = 'error') = 0 AS compliant FROM violations GROUP BY doc"""))
def g5(spark, folder):
    early = c("ts") < F.lit(_CUT).cast("timestamp_ntz")
    error = c("severity") == "error"
    total = lambda p: F.coalesce(F.sum(F.when(p, c("count"))), F.lit(0))
    return S.violations(spark, folder).groupBy("doc").agg(
        F.count_if(early).alias("before"), F.count_if(~early).alias("after"), (F.count_if(early) - F.count_if(~early)).alias("resolved"),
        F.count_distinct(F.when(~early, c("rule_id"))).alias("rules_left"), total(early & error).alias("errors_before"), total(~early & error).alias("errors_after"),
        (F.count_if(~early & error) == 0).alias("compliant"))


@query("g6_group_rows", with_frames("jobs", "SELECT CASE WHEN lang = 'en' THEN 'unspecified' ELSE lang END AS family, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM jobs GROUP BY ALL"))
def g6(spark, folder):
    return S.jobs(spark, folder).groupBy(F.coalesce(F.nullif(F.when(c("lang") == "en", "").otherwise(c("lang")), F.lit("")), F.lit("unspecified")).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("g7_invariants", with_frames("jobs", """SELECT unnest(['compliant', 'failed', 'long', 'not_blocking', 'release_ready']) AS invariant,
    unnest([count(*) FILTER (compliant), count(*) FILTER (failed), count(*) FILTER (n_chars > 2000), count(*) FILTER (NOT blocking), count(*) FILTER (compliant AND NOT blocking)]) AS passed, count(*) AS total FROM jobs"""))
def g7(spark, folder):
    one = S.jobs(spark, folder).agg(
        F.count_if("compliant").alias("compliant"), F.count_if("failed").alias("failed"), F.count_if(c("n_chars") > 2000).alias("long"), F.count_if(~c("blocking")).alias("not_blocking"),
        F.count_if(c("compliant") & ~c("blocking")).alias("release_ready"), F.count(F.lit(1)).alias("total"))
    return one.unpivot("total", ["compliant", "failed", "long", "not_blocking", "release_ready"], "invariant", "passed")


@query("g8_mean", with_frames("jobs", "SELECT source, round(avg(CASE WHEN failed THEN NULL ELSE n_chars END), 4) AS mean_chars FROM jobs GROUP BY source"))
def g8(spark, folder):
    return S.jobs(spark, folder).groupBy("source").agg(F.round(F.avg(F.when(~c("failed"), c("n_chars"))), 4).alias("mean_chars"))


@query("g9_type_counts", with_frames("page_elements", "SELECT type, count(*) AS n FROM page_elements GROUP BY type"))
def g9(spark, folder):
    return S.page_elements(spark, folder).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


_TYPES = ("title", "heading", "paragraph", "list_item", "table", "figure", "toc_item", "code")


@query("g10_type_metrics", with_frames("page_elements", f"""SELECT type, coalesce(gold, 0) AS gold, coalesce(candidate, 0) AS candidate, least(coalesce(gold, 0), coalesce(candidate, 0)) AS matched,
    CASE WHEN coalesce(gold, 0) = 0 THEN 1.0::DOUBLE ELSE round(least(gold, coalesce(candidate, 0)) / gold::DOUBLE, 4) END AS recall, greatest(coalesce(candidate, 0) - coalesce(gold, 0), 0) AS surplus
    FROM (SELECT unnest({list(_TYPES)}) AS type) LEFT JOIN (SELECT type, count(*) AS gold FROM page_elements WHERE doc % 2 = 0 GROUP BY 1) USING (type) LEFT JOIN (SELECT type, count(*) AS candidate FROM page_elements WHERE doc % 2 = 1 GROUP BY 1) USING (type)"""))
def g10(spark, folder):
    both = S.page_elements(spark, folder).groupBy("type").agg(F.count_if(c("doc") % 2 == 0).alias("gold"), F.count_if(c("doc") % 2 == 1).alias("candidate"))
    types = spark.createDataFrame([(t,) for t in _TYPES], "type string")
    g, k = F.coalesce("gold", F.lit(0)), F.coalesce("candidate", F.lit(0))
    return types.join(both, "type", "left").select(
        "type", g.alias("gold"), k.alias("candidate"), F.least(g, k).alias("matched"), F.when(g == 0, 1.0).otherwise(F.round(F.least(g, k) / g, 4)).alias("recall"), F.greatest(k - g, F.lit(0)).alias("surplus"))


@query("g14_font_targets", with_frames("violations", """SELECT rule_id, page, font, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, doc % 5 AS page, doc % 3 AS font FROM violations WHERE severity = 'error')
    GROUP BY ALL ORDER BY n DESC, rule_id, page, font LIMIT 12"""))
def g14(spark, folder):
    grouped = S.violations(spark, folder).where("severity = 'error'").groupBy("rule_id", (c("doc") % 5).alias("page"), (c("doc") % 3).alias("font")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))
    return grouped.orderBy(F.desc("n"), "rule_id", "page", "font").limit(12)


@query("g15_group_targets", with_frames("violations", "SELECT rule_id, doc % 3 AS font, count(*) AS n, array_to_string(list_sort(list(DISTINCT doc % 5)), ',') AS pages FROM violations GROUP BY ALL"))
def g15(spark, folder):
    return S.violations(spark, folder).groupBy("rule_id", (c("doc") % 3).alias("font")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(c("doc") % 5)), ",").alias("pages"))


@query("g16_table_risk", with_frames("table_cells", """SELECT tbl, cells, spans, header_rows, score, score >= 2.5 AS high_risk FROM (SELECT *,
    (CASE WHEN spans THEN 1.0 ELSE 0 END + CASE WHEN header_rows > 1 THEN 1.0 ELSE 0 END + CASE WHEN header_rows = 0 THEN 1.5 ELSE 0 END + CASE WHEN filled < greatest(4, cells * 0.35) THEN 0.5 ELSE 0 END)::DOUBLE AS score
    FROM (SELECT tbl, count(*) AS cells, bool_or(col_span > 1) AS spans, count(DISTINCT "row") FILTER (q > 40) AS header_rows, count(*) FILTER (q > 10) AS filled FROM table_cells GROUP BY tbl)) WHERE score > 0"""))
def g16(spark, folder):
    per = S.table_cells(spark, folder).groupBy("tbl").agg(
        F.count(F.lit(1)).alias("cells"), F.bool_or(c("col_span") > 1).alias("spans"), F.count_distinct(F.when(c("q") > 40, c("row"))).alias("header_rows"), F.count_if(c("q") > 10).alias("filled"))
    part = lambda p, v: F.when(p, v).otherwise(0.0)
    score = part(c("spans"), 1.0) + part(c("header_rows") > 1, 1.0) + part(c("header_rows") == 0, 1.5) + part(c("filled") < F.greatest(F.lit(4.0), c("cells") * 0.35), 0.5)
    return per.withColumn("score", score).where("score > 0").select("tbl", "cells", "spans", "header_rows", "score", (c("score") >= 2.5).alias("high_risk"))


@query("g17_form_risk", "SELECT c_nationkey, count(*) FILTER (c_custkey % 3 = 0) AS missing, count(*) FILTER (c_custkey % 3 = 1) AS weak FROM customer GROUP BY ALL")
def g17(spark, folder):
    label = F.when(c("c_custkey") % 3 == 0, F.lit("")).when(c("c_custkey") % 3 == 1, F.lit("f_1")).otherwise(c("c_mktsegment"))
    rated = S.table(spark, folder, "customer").select("c_nationkey", T.label_quality(label, c("c_name")).alias("quality"))
    return rated.groupBy("c_nationkey").agg(F.count_if(c("quality") == "missing").alias("missing"), F.count_if(c("quality") == "weak").alias("weak"))


@query("g18_meaningful_elements", with_frames("page_elements", "SELECT doc, count(*) FILTER (type IN ('heading', 'paragraph', 'list_item')) AS n FROM page_elements GROUP BY doc"))
def g18(spark, folder):
    return S.page_elements(spark, folder).groupBy("doc").agg(F.count_if(c("type").isin("heading", "paragraph", "list_item")).alias("n"))


@query("g19_task_merge", with_frames("review_tasks", """SELECT job_id, task_type, max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)::INT AS severity_rank, bool_or(blocking) AS blocking, count(*) AS merged FROM review_tasks GROUP BY ALL"""))
def g19(spark, folder):
    rank = F.when(c("severity") == "high", 3).when(c("severity") == "medium", 2).otherwise(1)
    return S.review_tasks(spark, folder).groupBy("job_id", "task_type").agg(F.max(rank).alias("severity_rank"), F.bool_or("blocking").alias("blocking"), F.count(F.lit(1)).alias("merged"))


@query("g20_fidelity_summary", with_frames("review_tasks", "SELECT job_id, count(*) FILTER (blocking) AS blocking_tasks, count(*) FILTER (NOT blocking) AS advisory_tasks, count(*) AS total, count(*) FILTER (blocking) = 0 AS passed FROM review_tasks GROUP BY ALL"))
def g20(spark, folder):
    return S.review_tasks(spark, folder).groupBy("job_id").agg(
        F.count_if("blocking").alias("blocking_tasks"), F.count_if(~c("blocking")).alias("advisory_tasks"), F.count(F.lit(1)).alias("total"), (F.count_if("blocking") == 0).alias("passed"))


@query("g22_usage_sum", with_frames("usage", "SELECT user_id, count(*) AS requests, sum(tokens)::BIGINT AS tokens, sum(cost_cents)::BIGINT AS cost_cents FROM usage GROUP BY ALL"))
def g22(spark, folder):
    return S.usage(spark, folder).groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost_cents").alias("cost_cents"))


@query("g23_usage_clamped", with_frames("usage", "SELECT model, count(*) AS requests, sum(greatest(tokens - 50, 0))::BIGINT AS tokens FROM usage GROUP BY ALL"))
def g23(spark, folder):
    return S.usage(spark, folder).groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.greatest(c("tokens") - 50, F.lit(0))).alias("tokens"))


_PRICES = [("click", 10, 2, 30), ("view", 5, 1, 20), ("purchase", 20, 4, 60)]


@query("g24_estimated_cost", with_frames("usage", """SELECT model, sum((tokens - tokens // 4) * p_in + (tokens // 4) * p_cache + cost_cents * p_out)::BIGINT AS micro_usd
    FROM usage JOIN (VALUES ('click', 10, 2, 30), ('view', 5, 1, 20), ('purchase', 20, 4, 60)) AS p(model, p_in, p_cache, p_out) USING (model) GROUP BY model"""))
def g24(spark, folder):
    prices = F.broadcast(spark.createDataFrame(_PRICES, "model string, p_in int, p_cache int, p_out int"))  # a fixed list
    cached = F.floor(c("tokens") / 4)
    cost = (c("tokens") - cached) * c("p_in") + cached * c("p_cache") + c("cost_cents") * c("p_out")
    return S.usage(spark, folder).join(prices, "model").groupBy("model").agg(F.sum(cost).cast("bigint").alias("micro_usd"))


@query("g25_document_language", f"""SELECT source, arg_max(lang, {{'w': w, 'd': len(lang) - len(replace(lang, '-', '')), 'n': len(lang), 'l': lang}}) AS lang FROM (
    SELECT source, lang, sum(greatest(CASE WHEN trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g')), ' ')) END, 1)) AS w FROM documents GROUP BY ALL) GROUP BY source""")
def g25(spark, folder):
    words = S.table(spark, folder, "documents").groupBy("source", "lang").agg(F.sum(F.greatest(T.word_count(c("text")), F.lit(1))).alias("w"))
    return words.groupBy("source").agg(F.max(F.struct("w", F.size(F.split("lang", "-")).alias("d"), F.length("lang").alias("n"), "lang"))["lang"].alias("lang"))


@query("g26_page_profile", with_frames("blocks", "SELECT page, count(*) AS block_count, sum(length(text))::BIGINT AS text_chars, count(*) FILTER (length(text) <= 42) AS short_blocks, count(*) FILTER (length(text) >= 90) AS long_blocks FROM blocks WHERE trim(text) <> '' AND role <> 'system' GROUP BY page"))
def g26(spark, folder):
    return S.blocks(spark, folder).where("trim(text) <> '' and role <> 'system'").groupBy("page").agg(
        F.count(F.lit(1)).alias("block_count"), F.sum(F.length("text")).alias("text_chars"), F.count_if(F.length("text") <= 42).alias("short_blocks"), F.count_if(F.length("text") >= 90).alias("long_blocks"))


@query("g27_dominant_region", with_frames("boxes", "SELECT page, arg_max(box, {'a': a, 'i': -box}) AS box, round(max(a) / sum(a), 6) AS share FROM (SELECT *, (r - l) * (t - b) AS a FROM boxes) GROUP BY page"))
def g27(spark, folder):
    a = S.boxes(spark, folder).withColumn("a", (c("r") - c("l")) * (c("t") - c("b")))
    return a.groupBy("page").agg(F.max_by("box", F.struct("a", -c("box"))).alias("box"), F.round(F.max("a") / F.sum("a"), 6).alias("share"))


@query("g33_best_label", with_frames("review_tasks", "SELECT job_id, arg_max(severity, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS best FROM review_tasks GROUP BY ALL"))
def g33(spark, folder):
    return S.review_tasks(spark, folder).groupBy("job_id").agg(F.max_by("severity", F.when(c("severity") == "high", 3).when(c("severity") == "medium", 2).otherwise(1)).alias("best"))


@query("g37_confirmed_blocks", "SELECT c_nationkey, sum(coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 10 END, CASE WHEN c_custkey % 3 = 1 THEN 2 END, 1))::BIGINT AS n FROM customer GROUP BY ALL")
def g37(spark, folder):
    n = F.coalesce(F.when(c("c_custkey") % 3 == 0, c("c_custkey") % 10), F.when(c("c_custkey") % 3 == 1, F.lit(2)), F.lit(1))
    return S.table(spark, folder, "customer").groupBy("c_nationkey").agg(F.sum(n).alias("n"))


@query("g38_blocking_tasks", with_frames("review_tasks", "SELECT count(*) FILTER (blocking) AS n FROM review_tasks"))
def g38(spark, folder):
    return S.review_tasks(spark, folder).agg(F.count_if("blocking").alias("n"))


@query("g40_month_ledger", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS used FROM events GROUP BY ALL")
def g40(spark, folder):
    return S.table(spark, folder, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("used"))


@query("g41_month_quota", "SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS used FROM events GROUP BY ALL HAVING count(*) + 10 > 80")
def g41(spark, folder):
    return S.table(spark, folder, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("used")).where("used + 10 > 80")


@query("g43_text_chars", with_frames("blocks", "SELECT page, sum(length(text) + length(role))::BIGINT AS chars FROM blocks GROUP BY page"))
def g43(spark, folder):
    return S.blocks(spark, folder).groupBy("page").agg(F.sum(F.length("text") + F.length("role")).alias("chars"))


@query("g44_slice_counts", with_frames("blocks", "SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM blocks WHERE page < 20 GROUP BY role"))
def g44(spark, folder):
    return S.blocks(spark, folder).where("page < 20").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("g45_active_jobs", "SELECT o_custkey AS session, count(*) AS active FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY ALL")
def g45(spark, folder):
    return S.table(spark, folder, "orders").where(c("o_orderstatus").isin("O", "P")).groupBy(c("o_custkey").alias("session")).agg(F.count(F.lit(1)).alias("active"))


@query("g46_step_durations", with_frames("job_steps", "SELECT job_id, step, count(*) AS n, sum(greatest(coalesce(epoch_us(completed) - epoch_us(started), 0), 0))::BIGINT AS micros FROM job_steps GROUP BY ALL"))
def g46(spark, folder):
    took = F.greatest(F.coalesce(F.timestamp_diff("MICROSECOND", c("started"), c("completed")), F.lit(0)), F.lit(0))
    return S.job_steps(spark, folder).groupBy("job_id", "step").agg(F.count(F.lit(1)).alias("n"), F.sum(took).alias("micros"))


@query("g47_safe_ratio", with_frames("jobs", "SELECT source, CASE WHEN count(*) FILTER (NOT failed) <= 0 THEN 1.0::DOUBLE ELSE round(count(*) FILTER (compliant) / (count(*) FILTER (NOT failed))::DOUBLE, 6) END AS ratio FROM jobs GROUP BY source"))
def g47(spark, folder):
    done = F.count_if(~c("failed"))
    return S.jobs(spark, folder).groupBy("source").agg(F.when(done <= 0, 1.0).otherwise(F.round(F.count_if("compliant") / F.nullif(done, F.lit(0)), 6)).alias("ratio"))


@query("g48_column_consistency", with_frames("table_cells", 'SELECT tbl, min(s) = max(s) AS consistent FROM (SELECT tbl, "row", sum(col_span) AS s FROM table_cells GROUP BY ALL) GROUP BY tbl'))
def g48(spark, folder):
    rows = S.table_cells(spark, folder).groupBy("tbl", "row").agg(F.sum("col_span").alias("s"))
    return rows.groupBy("tbl").agg((F.min("s") == F.max("s")).alias("consistent"))


@query("s9_kpi_report", with_frames("jobs", """SELECT count(*) AS total, count(*) FILTER (NOT failed) AS completed, count(*) FILTER (failed) AS failed, count(*) FILTER (compliant) AS compliant,
    count(*) FILTER (compliant AND NOT blocking) AS release_ready, count(*) FILTER (NOT failed AND NOT compliant) AS gaps, sum(n_chars)::BIGINT AS chars,
    round(avg(n_chars), 4) AS mean_chars, quantile_cont(n_chars, 0.5) AS median_chars FROM jobs"""))
def s9(spark, folder):
    return S.jobs(spark, folder).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~c("failed")).alias("completed"), F.count_if("failed").alias("failed"), F.count_if("compliant").alias("compliant"),
        F.count_if(c("compliant") & ~c("blocking")).alias("release_ready"), F.count_if(~c("failed") & ~c("compliant")).alias("gaps"), F.sum("n_chars").alias("chars"),
        F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.percentile("n_chars", 0.5).alias("median_chars"))


@query("s10_rollups", with_frames("jobs", "SELECT lang, source, count(*) AS n, count(*) FILTER (compliant) AS compliant FROM jobs GROUP BY GROUPING SETS ((lang), (source), ())"))
def s10(spark, folder):
    S.jobs(spark, folder).createOrReplaceTempView("_rollup_jobs")
    return spark.sql("SELECT lang, source, count(*) AS n, count_if(compliant) AS compliant FROM _rollup_jobs GROUP BY GROUPING SETS ((lang), (source), ())")


@query("s11_rule_matrix", with_frames("violations", "SELECT severity, rule_id, n, rank FROM (SELECT severity, rule_id, n, (row_number() OVER (PARTITION BY severity ORDER BY n DESC, rule_id))::INT AS rank FROM (SELECT severity, rule_id, count(*) AS n FROM violations GROUP BY ALL)) WHERE rank <= 15"))
def s11(spark, folder):
    from pyspark.sql import Window

    counts = S.violations(spark, folder).groupBy("severity", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("severity").orderBy(F.desc("n"), "rule_id"))).where("rank <= 15")


@query("s14_strip_counters", "SELECT count(*) FILTER (lang IS NOT NULL) AS langs_removed, count(*) FILTER (source IS NOT NULL) AS sources_removed, count(*) AS n FROM documents")
def s14(spark, folder):
    return S.table(spark, folder, "documents").agg(F.count_if(c("lang").isNotNull()).alias("langs_removed"), F.count_if(c("source").isNotNull()).alias("sources_removed"), F.count(F.lit(1)).alias("n"))


@query("p12_page_fold", "SELECT source, max(n_chars) AS largest, sum(n_chars)::BIGINT AS total, count(*) FILTER (n_chars > 3000) AS heavy FROM documents GROUP BY source")
def p12(spark, folder):
    return S.table(spark, folder, "documents").groupBy("source").agg(F.max("n_chars").alias("largest"), F.sum("n_chars").alias("total"), F.count_if(c("n_chars") > 3000).alias("heavy"))


@query("p40_lane_plan", with_frames("blocks", "SELECT role, count(*) AS candidates, CASE WHEN count(*) FILTER (length(text) < 60) > 0 THEN 'escalate' ELSE 'keep' END AS decision, coalesce(array_to_string(list_sort(list(DISTINCT page) FILTER (length(text) < 60)), ','), '') AS pages FROM blocks GROUP BY role"))
def p40(spark, folder):
    short = F.length("text") < 60
    return S.blocks(spark, folder).groupBy("role").agg(
        F.count(F.lit(1)).alias("candidates"), F.when(F.count_if(short) > 0, "escalate").otherwise("keep").alias("decision"), F.array_join(F.array_sort(F.collect_set(F.when(short, c("page")))), ",").alias("pages"))


@query("u1_rule_keys", with_frames("violations", f"SELECT rule_id FROM violations WHERE ts < TIMESTAMP '{_CUT}' UNION SELECT rule_id FROM violations WHERE ts >= TIMESTAMP '{_CUT}'"))
def u1(spark, folder):
    return S.violations(spark, folder).select("rule_id").distinct()


@query("u2_valid_indexes", with_frames("blocks", "SELECT DISTINCT pos FROM blocks WHERE pos >= 0"))
def u2(spark, folder):
    return S.blocks(spark, folder).where("pos >= 0").select("pos").distinct()


@query("u6_issue_types", with_frames("review_tasks", "SELECT job_id, array_to_string(list_sort(list(DISTINCT task_type)), ',') AS kinds FROM review_tasks GROUP BY job_id"))
def u6(spark, folder):
    return S.review_tasks(spark, folder).groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_set("task_type")), ",").alias("kinds"))


@query("frontend_by_category", with_frames("violations", "SELECT severity AS category, sum(count)::BIGINT AS total FROM violations GROUP BY severity"))
def frontend(spark, folder):
    return S.violations(spark, folder).groupBy(c("severity").alias("category")).agg(F.sum("count").alias("total"))
