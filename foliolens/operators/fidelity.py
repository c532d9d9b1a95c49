"""All checks of a remediated document from its measures, their tasks merged by key, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.operators.drift import merged_tasks

c = F.col

# Limits of the checks.
LEAST_SCANNED_CHARS = 40
LEAST_FRAGMENTS = 8
HIT_RATE_FAIL, HIT_RATE_WARN = 0.40, 0.65
ORDER_RATE_FAIL, ORDER_RATE_WARN = 0.55, 0.85
LEAST_COVERAGE = 0.75

#: Counts that a row of measures may lack or hold as null: 0 then, and below 0.
COUNTS = (
    "remaining_rules", "output_chars", "meaningful_elements", "sampled_pages", "grounded_targets", "fragments", "figures", "tagged_figures", "decorative_figures", "tables", "tagged_tables", "complex_tables", "high_risk_tables",
    "fields", "missing_labels", "weak_labels", "form_errors", "static_widgets", "missing_visuals", "machine_only_alt", "poor_links", "broken_links", "font_errors", "font_targets",
)


def _counts(measures: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return measures.withColumns({k: F.greatest(F.coalesce(c(k), zero), zero) if k in measures.columns else zero for k in COUNTS})


def _status(skip: Column, fail: Column, warn: Column) -> Column:
    return F.when(skip, "skip").when(fail, "fail").when(warn, "warning").otherwise("pass")


def with_checks(measures: DataFrame) -> DataFrame:
    """``measures`` with ``checks``: (check, status) of each of the checks that apply, in a fixed order.

    A row is a document: ``COUNTS`` and classification, visually_blank, drift (the status of
    the comparison of texts, see ``drift.text_drift``; null counts as skipped), hit_rate and
    order_rate. OCR coverage is a check of scanned documents alone.
    """
    no, n = F.lit(False), c
    no_text, no_elements = n("output_chars") < LEAST_SCANNED_CHARS, n("meaningful_elements") == 0
    few, hit, order = n("fragments") < LEAST_FRAGMENTS, F.coalesce("hit_rate", F.lit(0.0)), F.coalesce("order_rate", F.lit(0.0))
    unordered = lambda a, b: ~few & ((hit < a) | (order < b))
    covered = F.least(n("figures"), n("tagged_figures") + n("decorative_figures"))
    blank = (n("sampled_pages") == 0) | F.coalesce("visually_blank", no)
    checks = [
        ("compliance", _status(no, n("remaining_rules") > 0, no)),
        ("ocr_coverage", F.when(n("classification") == "scanned", _status(blank, no_text & no_elements, no_text))),
        ("text_drift", F.coalesce("drift", F.lit("skip"))),
        ("grounded_text_fidelity", _status(no, no, n("grounded_targets") > 0)),
        ("reading_order", _status((n("fragments") == 0) | (n("output_chars") == 0), unordered(HIT_RATE_FAIL, ORDER_RATE_FAIL), unordered(HIT_RATE_WARN, ORDER_RATE_WARN))),
        ("figure_coverage", _status(n("figures") == 0, no, covered < n("figures"))),
        ("table_coverage", _status(n("tables") == 0, no, n("tagged_tables") < n("tables"))),
        ("table_risk", _status(n("tables") == 0, (n("complex_tables") > 0) & (n("high_risk_tables") > 0), n("complex_tables") > 0)),
        ("form_semantics", _status(n("fields") == 0, n("missing_labels") + n("weak_labels") + n("form_errors") > 0, no)),
        ("static_widget_artifacts", _status(no, n("static_widgets") > 0, no)),
        ("visual_meaning_gap", _status(no, n("missing_visuals") > 0, no)),
        ("alt_text_provenance", _status(no, no, n("machine_only_alt") > 0)),
        ("link_text_quality", _status(no, no, n("poor_links") > 0)),
        ("internal_link_destinations", _status(no, no, n("broken_links") > 0)),
        ("font_text_fidelity", _status(no, n("font_errors") + n("font_targets") > 0, no)),
    ]
    rows = F.array(*[F.when(x.isNotNull(), F.struct(F.lit(name).alias("check"), x.alias("status"))) for name, x in checks])
    return _counts(measures).withColumn("checks", F.array_compact(rows))


def check_tasks(checked: DataFrame) -> DataFrame:
    """Rows for ``drift.merged_tasks`` of what ``with_checks`` found, but for text drift, whose tasks are ``drift.drift_tasks``.

    ``place`` orders them after the tasks of rule violations (place below 0, see ``violation_tasks``).
    """
    failed = lambda check: F.exists("checks", lambda x: (x["check"] == check) & (x["status"] == "fail"))
    found = lambda check: F.exists("checks", lambda x: (x["check"] == check) & x["status"].isin("fail", "warning"))
    thin = lambda done, of: F.when(done / of < LEAST_COVERAGE, "high").otherwise("medium")
    by = lambda check: F.when(failed(check), "high").otherwise("medium")
    yes, no = F.lit(True), F.lit(False)
    covered = F.least(c("figures"), c("tagged_figures") + c("decorative_figures"))
    # Keys and titles of the tasks.
    tasks = [
        ("ocr_coverage", "review:content_fidelity", F.when(failed("ocr_coverage"), "Verify OCR text coverage").otherwise("Spot-check OCR text coverage"), by("ocr_coverage"), failed("ocr_coverage"), ("output_chars", "meaningful_elements")),
        ("grounded_text_fidelity", "review:content_fidelity:grounded_text", F.lit("Review suspicious extracted text"), F.lit("medium"), no, ("grounded_targets",)),
        ("reading_order", "review:reading_order", F.when(failed("reading_order"), "Verify reading order").otherwise("Spot-check reading order"), by("reading_order"), failed("reading_order"), ("fragments", "hit_rate", "order_rate")),
        ("figure_coverage", "review:figure_semantics", F.lit("Verify figure semantics"), thin(covered, c("figures")), yes, ("figures", "tagged_figures", "decorative_figures")),
        ("table_coverage", "review:table_semantics", F.lit("Verify table semantics"), thin(c("tagged_tables"), c("tables")), yes, ("tables", "tagged_tables")),
        ("table_risk", "review:table_semantics_risk", F.lit("Review complex table semantics"), by("table_risk"), failed("table_risk"), ("complex_tables", "high_risk_tables")),
        ("form_semantics", "review:form_semantics", F.lit("Verify form field labels"), F.when(c("missing_labels") > 0, "high").otherwise("medium"), yes, ("fields", "missing_labels", "weak_labels", "form_errors")),
        ("static_widget_artifacts", "review:form_semantics:static_widgets", F.lit("Remove static widget artifacts"), F.lit("high"), yes, ("static_widgets",)),
        ("visual_meaning_gap", "review:content_fidelity:visual_meaning_gap", F.lit("Add semantics for meaning-bearing page visuals"), F.lit("high"), yes, ("missing_visuals",)),
        ("alt_text_provenance", "review:alt_text", F.lit("Spot-check generated alt text"), F.lit("medium"), no, ("machine_only_alt",)),
        ("link_text_quality", "review:link_text_quality", F.lit("Review non-descriptive link text"), F.lit("medium"), no, ("poor_links",)),
        ("internal_link_destinations", "review:broken_internal_links", F.lit("Fix broken internal links"), F.lit("medium"), no, ("broken_links",)),
        ("font_text_fidelity", "review:font_text_fidelity", F.lit("Verify accessible text against visible text"), F.lit("high"), yes, ("font_errors", "font_targets")),
    ]
    rows = F.array(*[
        F.when(found(check), F.struct(
            F.lit(10 + i).alias("place"), F.lit(key).alias("key"), title.alias("title"), severity.alias("severity"), blocking.alias("blocking"),
            F.map_filter(F.create_map(*[x for k in said for x in (F.lit(k), c(k).cast("string"))]), lambda _, v: v.isNotNull()).alias("metadata")))
        for i, (check, key, title, severity, blocking, said) in enumerate(tasks)])
    return checked.select("doc", F.inline(F.array_compact(rows)))


def violation_tasks(violations: DataFrame) -> DataFrame:
    """Rows for ``drift.merged_tasks``: a blocking task of high severity for each kind of task that errors of ``violations`` ask for.

    ``violations`` is (doc, pos, severity, rule_id, count, task_type, title); the first of a
    kind gives the title. A count below 1 is 1. Rules are named in order, each once. ``place`` is below 0.
    """
    errors = violations.where("severity = 'error'")
    count = F.greatest(F.coalesce("count", F.lit(1)), F.lit(1))
    rule = F.nullif(F.trim("rule_id"), F.lit(""))
    rules = F.array_sort(F.collect_set(rule))
    grouped = errors.groupBy("doc", "task_type").agg(F.min_by("title", "pos").alias("title"), F.sum(count).alias("n"), rules.alias("rules"))
    return grouped.select(
        "doc", F.concat(F.lit("review:"), "task_type").alias("key"), F.lit(-1).alias("place"), "title", F.lit("high").alias("severity"), F.lit(True).alias("blocking"),
        F.create_map(F.lit("count"), c("n").cast("string"), F.lit("rules"), F.array_join("rules", ",")).alias("metadata"))


def verdicts(documents: DataFrame, *tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tasks of a document merged by key, and (doc, passed, blocking_tasks, advisory_tasks, total_tasks) of each of ``documents`` (doc).

    A document passes if no task blocks it.
    """
    rows = tasks[0]
    for more in tasks[1:]:
        rows = rows.unionByName(more)
    merged = merged_tasks(rows)
    counted = merged.groupBy("doc").agg(F.count_if("blocking").alias("b"), F.count(F.lit(1)).alias("n"))
    b, n = F.coalesce("b", F.lit(0)), F.coalesce("n", F.lit(0))
    return merged, documents.select("doc").join(counted, "doc", "left").select("doc", (b == 0).alias("passed"), b.alias("blocking_tasks"), (n - b).alias("advisory_tasks"), n.alias("total_tasks"))
