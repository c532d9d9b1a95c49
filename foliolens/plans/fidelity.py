"""Queries of the whole fidelity report, with SQL of their own: parts as documents with measures, events as violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.operators import fidelity as O
from foliolens.plans.registry import query
from foliolens.sources import frames as S

c = F.col

# Measures of a part by its key (k) and size (z): the same words in either engine, "//" apart.
_MEASURES = {
    "remaining_rules": "z % 6 - 4", "output_chars": "z % 9 * 20", "meaningful_elements": "k % 4", "sampled_pages": "k % 7", "grounded_targets": "z % 8 - 6", "fragments": "z % 13", "figures": "k % 5", "tagged_figures": "z % 4", "decorative_figures": "k % 2",
    "tables": "z % 5", "tagged_tables": "k % 6", "complex_tables": "k % 3", "high_risk_tables": "z % 3 - 1", "fields": "z % 4", "missing_labels": "k % 6 - 4", "weak_labels": "z % 7 - 5", "form_errors": "k % 9 - 7", "static_widgets": "z % 12 - 10",
    "missing_visuals": "k % 11 - 9", "machine_only_alt": "z % 3 - 1", "poor_links": "k % 8 - 5", "broken_links": "z % 10 - 7", "font_errors": "k % 13 - 11", "font_targets": "z % 14 - 12",
}
_MORE = {
    "classification": "CASE WHEN k % 3 = 0 THEN 'scanned' ELSE 'digital' END", "visually_blank": "CASE k % 5 WHEN 0 THEN true WHEN 1 THEN false END",
    "drift": "CASE z % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'warning' WHEN 2 THEN 'pass' WHEN 3 THEN 'skip' END", "hit_rate": "CAST(k % 11 AS DOUBLE) / 10", "order_rate": "CAST(z % 11 AS DOUBLE) / 10",
}


def checked(spark, folder) -> DataFrame:
    part = S.table(spark, folder, "part").select(c("p_partkey").alias("doc"), c("p_partkey").alias("k"), c("p_size").alias("z"))
    return O.with_checks(part.select("doc", *[F.expr(x).alias(name) for name, x in (_MEASURES | _MORE).items()]))


_ROWS = f"""m AS (SELECT doc, classification, visually_blank, drift, hit_rate, order_rate, {', '.join(f'greatest({k}, 0) AS {k}' for k in _MEASURES)} FROM (
        SELECT p_partkey AS doc, {', '.join(f'{x} AS {k}' for k, x in (_MEASURES | _MORE).items())} FROM (SELECT p_partkey, p_partkey AS k, p_size AS z FROM part))),
    u AS (SELECT *, fragments >= 8 AND (hit_rate < 0.4 OR order_rate < 0.55) AS order_fails, fragments >= 8 AND (hit_rate < 0.65 OR order_rate < 0.85) AS order_warns, least(figures, tagged_figures + decorative_figures) AS covered FROM m),
    ch AS (SELECT doc, unnest([{{'c': 'compliance', 's': CASE WHEN remaining_rules > 0 THEN 'fail' ELSE 'pass' END}},
        {{'c': 'ocr_coverage', 's': CASE WHEN classification <> 'scanned' THEN NULL WHEN sampled_pages = 0 OR visually_blank IS TRUE THEN 'skip' WHEN output_chars >= LEAST THEN 'pass' WHEN meaningful_elements > 0 THEN 'warning' ELSE 'fail' END}},
        {{'c': 'text_drift', 's': coalesce(drift, 'skip')}}, {{'c': 'grounded_text_fidelity', 's': CASE WHEN grounded_targets > 0 THEN 'warning' ELSE 'pass' END}},
        {{'c': 'reading_order', 's': CASE WHEN fragments = 0 OR output_chars = 0 THEN 'skip' WHEN order_fails THEN 'fail' WHEN order_warns THEN 'warning' ELSE 'pass' END}},
        {{'c': 'figure_coverage', 's': CASE WHEN figures = 0 THEN 'skip' WHEN covered < figures THEN 'warning' ELSE 'pass' END}}, {{'c': 'table_coverage', 's': CASE WHEN tables = 0 THEN 'skip' WHEN tagged_tables < tables THEN 'warning' ELSE 'pass' END}},
        {{'c': 'table_risk', 's': CASE WHEN tables = 0 THEN 'skip' WHEN complex_tables = 0 THEN 'pass' WHEN high_risk_tables > 0 THEN 'fail' ELSE 'warning' END}},
        {{'c': 'form_semantics', 's': CASE WHEN fields = 0 THEN 'skip' WHEN missing_labels > 0 OR weak_labels > 0 OR form_errors > 0 THEN 'fail' ELSE 'pass' END}},
        {{'c': 'static_widget_artifacts', 's': CASE WHEN static_widgets > 0 THEN 'fail' ELSE 'pass' END}}, {{'c': 'visual_meaning_gap', 's': CASE WHEN missing_visuals > 0 THEN 'fail' ELSE 'pass' END}},
        {{'c': 'alt_text_provenance', 's': CASE WHEN machine_only_alt > 0 THEN 'warning' ELSE 'pass' END}}, {{'c': 'link_text_quality', 's': CASE WHEN poor_links > 0 THEN 'warning' ELSE 'pass' END}},
        {{'c': 'internal_link_destinations', 's': CASE WHEN broken_links > 0 THEN 'warning' ELSE 'pass' END}}, {{'c': 'font_text_fidelity', 's': CASE WHEN font_errors > 0 OR font_targets > 0 THEN 'fail' ELSE 'pass' END}}]) AS x, u FROM u)""".replace("LEAST", str(O.LEAST_SCANNED_CHARS))


@query("g19_fidelity_checks", f"""WITH {_ROWS} SELECT doc, x.c AS "check", x.s AS status FROM ch WHERE x.s IS NOT NULL""")
def g19_checks(spark, folder):
    return checked(spark, folder).select("doc", F.inline("checks"))


@query("g19_fidelity_verdict", f"""WITH {_ROWS}, k AS (SELECT doc, x.c AS c, x.s AS s, u FROM ch WHERE x.s IN ('fail', 'warning') AND x.c NOT IN ('compliance', 'text_drift')),
    t AS (SELECT doc, CASE c WHEN 'ocr_coverage' THEN 'review:content_fidelity' WHEN 'grounded_text_fidelity' THEN 'review:content_fidelity:grounded_text' WHEN 'figure_coverage' THEN 'review:figure_semantics' WHEN 'table_coverage' THEN 'review:table_semantics' WHEN 'table_risk' THEN 'review:table_semantics_risk'
            WHEN 'static_widget_artifacts' THEN 'review:form_semantics:static_widgets' WHEN 'visual_meaning_gap' THEN 'review:content_fidelity:visual_meaning_gap' WHEN 'alt_text_provenance' THEN 'review:alt_text' WHEN 'internal_link_destinations' THEN 'review:broken_internal_links' ELSE 'review:' || c END AS key,
            s = 'fail' OR c IN ('figure_coverage', 'table_coverage') AS blocking, CASE c WHEN 'figure_coverage' THEN u.covered / u.figures::DOUBLE < 0.75 WHEN 'table_coverage' THEN u.tagged_tables / u.tables::DOUBLE < 0.75 WHEN 'form_semantics' THEN u.missing_labels > 0 ELSE s = 'fail' END AS high FROM k
        UNION ALL SELECT DISTINCT user_id, 'review:' || CASE WHEN event_type = 'error' THEN 'form_semantics' ELSE 'metadata' END, true, true FROM events WHERE event_type IN ('error', 'purchase')),
    g AS (SELECT doc, key, bool_or(blocking) AS blocking, bool_or(high) AS high FROM t GROUP BY ALL),
    n AS (SELECT doc, count(*) FILTER (blocking) AS b, count(*) AS n, count(*) FILTER (high) AS h FROM g GROUP BY doc)
    SELECT doc, coalesce(b, 0) = 0 AS passed, coalesce(b, 0) AS blocking_tasks, coalesce(n - b, 0) AS advisory_tasks, coalesce(n, 0) AS total_tasks, coalesce(h, 0) AS high_tasks FROM m LEFT JOIN n USING (doc)""")
def g19_verdict(spark, folder):
    """Tasks of checks and of violations under the same keys, and whether one blocks the document."""
    rows = checked(spark, folder)
    kind = F.when(c("rule_id") == "error", "form_semantics").otherwise("metadata")
    events = S.violations(spark, folder).select("doc", c("event_id").alias("pos"), "severity", "rule_id", "count", kind.alias("task_type"), c("description").alias("title"))
    merged, found = O.verdicts(rows, O.check_tasks(rows), O.violation_tasks(events))
    high = merged.groupBy("doc").agg(F.count_if(c("severity") == "high").alias("high_tasks"))
    return found.join(high, "doc", "left").withColumn("high_tasks", F.coalesce("high_tasks", F.lit(0)))
