"""The fidelity report on cases made by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliolens.operators.fidelity import LEAST_SCANNED_CHARS, check_tasks, verdicts, violation_tasks, with_checks

KINDS = {"classification": "string", "visually_blank": "boolean", "drift": "string", "hit_rate": "double", "order_rate": "double"}
CASES = [
    ({}, {"text_drift": "skip", "reading_order": "skip", "figure_coverage": "skip", "table_coverage": "skip", "table_risk": "skip", "form_semantics": "skip"}),
    ({"remaining_rules": 2, "drift": "warning"}, {"compliance": "fail", "text_drift": "warning"}),
    ({"classification": "scanned", "sampled_pages": 1, "meaningful_elements": 1}, {"ocr_coverage": "warning"}),
    ({"classification": "scanned", "sampled_pages": 1}, {"ocr_coverage": "fail"}),
    ({"classification": "scanned", "sampled_pages": 1, "visually_blank": True}, {"ocr_coverage": "skip"}),
    ({"classification": "scanned", "sampled_pages": 1, "output_chars": LEAST_SCANNED_CHARS}, {"ocr_coverage": "pass"}),
    ({"fragments": 8, "output_chars": 9, "hit_rate": 0.4, "order_rate": 0.55}, {"reading_order": "warning"}),
    ({"fragments": 8, "output_chars": 9, "hit_rate": 0.39, "order_rate": 1.0}, {"reading_order": "fail"}),
    ({"fragments": 7, "output_chars": 9, "hit_rate": 0.0, "order_rate": 0.0}, {"reading_order": "pass"}),
    ({"fragments": 9, "output_chars": 9, "hit_rate": 0.65, "order_rate": 0.85}, {"reading_order": "pass"}),
    ({"figures": 3, "tagged_figures": 2, "decorative_figures": 1, "tables": 2, "tagged_tables": -4, "complex_tables": 1}, {"figure_coverage": "pass", "table_coverage": "warning", "table_risk": "warning"}),
    ({"tables": 1, "tagged_tables": 1, "complex_tables": 1, "high_risk_tables": 1, "fields": 1, "weak_labels": 1, "font_targets": 1}, {"table_coverage": "pass", "table_risk": "fail", "form_semantics": "fail", "font_text_fidelity": "fail"}),
    ({"static_widgets": 1, "missing_visuals": 1, "machine_only_alt": 1, "poor_links": 1, "broken_links": 1, "grounded_targets": 1, "missing_labels": 3},
     {"static_widget_artifacts": "fail", "visual_meaning_gap": "fail", "alt_text_provenance": "warning", "link_text_quality": "warning", "internal_link_destinations": "warning", "grounded_text_fidelity": "warning", "form_semantics": "skip"}),
]


@pytest.fixture(scope="module")
def checked(spark):
    names = sorted({k for given, _ in CASES for k in given} | set(KINDS))
    rows = [(i, *[given.get(k) for k in names]) for i, (given, _) in enumerate(CASES)]
    return with_checks(spark.createDataFrame(rows, "doc int, " + ", ".join(f"{k} {KINDS.get(k, 'int')}" for k in names)))


def test_each_check_has_its_status(checked):
    for row in checked.collect():
        got = {x["check"]: x["status"] for x in row["checks"]}
        assert len(got) == (15 if row["classification"] == "scanned" else 14)
        assert {k: got[k] for k in CASES[row["doc"]][1]} == CASES[row["doc"]][1]


def test_tasks_meet_those_of_violations(spark, checked):
    faults = spark.createDataFrame([(11, 2, "error", "r1", 3, "form_semantics", "B"), (11, 1, "error", "r0", None, "form_semantics", "A"), (0, 1, "warning", "r2", 1, "other", "C"), (6, 0, "error", " ", -2, "reading_order", "D")],
                                   "doc int, pos int, severity string, rule_id string, count int, task_type string, title string")
    merged, found = verdicts(checked, check_tasks(checked), violation_tasks(faults))
    rows = {(r["doc"], r["key"]): r for r in merged.collect()}
    forms = rows[11, "review:form_semantics"]
    assert (forms["title"], forms["severity"], forms["blocking"], forms["metadata"]["rules"], forms["metadata"]["count"], forms["metadata"]["weak_labels"]) == ("A", "high", True, "r0,r1", "4", "1")
    order = rows[6, "review:reading_order"]
    assert (order["title"], order["severity"], order["blocking"], order["metadata"]["hit_rate"], order["metadata"]["count"]) == ("D", "high", True, "0.4", "1")
    tables = rows[10, "review:table_semantics"]
    assert (tables["severity"], tables["blocking"], rows[10, "review:table_semantics_risk"]["blocking"]) == ("high", True, False)
    got = {r["doc"]: tuple(r)[1:] for r in found.collect()}
    assert got[0] == (True, 0, 0, 0) and got[2] == (True, 0, 1, 1) and got[3] == (False, 1, 0, 1) and got[11] == (False, 3, 0, 3) and got[12] == (False, 2, 4, 6)
    assert len(got) == len(CASES)


def test_no_documents(spark, checked):
    none = checked.where(F.lit(False))
    assert [x.count() for x in verdicts(none, check_tasks(none))] == [0, 0]
