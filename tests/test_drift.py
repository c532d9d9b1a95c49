"""Text drift case by case and against plain loops; tasks merged by key."""

from __future__ import annotations

import random
import time
from difflib import SequenceMatcher

from foliolens.functions import similarity as X
from foliolens.operators import drift as D

TEXTS = "source string, output string, original string, classification string, doc int"


def brute(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    pairs = [(short, long), (long, short)] if len(a) == len(b) else [(short, long)]
    best = 0.0
    for s, t in pairs:
        n = len(s)
        spans = [t[i : i + n] for i in range(len(t) - n + 1)] + [t[:i] for i in range(1, n)] + [t[len(t) - i :] for i in range(1, n)]
        best = max([best] + [X.indel_ratio(s, x) for x in spans])
    return best


def test_window_ratio_equals_all_windows():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(1, 30))) for _ in range(2))
        assert X.window_ratio(a, b) == brute(a, b) == X.window_ratio(b, a)
        assert abs((1 - X.preservation("zz" + a + "yx", "zz" + b + "yx")) * (len(a) + 4) - (1 - X.preservation(a, b)) * len(a)) < 1e-9
    assert X.window_ratio("", "") == 1.0 and X.window_ratio("", "a") == 0.0
    assert X.window_ratio("needle", "x" * 500 + "needle" + "y" * 500) == 1.0


def test_sequence_ratio_equals_difflib():
    rng = random.Random(11)
    for n in (0, 1, 30, 199, 200, 900):
        for letters in ("ab", "etaoin shrdlu", "".join(map(chr, range(97, 400)))):
            a = "".join(rng.choices(letters, k=n))
            for b in (a, a[: n // 2] + "x" + a[n // 2 :], "".join(x for x in a if rng.random() > 0.1), "".join(rng.choices(letters, k=n)), a[n // 3 :] + a[: n // 3]):
                assert X.sequence_ratio(a, b) == SequenceMatcher(None, a, b).ratio() and X.sequence_ratio(b, a) == SequenceMatcher(None, b, a).ratio()


def test_preservation_of_lost_or_added_text_takes_one_pass():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(3600)]
    text = " ".join(words)[:20000]
    lost = " ".join(w for i, w in enumerate(text.split(" ")) if i % 5 != 4)
    began = time.process_time()
    assert abs(X.preservation(text, lost) - len(lost) / len(text)) < 1e-12 and X.preservation(lost, text) == 1.0
    assert time.process_time() - began < 0.5  # the whole table takes seconds


def test_verdicts_by_kind(spark):
    words = random.Random(5)
    text = " ".join("".join(words.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(60))
    more = text + " " + text[::-1][:300]
    rows = [
        (text, text, None, "digital", 0), (text, more, None, "digital", 1), (text, more, None, "scanned", 2), (text, text[: len(text) * 65 // 100], None, "mixed", 3),
        (text, text[: len(text) * 83 // 100], None, "digital", 4), (text, text[: len(text) * 93 // 100], None, "ocr_scan", 5), (text[:299], text, None, "scanned", 6), (None, None, None, None, 7),
        (text, text, text[::-1], None, 8), (text, text, text, "digital", 9), (text, text, "short", "digital", 10),
    ]
    found = D.text_drift(spark.createDataFrame(rows, TEXTS))
    got = {r.doc: r for r in found.collect()}
    assert [got[i].status for i in range(11)] == ["pass", "fail", "pass", "fail", "warning", "warning", "skip", "skip", "pass", "pass", "pass"]
    assert [i for i in got if got[i].rescue_review] == [8]
    assert got[2].containment == 100.0 and got[2].preservation == 1.0 and got[0].containment is None and got[6].similarity is None
    tasks = {(r.doc, r.key): r for r in D.merged_tasks(D.drift_tasks(found)).collect()}
    look, ocr = "review:content_fidelity", "review:content_fidelity:ocr_rescue"
    assert set(tasks) == {(1, look), (3, look), (4, look), (5, look), (8, ocr)}
    assert tasks[3, look].blocking and tasks[3, look].severity == "high" and not tasks[4, look].blocking and not tasks[8, ocr].blocking
    assert set(tasks[4, look].metadata) == {"similarity", "length_ratio"} and set(tasks[5, look].metadata) == {"similarity", "length_ratio", "containment", "preservation"}


def test_extra_columns_and_empty_tables(spark):
    assert D.text_drift(spark.createDataFrame([], TEXTS)).count() == 0
    tasks = spark.createDataFrame([], "doc int, key string, place int, title string, severity string, blocking boolean, metadata map<string,string>")
    assert D.merged_tasks(tasks).count() == 0


def test_tasks_merge_by_key(spark):
    rows = [
        (1, "a", 0, "first", "odd", False, {"x": "1", "y": "1"}), (1, "a", 1, "second", "low", True, {"y": "2"}), (1, "a", 2, "third", "medium", False, None),
        (1, "b", 3, "alone", "low", False, None), (2, "a", 0, "other", "high", False, {}),
    ]
    tasks = spark.createDataFrame(rows, "doc int, key string, place int, title string, severity string, blocking boolean, metadata map<string,string>")
    got = sorted((r.doc, r.key, r.title, r.severity, r.blocking, r.metadata) for r in D.merged_tasks(tasks).select("doc", "key", "title", "severity", "blocking", "metadata").collect())
    assert got == [(1, "a", "first", "medium", True, {"x": "1", "y": "2"}), (1, "b", "alone", "low", False, {}), (2, "a", "other", "high", False, {})]


def test_metadata_goes_into_the_first_match(spark):
    tasks = spark.createDataFrame(
        [(1, 4, "t", None, {"a": "0", "b": "0"}), (1, 2, "t", "else", None), (1, 5, "t", "fidelity", None), (2, 1, "t", "fidelity", None), (3, 1, "t", "fidelity", {"c": "1"})],
        "doc int, place int, task_type string, source string, metadata map<string,string>")
    updates = spark.createDataFrame([(1, "t", "fidelity", {"a": "9"}), (2, "t", "fidelity", {"z": "1"}), (3, "t", "fidelity", {})], "doc int, task_type string, source string, metadata map<string,string>")
    got = {(r.doc, r.place): r.metadata for r in D.with_metadata(tasks, updates).collect()}
    assert got == {(1, 4): {"a": "9", "b": "0"}, (1, 2): None, (1, 5): None, (2, 1): {"z": "1"}, (3, 1): {"c": "1"}}
