"""Statistics, language profiles and packing of whole tables against plain Python."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import regex
from test_operators import _check_packing

from foliolens.llm import language_id, quality_rules, queries
from foliolens.llm.common import table

SF = "/root/testdata/sf0.001"
MORE = ["", None, "a", "Éa ÀB  the the THE, the\nthe!\n\n|| -- 12 ³4 ..", "x" * 5000, "wor wort wort wor\twor 中文 中文 !?! A.\r\nB", "one.\ntwo? three!", "|", "   \n "]


def plain_statistics(text: str | None) -> dict[str, float]:
    t = text or ""
    words, lines = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w], [x for x in t.split("\n") if x]
    n = max(len(words), 1)
    count = lambda p: len(regex.findall(p, t)) / n
    return {
        "n_words": len(words), "mean_word": sum(map(len, words)) / n, "distinct_words": len(set(words)) / n,
        "short_words": sum(len(w) <= 3 for w in words) / n, "letters": len(regex.findall(r"\p{L}", t)) / max(len(t), 1),
        "symbol_runs": count(r"[^\p{L}\p{N} \t\n\x0b\f\r]{2,}"), "capital_runs": count(r"\p{Lu}{2,}"), "bars": t.count("|") / n, "numbers": count(r"\p{N}+"),
        "marks": count(r"[.!?](?=[ \t\n\x0b\f\r]|$)"), "echoes": count(r"\b(?:(\p{L}++)(?=[ \t\n\x0b\f\r]\1\b))"),
        "line_words": len(words) / max(len(lines), 1), "distinct_lines": len(set(lines)) / max(len(lines), 1), "longest_word": max(map(len, words), default=0),
    }


def test_statistics_equal_plain_python(spark):
    texts = [r["text"] for r in table(spark, SF, "documents").select("text").collect()] + MORE
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = quality_rules.with_statistics(df).select("i", "_statistics.*").toPandas().sort_values("i")
    for name in quality_rules.STATISTICS:
        wanted = [plain_statistics(t)[name] for t in texts]
        assert np.allclose(got[name], wanted, atol=1e-12), name


def test_few_labels_still_teach(spark):
    docs = [(i, "good words of a plain text" if i % 2 else "|||| #### $$$$ ||||") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    some = [i for i in range(40) if crc32(str(i).encode()) % 3 != 1][:14]
    labels = spark.createDataFrame([(i, i % 2) for i in some] + [(some[0], 1 - some[0] % 2), (some[0], some[0] % 2)], "doc_id bigint, quality int")
    got = quality_rules.with_quality(df, quality_rules.fit_quality(df, labels)).collect()
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in got)


def grams(text: str | None) -> Counter:
    found: Counter = Counter()
    for w in (w.lower() for w in regex.findall(r"\p{L}+", text or "")):
        for n in (1, 2, 3):
            padded = w if n == 1 else f" {w} "
            found.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return found


def ranked(counts: Counter, length: int) -> list[str]:
    def number(g: str) -> int:
        out = 0
        for c in g:
            out = out << 21 | ord(c)
        return out

    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:length]


def test_the_language_query_equals_plain_loops(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").toPandas()
    length, total = language_id.PROFILE_LENGTH, {}
    for i, text, lang in docs.itertuples(index=False):
        if crc32(str(i).encode()) % 3 != 1 and lang is not None and text is not None:
            total.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: r for r, g in enumerate(ranked(c, length))} for lang, c in total.items()}
    got = queries.op9_language(spark, SF).toPandas().set_index("doc_id")
    for i, text, _ in docs.itertuples(index=False):
        own = ranked(grams(text), length)
        wanted = ("und", 0.0)
        if own:
            off = {lang: sum(min(abs(ranks[g] - r), length) if g in ranks else length for r, g in enumerate(own)) for lang, ranks in profiles.items()}
            best = min(sorted(off), key=off.get)
            wanted = (best, 1 - off[best] / (len(own) * length))
        assert got.lang_pred[i] == wanted[0] and abs(got.score[i] - wanted[1]) < 1e-12
        assert got.held_out[i] == (crc32(str(i).encode()) % 3 == 1)


def test_the_packing_query_covers_its_whole_table(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").toPandas()
    got = queries.op10_packing(spark, SF).toPandas()
    assert set(got.doc_id) == set(rows.doc_id)
    _check_packing(got, dict(zip(rows.doc_id, rows.text, strict=True)))
