"""Licence scans: interleaved licences, slots for names, rules against patterns over identifiers, the query's columns."""

from __future__ import annotations

import random
import re
import textwrap

from foliolens.llm import licence_rules as L
from foliolens.llm import queries
from foliolens.llm.common import table

SF = "/root/testdata/sf0.001"


def names(text: str) -> list[str]:
    return [x[0] for x in L.find_licences(text)]


def test_a_known_sentence_between_two_of_a_rule_is_not_swallowed():
    grant, notice = L.SENTENCES["mit-grant"][0], L.SENTENCES["mit-notice"][0]
    assert names(f"{grant}\nLicensed under the Apache License, Version 2.0.\n{notice}") == ["MIT", "Apache-2.0"]
    assert L.find_licences(f"{grant}\nCopyright me\n\n(all of it)\n{notice}")[0][3] == ("mit-grant", "mit-notice")


def test_rules_equal_patterns_over_identifiers():
    """Identifiers become characters, and each rule a pattern: the leftmost match, of the longest rule that fits there."""
    keys = sorted({k for _, r in L.RULES for k in r} | set(L.SENTENCES))
    char = {k: chr(0x4E00 + i) for i, k in enumerate(keys)} | {None: "."}
    patterns = [(licence, r, re.compile(rf"\.{{0,{L.GAP}}}".join(char[k] for k in r))) for licence, r in sorted(L.RULES, key=lambda r: -len(r[1]))]
    rng = random.Random(7)
    for _ in range(20_000):
        some = rng.sample(keys, 4) + ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "mit-grant", "mit-notice", "mit-warranty"]
        row = []
        while len(row) < 14:
            row += rng.choice([[None], [None], [rng.choice(some)], list(rng.choice(L.RULES)[1])])
        text, at, wanted = "".join(char[k] for k in row), 0, []
        while at < len(text):
            m = next(((licence, r, m) for licence, r, p in patterns if (m := p.match(text, at))), None)
            if m:
                wanted.append((m[0], at, m[2].end() - 1, m[1]))
            at = m[2].end() if m else at + 1
        assert L.match_rules(row) == wanted


def test_slots_for_names():
    bsd = [L.SENTENCES[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary")]
    holder = "Neither the name of The Example Project, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    for width in (30, 60, 400):
        assert names("\n\n".join(textwrap.fill(x, width) for x in [*bsd, holder])) == ["BSD-3-Clause"]
    assert names("This library is released under the MIT License.") == ["MIT"]
    assert L.find_licences("A text. The code is licensed under the\nMIT License. More.")[0][1:3] == (8, 8 + len("The code is licensed under the\nMIT License."))
    assert names("Released notes.\nThis work is distributed under the terms of the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert names("Nothing here was ever released. MIT License. is a text") == ["MIT"]
    assert names("One two three four five six seven eight nine ten eleven twelve thirteen released under the MIT License.") == []


def test_whole_licence_at_many_widths():
    mit = [L.SENTENCES[k][0] for k in ("mit-grant", "mit-notice", "mit-warranty")]
    for lines in (1, 16, 40):
        text = "\n\n".join(textwrap.fill(x, max(12, len(x) // lines), break_long_words=False) for x in mit)
        assert names(text) == ["MIT"]


def test_columns_of_the_query(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").toPandas()
    got = queries.op7_licences(spark, SF).toPandas().set_index("doc_id")
    planted = {
        "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    }
    wanted = re.compile("^(?:" + "|".join(map(re.escape, planted)) + ")$", re.M)
    for i, text in zip(rows.doc_id, rows.text, strict=True):
        spans = [(planted[m[0]], m.start(), m.end()) for m in wanted.finditer(text or "")]
        assert tuple(got.loc[i, ["licences", "n_matches", "spans"]]) == (",".join(sorted({s[0] for s in spans})), len(spans), ",".join(f"{a}:{b}:{c}" for a, b, c in spans))
    assert got.n_matches.sum() > 0
