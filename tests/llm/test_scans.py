"""Secrets in linear time, and the personal-data query against plain patterns."""

from __future__ import annotations

import base64
import hashlib
import re
import time

from foliolens.llm import pii, queries, secret_scan
from foliolens.llm.common import table

SF = "/root/testdata/sf0.001"
HEAD = base64.urlsafe_b64encode(b'{"alg":"HS256","typ":"JWT"}').decode().rstrip("=")


def test_a_million_characters_of_keywords_take_linear_time():
    for word in ("eyJ", "eyJeyj", "password", "xoxb-", "AKIA", "ghp_", "secret ", "-----BEGIN PRIVATE KEY-----", "eyJ.", "AIza"):
        text = word * (1_000_000 // len(word))
        began = time.time()
        secret_scan.find_secrets(text)
        assert time.time() - began < 30, word


def test_web_tokens_before_and_after_runs_that_fail():
    token = f"{HEAD}.eyJzdWIiOiIxIn0.c2ln"
    assert [s[1:] for s in secret_scan.find_secrets(f"eyJeyJeyJ {token}") if s[0] == "jwt"] == [(10, 10 + len(token))]
    assert [s[1:] for s in secret_scan.find_secrets(f"eyjeyJ.. {token} eyJ") if s[0] == "jwt"] == [(9, 9 + len(token))]
    assert [s[1:] for s in secret_scan.find_secrets(f"eyj{token}") if s[0] == "jwt"] == [(3, 3 + len(token))]


def _plain(text: str) -> list[tuple[str, int, int]]:
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(s: str) -> bool:
        return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(s))) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    order = [r[0] for r in rules]
    return sorted(((k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])), key=lambda s: (s[1], order.index(s[0])))


def test_columns_of_the_personal_data_query(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").toPandas()
    got = {r["doc_id"]: r for r in queries.op5_pii(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, text in zip(rows.doc_id, rows.text, strict=True):
        base, own = _plain(text or ""), got[i]
        assert [own[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        assert own["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [tuple(s[:3]) for s in pii.find_pii(text)]
        assert set(base) <= set(spans) and own["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
