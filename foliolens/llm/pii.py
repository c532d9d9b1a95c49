"""Personal data: patterns propose spans, checksum validators confirm them, context words adjust the score.

All patterns take time linear in the text: the parts before an ``@`` are walked back from
it, digit runs are tried at their first digit only, and runs are possessive.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from foliolens.llm.common import map_batches, with_column, with_fields

#: kind, start, end, score.
Span = tuple[str, int, int, float]

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + MORE_KINDS

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_WORD_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NO_DIGITS = str.maketrans("", "", " ().-+")

#: Score before context, and what a context word nearby adds.
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
_BOOST = 0.3
#: Kinds that are no spans without a context word.
_LEAST = {"ssn": 0.5}
#: How far before and behind a span context words count, in code points.
CONTEXT_WINDOW = 60
_CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|contact|courriel|correo|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|debit|carte|tarjeta|karte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
}


def luhn_holds(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97_holds(iban: str) -> bool:
    """The check digits of an account number: letters become 10 to 35, the remainder by 97 is 1."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _ibans(text: str):
    """Of the stretches that end with a word, the longest whose check digits hold; words after a number are not part of it."""
    m = _IBAN.search(text)
    while m:
        free = m.start() + 4
        for end in reversed([e.start() for e in _WORD_END.finditer(text, free, m.end() + 1) if e.start() <= m.end()]):
            body = text[m.start() : end].replace(" ", "")
            if len(body) >= 15 and mod97_holds(body):
                yield m.start(), end
                free = end
                break
        m = _IBAN.search(text, free)


def _proposed(text: str):
    """(kind, start, end) of every span that its validator confirms; per kind leftmost, without overlap."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        digits = m[0].translate(_NO_DIGITS)
        if 12 <= len(digits) <= 19 and luhn_holds(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(m[0].translate(_NO_DIGITS)) <= 15:
                yield "phone", m.start(), m.end()
    for a, b in _ibans(text):
        yield "iban", a, b
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def find_pii(text: str | None) -> list[Span]:
    """All spans (kind, start, end, score) of a whole text in code points, by start, then kind as listed.

    A failing match uses up its characters and isn't tried again inside, but for account
    numbers, which are tried from each word on. Null and empty
    texts have none.
    """
    if not text:
        return []
    found = []
    for kind, a, b in _proposed(text):
        near = text[max(0, a - CONTEXT_WINDOW) : a] + " " + text[b : b + CONTEXT_WINDOW]
        score = min(1.0, _PRIOR[kind] + (_BOOST if _CONTEXT[kind].search(near) else 0.0))
        if score >= _LEAST.get(kind, 0.0):
            found.append((kind, a, b, score))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def scan_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pii``, an array of (kind, start, end, score, value), to each row; one of that name is replaced."""
    out = docs.drop("pii")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("value", pa.string())]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        rows = [[{"kind": k, "start": a, "end": b, "score": s, "value": t[a:b]} for k, a, b, s in find_pii(t)] for t in texts]
        return with_column(batch, "pii", pa.array(rows, kind))

    return map_batches(out, scan, with_fields(out.schema, ("pii", "array<struct<kind:string,start:bigint,end:bigint,score:double,value:string>>")))


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, all spans as text, and the highest score."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find_pii(t) for t in batch.column(1).to_pylist()]
        base = [[s for s in spans if s[0] in BASE_KINDS] for spans in found]
        columns = {"doc_id": batch.column(0)}
        for kind in BASE_KINDS:
            columns[f"n_{kind}"] = pa.array([sum(s[0] == kind for s in spans) for spans in base], pa.int64())
        columns["base_sha256"] = pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string())
        columns["spans"] = pa.array([joined(spans) for spans in found], pa.string())
        columns["top_score"] = pa.array([max((s[3] for s in spans), default=0.0) for spans in found], pa.float64())
        return pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(
        docs.select(doc_id, text), scan,
        f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, top_score double")
