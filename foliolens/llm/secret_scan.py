"""Secret scans: a keyword automaton finds where to look, anchored patterns match there, checksums confirm.

An Aho-Corasick automaton runs once over each whole text and reports where the fixed
words of the kinds occur. Only there are patterns tried, anchored at the hit, so text
without keywords costs one automaton pass. Kinds that carry a checksum are kept only
where it holds.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from foliolens.llm.common import map_batches, with_column, with_fields

Span = tuple[str, int, int]

#: Kinds in their listed order, which breaks ties between spans that start together.
BASE_KINDS = ("assign", "access", "hex")
MORE_KINDS = ("github", "npm", "slack", "jwt", "google", "stripe", "private_key")
KINDS = BASE_KINDS + MORE_KINDS

_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc32(body: str) -> str:
    """The six base-62 digits of a text's CRC-32 that some issuers append to their tokens."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _DIGITS62[r] + out
    return out


def _crc_holds(found: str) -> bool:
    body = found.partition("_")[2]
    return base62_crc32(body[:-6]) == body[-6:]


def _is_jwt(found: str) -> bool:
    """The first part of a web token is a JSON object that names an algorithm."""
    head = found.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except ValueError:
        return False


#: kind: (keywords in lower case, pattern anchored at the keyword, what a match must hold besides).
_RULES: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        lambda m: len(m[2]) >= 6,
    ),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: _crc_holds(m[0])),
    "npm": (("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: _crc_holds(m[0])),
    "slack": (("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), re.compile(r"xox[abprs](?:-[A-Za-z0-9]{8,}+){2,}+"), lambda m: True),
    "jwt": (("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"), lambda m: _is_jwt(m[0])),
    "google": (("aiza",), re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"), lambda m: True),
    "stripe": (("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}+"), lambda m: True),
    # To the END line of the same label where that comes next; else header lines and all that base64 can be.
    "private_key": (("-----begin ",), re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END \1-----|(?:\s*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n]*+)*+[A-Za-z0-9+/=\s]*+(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?)"), lambda m: True),
}
#: Where a pattern fails, it fails alike at every keyword in the same run: the scan goes on after it.
_RUNS = {"jwt": re.compile(r"eyJ[A-Za-z0-9_-]*+")}
#: A run of hexadecimal digits has no keyword; the pattern skips to runs that are long enough.
_HEX = re.compile(r"[0-9a-f]{24,}+")


@cache
def _automaton():
    import ahocorasick

    found: dict[str, list[str]] = {}
    for kind, (words, _, _) in _RULES.items():
        for w in words:
            found.setdefault(w, []).append(kind)
    machine = ahocorasick.Automaton()
    for w, kinds in found.items():
        machine.add_word(w, (len(w), tuple(kinds)))
    machine.make_automaton()
    return machine


def find_secrets(text: str | None) -> list[Span]:
    """All spans (kind, start, end) of a whole text in code points, by start, then kind as listed.

    Spans of a kind are leftmost and don't overlap: a match uses up its characters even
    where it then fails its check. Null and empty texts have none.
    """
    if not text:
        return []
    spans: list[Span] = [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits: dict[str, list[int]] = {}
    for last, (length, kinds) in _automaton().iter(low):
        for kind in kinds:
            hits.setdefault(kind, []).append(last - length + 1)
    for kind, starts in hits.items():
        _, pattern, holds = _RULES[kind]
        free = 0
        for at in sorted(starts):
            if at < free:
                continue
            if m := pattern.match(text, at):
                free = m.end()
                if holds(m):
                    spans.append((kind, at, free))
            elif kind in _RUNS and (run := _RUNS[kind].match(text, at)):
                free = run.end()
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover, overlaps merged, put as ``[SECRET]``."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end = spans[i][1], spans[i][2]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], "[SECRET]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``secrets``, an array of (kind, start, end, value), to each row; one of that name is replaced."""
    out = docs.drop("secrets")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        rows = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in find_secrets(t)] for t in texts]
        return with_column(batch, "secrets", pa.array(rows, kind))

    return map_batches(out, scan, with_fields(out.schema, ("secrets", "array<struct<kind:string,start:bigint,end:bigint,value:string>>")))


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, with secrets in the text replaced; ``n_chars`` follows changed texts."""

    def redact(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        texts = batch.column(names.index(text)).to_pylist()
        spans = [find_secrets(t) for t in texts]
        if not any(spans):
            return batch
        new = [redacted(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
        if n_chars in names:
            old = batch.column(names.index(n_chars))
            sizes = [len(t) if s else n for t, s, n in zip(new, spans, old.to_pylist(), strict=True)]
            batch = with_column(batch, n_chars, pa.array(sizes, old.type))
        return with_column(batch, text, pa.array(new, pa.string()))

    return map_batches(docs, redact, docs.schema)


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts of the base kinds, the SHA-256 of the base spans, and all spans as text."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find_secrets(t) for t in batch.column(1).to_pylist()]
        base = [[s for s in spans if s[0] in BASE_KINDS] for spans in found]
        columns = {"doc_id": batch.column(0)}
        for kind in BASE_KINDS:
            columns[f"n_{kind}"] = pa.array([sum(s[0] == kind for s in spans) for spans in base], pa.int64())
        columns["base_sha256"] = pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string())
        columns["spans"] = pa.array([joined(spans) for spans in found], pa.string())
        return pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(doc_id, text), scan, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
