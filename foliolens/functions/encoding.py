"""Font encodings: character maps as text, and which fonts may get one by themselves."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the character-map format.
CMAP_HEAD = [
    "/CIDInit /ProcSet findresource begin",
    "12 dict begin",
    "begincmap",
    "/CIDSystemInfo << /Registry (Adobe) /Ordering (UCS) /Supplement 0 >> def",
    "/CMapName /Adobe-Identity-UCS def",
    "/CMapType 2 def",
    "1 begincodespacerange",
]
CMAP_TAIL = ["endcmap", "CMapName currentdict /CMap defineresource pop", "end", "end", ""]
ENTRIES_A_SECTION = 100
LONGEST_RANGE = 65_536

# Fonts whose codes are known without a map, punctuation left out.
STANDARD_FONTS = [
    "TimesRoman", "TimesBold", "TimesItalic", "TimesBoldItalic",
    "Helvetica", "HelveticaBold", "HelveticaOblique", "HelveticaBoldOblique",
    "Courier", "CourierBold", "CourierOblique", "CourierBoldOblique",
]

#: Characters that no map may lead to.
_BARRED = "\x00\ufeff\ufffe"


def cmap_text(entries: Column, code_bytes: int) -> Column:
    """An array of (code, text) as the text of a character map, by code; codes out of range and barred texts are left out."""
    width = 2 * (code_bytes if code_bytes in (1, 2, 4) else 2)
    top = (1 << 4 * width) - 1
    fits = F.array_sort(F.filter(entries, lambda e: e["code"].between(0, top) & (e["text"] != "") & ~F.rlike(e["text"], F.lit(f"[{_BARRED}]"))))
    lines = F.transform(fits, lambda e: F.concat(
        F.lit("<"), F.lpad(F.hex(e["code"].cast("bigint")), width, "0"), F.lit("> <"), F.hex(F.encode(e["text"], "UTF-16BE")), F.lit(">")))
    starts = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines), F.lit(ENTRIES_A_SECTION))).otherwise(F.expr("cast(array() as array<int>)"))
    sections = F.flatten(F.transform(starts, lambda s: F.concat(
        F.array(F.concat(F.least(F.size(lines) - s + 1, F.lit(ENTRIES_A_SECTION)).cast("string"), F.lit(" beginbfchar"))),
        F.slice(lines, s, ENTRIES_A_SECTION), F.array(F.lit("endbfchar")))))
    head = [*CMAP_HEAD, f"<{'0' * width}> <{top:X}>", "endcodespacerange"]
    return F.array_join(F.concat(F.array(*map(F.lit, head)), sections, F.array(*map(F.lit, CMAP_TAIL))), "\n")


def _utf16(digits: str) -> str | None:
    """Hexadecimal UTF-16 as text, null where it is none or barred."""
    if not digits or len(digits) % 4:
        return None
    try:
        text = bytes.fromhex(digits).decode("utf-16-be")
    except UnicodeDecodeError:
        return None
    return None if any(x in _BARRED for x in text) else text


def _range(first: int, last: int, targets: list[str], listed: bool) -> Iterator[tuple[int, str | None]]:
    """Codes of a range with their texts; null is an entry that can't be read."""
    if not 0 <= last - first < LONGEST_RANGE:
        yield first, None
    elif listed:
        yield from ((first + i, _utf16(t)) for i, t in zip(range(last - first + 1), targets, strict=False))
    elif len(targets[0]) % 4 == 0:
        try:
            seed = bytes.fromhex(targets[0]).decode("utf-16-be")
        except UnicodeDecodeError:
            return
        if len(seed) != 1:
            yield first, None
            return
        for code in range(first, last + 1):
            point = ord(seed) + code - first
            ok = point <= 0x10FFFF and not 0xD800 <= point <= 0xDFFF and chr(point) not in _BARRED
            yield code, chr(point) if ok else None


def cmap_entries(text: str | None) -> tuple[dict[int, str], int]:
    """The texts by code that a character map states, later entries winning, and how many entries can't be read."""
    plain = re.sub(r"%[^\r\n]*", "", text or "")
    found, bad = {}, 0
    for kind, body in re.findall(r"(?is)begin(bfchar|bfrange)[ \t]*[\r\n](.*?)(?=end(?:bfchar|bfrange)|begin(?:bfchar|bfrange)|\Z)", plain):
        for line in body.splitlines():
            groups = re.findall(r"<([0-9A-Fa-f]+)>", line)
            if kind.lower() == "bfchar":
                pairs = [(int(groups[0], 16), _utf16(groups[1]))] if len(groups) > 1 else []
            else:
                pairs = _range(int(groups[0], 16), int(groups[1], 16), groups[2:], "[" in line and "]" in line) if len(groups) > 2 else []
            for code, value in pairs:
                if value is None:
                    bad += 1
                else:
                    found[code] = value
    return found, bad


def read_cmap(text: Column) -> Column:
    """(entries, unread) of a character map, over Arrow batches: an array of (code, text), and how many entries can't be read."""

    def run(texts: pd.Series) -> pd.DataFrame:
        read = [cmap_entries(t) for t in texts]
        return pd.DataFrame({"entries": [[{"code": k, "text": v} for k, v in sorted(found.items())] for found, _ in read], "unread": [bad for _, bad in read]})

    return F.pandas_udf(run, "entries array<struct<code:bigint,text:string>>, unread int")(text)


def has_text_operator(stream: Column) -> Column:
    """Whether a content stream, decoded byte by byte, shows text."""
    return F.coalesce(F.rlike(stream, F.lit(r"(?:Tj|TJ)\b")), F.lit(False))


def unicode_policy(encoded: Column, base_font: Column, subtype: Column, built_in: Column) -> Column:
    """Why a simple font's codes may be read as text: explicit, standard14, embedded_cff, or blocked."""
    name = F.regexp_replace(F.coalesce(base_font, F.lit("")), "[^A-Za-z0-9]+", "")
    return (
        F.when(encoded, "explicit").when(name.isin(STANDARD_FONTS), "standard14")
        .when(subtype.isin("/Type1", "/MMType1") & built_in, "embedded_cff").otherwise("blocked"))
