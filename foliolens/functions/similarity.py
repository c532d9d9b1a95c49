"""Text similarities that Spark lacks, over Arrow batches: the indel ratio and the matching-blocks ratio."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable
from difflib import SequenceMatcher
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.sources.shipping import ship


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: one machine word of bits for each row of the table."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 if both are empty."""
    total = len(a) + len(b)
    return 1.0 if not total else 2 * common_subsequence(a, b) / total


def sequence_ratio(a: str, b: str) -> float:
    """Ratio of matching blocks, frequent characters of long texts left out.

    The figure is ``SequenceMatcher(None, a, b).ratio()``; here a stretch looks only at its own
    places of the characters that aren't frequent, and matches are drawn out by stretches.
    """
    if a == b:
        return 1.0
    found: dict[str, list[int]] = defaultdict(list)
    for j, x in enumerate(b):
        found[x].append(j)
    most = len(b) // 100 + 1 if len(b) >= 200 else len(b)
    places = {x: js for x, js in found.items() if len(js) <= most}
    rare = [i for i, x in enumerate(a) if x in places]
    matched, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        besti, bestj, size = a0, b0, 0
        before, last = {}, -2
        for i in rare[bisect_left(rare, a0) : bisect_left(rare, a1)]:
            js = places[a[i]]
            runs = {}
            for j in js[bisect_left(js, b0) : bisect_left(js, b1)]:
                k = runs[j] = before.get(j - 1, 0) + 1 if last == i - 1 else 1
                if k > size:
                    besti, bestj, size = i - k + 1, j - k + 1, k
            before, last = runs, i
        more = _same_end(a, besti, b, bestj, min(besti - a0, bestj - b0))
        besti, bestj, size = besti - more, bestj - more, size + more
        size += _same_start(a, besti + size, b, bestj + size, min(a1 - besti, b1 - bestj) - size)
        if size:
            matched += size
            if a0 < besti and b0 < bestj:
                todo.append((a0, besti, b0, bestj))
            if besti + size < a1 and bestj + size < b1:
                todo.append((besti + size, a1, bestj + size, b1))
    return 2.0 * matched / (len(a) + len(b))


def _same_start(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters, ``most`` at most, are the same from ``a[i]`` and ``b[j]`` on."""
    known, step = 0, 16
    while known < most:
        step = min(step, most - known)
        if a[i + known : i + known + step] == b[j + known : j + known + step]:
            known, step = known + step, step * 2
        elif step == 1:
            break
        else:
            most, step = known + step - 1, max(1, step // 2)
    return known


def _same_end(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters, ``most`` at most, are the same before ``a[i]`` and ``b[j]``."""
    known = 0
    while known < most and a[i - known - 1] == b[j - known - 1]:
        known += 1
    return known


MEASURES: dict[str, Callable[[str, str], float]] = {"indel": indel_ratio, "sequence": sequence_ratio}


def with_similarity(df: DataFrame, a: str, b: str, *measures: str) -> DataFrame:
    """Add the measures asked for (``indel`` and ``sequence`` if none is named); null texts count as empty."""

    ship(df.sparkSession)

    def column(measure: Callable[[str, str], float]) -> Column:
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([measure(p, q) for p, q in zip(x.fillna(""), y.fillna(""), strict=True)], dtype="float64")

        return F.pandas_udf(run, "double")(a, b)

    return df.withColumns({name: column(MEASURES[name]) for name in measures or MEASURES})


def preservation(source: str, output: str) -> float:
    """1 less the share of the source's characters that an optimal edit script replaces or deletes.

    Of optimal scripts the one that damages least counts; characters added cost nothing here.
    What both texts begin or end with alike is kept by one such script, so it is left out first.
    If one rest holds the other in order, optimal scripts only delete or only insert.
    """
    if not source:
        return 1.0
    chars = len(source)
    same = len(commonprefix((source, output)))
    source, output = source[same:], output[same:]
    same = len(commonprefix((source[::-1], output[::-1])))
    source, output = source[: len(source) - same], output[: len(output) - same]
    if _holds_in_order(source, output):
        return 1.0 - (len(source) - len(output)) / chars
    if _holds_in_order(output, source):
        return 1.0
    big = 1 << 32
    out = np.frombuffer(output.encode("utf-32-le"), dtype=np.uint32)
    steps = np.arange(len(out) + 1, dtype=np.int64) * big
    row = steps.copy()
    for x in source:
        best = row + big + 1
        if len(out):
            best[1:] = np.minimum(best[1:], row[:-1] + np.where(out == ord(x), 0, big + 1))
        row = np.minimum.accumulate(best - steps) + steps
    return 1.0 - float(row[-1] % big) / chars


def _holds_in_order(text: str, part: str) -> bool:
    """Whether all characters of ``part`` occur in ``text`` in this order."""
    at = 0
    for x in part:
        at = text.find(x, at) + 1
        if not at:
            return False
    return True


def partial_ratio(a: str, b: str) -> float:
    """The best matching-blocks ratio of the shorter text with a stretch of the longer of the same length."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    blocks = SequenceMatcher(None, short, long).get_matching_blocks()
    starts = {max(0, min(m.b - m.a, len(long) - len(short))) for m in blocks}
    return max(SequenceMatcher(None, short, long[s : s + len(short)]).ratio() for s in starts)


def window_ratio(a: str, b: str) -> float:
    """The best indel ratio of the shorter text with any stretch of the longer that is as long, or shorter at either end."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    if short in long:
        return 1.0
    best = _best_stretch(short, long)
    return max(best, _best_stretch(long, short)) if len(short) == len(long) else best


def _best_stretch(needle: str, text: str) -> float:
    """``window_ratio`` of a needle and a text at least as long: one pass over the table, a diagonal at a time.

    Strands enter the table at its left and top; two of them cross at most once, and bend
    where characters match. Those that enter at the top at or after a stretch's beginning and
    leave at the bottom before its end count the characters that its common subsequence lacks.
    """
    n, size = len(needle), len(text)
    codes = np.unique(np.frombuffer((needle[::-1] + text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)[1]
    kind = np.uint16 if n + size < 1 << 16 else np.uint32  # holds all codes and strands, and one more
    codes = codes.astype(kind)
    rows, columns = codes[:n], codes[n:]
    left, top = np.arange(n, dtype=kind), np.arange(n, n + size, dtype=kind)
    one, bends, low, xor, least = kind(1), np.empty(n, kind), np.empty(n, kind), np.bitwise_xor, np.minimum
    for shift in range(1 - n, size):
        r, k = max(0, -shift), max(0, shift)
        m = min(n - r, size - k)
        h, v, x, y = left[r : r + m], top[k : k + m], bends[:m], low[:m]
        xor(rows[r : r + m], columns[k : k + m], x)
        least(x, one, x)
        np.subtract(x, one, x)  # all bits where characters match, else none
        np.bitwise_or(x, h, x)
        least(x, v, y)  # what goes on to the right: v where strands bend, else the lesser
        xor(v, h, v)
        xor(v, y, v)
        h[:] = y
    left, top = left.astype(np.int64), top.astype(np.int64)
    ends = np.flatnonzero(top >= n)
    starts = top[ends] - n
    lengths = np.arange(1, n)
    first = lengths - np.cumsum(top >= n)[: n - 1]
    after = np.cumsum(np.bincount(starts, minlength=size)[::-1])  # strands that start among the last 1, 2, … places
    last = lengths - after[: n - 1]
    windows = np.zeros(size + 1, np.int64)
    earliest = np.maximum(ends - n + 1, 0)
    np.add.at(windows, earliest[earliest <= starts], 1)
    np.add.at(windows, starts[earliest <= starts] + 1, -1)
    whole = n - np.cumsum(windows)[: size - n + 1]
    return float(max(whole.max() / n, (2 * np.maximum(first, last) / (n + lengths)).max(initial=0.0)))


def repaired(text: str | None) -> str:
    """UTF-8 that was read as Latin-1 read again, and white space collapsed; other texts as they are."""
    out = text or ""
    try:
        out = out.encode("latin-1").decode("utf-8")
    except UnicodeError:
        pass
    return " ".join(out.split())


def fragments_joined(text: str | None) -> str:
    """A letter split from the rest of its word joined to it again, until nothing changes."""
    out, before = " ".join((text or "").split()), None
    while out != before:
        before, out = out, re.sub(r"\b([A-Za-z])\s+([a-z]{2,})\b", r"\1\2", out)
    return out


def script_of(char: str) -> str | None:
    """LATIN, GREEK or OTHER for a letter, null for what is none."""
    if not char.isalpha():
        return None
    name = unicodedata.name(char, "")
    return "LATIN" if "LATIN" in name else "GREEK" if "GREEK" in name else "OTHER"


def mapped(kind: str, fn: Callable[[str | None], object]) -> Callable[[Column | str], Column]:
    """A function of one text as a column function over Arrow batches."""
    return F.pandas_udf(lambda s: s.map(fn, na_action=None).astype("object"), kind)
