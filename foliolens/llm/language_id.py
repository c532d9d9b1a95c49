"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (1 to 3 letters, words
padded with a blank), most frequent first. A document's own list is compared with each
profile: every n-gram adds how far it is out of place, or the length of the profile
where the profile lacks it. The language at the least distance wins.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.llm.common import hash_fraction, held_out, map_batches, with_column, with_fields

UNKNOWN = "und"
#: n-grams in a profile and in a document's own list.
PROFILE_LENGTH = 400
#: Bound of the sample that a profile is learnt from: so many documents of each language, about.
FIT_DOCS_PER_LANG = 1500

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Lower-case letter of each code point; the blank for all that is no letter."""
    global _letters
    if _letters is None:
        table = np.full(sys.maxunicode + 1, 32, dtype=np.int64)
        for c in range(sys.maxunicode + 1):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters = table
    return _letters


def ranked_ngrams(text: str | None, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``limit`` most frequent n-grams of a whole text as 63-bit keys with their counts, ties by key."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    a = _letter_table()[codes]
    blank = a == 32
    a = a[~(blank & np.roll(blank, 1))] if len(a) > 1 else a  # runs of blanks count as one
    if a.size == 0 or a[0] != 32:
        a = np.concatenate(([32], a))
    if a[-1] != 32:
        a = np.concatenate((a, [32]))
    if len(a) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    middle = a[1:-1]
    inner = middle != 32
    two = (a[:-1] << 21) | a[1:]
    three = ((a[:-2] << 42) | (middle << 21) | a[2:])[inner]
    keys = np.concatenate((middle[inner], two, three))
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    if len(keys) > limit:
        order = np.argsort(-counts, kind="stable")[:limit]
    else:
        order = np.argsort(-counts, kind="stable")
    return keys[order], counts[order]


@dataclass
class LanguageProfiles:
    """Ranks of the n-grams of all profiles; -1 where a profile lacks one."""

    langs: list[str]
    keys: np.ndarray
    ranks: np.ndarray
    length: int = PROFILE_LENGTH

    @staticmethod
    def of(profiles: dict[str, list[int]], length: int = PROFILE_LENGTH) -> LanguageProfiles:
        langs = sorted(profiles)
        keys = np.array(sorted({k for p in profiles.values() for k in p}), dtype=np.int64)
        ranks = np.full((len(langs), len(keys)), -1, dtype=np.int64)
        for i, lang in enumerate(langs):
            ranks[i, np.searchsorted(keys, profiles[lang])] = np.arange(len(profiles[lang]))
        return LanguageProfiles(langs, keys, ranks, length)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): 1 at distance 0, 0 where no n-gram is shared; ('und', 0) without letters.

        Ties go to the first language in alphabetical order.
        """
        keys, _ = ranked_ngrams(text, self.length)
        if not len(keys) or not self.langs or not (keys > 32).any():
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        place = np.flatnonzero(known)
        ranks = self.ranks[:, at[known]]
        off = np.where(ranks < 0, self.length, np.minimum(np.abs(ranks - place), self.length)).sum(axis=1)
        total = off + (len(keys) - len(place)) * self.length
        best = int(np.argmin(total))
        return self.langs[best], float(1 - total[best] / (len(keys) * self.length))


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                 per_lang: int = FIT_DOCS_PER_LANG, length: int = PROFILE_LENGTH) -> LanguageProfiles:
    """Learn a profile of each language from documents that aren't held out.

    About ``per_lang`` documents of each language are drawn by a hash of their id (all,
    where there are fewer), each read whole. The counting is distributed; the driver gets
    ``length`` n-grams of each language and one threshold. Rows with null text or language
    teach nothing. No training rows: every document is then ``und``.
    """
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where(
        ~held_out(F.col("i")) & F.col("l").isNotNull() & F.col("t").isNotNull())
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageProfiles([], np.empty(0, np.int64), np.empty((0, 0), np.int64), length)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    drawn = rows.where(hash_fraction(F.col("i")) < F.element_at(share, F.col("l"))).select("l", "t")

    def count(batches):
        found: dict[str, dict[int, int]] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = found.setdefault(name, {})
                keys, counts = ranked_ngrams(body, 1 << 40)
                for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
                    own[k] = own.get(k, 0) + n
        for name, own in found.items():
            yield pa.RecordBatch.from_pydict({"l": [name] * len(own), "k": pa.array(list(own), pa.int64()), "n": pa.array(list(own.values()), pa.int64())})

    counted = drawn.mapInArrow(count, "l string, k bigint, n bigint").groupBy("l", "k").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("l").orderBy(F.desc("n"), "k")
    top = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= length).orderBy("l", "r").collect()
    profiles: dict[str, list[int]] = {}
    for r in top:
        profiles.setdefault(r["l"], []).append(r["k"])
    return LanguageProfiles.of(profiles, length)


def with_language(docs: DataFrame, profiles: LanguageProfiles, text: str = "text",
                  lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its score to each row; columns of these names are replaced.

    Whole texts are read. Null or empty texts, and texts without a letter, get ``und`` and 0.
    """

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [profiles.predict(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        batch = with_column(batch, lang_pred, pa.array([x[0] for x in found], pa.string()))
        return with_column(batch, score, pa.array([x[1] for x in found], pa.float64()))

    out = docs.drop(lang_pred, score)
    return map_batches(out, predict, with_fields(out.schema, (lang_pred, "string"), (score, "double")))
