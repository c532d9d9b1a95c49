"""Near-duplicates by sets of word shingles against brute force and planted near copies."""

from __future__ import annotations

import random

import numpy as np
import pytest
from foliolens.llm import components, simhash_vp, word_sets
from foliolens.llm.common import table

SF = "/root/testdata/sf0.01"


def _sets(text: str | None) -> set:
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def _brute(texts: list) -> np.ndarray:
    sets = [_sets(t) for t in texts]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or (min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and len(a & b) * 5 >= len(a | b) * 4)]
    return components.local_labels(len(sets), *(np.array([p[k] for p in near], dtype=np.int64) for k in (0, 1)))


@pytest.mark.parametrize("chunk_rows", [4, 128])
def test_groups_equal_brute_force(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(word_sets, "CHUNK_ROWS", chunk_rows)
    docs = table(spark, SF, "documents").where("doc_id < 400").select("doc_id", "text").toPandas().sort_values("doc_id")
    rng = random.Random(chunk_rows)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    texts = [*docs.text, None, "", "a b", "A B", "a b c"]
    for _ in range(40):  # one large group of near copies, some linked only by way of others
        words = list(base)
        for _ in range(rng.randrange(1, 8)):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    got = word_sets.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert [r["component_id"] for r in got.orderBy("doc_id").collect()] == _brute(texts).tolist()


def test_near_copies_beyond_three_bits_are_one_group(spark):
    rng = random.Random(7)
    rows = []
    for i in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        copy = list(words)
        for k in rng.sample(range(300), 5):  # at most 25 of 296 shingles differ: similarity 0.84 or more
            copy[k] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    bits = [(simhash_vp.fingerprint(a) ^ simhash_vp.fingerprint(b)).bit_count() for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True)]
    assert max(bits) > 3
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id bigint, text string")
    kept = simhash_vp.one_of_each_group(df, groups=word_sets.near_duplicates).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept) == [-1, *range(0, 60, 2)]
