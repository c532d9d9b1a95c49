"""Trees of quarters, shards cut into chunks, and fingerprints that share a half, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from foliolens.llm import components, simhash_vp
from foliolens.llm.common import table


def made(seed: int, n: int = 400) -> np.ndarray:
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near = base[: n // 2].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, n // 2).astype(np.uint64)
    hot = np.repeat(base[:1], 150) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    half = (base[1] >> np.uint64(32) << np.uint64(32)) | rng.integers(0, 1 << 32, 200, dtype=np.uint64)
    return np.unique(np.concatenate((base, near, hot, half))).view(np.int64)


def all_pairs(fps: np.ndarray, reps: np.ndarray) -> np.ndarray:
    u = fps.view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)
    return components.local_labels(len(fps), reps[i], reps[j])


@pytest.mark.parametrize("levels", [0, 3, 6])
@pytest.mark.parametrize("parts", [2, 4])
@pytest.mark.parametrize("chunks", [1, 3])
def test_no_pair_is_lost(levels, parts, chunks, monkeypatch):
    monkeypatch.setattr(simhash_vp, "BLOCK", 400)
    fps = made(levels)
    reps = np.random.default_rng(1).permutation(len(fps)).astype(np.int64)
    a, b, copies = [], [], 0
    for t in range(parts):
        row, shard, home = simhash_vp.VantageTree.fit(fps, t, levels, parts).route(fps)
        assert np.bincount(row[home], minlength=len(fps)).tolist() == [1] * len(fps)
        copies += len(row)
        for s in np.unique(shard):
            own = row[shard == s]
            chunk = reps[own] % chunks
            for low in range(chunks):
                for high in range(low, chunks):
                    some = (chunk == low) | (chunk == high)
                    sides = None if low == high else chunk[some] == low
                    x, y = simhash_vp.shard_links(fps[own[some]], reps[own[some]], home[shard == s][some], t, parts, sides)
                    a.append(x)
                    b.append(y)
    assert parts == 2 or copies == 4 * len(fps)
    assert (components.local_labels(len(fps), np.concatenate(a), np.concatenate(b)) == all_pairs(fps, reps)).all()


@pytest.mark.parametrize("shard_rows,chunked", [(10, 1 << 20), (10, 60), (1 << 20, 300)])
def test_groups_of_many_shards_and_chunks(spark, monkeypatch, shard_rows, chunked):
    monkeypatch.setattr(simhash_vp, "CHUNKED_ROWS", chunked)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = simhash_vp.near_duplicates(docs, shard_rows=shard_rows).toPandas().sort_values("doc_id")
    ids = got.doc_id.to_numpy()
    labels = all_pairs(got.fp.to_numpy(), np.arange(len(ids)))
    assert (got.component_id.to_numpy() == ids[labels]).all() and len(set(labels)) < len(ids)
