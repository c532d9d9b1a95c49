"""Optimal one-to-one assignment of scored pairs, page by page."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from foliolens.sources.shipping import ship

#: Pairs below this score are no match.
LEAST_SCORE = 0.05


def cheapest(cost: np.ndarray) -> np.ndarray:
    """Column of each row at the least total cost (rows at most columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            better = reduced < low[free]
            low[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[low[free].argmin()]
            step = low[j1]
            u[owner[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    out = np.zeros(n, int)
    out[owner[1:][owner[1:] > 0] - 1] = np.flatnonzero(owner[1:] > 0)
    return out


def best_assignment(scored: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(page, a, b, score): the one-to-one pairs of the highest total on each page; scores below ``least`` are dropped.

    Pages are bounded groups, each solved in one task.
    """

    ship(scored.sparkSession)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot_table(index="a", columns="b", values="score", aggfunc="max").sort_index().sort_index(axis=1).fillna(0.0)
        x = grid.to_numpy()
        if x.shape[0] <= x.shape[1]:
            rows, cols = np.arange(len(x)), cheapest(-x)
        else:
            rows, cols = cheapest(-x.T), np.arange(x.shape[1])
        out = pd.DataFrame({"page": pdf["page"].iloc[0], "a": grid.index[rows], "b": grid.columns[cols], "score": x[rows, cols]})
        return out[out.score >= least]

    return scored.groupBy("page").applyInPandas(solve, scored.select("page", "a", "b", "score").schema)
