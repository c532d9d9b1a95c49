"""Greedy one-dimensional clustering of words into rows, page by page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from foliolens.sources.shipping import ship

#: A word joins the first row whose centre is at most this far.
ROW_TOLERANCE = 4.0


def greedy_rows(words: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """(page, row, y, text) of word cells (page, pos, y, x, text).

    Words are taken in order of ``pos``; each joins the first row within the tolerance,
    whose centre then is the mean of its words. A choice depends on those before, so a
    page, a bounded group, is one task.
    """

    ship(words.sparkSession)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = []
        for w in pdf.sort_values("pos").itertuples():
            home = next((r for r in rows if abs(sum(x.y for x in r) / len(r) - w.y) <= tolerance), None)
            if home is None:
                rows.append(home := [])
            home.append(w)
        return pd.DataFrame({
            "page": pdf["page"].iloc[0], "row": range(len(rows)), "y": [sum(x.y for x in r) / len(r) for r in rows],
            "text": [" ".join(x.text for x in sorted(r, key=lambda x: x.x)) for r in rows]})

    kind = words.schema["page"].dataType.simpleString()
    return words.groupBy("page").applyInPandas(cluster, f"page {kind}, row int, y double, text string")
