"""Answers of an outside service to rows of pages, in bounded batches with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from itertools import chain, pairwise
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.sources.shipping import ship

BATCH_ROWS = 8
ATTEMPTS = 3
FIRST_WAIT_S = 0.05


def asked(ask: Callable[[pd.DataFrame], list[Mapping[str, Any] | None]], rows: pd.DataFrame, attempts: int = ATTEMPTS, wait: float = FIRST_WAIT_S) -> tuple[list, str | None]:
    """The answers to rows, one each, or nulls and the last error once all attempts failed; each wait is twice the one before."""
    problem = None
    for k in range(attempts):
        try:
            answers = list(ask(rows))
            if len(answers) == len(rows):
                return answers, None
            problem = f"{len(answers)} answers to {len(rows)} rows"
        except Exception as e:  # a service may fail in any way; the row says how
            problem = f"{type(e).__name__}: {e}"
        if k + 1 < attempts:
            time.sleep(wait * 2**k)
    return [None] * len(rows), problem


def with_answers(
    rows: DataFrame, page: str, pos: str, ask: Callable[[pd.DataFrame], list[Mapping[str, Any] | None]], answer: str, batch_rows: int = BATCH_ROWS, attempts: int = ATTEMPTS,
) -> DataFrame:
    """(page, pos, the columns of the DDL ``answer``, problem): what ``ask`` says to each row.

    A batch holds the rows of one page whose places fall in one stretch of ``batch_rows``
    places, so no batch grows with the page. Rows that stay without an answer have nulls;
    a null page or place makes a batch of its own rows one by one.
    """
    ship(rows.sparkSession)
    names = [part.split()[0] for part in answer.split(",")]
    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in (page, pos))

    def answered(pdf: pd.DataFrame) -> dict[str, list]:
        answers, problem = asked(ask, pdf, attempts)
        return {n: [a.get(n) if a else None for a in answers] for n in names} | {"problem": [problem] * len(pdf)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in chain(frames, [None]):
            # The last stretch of a frame may go on in the next one, so it waits.
            pdf = frame if held is None else held if frame is None else pd.concat([held, frame], ignore_index=True)
            if pdf is None or not len(pdf):
                continue
            new = (pdf[[page, "_stretch"]] != pdf[[page, "_stretch"]].shift()).any(axis=1)
            starts = list(pdf.index[new])
            if frame is None:
                starts.append(len(pdf))
            held = pdf.iloc[starts[-1] :].reset_index(drop=True)
            told = pdf.iloc[: starts[-1]]
            if len(told):
                own = told.drop(columns="_stretch")
                parts = [answered(own.iloc[i:j]) for i, j in pairwise(starts)]
                yield pd.DataFrame({page: told[page], pos: told[pos]} | {n: pd.Series([x for part in parts for x in part[n]], dtype=object, index=told.index) for n in [*names, "problem"]})

    batched = rows.withColumn("_stretch", F.floor(F.col(pos) / batch_rows))
    return batched.repartition(page, "_stretch").sortWithinPartitions(page, "_stretch", pos).mapInPandas(run, f"{keys}, {answer}, problem string")
