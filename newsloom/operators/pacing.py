"""Pacing of requests, replayed over a log: the interval doubles on a penalty and halves after a run of successes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paced(events: DataFrame, scope: str, order: str, penalty: str, least: float, most: float = 60.0, run: int = 10) -> DataFrame:
    """``events`` (scope, order, penalty) with the ``interval`` in force after each, per scope in order.

    A scope is sorted by Spark and read batch by batch with only its state in memory, so a hot scope never has to fit a task.
    Null penalties are successes; rows of a null scope are a scope of their own.
    """

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: tuple = ()
        interval, good = least, 0
        for df in batches:
            out = []
            for key, at, bad in zip(df[scope], df[order], df[penalty]):
                name = None if key is None or key != key else key
                if state != (name,):
                    state, interval, good = (name,), least, 0
                if bad is not None and bad == bad and bool(bad):
                    interval, good = min(most, interval * 2), 0
                else:
                    good += 1
                    if good == run:
                        interval, good = max(least, interval / 2), 0
                out.append((key, at, interval))
            yield pd.DataFrame(out, columns=[scope, order, "interval"])

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    sorted_ = events.select(scope, order, F.col(penalty)).repartition(F.col(scope)).sortWithinPartitions(scope, order)
    return sorted_.mapInPandas(replay, f"`{scope}` {kinds[scope]}, `{order}` {kinds[order]}, interval double")
