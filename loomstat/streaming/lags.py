"""Lag features over a stream: the same columns as `ranking.lag_features` gives for a table.

Rows of a key wait until the watermark has passed them, so that their order is final; then each takes its lags from a buffer of
the last `most` rows. A row that arrives behind the watermark is late and left out, as Spark's watermark has it; rows that
the watermark has not passed when the stream ends have not been given out yet. State of a key: `most` rows and the rows within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, TimestampType


class LagBuffer(StatefulProcessor):
    """A buffer of the last rows and a list of those that wait, by event time in milliseconds."""

    def __init__(self, names: list[str], order: list[str], cols: list[str], span: int, most: int, schema: StructType) -> None:
        self.names, self.order, self.cols, self.span, self.most, self.schema = names, order, cols, span, most, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", StructType([self.schema[c] for c in self.cols]))
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))[self.names]
        self.waiting.appendList([tuple(r) for r in arrived.itertuples(index=False, name=None)])
        self._wake(arrived[self.order[0]].min())
        return iter([])

    def _wake(self, first) -> None:
        """Come back when the watermark has passed the first row that waits; all that it has passed by then are given out."""
        self.handle.registerTimer(int(pd.Timestamp(first).timestamp() * 1000) + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        at = [self.names.index(c) for c in self.order]
        ready = sorted((r for r in held if pd.Timestamp(r[at[0]]).timestamp() * 1000 < passed), key=lambda r: tuple(r[i] for i in at))
        recent = [tuple(r) for r in self.recent.get()]
        out = []
        place = [self.names.index(c) for c in self.cols]
        for r in ready:
            if len(recent) == self.most:
                out.append((*r, *(recent[-k][j] for j in range(len(self.cols)) for k in range(self.span, self.most + 1, self.span))))
            recent = [*recent, tuple(r[i] for i in place)][-self.most :]
        self.recent.put(recent)
        rest = [r for r in held if pd.Timestamp(r[at[0]]).timestamp() * 1000 >= passed]
        if rest:
            self.waiting.put(rest)
            self._wake(min(r[at[0]] for r in rest))
        else:
            self.waiting.clear()
        names = [*self.names, *(f"{c}_lag{k}" for c in self.cols for k in range(self.span, self.most + 1, self.span))]
        return iter([pd.DataFrame(out, columns=names)] if out else [])

    def close(self) -> None:
        pass


def lag_stream(df: DataFrame, key: str, order: list[str], cols: list[str], span: int, most: int, delay: str) -> DataFrame:
    """A stream with copies of cols delayed by span, 2 span, ... up to most rows; the first `most` rows of a key go. order begins with
    the event time; rows up to `delay` out of order are put in order."""
    if not isinstance(df.schema[order[0]].dataType, TimestampType):
        raise ValueError(f"{order[0]} is no timestamp")
    schema = df.schema
    made = [StructField(f"{c}_lag{k}", schema[c].dataType) for c in cols for k in range(span, most + 1, span)]
    processor = LagBuffer(df.columns, order, cols, span, most, schema)
    return df.withWatermark(order[0], delay).groupBy(key).transformWithStateInPandas(processor, StructType([*schema.fields, *made]), "append", "eventtime")
