"""Segments of a stream's rows bounded by span and size, cut as rows come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "stream string, id long, segment long"


def segment_stream(rows: DataFrame, most_span: int, most_size: int) -> DataFrame:
    """(stream, id, segment) of a stream's rows (stream, id, span, size), as operators.ordered.segment cuts a batch.

    The open segment's number and sums are the state; a micro-batch's rows are taken in the order of id, and must not be
    older than those of the batches before.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, spans, sizes = state.get if state.exists else (0, 0, 0)
        out, begun = [], state.exists
        for i, a, b in pd.concat(list(frames)).sort_values("id", kind="stable")[["id", "span", "size"]].itertuples(index=False):
            if begun and (spans + a > most_span or sizes + b > most_size):
                now, spans, sizes = now + 1, 0, 0
            spans, sizes, begun = spans + int(a), sizes + int(b), True
            out.append((key[0], i, now))
        state.update((int(now), int(spans), int(sizes)))
        yield pd.DataFrame(out, columns=["stream", "id", "segment"])

    grouped = rows.select("stream", "id", "span", "size").groupBy("stream")
    return grouped.applyInPandasWithState(fold, SCHEMA, "now long, spans long, sizes long", "append", "NoTimeout")
