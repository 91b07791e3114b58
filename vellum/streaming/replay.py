"""Edit events as a stream.

Writes to cells need no state beyond the last one of each cell, which a streaming
aggregation keeps; edits of running texts move positions, so each document's text is
state of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.edit import apply_edit

_RESULT = "doc_id long, seq long, text string"


def cells(edits: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last write of each cell so far; run it in update mode."""
    return edits.groupBy(*keys).agg(F.max_by("ch", order).alias("ch"))


def texts(edits: DataFrame) -> DataFrame:
    """(doc_id, seq, text) after each batch of edits (doc_id, seq, op, start, end, piece); edits at or before the last seq are late and passed over."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, last = state.get if state.exists else ("", -1)
        for row in pd.concat(frames).sort_values("seq").itertuples(index=False):
            if row.seq > last:
                text, last = apply_edit(text, row.op, row.start, row.end, row.piece), row.seq
        state.update((text, last))
        yield pd.DataFrame({"doc_id": [key[0]], "seq": [last], "text": [text]})

    return edits.groupBy("doc_id").applyInPandasWithState(run, _RESULT, "text string, last long", "update", GroupStateTimeout.NoTimeout)
