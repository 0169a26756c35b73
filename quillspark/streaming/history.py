"""Chat history over a stream: the turns of each conversation that came last, kept as keyed state."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# sent to workers by value, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEPT = 10


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kept = list(state.get[0]) if state.exists else []
    out = []
    rows = pd.concat(list(frames)).sort_values("turn", kind="stable")
    for turn, role, text in zip(rows["turn"], rows["role"], rows["text"], strict=True):
        out.append((key[0], turn, "\n".join(kept)))
        kept = [*kept, f"{role}: {text[:600] if role == 'assistant' else text}"][-KEPT:]
    state.update((kept,))
    yield pd.DataFrame(out, columns=["conv_id", "turn", "history"])


def streaming_history(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, history) for every turn of a stream with conv_id, turn, role and text."""
    return turns.groupBy("conv_id").applyInPandasWithState(_step, "conv_id bigint, turn bigint, history string", "kept array<string>", "append", GroupStateTimeout.NoTimeout)
