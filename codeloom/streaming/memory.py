"""The memory of chats as state: the last turns of each conversation, whatever the order in which they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.operators.history import MEMORY

TURNS = "array<struct<turn:long,role:string,content:string>>"


def remembered(messages: DataFrame, memory: int = MEMORY, ttl_ms: int | None = None) -> DataFrame:
    """A stream of messages (conv_id, turn, role, content) as a stream (output mode update) of what each conversation's memory is after
    what has come: conv_id, n_seen, turns. Late turns are put in their place, a turn that comes again replaces the one before, and a
    conversation without new turns for ttl_ms is forgotten (give that to a query whose trigger repeats: with a time to live Spark runs
    batches without data too, and a query over what is there now would not end). A conversation's state is memory turns, never its past."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, turns, roles, contents = state.get if state.exists else (0, [], [], [])
        held = dict(zip(turns, zip(roles, contents, strict=True), strict=True))
        for batch in batches:
            seen += len(batch)
            for turn, role, content in zip(batch["turn"], batch["role"], batch["content"], strict=True):
                held[int(turn)] = ("user" if role == "user" else "assistant", content)
            held = dict(sorted(held.items())[-memory:])
        state.update((seen, [*held], [r for r, _ in held.values()], [c for _, c in held.values()]))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        shown = [{"turn": t, "role": r, "content": c} for t, (r, c) in held.items()]
        yield pd.DataFrame({"conv_id": [key[0]], "n_seen": [seen], "turns": [shown]})

    return messages.groupBy("conv_id").applyInPandasWithState(
        update, f"conv_id long, n_seen long, turns {TURNS}", "seen long, turns array<long>, roles array<string>, contents array<string>", "update",
        GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
