"""Folds over each key's rows in the order of their event time, on streams: rows wait until the watermark has passed them.

A row may come late by as much as the watermark allows, or be replayed, or lie in any trigger: what it gets is what a
fold over all rows in order gives it. Timers are of event time, so a pause on the wall clock forgets nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: What a fold remembers of a key, a row's values, and the moment from which on it may be forgotten.
Step = Callable[[tuple, tuple], tuple[tuple, tuple]]


def in_event_time(rows: DataFrame, columns: list[str], start: tuple, step: Step, memory: str, result: str, keep_seconds: int, late: str) -> DataFrame:
    """rows(client, at seconds, seq, columns) -> (client, at, seq, result).

    step(memory, (at, *columns)) -> (memory, result), over a client's rows by at and seq. memory is the schema of what it
    remembers, forgotten keep_seconds after the client's last row; result that of its columns. Rows that come more than
    late after the latest are dropped, as everywhere with a watermark.
    """
    waiting = ", ".join(f"w{k} array<{rows.schema[c].dataType.simpleString()}>" for k, c in enumerate(["at", "seq", *columns]))
    size = len(memory.split(", "))
    names = ["client", "at", "seq", *(c.split()[0] for c in result.split(", "))]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else (*start, *([] for _ in range(2 + len(columns))))
        remembered, pending = held[:size], list(zip(*held[size:], strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                pending += list(frame[["at", "seq", *columns]].itertuples(index=False, name=None))
        pending = sorted(tuple(x.item() if hasattr(x, "item") else x for x in p) for p in pending)
        mark, out = state.getCurrentWatermarkMs(), []
        while pending and pending[0][0] * 1000 <= mark:
            at, seq, *values = pending.pop(0)
            remembered, found = step(remembered, (at, *values))
            out.append((key[0], at, seq, *found))
        last = pending[0][0] if pending else (out[-1][1] if out else None)
        if not pending and (not out and state.hasTimedOut):
            state.remove()
        else:
            state.update((*remembered, *(map(list, zip(*pending, strict=True)) if pending else ([] for _ in range(2 + len(columns))))))
            # rows that wait are due when the watermark reaches them; what is remembered is due when it is of no more use
            due = last * 1000 if pending else (last + keep_seconds) * 1000 if last is not None else mark + keep_seconds * 1000
            state.setTimeoutTimestamp(max(due, mark + 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    timed = rows.select("client", "at", "seq", *columns).withColumn("_ts", F.timestamp_seconds("at")).withWatermark("_ts", late)
    return timed.groupBy("client").applyInPandasWithState(run, f"client {rows.schema['client'].dataType.simpleString()}, at long, seq long, {result}", f"{memory}, {waiting}", "append", "EventTimeTimeout")
