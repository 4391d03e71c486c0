"""Beyond the reference: time differences of a stream of records, by subject.

The state of a subject is the time of its last record.  Records of a micro-batch
are taken in the order of their times; a record older than the state's time
gives 0, as the first one does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_time_diff(events: DataFrame, key: str, ts: str, name: str = "total_seconds") -> DataFrame:
    """Seconds since a subject's previous record, over an unbounded stream: (key, ts, name)."""

    def step(subject: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(ts)
        out = []
        for t in rows[ts]:
            now = pd.Timestamp(t).value // 1000
            out.append(max(0, (now - last) // 1_000_000) if last is not None else 0)
            last = now if last is None else max(last, now)
        state.update((last,))
        yield pd.DataFrame({key: [subject[0]] * len(rows), ts: rows[ts].to_numpy(), name: out})

    kinds = dict(events.dtypes)
    return events.select(key, ts).groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {ts} {kinds[ts]}, {name} bigint", "last bigint", "append", GroupStateTimeout.NoTimeout
    )
