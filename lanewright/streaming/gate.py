"""The cooldown and the age limit as stateful streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lanewright.functions.scalar import COOLDOWN_MS, TTL_MS


def cooldown_stream(events: DataFrame, window_ms: int = COOLDOWN_MS) -> DataFrame:
    """(key, seq, at, accepted) of a stream of (key, seq, at): state is the time of
    a key's last accepted event. Events of one batch are taken in order of
    (at, seq); batches in order of arrival. State is one number a key, for good:
    a timeout by the clock would keep a bounded run from ending, and one by
    event time would drop late events."""

    def gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        ok = []
        for at in rows["at"]:
            go = last is None or at - last >= window_ms
            ok.append(go)
            last = int(at) if go else last
        state.update((last,))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"], "at": rows["at"], "accepted": ok})

    return events.groupBy("key").applyInPandasWithState(gate, "key string, seq long, at long, accepted boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def ttl_stream(events: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """(key, seq, at, hit) of the gets in a stream of (key, seq, at, op): a get
    hits if the key's last put is no older than the limit."""

    def look(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        put = state.get[0] if state.exists else None
        out = []
        for seq, at, op in pd.concat(list(frames)).sort_values(["at", "seq"])[["seq", "at", "op"]].itertuples(index=False):
            if op == "put":
                put = int(at)
            else:
                out.append((key[0], seq, at, put is not None and at - put <= ttl_ms))
        if put is not None:
            state.update((put,))
        yield pd.DataFrame(out, columns=["key", "seq", "at", "hit"])

    return events.groupBy("key").applyInPandasWithState(look, "key string, seq long, at long, hit boolean", "put long", "append", GroupStateTimeout.NoTimeout)
