"""Cached areas: lossless small encoding, age limits, recency, cooldown."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from contextlib import suppress
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright import schemas
from lanewright.functions.scalar import COOLDOWN_MS, MAX_ENTRY_CHARS, TTL_MS, area_key, from_fixed7, to_fixed7
from lanewright.operators.runs import in_order


def slim(items: DataFrame) -> DataFrame:
    """(area_id, v, i, a, o, w) of an element table: node ids in order and their
    fixed-point coordinates, each as the step from the one before; the ways'
    references in order. The last node of an id counts; tags go."""
    last = items.where("type = 'node'").groupBy("area_id", "id").agg(F.max_by(F.struct("lat", "lon"), "pos").alias("p"))
    fixed = last.select("area_id", "id", to_fixed7("p.lat").alias("y"), to_fixed7("p.lon").alias("x"))
    w = Window.partitionBy("area_id").orderBy("id")
    step = lambda c: (F.col(c) - F.lag(c, 1, 0).over(w)).alias("d" + c)
    steps = fixed.select("area_id", "id", step("id"), step("y"), step("x"))
    nodes = steps.groupBy("area_id").agg(F.array_sort(F.collect_list(F.struct("id", "did", "dy", "dx"))).alias("s"))
    refs = items.where("type = 'way' and nodes is not null").groupBy("area_id").agg(F.array_sort(F.collect_list(F.struct("pos", "nodes"))).alias("w"))
    none = F.array().cast("array<bigint>")
    column = lambda f: F.coalesce(F.transform("s", lambda s: s[f]), none)
    both = nodes.join(refs, "area_id", "full")
    return both.select("area_id", F.lit(1).alias("v"), column("did").alias("i"), column("dy").alias("a"), column("dx").alias("o"), F.coalesce(F.transform("w", lambda x: x["nodes"]), F.array().cast("array<array<bigint>>")).alias("w"))


def expand(slimmed: DataFrame) -> DataFrame:
    """The element table again: nodes by id, then ways; no tags."""
    rows = slimmed.select("area_id", F.posexplode(F.arrays_zip("i", "a", "o")).alias("pos", "s"))
    w = Window.partitionBy("area_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    upto = lambda f: F.sum(F.col(f"s.{f}")).over(w)
    nodes = rows.select("area_id", "pos", F.lit("node").alias("type"), upto("i").alias("id"), from_fixed7(upto("a")).alias("lat"), from_fixed7(upto("o")).alias("lon"), F.lit(None).cast("array<bigint>").alias("nodes"))
    number = slimmed.select("area_id", F.size("i").alias("n"), "w")
    ways = number.select("area_id", "n", F.posexplode("w").alias("k", "nodes")).select("area_id", (F.col("n") + F.col("k")).alias("pos"), F.lit("way").alias("type"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "nodes")
    return nodes.unionByName(ways)


def peek(requests: DataFrame, entries: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """``requests`` (key, now, ..) with hit: whether the key's newest record of
    (key, t) up to then is no older than the limit. At the limit is a hit."""
    marks = requests.select("*", F.lit(None).cast("bigint").alias("_t"), F.lit(1).alias("_ask"))
    puts = entries.select("key", F.col("t").alias("now"), F.col("t").alias("_t"), F.lit(0).alias("_ask"))
    w = Window.partitionBy("key").orderBy("now", "_ask").rowsBetween(Window.unboundedPreceding, -1)
    both = marks.unionByName(puts, allowMissingColumns=True).withColumn("_last", F.last("_t", ignorenulls=True).over(w))
    return both.where("_ask = 1").select(*requests.columns, F.coalesce(F.col("now") - F.col("_last") <= ttl_ms, F.lit(False)).alias("hit"))


def recency(uses: DataFrame, keys: list[str], at: str = "at", tie: str = "seq") -> DataFrame:
    """(keys.., key, place): entries by their last use, the newest at 1."""
    last = uses.groupBy(*keys, "key").agg(F.max(F.struct(at, tie)).alias("_u"))
    return last.select(*keys, "key", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_u"))).alias("place"))


def cooldown_gate(events: DataFrame, keys: list[str], window_ms: int = COOLDOWN_MS) -> DataFrame:
    """(keys.., seq, at, accepted) of (keys.., seq, at): an event passes if it is
    at least the window after the last of its key that passed."""

    def fold():
        last = None

        def step(at: int) -> bool:
            nonlocal last
            go = last is None or at - last >= window_ms
            last = at if go else last
            return go

        return step

    return in_order(events.select(*keys, "seq", "at"), keys, ["at", "seq"], fold, ["at"], "accepted", pa.bool_())


def would_use_network(requests: DataFrame, places: DataFrame, areas: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """``requests`` (demo, key, now, radius_m, net, ..) with network: unless it is
    a demo, or both the address (key, t, lat, lon) and the area (key, t) around
    it are cached and young enough."""
    fresh = lambda t: F.col("now") - F.col(t) <= ttl_ms
    p = places.select(F.col("key"), F.col("t").alias("_pt"), F.col("lat").alias("_y"), F.col("lon").alias("_x"))
    with_place = requests.join(p, "key", "left").withColumn("_area", area_key("net", "radius_m", "_y", "_x"))
    a = areas.select(F.col("key").alias("_area"), F.col("t").alias("_at"))
    out = with_place.join(a, "_area", "left")
    cached = F.coalesce(fresh("_pt"), F.lit(False)) & F.coalesce(fresh("_at"), F.lit(False))
    return out.select(*requests.columns, (~F.col("demo") & ~cached).alias("network"))


@dataclass
class Store:
    """Records in a store of limited size, the least recently used going first.

    ``room`` is in characters. A put over ``most`` is refused before anything
    changes, so an old record survives it; a record past its age goes when it
    is got, not when it is peeked at; a get renews use, not age. ``write`` and
    ``remove`` reach the medium behind; a write that raises is like a store
    without room (older records make way, and if none is left the put fails),
    and a removal that raises is passed over.
    """

    room: int
    ttl_ms: int = TTL_MS
    most: int = MAX_ENTRY_CHARS
    clock: Callable[[], int] | None = None
    #: key -> (time, size, value), the least recently used first
    records: OrderedDict[str, tuple[int, int, object]] = field(default_factory=OrderedDict)
    used: int = 0
    write: Callable[[str, object], None] = lambda key, value: None
    remove: Callable[[str], None] = lambda key: None

    def _fits(self, key: str, size: int, value: object) -> bool:
        if self.used + len(key) + size > self.room:
            return False
        try:
            self.write(key, value)
        except Exception:  # the medium's own errors: full, gone, not allowed
            return False
        return True

    def put(self, key: str, size: int, at: int, value: object = None) -> tuple[bool, list[str]]:
        if size > self.most:
            return False, []
        self.drop(key)
        gone = []
        while not self._fits(key, size, value):
            if not self.records:
                return False, gone
            gone.append(next(iter(self.records)))
            self.drop(gone[-1])
        self.records[key] = at, size, value
        self.used += len(key) + size
        return True, gone

    def peek(self, key: str, at: int) -> bool:
        return key in self.records and at - self.records[key][0] <= self.ttl_ms

    def get(self, key: str, at: int) -> bool:
        if not self.peek(key, at):
            self.drop(key)
            return False
        self.records.move_to_end(key)
        return True

    def value(self, key: str) -> object:
        return self.records[key][2] if key in self.records else None

    def drop(self, key: str) -> None:
        if (old := self.records.pop(key, None)) is not None:
            self.used -= len(key) + old[1]
            with suppress(Exception):
                self.remove(key)


def replay(events: DataFrame, room: int, ttl_ms: int = TTL_MS, most: int = MAX_ENTRY_CHARS) -> DataFrame:
    """What each put, get, peek and drop of (namespace, seq, op, key, size, at)
    gives: ok, and the keys that had to go. One store a namespace, in order of
    seq; namespaces run in parallel."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        store, out = Store(room, ttl_ms, most), []
        for ns, seq, op, key, size, at in frame.sort_values("seq")[["namespace", "seq", "op", "key", "size", "at"]].itertuples(index=False):
            gone: list[str] = []
            if op == "put":
                ok, gone = store.put(key, int(size), int(at))
            elif op == "drop":
                ok = key in store.records
                store.drop(key)
            else:
                ok = (store.get if op == "get" else store.peek)(key, int(at))
            out.append((ns, seq, op, key, ok, gone))
        return pd.DataFrame(out, columns=["namespace", "seq", "op", "key", "ok", "evicted"])

    return events.groupBy("namespace").applyInPandas(run, schemas.CACHE_RESULT)


class AreaCache:
    """What a client keeps: areas in their small form, addresses, and when it
    last asked the network. Keys are texts made by ``area_key`` and
    ``address_key``; areas and addresses share one order of use, and the stamp
    stands outside it."""

    def __init__(self, store: Store, clock: Callable[[], int]):
        self.store, self.clock, self.stamp = store, clock, None

    def put_area(self, key: str, slimmed: object, size: int) -> bool:
        return self.store.put("area|" + key, size, self.clock(), slimmed)[0]

    def get_area(self, key: str) -> object | None:
        return self.store.value("area|" + key) if self.store.get("area|" + key, self.clock()) else None

    def has_area(self, key: str) -> bool:
        return self.store.peek("area|" + key, self.clock())

    def put_address(self, key: str, place: tuple[float, float]) -> bool:
        return self.store.put("address|" + key, len(str(list(place))), self.clock(), tuple(place))[0]

    def _place(self, key: str) -> tuple[float, float] | None:
        place = self.store.value("address|" + key)
        return place if isinstance(place, tuple) and len(place) == 2 else None

    def get_address(self, key: str) -> tuple[float, float] | None:
        return self._place(key) if self.store.get("address|" + key, self.clock()) else None

    def peek_address(self, key: str) -> tuple[float, float] | None:
        return self._place(key) if self.store.peek("address|" + key, self.clock()) else None

    def note_fetch(self, at: int) -> None:
        self.stamp = at

    def last_fetch(self) -> int | None:
        return self.stamp if isinstance(self.stamp, int) else None

    def cooling(self, window_ms: int = COOLDOWN_MS) -> int:
        """Milliseconds until the network may be asked again."""
        return 0 if self.last_fetch() is None else max(0, window_ms - (self.clock() - self.last_fetch()))
