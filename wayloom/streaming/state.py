"""Stateful operators of the request stream: each a plain transition, run in batch or over a stream.

A transition takes (state, event) and returns (state, output).  `over_batch`
runs it along the order of each key; `over_stream` runs the same function with
`applyInPandasWithState`.  Keys are users or addresses: many, each with few
events; events of a key are ordered by time, then by their number.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Requests a minute and an hour, seconds of the windows, of history folding, of cached refusals and of backoff.
PER_MINUTE, PER_HOUR = 60, 600
MINUTE_S, HOUR_S, FOLD_S, REFUSAL_S = 60.0, 3600.0, 600.0, 60.0
BACKOFF_S, BACKOFF_DOUBLINGS = 5, 4
LIST_ITEMS, LIST_BYTES = 200, 57_344
DEDUP_S = 120


def limiter(per_minute: int = PER_MINUTE, per_hour: int = PER_HOUR) -> Callable[[Any, dict], tuple[Any, dict]]:
    """Fixed windows that start with the first request after the last one ended; a refused request costs nothing."""

    def step(state: Any, event: dict) -> tuple[Any, dict]:
        now = event["at"]
        windows = state or [[None, 0], [None, 0]]
        for w, span in zip(windows, (MINUTE_S, HOUR_S), strict=True):
            if w[0] is None or now - w[0] >= span:
                w[0], w[1] = now, 0
        for w, span, most in zip(windows, (MINUTE_S, HOUR_S), (per_minute, per_hour), strict=True):
            if w[1] >= most:
                return windows, {"allowed": False, "retry_after": int(math.floor(w[0] + span - now)) + 1}
        for w in windows:
            w[1] += 1
        return windows, {"allowed": True, "retry_after": 0}

    return step


def refusal_cache(ttl: float = REFUSAL_S) -> Callable[[Any, dict], tuple[Any, dict]]:
    """Whether a key is answered from cache: within `ttl` of the last answer that was not."""

    def step(state: Any, event: dict) -> tuple[Any, dict]:
        if state is not None and event["at"] - state < ttl:
            return state, {"cached": True}
        return event["at"], {"cached": False}

    return step


def backoff() -> Callable[[Any, dict], tuple[Any, dict]]:
    """Health of a broker: failures in a row and the wait after each."""

    def step(state: Any, event: dict) -> tuple[Any, dict]:
        n = 0 if event["ok"] else (state or 0) + 1
        return n, {"degraded": n > 0, "wait": 0 if n == 0 else BACKOFF_S * 2 ** min(n - 1, BACKOFF_DOUBLINGS)}

    return step


def over_batch(df: DataFrame, key: str, order: list[str], step: Callable, out: str, inputs: list[str]) -> DataFrame:
    """df's `key` and `order` columns with the transition's outputs, key by key.

    Partitions are sorted by key and order and streamed, so no key is held in memory.
    """
    columns = [c.split()[0] for c in out.split(", ")]
    kept = list(dict.fromkeys([key, *order, *inputs]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = object(), None
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                if r[key] != held:
                    held, state = r[key], None
                state, o = step(state, r)
                rows.append([*(r[c] for c in (key, *order)), *(o[c] for c in columns)])
            yield pd.DataFrame(rows, columns=[key, *order, *columns])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, *order)) + ", " + out
    return df.select(*kept).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def over_stream(df: DataFrame, key: str, order: list[str], step: Callable, out: str, inputs: list[str], idle_s: float | None = HOUR_S) -> DataFrame:
    """The same transition over a stream, its state as JSON; a key idle for `idle_s` is forgotten.

    With idle_s None keys stay.  A job that is to end when its input does needs
    that: Spark runs empty batches for as long as keys may time out.
    """
    columns = [c.split()[0] for c in out.split(", ")]
    kinds = dict(df.dtypes)
    kept = list(dict.fromkeys([key, *order, *inputs]))

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else None
        rows = []
        for r in pd.concat(list(frames)).sort_values(order, kind="stable").to_dict("records"):
            held, o = step(held, r)
            rows.append([*(r[c] for c in (key, *order)), *(o[c] for c in columns)])
        state.update((json.dumps(held),))
        if idle_s is not None:
            state.setTimeoutDuration(int(idle_s * 1000))
        yield pd.DataFrame(rows, columns=[key, *order, *columns])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, *order)) + ", " + out
    return df.select(*kept).groupBy(key).applyInPandasWithState(run, schema, "state string", "append", "NoTimeout" if idle_s is None else "ProcessingTimeTimeout")


def dedup_window(df: DataFrame, keys: list[str], at: str, seconds: float = DEDUP_S) -> DataFrame:
    """Batch twin of a deduplication window: rows not within `seconds` of the row of the same keys that was kept last.

    Partitions are sorted by keys and time and streamed, so no key is held in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, anchor = None, None
        for b in batches:
            kept = []
            for t, *key in zip(*(b.column(c).to_pylist() for c in (at, *keys)), strict=True):
                fresh = key != held or t is None or anchor is None or t - anchor > seconds
                if fresh:
                    held, anchor = key, t
                kept.append(fresh)
            yield b.filter(pa.array(kept, pa.bool_()))

    return df.repartition(*keys).sortWithinPartitions(*keys, at).mapInArrow(run, df.schema)


def dedup_stream(df: DataFrame, keys: list[str], at: str, seconds: int = DEDUP_S) -> DataFrame:
    """Streaming deduplication of a window: state goes with the watermark."""
    return df.withWatermark(at, f"{seconds} seconds").dropDuplicatesWithinWatermark(keys)


def fold_history(df: DataFrame, user: str, question: str, at: str, order: str, seconds: float = FOLD_S) -> DataFrame:
    """df with `entry`: a question that repeats the one before within `seconds` updates it, else begins an entry."""
    w = Window.partitionBy(user).orderBy(at, order)
    same = F.col(question).eqNullSafe(F.lag(question).over(w)) & (F.col(at) - F.lag(at).over(w)).between(0, seconds)
    new = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("entry", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def newest(df: DataFrame, user: str, at: str, order: str, size: str, items: int = LIST_ITEMS, limit: int = LIST_BYTES) -> DataFrame:
    """The newest rows of each user: at most `items`, then as many as fit into `limit` bytes, one at least."""
    w = Window.partitionBy(user).orderBy(F.desc(at), F.desc(order))
    ranked = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= items)
    return ranked.withColumn("_bytes", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("_n") == 1) | (F.col("_bytes") <= limit)).drop("_n", "_bytes")


def answered(requests: DataFrame, replies: DataFrame, seconds: int = 15) -> DataFrame:
    """Requests with the reply of the same id that came within `seconds`; works on streams with watermarks, too."""
    r = replies.select(F.col("id").alias("rid"), F.col("at").alias("replied"), *[c for c in replies.columns if c not in ("id", "at")])
    return requests.join(r, F.expr(f"id = rid and replied >= at and replied <= at + interval {seconds} seconds"), "left")
