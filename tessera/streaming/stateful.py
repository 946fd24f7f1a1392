"""Running values of an entity over a stream of bars, in the order of their times: balance of volume, an exponential
mean, and a held rule's position.

An entity's state is its accumulators and the bars that the watermark has not passed. Bars come in any order within the
watermark's delay and are taken in order once it has passed them, so the stream gives what a batch over the same bars
gives; later ones are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..deploy import ship

OUT = "entity long, ts timestamp, close double, obv double, ewma double, pos int"
STATE = "last double, obv double, num double, den double, recent array<double>, pos int, lock int, waiting array<struct<ts:bigint,close:double,vol:double>>"
START = (float("nan"), 0.0, 0.0, 0.0, [], 0, 0, [])


def advance(state: tuple, bars: list[tuple[int, float, float]], n: int, hold: int, decay: float) -> tuple[tuple, list[tuple]]:
    """State after ``bars`` (time, close, volume) in order, and a row for each: time, close, obv, ewma, pos.

    The rule goes long above the highest and short below the lowest of the n closes before, and then holds its position
    for ``hold`` bars, whatever comes.
    """
    last, obv, num, den, recent, pos, lock, waiting = state
    recent, out = list(recent), []
    for ts, close, vol in bars:
        if last == last:
            obv += vol if close >= last else -vol
        num, den = close + decay * num, 1.0 + decay * den
        signal = 0
        if len(recent) == n:
            signal = 1 if close > max(recent) else -1 if close < min(recent) else 0
        if lock == 0 and signal:
            pos, lock = signal, max(hold - 1, 0)
        else:
            lock = max(lock - 1, 0)
        recent = [*recent, close][-n:]
        last = close
        out.append((ts, close, obv, num / den, pos))
    return (last, obv, num, den, recent, pos, lock, waiting), out


def _rows(key, out: list[tuple]) -> pd.DataFrame:
    d = pd.DataFrame(out, columns=["ts", "close", "obv", "ewma", "pos"])
    d.insert(0, "entity", np.int64(key))
    d["ts"] = pd.to_datetime(d["ts"], unit="us")
    d["pos"] = d["pos"].astype(np.int32)
    return d


def running(bars: DataFrame, late: str = "1 day", n: int = 5, hold: int = 3, decay: float = 0.9) -> DataFrame:
    """A stream of entity, ts, close, vol to the running values at each bar (append mode). Repeated times of an entity
    are taken in the order of close and volume."""
    ship(bars.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else START
        waiting = [tuple(w) for w in now[-1]]
        for p in parts:
            waiting += list(zip(p["us"].tolist(), p["close"].tolist(), p["vol"].tolist()))
        waiting.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        due = [w for w in waiting if w[0] < passed]
        waiting = waiting[len(due) :]
        now, out = advance(now, due, n, hold, decay)
        state.update((*now[:-1], waiting))
        if waiting:
            # wakes once the watermark lies beyond the first bar that waits
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield _rows(key[0], out)

    watched = bars.select("entity", "ts", F.unix_micros("ts").alias("us"), "close", "vol").withWatermark("ts", late)
    return watched.groupBy("entity").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def batch(bars: DataFrame, n: int = 5, hold: int = 3, decay: float = 0.9) -> DataFrame:
    """The same over a table."""
    ship(bars.sparkSession)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        _, out = advance(START, sorted(zip(d["us"].tolist(), d["close"].tolist(), d["vol"].tolist())), n, hold, decay)
        return _rows(d["entity"].iloc[0], out)

    return bars.select("entity", F.unix_micros("ts").alias("us"), "close", "vol").groupBy("entity").applyInPandas(run, OUT)
