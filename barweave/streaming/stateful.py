"""Recursive indicators on a stream of bars: one small state a security, kept by Structured Streaming.

A security's bars of a micro-batch are taken in date order; bars that aren't later than the last
one seen were corrected too late for a recursion and are left out, as a batch recompute is the
way to correct them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "security_id string, date date, close double, ema double, rsi double"
STATE = "last date, n long, ema double, close double, gain double, loss double"


def advance(state: tuple | None, closes: list[float], span: int, period: int) -> tuple[tuple, list[tuple[float | None, float | None]]]:
    """The state after some closes, and the exponential mean and strength index at each; state: (n, ema, close, gain, loss)."""
    n, ema, close, gain, loss = state or (0, None, None, 0.0, 0.0)
    a, out = 2.0 / (span + 1), []
    for c in closes:
        ema = c if ema is None else a * c + (1 - a) * ema
        if close is not None:
            up, down = max(c - close, 0.0), max(close - c, 0.0)
            if n <= period:  # the seed is the mean of the first moves
                gain, loss = gain + up / period, loss + down / period
            else:
                gain, loss = (gain * (period - 1) + up) / period, (loss * (period - 1) + down) / period
        n, close = n + 1, c
        index = None
        if n > period:
            index = (50.0 if gain == 0 else 100.0) if loss == 0 else 100 - 100 / (1 + gain / loss)
        out.append((ema if n >= span else None, index))
    return (n, ema, close, gain, loss), out


def running(bars: DataFrame, span: int = 12, period: int = 14) -> DataFrame:
    """(security_id, date, close, ema, rsi) of each new bar of a stream (security_id, date, close)."""

    def update(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).dropna(subset=["close"]).sort_values("date").drop_duplicates("date", keep="last")
        held = state.get if state.exists else None
        if held is not None:
            rows = rows[rows["date"] > held[0]]
        if not len(rows):
            return
        now, made = advance(tuple(held[1:]) if held is not None else None, rows["close"].tolist(), span, period)
        state.update((rows["date"].iloc[-1], *now))
        ema, rsi = zip(*made)
        yield pd.DataFrame({"security_id": key[0], "date": rows["date"], "close": rows["close"], "ema": pd.array(ema, "Float64"),
            "rsi": pd.array(rsi, "Float64")})

    wanted = bars.select("security_id", "date", "close")
    return wanted.groupBy("security_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
