"""Synthetic price bars and weights, made per symbol on the executors. Equal arguments, equal rows."""

from __future__ import annotations

import datetime as dt
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MINUTES = {"1分钟": 1, "5分钟": 5, "15分钟": 15, "30分钟": 30, "日线": None, "1min": 1, "5min": 5, "15min": 15, "30min": 30, "1d": None}
KLINE = "dt timestamp_ntz, symbol string, open double, close double, high double, low double, vol double, amount double"


def _times(freq: str, start: str, end: str) -> pd.DatetimeIndex:
    """Bar ends on weekdays; intraday two sessions of two hours."""
    if freq not in MINUTES:
        raise ValueError(f"unknown frequency: {freq}")
    days = pd.bdate_range(start, end)
    step = MINUTES[freq]
    if step is None:
        return days
    marks = [pd.Timedelta(minutes=m) for a, b in ((570, 690), (780, 900)) for m in range(a + step, b + 1, step)]
    return pd.DatetimeIndex([d + m for d in days for m in marks])


def _kline(symbol: str, freq: str, start: str, end: str, seed: int) -> pd.DataFrame:
    times = _times(freq, start, end)
    draw = np.random.default_rng([seed, zlib.crc32(symbol.encode())])
    n = len(times)
    scale = 0.015 if MINUTES[freq] is None else 0.015 * np.sqrt(MINUTES[freq] / 240)
    trend = 0.3 * scale * np.sin(np.arange(n) * 2 * np.pi / 250 + draw.uniform(0, 6))
    close = np.round(100 * np.exp(np.cumsum(trend + scale * draw.normal(size=n))), 2)
    open_ = np.round(np.concatenate(([100.0], close[:-1]))[:n] * (1 + 0.1 * scale * draw.normal(size=n)), 2)
    high = np.round(np.maximum(open_, close) * (1 + scale * np.abs(draw.normal(size=n)) / 2), 2)
    low = np.round(np.minimum(open_, close) * (1 - scale * np.abs(draw.normal(size=n)) / 2), 2)
    vol = np.round(draw.lognormal(10, 0.5, n))
    return pd.DataFrame({"dt": times, "symbol": symbol, "open": open_, "close": close, "high": high, "low": low, "vol": vol, "amount": vol * close})


def mock_klines(spark: SparkSession, symbols: list[str], freq: str = "30min", start: str = "20100101", end: str = "20250101", seed: int = 42) -> DataFrame:
    _times(freq, start, start)

    def make(batches):
        for pdf in batches:
            for symbol in pdf["symbol"]:
                yield _kline(symbol, freq, start, end, seed)

    names = spark.createDataFrame([(s,) for s in symbols], "symbol string").repartition(max(1, len(symbols)))
    return names.mapInPandas(make, KLINE)


def mock_weights(spark: SparkSession, symbols: list[str], freq: str = "30min", start: str = "20100101", end: str = "20250101", seed: int = 42) -> DataFrame:
    """dt, symbol, weight in [-1, 1], price (the close)."""

    def make(batches):
        for pdf in batches:
            for symbol in pdf["symbol"]:
                bars = _kline(symbol, freq, start, end, seed)
                draw = np.random.default_rng([seed, zlib.crc32(symbol.encode()), 1])
                size = np.clip(draw.normal(0.5, 0.5, len(bars)), 0, 1) * draw.permutation(np.where(np.arange(len(bars)) % 2, -1.0, 1.0))
                yield pd.DataFrame({"dt": bars["dt"], "symbol": symbol, "weight": np.round(size, 2), "price": bars["close"]})

    names = spark.createDataFrame([(s,) for s in symbols], "symbol string").repartition(max(1, len(symbols)))
    return names.mapInPandas(make, "dt timestamp_ntz, symbol string, weight double, price double")


def date_of(value) -> dt.date | None:
    """A date from None, a date, a timestamp, ``20240131`` or ``2024-01-31``."""
    return None if value is None else pd.Timestamp(str(value) if isinstance(value, int) else value).date()
