"""Bars as they come: returns of symbols and days of a stream, with one bar of state a symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators.bars import MEASURES

_BAR = "symbol string, dt timestamp, late long, " + ", ".join(f"`{m}` double" for m in MEASURES)


def bar_stream(weights: DataFrame, fee: float = 0.0002, idle: str | None = None) -> DataFrame:
    """A streaming ``symbol, dt, weight, price`` to the measures of each bar against the one before.

    State is a symbol's last bar. Bars of a symbol must come in order between batches; those of one
    batch are sorted here. A bar not later than the last one seen gives no measures; ``late`` of the
    symbol's next row counts such bars (a row of nulls at the last bar's time carries it where no
    later bar came with them). With ``idle`` (as "30 days"), a symbol without bars for so long, by the
    clock, is forgotten: its next bar is a first one. (Such a query has a batch at every trigger, so it
    never comes to the end of an ``availableNow`` run.)
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("dt", kind="stable")
        rows, late = rows.drop_duplicates("dt"), len(rows)
        late -= len(rows)
        if wait:
            state.setTimeoutDuration(wait)
        if state.exists:
            seconds, weight, price = state.get
            last = pd.Timestamp(seconds, unit="us")
            late += int((rows["dt"] <= last).sum())
            rows = rows[rows["dt"] > last]
            if late and not len(rows):
                yield pd.DataFrame({"symbol": [key[0]], "dt": [last], "late": [late], **{m: [None] for m in MEASURES}}).astype(dict.fromkeys(MEASURES, "float64"))
                return
            rows = pd.concat([pd.DataFrame({"symbol": key[0], "dt": [last], "weight": [weight], "price": [price]}), rows])
        if len(rows):
            end = rows.iloc[-1]
            state.update((int(pd.Timestamp(end["dt"]).value // 1000), float(end["weight"]), float(end["price"])))
        before, now = rows.shift(1).iloc[1:], rows.iloc[1:]
        out = pd.DataFrame({"symbol": key[0], "dt": now["dt"], "late": 0})
        if len(out):
            out.iloc[0, 2] = late
        out["n1b"] = (now["price"] / before["price"] - 1).where(before["price"] != 0, 0.0)
        for side, cut in (("", lambda w: w), ("long_", lambda w: w.clip(lower=0)), ("short_", lambda w: w.clip(upper=0))):
            held, new = cut(before["weight"]), cut(now["weight"])
            out[f"{side}edge"] = held * out["n1b"]
            out[f"{side}turnover"] = (held - new).abs()
            out[f"{side}cost"] = out[f"{side}turnover"] * fee
            out[f"{side}return"] = out[f"{side}edge"] - out[f"{side}cost"]
        yield out[["symbol", "dt", "late", *MEASURES]]

    rows = weights.select("symbol", F.col("dt").cast("timestamp").alias("dt"), F.col("weight").cast("double").alias("weight"), F.col("price").cast("double").alias("price"))
    return rows.groupBy("symbol").applyInPandasWithState(step, _BAR, "us long, weight double, price double", "append", "ProcessingTimeTimeout" if idle else "NoTimeout")


def live_dailys(weights: DataFrame, fee: float = 0.0002, idle: str | None = None):
    """A writer that keeps the parts of ``read_dailys`` up to date with a stream; the caller gives it a
    checkpoint and starts it: ``live_dailys(stream)(path).option("checkpointLocation", c).start()``.

    Sums by day after the state of bars, in one query: what a batch adds to a day is a part of it, so a
    day is there as soon as it has bars, and no bar that has measures comes too late for its day. Each
    batch has a folder of its own, written over if the batch is tried again.
    """
    bars = bar_stream(weights, fee, idle)

    def to(path: str):
        return bars.writeStream.outputMode("append").foreachBatch(lambda batch, nr: _replace(batch, f"{path}/batch={nr}"))

    return to


def _replace(batch: DataFrame, path: str) -> None:
    days = batch.groupBy("symbol", F.to_date("dt").alias("date")).agg(*[F.sum(m).alias(m) for m in MEASURES], F.sum("late").alias("late"))
    days.write.mode("overwrite").parquet(path)


def read_dailys(spark: SparkSession, path: str) -> DataFrame:
    """The days so far, as :func:`barwright.operators.bars.dailys` has them, and the late bars counted
    with them."""
    parts = spark.read.parquet(path)
    days = parts.groupBy("symbol", "date").agg(*[F.sum(m).alias(m) for m in MEASURES], F.sum("late").alias("late"))
    return days.where("`return` is not null or late > 0")
