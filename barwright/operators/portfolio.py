"""Combining weights, trade prices, and a summary of a strategy's weights."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalars import clamp, ratio

log = logging.getLogger(__name__)


def ensemble(df: DataFrame, columns: list[str], method: str = "mean", only_long: bool = False, clip_min: float = -1, clip_max: float = 1) -> DataFrame:
    """Adds weight: the mean of the present values, the sign of their sum (vote), or their sum within
    limits (sum_clip). Null and NaN are absent; nothing present gives 0."""
    if missing := set(columns) - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    if "weight" in df.columns:
        raise ValueError("there is a weight column already")
    present = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in present), F.lit(0.0))
    count = sum((p.isNotNull().cast("int") for p in present), F.lit(0))
    method = method.lower()
    if method == "mean":
        weight = ratio(total, count)
    elif method == "vote":
        weight = F.signum(total)
    elif method == "sum_clip":
        weight = clamp(total, float(clip_min), float(clip_max))
    else:
        raise ValueError("method is mean, vote or sum_clip")
    return df.withColumn("weight", F.greatest(weight, F.lit(0.0)) if only_long else weight)


def trade_prices(bars: DataFrame, digits: int | None = None, windows: tuple[int, ...] = (5, 10, 15, 20, 30, 60)) -> DataFrame:
    """Adds TP_CLOSE, TP_NEXT_OPEN, TP_NEXT_CLOSE, and for each window TP_TWAPt and TP_VWAPt over the
    next t bars; where there are too few, or no volume, the close. Rounded to ``digits``, or to the
    most decimals of the symbol's closes."""
    for c in ("symbol", "dt", "open", "close", "vol"):
        if c not in bars.columns:
            raise ValueError(f"missing column: {c}")
    by = Window.partitionBy("symbol").orderBy("dt")
    out = {"TP_CLOSE": F.col("close"), "TP_NEXT_OPEN": F.lead("open").over(by), "TP_NEXT_CLOSE": F.lead("close").over(by)}
    for t in windows:
        ahead = by.rowsBetween(1, t)
        full = F.count("close").over(ahead) == t
        vol = F.sum("vol").over(ahead)
        out[f"TP_TWAP{t}"] = F.when(full, F.avg("close").over(ahead))
        out[f"TP_VWAP{t}"] = F.when(full & (vol != 0), F.sum(F.col("vol") * F.col("close")).over(ahead) / F.when(vol != 0, vol))
    if digits is None:
        text = F.col("close").cast("decimal(38,12)").cast("string")
        decimals = F.length(F.regexp_replace(F.split_part(text, F.lit("."), F.lit(2)), "0+$", ""))
        scale = F.pow(F.lit(10.0), F.greatest(F.max(decimals).over(Window.partitionBy("symbol")), F.lit(1)))
    else:
        scale = F.lit(10.0**digits)
    df = bars.withColumns({k: F.coalesce(v, F.col("close")) for k, v in out.items()}).withColumn("_scale", scale)
    return df.withColumns({k: F.rint(F.col(k) * F.col("_scale")) / F.col("_scale") for k in out}).drop("_scale")


def strategy_summary(df: DataFrame) -> DataFrame:
    """For each symbol: rows, first and last dt, least, most and mean weight, null and zero weights."""
    w = F.col("weight")
    return df.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.min(w).alias("min_weight"), F.max(w).alias("max_weight"), F.avg(w).alias("mean_weight"), F.count_if(w.isNull()).alias("n_null"), F.count_if(w == 0).alias("n_zero")
    )


def log_strategy(name: str, df: DataFrame) -> None:
    rows = strategy_summary(df).orderBy("symbol").collect()  # a row for each symbol
    if not rows:
        log.warning("%s: no rows", name)
        return
    times = df.agg(F.countDistinct("dt")).first()[0]
    log.info("%s: %d rows, %d symbols, %d points in time, %s to %s", name, sum(r.n_rows for r in rows), len(rows), times, min((r.first_dt for r in rows), default=None), max((r.last_dt for r in rows), default=None))
    for r in rows:
        log.info("%s: %d rows, weight %s to %s, mean %s", r.symbol, r.n_rows, r.min_weight, r.max_weight, r.mean_weight)
        if r.n_null:
            log.warning("%s: %d null weights", r.symbol, r.n_null)
        if r.n_zero:
            log.warning("%s: %d zero weights", r.symbol, r.n_zero)
