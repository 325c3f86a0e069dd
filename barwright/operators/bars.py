"""From bars of weights and prices to returns of each symbol and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalars import negative, positive

MEASURES = ("n1b", "edge", "return", "cost", "turnover", "long_edge", "short_edge", "long_cost", "short_cost", "long_turnover", "short_turnover", "long_return", "short_return")


def bar_transitions(weights: DataFrame, fee: float = 0.0002) -> DataFrame:
    """A row for each bar but a symbol's first: what the weight held since the last bar earned, and
    what the change of weight cost. The first position is free. Bars of one symbol have distinct dt."""
    by = Window.partitionBy("symbol").orderBy("dt")
    w = weights.withColumns({"prev_price": F.lag("price").over(by), "prev_weight": F.lag("weight").over(by)})
    w = w.where("prev_weight is not null")
    prev, now = F.col("prev_weight"), F.col("weight")
    w = w.withColumn("n1b", F.when(F.col("prev_price") != 0, F.col("price") / F.col("prev_price") - 1).otherwise(0.0))
    sides = {"": (prev, now), "long_": (positive(prev), positive(now)), "short_": (negative(prev), negative(now))}
    columns = [F.col("n1b")]
    for name, (before, after) in sides.items():
        edge, turnover = before * F.col("n1b"), F.abs(before - after)
        columns += [edge.alias(f"{name}edge"), turnover.alias(f"{name}turnover"), (turnover * fee).alias(f"{name}cost"), (edge - turnover * fee).alias(f"{name}return")]
    return w.select("symbol", "dt", *columns).select("symbol", "dt", *MEASURES)


def dailys(bars: DataFrame) -> DataFrame:
    """Sums by symbol and date. The bars are already dealt by symbol, so nothing is shuffled."""
    days = bars.withColumn("date", F.to_date("dt"))
    return days.groupBy("symbol", "date").agg(*[F.sum(m).alias(m) for m in MEASURES])
