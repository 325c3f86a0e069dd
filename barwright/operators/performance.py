"""Performance of daily return series: one grouped function for every series there is.

The group columns carry side, segment, year or rolling row, so all uses share one plan.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalars import EPSILON, clamp, ratio, rnd, snapped

log = logging.getLogger(__name__)

METRICS = (
    "absolute_return",
    "annual_return",
    "sharpe",
    "max_drawdown",
    "calmar",
    "daily_win_rate",
    "daily_profit_loss_ratio",
    "daily_win_probability",
    "annual_volatility",
    "downside_volatility",
    "non_zero_coverage",
    "break_even_point",
    "new_high_interval",
    "new_high_ratio",
    "drawdown_risk",
    "annual_lin_reg_cumsum_return",
    "length_adjusted_average_max_drawdown",
)
#: Drawdowns whose lengths are averaged.
TOP = 5


def underwater(rows: DataFrame, group: list[str], order: str = "date", ret: str = "ret", snap: int | None = None) -> DataFrame:
    """Adds i (place from 0), cum, uw (cum less its running maximum) and ep, the drawdown episode:
    each high begins one, and the days under it belong to it."""
    by = Window.partitionBy(*group).orderBy(order)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("i", F.row_number().over(by) - 1).withColumn("cum", snapped(F.sum(ret).over(so_far), snap))
    out = out.withColumn("uw", F.col("cum") - F.max("cum").over(so_far))
    return out.withColumn("ep", F.sum((F.col("uw") >= 0).cast("int")).over(so_far))


def episodes(under: DataFrame, group: list[str], order: str = "date") -> DataFrame:
    """A row for each drawdown: depth, places and dates of peak and (first) valley, days under water,
    and recovery, the date of the next high (null if none)."""
    e = under.groupBy(*group, "ep").agg(
        F.min("uw").alias("depth"),
        F.min("i").alias("peak"),
        F.min(F.struct("uw", "i", F.col(order).alias("at"))).alias("v"),
        F.min_by(order, "i").alias("start"),
        F.count_if(F.col("uw") < 0).alias("days_under"),
    )
    e = e.withColumn("recovery", F.lead("start").over(Window.partitionBy(*group).orderBy("ep")))
    return e.where("depth < 0").select(*group, "ep", "depth", "peak", F.col("v.i").alias("valley"), "start", F.col("v.at").alias("bottom"), "recovery", "days_under")


def daily_performance(rows: DataFrame, group: list[str], order: str = "date", ret: str = "ret", yearly_days: int = 252, snap: int | None = None) -> DataFrame:
    """The 17 metrics of each group. A series without rows, with a sum or a deviation of (nearly) 0
    has all metrics 0 and no slope. Needs distinct ``order`` values in a group."""
    under = underwater(rows.select(*group, order, ret), group, order, ret, snap)
    r = F.col(ret)
    base = under.groupBy(*group).agg(
        F.count("*").cast("double").alias("n"),
        F.sum(r).alias("total"),
        F.avg(r).alias("mean"),
        F.stddev_pop(r).alias("std"),
        F.count_if(r >= 0).alias("wins"),
        F.count_if(r == 0).alias("zeros"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("won"),
        F.sum(F.when(r < 0, r).otherwise(0.0)).alias("lost"),
        F.stddev_pop(F.when(r < 0, r)).alias("down"),
        F.regr_slope("cum", "i").alias("slope"),
        F.avg((F.col("uw") >= 0).cast("double")).alias("high"),
    )
    falls = episodes(under, group, order)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("depth", "valley"))
    falls = falls.withColumn("k", rank).groupBy(*group).agg(
        F.max(-F.col("depth")).alias("mdd"),
        F.max("days_under").alias("longest"),
        F.sum(F.when(F.col("k") <= TOP, F.col("valley") - F.col("peak")).otherwise(0)).alias("top_days"),
    )
    by_ret = Window.partitionBy(*group).orderBy(ret)
    paid = under.withColumn("k", F.row_number().over(by_ret)).withColumn("paid", F.sum(ret).over(by_ret.rowsBetween(Window.unboundedPreceding, 0)))
    paid = paid.where("paid > 0").groupBy(*group).agg(F.min("k").alias("paid_at"))
    j = base.join(falls, group, "left").join(paid, group, "left").fillna({"mdd": 0.0, "longest": 0, "top_days": 0})

    year = float(yearly_days)
    root = year**0.5
    n, mdd = F.col("n"), F.col("mdd")
    annual = rnd(F.col("mean") * year, 4)
    vol = rnd(F.col("std") * root, 4)
    win_rate = rnd(F.col("wins") / n, 4)
    losses = n - F.col("wins")
    mean_win, mean_loss = ratio(F.col("won"), F.col("wins")), F.abs(ratio(F.col("lost"), losses))
    pl = rnd(F.when(mean_loss > EPSILON, ratio(mean_win, mean_loss)).otherwise(5.0), 4)
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    metrics: dict[str, Column] = {
        "absolute_return": rnd(F.col("total"), 4),
        "annual_return": annual,
        "sharpe": rnd(clamp(ratio(F.col("mean"), F.col("std")) * root, -5.0, 10.0), 4),
        "max_drawdown": rnd(mdd, 4),
        "calmar": rnd(clamp(rnd(F.when(mdd < EPSILON, F.lit(10.0)).otherwise(ratio(annual, mdd)), 4), -10.0, 20.0), 4),
        "daily_win_rate": win_rate,
        "daily_profit_loss_ratio": pl,
        "daily_win_probability": rnd(pl * win_rate - (1 - win_rate), 4),
        "annual_volatility": vol,
        "downside_volatility": rnd(F.coalesce("down", F.lit(0.0)) * root, 4),
        "non_zero_coverage": rnd((n - F.col("zeros")) / n, 4),
        "break_even_point": F.when(F.col("paid_at").isNull(), 1.0).otherwise(rnd(F.col("paid_at") / n, 4)),
        "new_high_interval": F.col("longest").cast("double"),
        "new_high_ratio": rnd(F.col("high"), 4),
        "drawdown_risk": F.when(vol != 0, rnd(ratio(mdd, vol), 4)).when(mdd == 0, nan).otherwise(inf),
        "annual_lin_reg_cumsum_return": rnd(F.col("slope") * year, 4),
        "length_adjusted_average_max_drawdown": rnd(F.col("top_days") / float(TOP) / year, 4),
    }
    flat = (F.abs(F.col("total")) < EPSILON) | (F.col("std") < EPSILON)
    return j.select(*group, *[F.when(flat, F.lit(None if m == "annual_lin_reg_cumsum_return" else 0.0).cast("double")).otherwise(c).alias(m) for m, c in metrics.items()])


def top_drawdowns(rows: DataFrame, top: int = 10, order: str = "date", ret: str = "ret", group: list[str] | None = None, snap: int | None = None) -> DataFrame:
    """The deepest drawdowns with dates, and gaps in calendar days (null where not recovered)."""
    group = group or []
    rows = rows if group else rows.withColumn("_g", F.lit(0))
    by = group or ["_g"]
    e = episodes(underwater(rows, by, order, ret, snap), by, order)
    e = e.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("depth", "valley"))).where(F.col("rank") <= top)
    fell, rose = F.datediff("bottom", "start"), F.datediff("recovery", "bottom")
    return e.select(*group, "rank", "start", F.col("bottom").alias("end"), "recovery", "depth", fell.alias("drawdown_days"), rose.alias("recovery_days"), (fell + rose).alias("new_high_days"))


def rolling_performance(rows: DataFrame, order: str = "date", ret: str = "ret", window: int = 252, min_periods: int = 100, yearly_days: int | None = None, group: list[str] | None = None, snap: int | None = None) -> DataFrame:
    """The metrics over the last ``window`` calendar days up to each row from the ``min_periods``-th
    on, with sdt and edt. Null and NaN returns count as 0.

    A range frame gathers each row's window (bounded by ``window`` days) in place of a join on dates.
    """
    group = group or []
    clean = F.coalesce(F.nanvl(F.col(ret).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = rows.select(*group, F.col(order).cast("date").alias("edt"), clean.alias("r"))
    if yearly_days is None:
        yearly_days = infer_yearly_days(rows, "edt")
    by = Window.partitionBy(*group)
    rows = rows.withColumn("rn", F.row_number().over(by.orderBy("edt")) - 1).withColumn("day", F.unix_date("edt"))
    near = F.collect_list(F.struct("rn", "r")).over(by.orderBy("day").rangeBetween(-window, 0))
    ends = rows.withColumn("near", near).where(F.col("rn") >= min_periods).select(*group, "rn", "edt", "near")
    # peers of the same date after this row are in the range frame, not in the window
    each = ends.select(*group, F.col("rn").alias("end"), F.explode("near").alias("x")).where("x.rn <= end").select(*group, "end", "x.rn", "x.r")
    found = daily_performance(each, [*group, "end"], "rn", "r", yearly_days, snap)
    dated = ends.select(*group, F.col("rn").alias("end"), "edt")
    return found.join(dated, [*group, "end"]).withColumn("sdt", F.date_sub("edt", window)).drop("end")


def yearly_days_of(dates: DataFrame, name: str = "date") -> DataFrame:
    """One row: days a year to reckon with. 252 for dates spanning under 365 days, else the most
    dates in a year, 365 at most."""
    days = dates.select(F.col(name).cast("date").alias("d")).distinct()
    years = days.groupBy(F.year("d").alias("y")).agg(F.count("*").alias("n"), F.min("d").alias("a"), F.max("d").alias("b"))
    return years.agg(F.when(F.datediff(F.max("b"), F.min("a")) < 365, 252).when(F.max("n").isNotNull(), F.least(F.max("n"), F.lit(365))).cast("int").alias("yearly_days"))


def infer_yearly_days(dates: DataFrame, name: str = "date") -> int:
    """The same as a number; warns where the dates span under a year, and 252 is but the usual."""
    days = dates.select(F.col(name).cast("date").alias("d"))
    found, span = yearly_days_of(days, "d").join(days.agg(F.datediff(F.max("d"), F.min("d")).alias("span"))).first()  # a row each
    if found is None:
        raise ValueError("no dates")
    if span < 365:
        log.warning("dates span %d days, under a year: 252 days a year are taken", span)
    return found
