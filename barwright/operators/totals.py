"""From returns of symbols and days to daily series, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalars import rnd

WEIGHT_TYPES = ("ts", "cs")


def _over_symbols(weight_type: str):
    """ts: mean over the symbols with a return that day; cs: sum."""
    if weight_type not in WEIGHT_TYPES:
        raise ValueError(f"weight_type is one of {WEIGHT_TYPES}, not {weight_type!r}")
    return F.avg if weight_type == "ts" else F.sum


def daily_totals(daily: DataFrame, weight_type: str = "ts") -> DataFrame:
    """date, total, long, short (by ``weight_type``), strategy and benchmark (always means), excess."""
    agg = _over_symbols(weight_type)
    out = daily.groupBy("date").agg(
        agg("return").alias("total"),
        agg("long_return").alias("long"),
        agg("short_return").alias("short"),
        F.avg("return").alias("strategy"),
        F.avg("n1b").alias("benchmark"),
        F.count("*").alias("n_symbols"),
    )
    return out.withColumn("excess", F.col("strategy") - F.col("benchmark"))


def series(totals: DataFrame, *names: str) -> DataFrame:
    """Long form: side, date, ret."""
    return totals.unpivot(["date"], list(names), "side", "ret")


def wide_returns(daily: DataFrame, symbols: list[str], measure: str = "return", weight_type: str = "ts") -> DataFrame:
    """date, a column for each symbol, total. The symbols are given, so the pivot needs no extra pass."""
    agg = _over_symbols(weight_type)
    return daily.groupBy("date").agg(*[F.sum(F.when(F.col("symbol") == s, F.col(measure))).alias(s) for s in symbols], agg(measure).alias("total"))


def weight_rows(weights: DataFrame) -> DataFrame:
    """Rows of each date with a long or a short weight, and all: of the input, not of returns."""
    w = F.col("weight")
    return weights.groupBy(F.to_date("dt").alias("date")).agg(F.count_if(w > 0).alias("n_long"), F.count_if(w < 0).alias("n_short"), F.count("*").alias("n_rows"))


def rates(rows: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each group): long_rate and short_rate, shares of all weight rows."""
    s = rows.groupBy(*group).agg(F.sum("n_long").alias("l"), F.sum("n_short").alias("s"), F.sum("n_rows").alias("n"))

    def share(c: str) -> Column:
        return F.when(F.col("n") > 0, rnd(F.col(c) / F.col("n"), 4)).otherwise(0.0)

    return s.select(*group, share("l").alias("long_rate"), share("s").alias("short_rate"))


def effective_range(totals: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: start_date and end_date of the returns, or else of the weights, or else 1970-01-01."""
    both = totals.select(F.lit(0).alias("kind"), "date").union(rows.select(F.lit(1).alias("kind"), "date"))
    first = [F.coalesce(*[f(F.when(F.col("kind") == k, F.col("date"))) for k in (0, 1)], F.to_date(F.lit("1970-01-01"))) for f in (F.min, F.max)]
    return both.agg(first[0].alias("start_date"), first[1].alias("end_date"))


def symbol_returns(daily: DataFrame) -> DataFrame:
    return daily.groupBy("symbol").agg(F.sum("return").alias("ret"))


def top_symbols(daily: DataFrame, n: int, kind: str) -> DataFrame:
    """The ``n`` symbols of the most profit, or of the most loss."""
    if kind not in ("profit", "loss"):
        raise ValueError("kind is 'profit' or 'loss'")
    return symbol_returns(daily).orderBy(F.desc("ret") if kind == "profit" else F.asc("ret"), "symbol").limit(n)


def yearly_returns(daily: DataFrame, totals: DataFrame, min_days: int = 120) -> DataFrame:
    """year, symbol (or 'total'), ret, of years with at least ``min_days`` returns."""
    rows = daily.select("symbol", "date", F.col("return").alias("r")).union(totals.select(F.lit("total"), "date", "total"))
    out = rows.groupBy(F.year("date").alias("year"), "symbol").agg(F.sum("r").alias("ret"), F.count("r").alias("n"))
    return out.where(F.col("n") >= min_days).drop("n")


def monthly_returns(totals: DataFrame) -> DataFrame:
    """year, month, ret: all twelve months of each year with a return, 0 where there is none."""
    months = totals.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(F.sum("total").alias("ret"))
    spine = months.select("year").distinct().select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return spine.join(months, ["year", "month"], "left").select("year", "month", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def year_starts(totals: DataFrame) -> DataFrame:
    return totals.groupBy(F.year("date").alias("year")).agg(F.min("date").alias("first_date"))


def return_spread(totals: DataFrame) -> DataFrame:
    """Mean and sample deviation of daily totals, in percent."""
    x = F.col("total") * 100
    return totals.agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("mean_pct"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std_pct"))


def period_key(period: str) -> Column:
    """A number for each ISO week, month, quarter or year of ``date``."""
    d = F.col("date")
    keys = {
        "week": F.extract(F.lit("YEAROFWEEK"), d) * 100 + F.weekofyear(d),
        "month": F.year(d) * 100 + F.month(d),
        "quarter": F.year(d) * 10 + F.quarter(d),
        "year": F.year(d),
    }
    return keys[period].cast("int")


def win_rates(rows: DataFrame, group: list[str], ret: str = "ret", yearly_days: int = 252) -> DataFrame:
    """Shares of weeks, months, quarters and years whose sum is above 0. A year counts from half of
    ``yearly_days`` on. One pass sums the rows by each of their periods, another the periods."""
    periods = ("week", "month", "quarter", "year")
    keys = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), period_key(p).alias("key")) for p in periods]))
    sums = rows.select(*group, F.col(ret).alias("_r"), keys.alias("_p")).groupBy(*group, "_p").agg(F.sum("_r").alias("s"), F.count("*").alias("n"))
    won = F.when((F.col("_p.period") != "year") | (F.col("n") >= yearly_days // 2), (F.col("s") > 0).cast("double"))
    rates_ = [F.coalesce(rnd(F.avg(F.when(F.col("_p.period") == p, won)), 4), F.lit(0.0)).alias(f"{p}_win_rate") for p in periods]
    return sums.groupBy(*group).agg(*rates_)


def curves(rows: DataFrame, group: list[str], ret: str = "ret") -> DataFrame:
    """Adds cum (running sum) and drawdown (cum less its running maximum)."""
    by = Window.partitionBy(*group).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cum", F.sum(ret).over(by)).withColumn("drawdown", F.col("cum") - F.max("cum").over(by))
