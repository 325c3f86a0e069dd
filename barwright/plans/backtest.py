"""A strategy's backtest: lazy tables, and dictionaries of metrics on demand."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions.scalars import ratio, rnd
from barwright.operators import bars, pairs, performance, totals, verdict
from barwright.sources.mock import date_of
from barwright.sources.weights import from_any, normalise

KINDS = {"all": "total", "long": "long", "short": "short"}
#: Order of the statistics.
STATS = (
    "absolute_return",
    "annual_return",
    "sharpe",
    "calmar",
    "new_high_ratio",
    "single_profit_loss_ratio",
    "single_trade_profit",
    "daily_win_rate",
    "week_win_rate",
    "month_win_rate",
    "quarter_win_rate",
    "year_win_rate",
    "max_drawdown",
    "annual_volatility",
    "downside_volatility",
    "new_high_interval",
    "trade_count",
    "annual_trade_count",
    "position_k_days",
    "trade_win_rate",
    "long_rate",
    "short_rate",
    "symbols_count",
    "start_date",
    "end_date",
)
ALPHA_STATS = ("absolute_return", "annual_return", "sharpe", "calmar", "new_high_ratio", "daily_win_rate", "week_win_rate", "month_win_rate", "quarter_win_rate", "year_win_rate", "max_drawdown", "annual_volatility", "downside_volatility", "new_high_interval")


def stats_table(
    rows: DataFrame, trades: DataFrame, weight_rows: DataFrame, symbols: DataFrame, yearly_days: int = 252, snap: int | None = None, kinds: tuple[str, ...] = tuple(KINDS), groups: DataFrame | None = None
) -> DataFrame:
    """A row for each side of ``rows`` (side: those of ``kinds``; date, ret). Trades and rates are
    those of the side; the rate of the other direction is 0. With ``groups`` (a row for each value of
    its one column, which ``rows``, ``trades`` and ``weight_rows`` have too), a row for each of these
    and side."""
    more = tuple(groups.columns) if groups is not None else ()
    by = [*more, "side"]
    perf = performance.daily_performance(rows, by, yearly_days=yearly_days, snap=snap)
    wins = totals.win_rates(rows, by, yearly_days=yearly_days)
    days = rows.groupBy(*by).agg(F.count("*").alias("n_days"))
    ev = pairs.evaluate(trades, kinds, groups).select(*by, "single_profit_loss_ratio", "single_trade_profit", "trade_count", "position_k_days", F.col("win_rate").alias("trade_win_rate"))
    count = symbols.agg(F.countDistinct("symbol").alias("symbols_count"))  # one row, as are the rates of a group
    one = totals.rates(weight_rows, more).join(count)
    out = perf.join(wins, by).join(days, by).join(ev, by, "left")
    out = out.join(F.broadcast(one), list(more), "left") if more else out.join(F.broadcast(one))
    out = out.withColumn("annual_trade_count", rnd(ratio(F.col("trade_count"), F.col("n_days") / float(yearly_days)), 2))
    out = out.withColumn("long_rate", F.when(F.col("side") == "short", 0.0).otherwise(F.col("long_rate")))
    return out.withColumn("short_rate", F.when(F.col("side") == "long", 0.0).otherwise(F.col("short_rate")))


def sides(daily_totals: DataFrame, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    return totals.series(daily_totals.withColumnRenamed("total", "all"), *kinds)


class Backtest:
    """Weights held from bar to bar. ``data``: a Spark, pandas or Arrow table, or a file.

    Nothing runs before a result is asked for. ``dailys`` and ``pairs`` are kept in memory once
    computed, since all else is read off them; ``close()`` lets them go.
    """

    def __init__(self, data, spark: SparkSession | None = None, digits: int = 2, fee: float = 0.0002, weight_type: str = "ts", yearly_days: int = 252):
        if weight_type not in totals.WEIGHT_TYPES:
            raise ValueError(f"weight_type is one of {totals.WEIGHT_TYPES}")
        if fee < 0 or digits < 0 or yearly_days <= 0:
            raise ValueError("fee and digits must not be negative, yearly_days must be positive")
        self.spark = spark or (data.sparkSession if isinstance(data, DataFrame) else SparkSession.active())
        self.digits, self.fee, self.weight_type, self.yearly_days = digits, fee, weight_type, yearly_days
        # dealt by symbol once; bars, trades and symbol sums all use it
        self.weights = normalise(from_any(self.spark, data), digits).repartition("symbol")

    # tables

    @cached_property
    def dailys(self) -> DataFrame:
        return bars.dailys(bars.bar_transitions(self.weights, self.fee)).persist()

    @cached_property
    def pairs(self) -> DataFrame:
        return pairs.trades(self.weights, self.digits).persist()

    @cached_property
    def daily_totals(self) -> DataFrame:
        return totals.daily_totals(self.dailys, self.weight_type).persist()

    def close(self) -> None:
        for name in ("dailys", "pairs", "daily_totals"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()

    @cached_property
    def symbols(self) -> list[str]:
        return [r[0] for r in self.weights.select("symbol").distinct().orderBy("symbol").collect()]

    @property
    def daily_return(self) -> DataFrame:
        return totals.wide_returns(self.dailys, self.symbols, "return", self.weight_type)

    @property
    def long_daily_return(self) -> DataFrame:
        return totals.wide_returns(self.dailys, self.symbols, "long_return", self.weight_type)

    @property
    def short_daily_return(self) -> DataFrame:
        return totals.wide_returns(self.dailys, self.symbols, "short_return", self.weight_type)

    @property
    def alpha(self) -> DataFrame:
        return self.daily_totals.select("date", "excess", "strategy", "benchmark")

    @property
    def weight_rows(self) -> DataFrame:
        return totals.weight_rows(self.weights)

    @property
    def aggregated_pairs(self) -> DataFrame:
        return pairs.aggregated(self.pairs)

    def key_trades(self, top: int = 3) -> DataFrame:
        return pairs.key_trades(pairs.holding_segments(self.aggregated_pairs), top)

    def yearly_return(self, min_days: int = 120) -> DataFrame:
        return totals.yearly_returns(self.dailys, self.daily_totals, min_days)

    def symbol_daily(self, symbol: str) -> DataFrame:
        return self.dailys.where(F.col("symbol") == symbol)

    def symbol_pairs(self, symbol: str) -> DataFrame:
        return self.pairs.where(F.col("symbol") == symbol)

    def top_symbols(self, n: int = 1, kind: str = "profit") -> list[str]:
        return [r[0] for r in totals.top_symbols(self.dailys, n, kind).collect()]

    def top_drawdowns(self, top: int = 10) -> DataFrame:
        return performance.top_drawdowns(self.daily_totals.select("date", F.col("total").alias("ret")), top)

    def rolling(self, window: int = 252, min_periods: int = 100) -> DataFrame:
        return performance.rolling_performance(self.daily_totals.select("date", F.col("total").alias("ret")), window=window, min_periods=min_periods, yearly_days=self.yearly_days)

    # metrics

    def _range(self) -> tuple[dt.date, dt.date]:
        return tuple(totals.effective_range(self.daily_totals, self.weight_rows).first())

    def segment_stats(self, start=None, end=None, kind: str = "all") -> dict:
        """Statistics between two dates, both included. Returns and trades are those of the whole
        run, cut to the dates; bars outside still count for what is held and matched."""
        side = kind if kind in KINDS else "all"
        first, last = self._range()
        start, end = date_of(start) or first, date_of(end) or last
        inside = F.col("date").between(F.lit(start), F.lit(end))
        rows = totals.daily_totals(self.dailys.where(inside), self.weight_type)
        found = stats_table(sides(rows, (side,)), pairs.between(self.pairs, start, end), self.weight_rows.where(inside), self.weights, self.yearly_days, kinds=(side,)).first()
        out = _zeros(found, self.symbols) | {"start_date": start.isoformat(), "end_date": end.isoformat()}
        return {k: out[k] for k in STATS}

    @cached_property
    def _stats(self) -> dict[str, dict]:
        found = stats_table(sides(self.daily_totals), self.pairs, self.weight_rows, self.weights, self.yearly_days).collect()
        first, last = self._range()
        rows = {r.side: r for r in found}
        dates = {"start_date": first.isoformat(), "end_date": last.isoformat()}
        return {side: {k: v for k, v in (_zeros(rows.get(side), self.symbols) | (dates if side == "all" else {})).items() if k in STATS} for side in KINDS}

    @property
    def stats(self) -> dict:
        return _ordered(self._stats["all"])

    @property
    def long_stats(self) -> dict:
        return _ordered(self._stats["long"])

    @property
    def short_stats(self) -> dict:
        return _ordered(self._stats["short"])

    def _series_stats(self, column: str) -> dict:
        rows = self.daily_totals.select(F.lit(column).alias("side"), "date", F.col(column).alias("ret"))
        found = performance.daily_performance(rows, ["side"], yearly_days=self.yearly_days).first()
        first, last = self._range()
        return {m: (found[m] if found else 0.0) for m in performance.METRICS} | {"start_date": first.isoformat(), "end_date": last.isoformat()}

    @property
    def alpha_stats(self) -> dict:
        return self._series_stats("excess")

    @property
    def bench_stats(self) -> dict:
        return self._series_stats("benchmark")

    @property
    def long_alpha_stats(self) -> dict:
        found = long_alpha(self.daily_totals, self.yearly_days).first()
        return {m: (found[m] if found and found[m] is not None else 0.0) for m in ALPHA_STATS}

    def verdict(self, mode: str = "history", **limits) -> dict:
        if mode not in ("history", "recent"):
            raise ValueError("mode is history or recent")
        out = (verdict.history if mode == "history" else verdict.recent)(self.daily_totals, self.yearly_days, **limits).first()
        if out is None:
            raise ValueError("there are no returns to judge")
        found = {"mode": mode} | out.asDict()
        if mode == "history":
            years = verdict.yearly_metrics(verdict.volatility_adjusted(self.daily_totals, self.yearly_days), limits.get("min_year_days", 200), limits.get("max_dd", 0.20))
            found["yearly_metrics"] = [r.asDict() for r in years.orderBy("year").collect()]
        return found


def long_alpha(daily_totals: DataFrame, yearly_days: int = 252, snap: int | None = None) -> DataFrame:
    """One row: metrics and win rates of the volatility-adjusted excess of the long side. No row if
    either series hardly moves."""
    rows = verdict.volatility_adjusted(daily_totals, yearly_days).where("alpha is not null").select(F.lit("alpha").alias("side"), "date", F.col("alpha").alias("ret"))
    perf = performance.daily_performance(rows, ["side"], yearly_days=yearly_days, snap=snap)
    return perf.join(totals.win_rates(rows, ["side"], yearly_days=yearly_days), "side").select(*ALPHA_STATS)


def _zeros(row, symbols: list[str]) -> dict:
    if row is not None:
        return {k: v for k, v in row.asDict().items() if k in STATS}
    return {k: 0.0 for k in STATS} | {"trade_count": 0, "symbols_count": len(symbols)}


def _ordered(found: dict) -> dict:
    return {k: found[k] for k in STATS if k in found}


def backtest(data, **options) -> Backtest:
    return Backtest(data, **options)
