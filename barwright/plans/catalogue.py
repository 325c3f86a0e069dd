"""The engine's queries over the test tables. Their SQL is in :mod:`barwright.plans.oracle`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions.scalars import rnd
from barwright.operators import bars, pairs, performance, portfolio, totals, verdict
from barwright.plans import backtest, fixtures
from barwright.plans.oracle import SQL  # noqa: F401
from barwright.sources.weights import normalise

FEE, SNAP, YEAR = 0.0002, 12, 252
#: Decimals of doubles in results. Fees of 0.0002 of 0.01 weights make ties at six.
DIGITS = 8
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, folder: shown(f(spark, folder))
    return f


def shown(df: DataFrame) -> DataFrame:
    """Doubles to ``DIGITS`` decimals, whole numbers as bigint."""
    kinds = dict(df.dtypes)
    whole = {"int", "bigint", "smallint", "tinyint"}
    return df.select(*[rnd(F.col(f"`{c}`"), DIGITS).alias(c) if k == "double" else F.col(f"`{c}`").cast("bigint").alias(c) if k in whole else F.col(f"`{c}`") for c, k in kinds.items()])


def w1(spark: SparkSession, folder: str) -> DataFrame:
    return normalise(fixtures.daily_weights(spark, folder), check=False)


def w2(spark, folder):
    return normalise(fixtures.intraday_weights(spark, folder), check=False)


def w3(spark, folder):
    return normalise(fixtures.stepwise_weights(spark, folder), check=False)


def days(spark, folder, weights=w1):
    return bars.dailys(bars.bar_transitions(weights(spark, folder), FEE))


def tot(spark, folder, weight_type="ts"):
    return totals.daily_totals(days(spark, folder), weight_type)


def ret(spark, folder, column="total"):
    return tot(spark, folder).select(F.lit(column).alias("side"), "date", F.col(column).alias("ret"))


# bars and daily series


@query
def round_weight(spark, folder):
    return w2(spark, folder).select("symbol", "dt", "weight")


@query
def symbol_dict(spark, folder):
    return w1(spark, folder).select("symbol").distinct()


@query
def bar_transition(spark, folder):
    return bars.bar_transitions(w2(spark, folder), FEE)


@query
def dailys(spark, folder):
    return days(spark, folder)


@query
def dailys_intraday(spark, folder):
    return days(spark, folder, w2)


@query
def dailys_one_symbol(spark, folder):
    return days(spark, folder, w2).where("symbol = 'U3'")


@query
def dailys_between(spark, folder):
    return days(spark, folder).where("date between date '1996-03-01' and date '1998-06-30'")


@query
def daily_total_ts(spark, folder):
    return tot(spark, folder).select("date", "total", "n_symbols")


@query
def daily_total_cs(spark, folder):
    return tot(spark, folder, "cs").select("date", "total", "n_symbols")


@query
def daily_return_long(spark, folder):
    return days(spark, folder).select("date", "symbol", F.col("return").alias("ret"))


def _wide(spark, folder, measure, weight_type="ts"):
    out = totals.wide_returns(days(spark, folder), PRIORITIES, measure, weight_type)
    return out.toDF("date", "s1", "s2", "s3", "s4", "s5", "total")


@query
def daily_return_wide(spark, folder):
    return _wide(spark, folder, "return")


@query
def long_daily_return_wide(spark, folder):
    return _wide(spark, folder, "long_return")


@query
def short_daily_return_wide_cs(spark, folder):
    return _wide(spark, folder, "short_return", "cs")


@query
def long_short_daily(spark, folder):
    return tot(spark, folder).select("date", "long", "short")


@query
def alpha(spark, folder):
    return tot(spark, folder).select("date", "excess", "strategy", "benchmark")


@query
def weight_rows_per_day(spark, folder):
    return totals.weight_rows(w1(spark, folder))


@query
def weight_rates(spark, folder):
    return totals.rates(totals.weight_rows(w1(spark, folder)))


@query
def effective_range(spark, folder):
    return totals.effective_range(tot(spark, folder), totals.weight_rows(w1(spark, folder)))


@query
def symbol_returns(spark, folder):
    return totals.symbol_returns(days(spark, folder))


@query
def top_symbols_profit(spark, folder):
    return totals.top_symbols(days(spark, folder, w2), 3, "profit")


@query
def top_symbols_loss(spark, folder):
    return totals.top_symbols(days(spark, folder, w2), 3, "loss")


@query
def yearly_return(spark, folder):
    d = days(spark, folder)
    return totals.yearly_returns(d, totals.daily_totals(d))


@query
def monthly_heatmap(spark, folder):
    return totals.monthly_returns(tot(spark, folder))


@query
def year_starts(spark, folder):
    return totals.year_starts(tot(spark, folder))


@query
def return_dist(spark, folder):
    return totals.return_spread(tot(spark, folder))


@query
def win_rates(spark, folder):
    rows = backtest.sides(tot(spark, folder))
    return totals.win_rates(rows, ["side"], yearly_days=YEAR)


# performance


def _performance(column, name):
    def f(spark, folder):
        return performance.daily_performance(ret(spark, folder, column), ["side"], snap=SNAP)

    f.__name__ = f"daily_performance_{name}"
    query(f)


for _column, _name in (("total", "total"), ("long", "long"), ("short", "short"), ("excess", "alpha"), ("benchmark", "bench")):
    _performance(_column, _name)


@query
def equity_curves(spark, folder):
    return totals.curves(backtest.sides(tot(spark, folder)), ["side"])


@query
def underwater(spark, folder):
    return performance.underwater(ret(spark, folder), ["side"], snap=SNAP).select("date", "i", "cum", "uw", "ep")


@query
def drawdown_episodes(spark, folder):
    return performance.episodes(performance.underwater(ret(spark, folder), ["side"], snap=SNAP), ["side"])


@query
def top_drawdowns(spark, folder):
    return performance.top_drawdowns(ret(spark, folder), 10, group=["side"], snap=SNAP)


@query
def rolling_daily_performance(spark, folder):
    return performance.rolling_performance(ret(spark, folder), yearly_days=YEAR, group=["side"], snap=SNAP)


@query
def cal_yearly_days(spark, folder):
    return performance.yearly_days_of(tot(spark, folder))


# trades


@query
def pairs_stepwise(spark, folder):
    return pairs.trades(w3(spark, folder))


@query
def pairs_intraday(spark, folder):
    return pairs.trades(w2(spark, folder))


@query
def pairs_daily(spark, folder):
    return pairs.trades(w1(spark, folder))


@query
def pairs_between(spark, folder):
    return pairs.between(pairs.trades(w1(spark, folder)), "1996-03-01", "1998-06-30")


def _evaluation(side):
    def f(spark, folder):
        return pairs.evaluate(pairs.trades(w2(spark, folder)), (side,))

    f.__name__ = f"pairs_eval_{side}"
    query(f)


for _side in ("all", "long", "short"):
    _evaluation(_side)


@query
def aggregated_pairs(spark, folder):
    return pairs.aggregated(pairs.trades(w3(spark, folder)))


@query
def pairs_dist(spark, folder):
    agg = pairs.aggregated(pairs.trades(w1(spark, folder)))
    return agg.select("dir", rnd(F.col("profit_bp") / 100.0, 4).alias("pnl_pct"), "hold_bars")


@query
def holding_segments(spark, folder):
    return pairs.holding_segments(pairs.aggregated(pairs.trades(w3(spark, folder))))


@query
def key_trades(spark, folder):
    return pairs.key_trades(pairs.holding_segments(pairs.aggregated(pairs.trades(w1(spark, folder)))), 3)


# whole strategies


def _stats(spark, folder, side):
    w = w1(spark, folder)
    return backtest.stats_table(backtest.sides(tot(spark, folder), (side,)), pairs.trades(w), totals.weight_rows(w), w, YEAR, SNAP, (side,)).select("side", *backtest.STATS[:-2])


@query
def stats(spark, folder):
    return _stats(spark, folder, "all")


@query
def long_stats(spark, folder):
    return _stats(spark, folder, "long")


@query
def short_stats(spark, folder):
    return _stats(spark, folder, "short")


@query
def segment_stats(spark, folder):
    """Two segments of time, of all three sides: the segment is a group, trades are matched once."""
    bounds = [("1995-01-01", "1996-12-31"), ("1997-01-01", "1998-12-31")]
    array = F.array(*[F.struct(F.lit(a).alias("start_date"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for a, b in bounds])

    def within(df, first, last):
        inside = F.filter(array, lambda s: (F.to_date(first) >= s["a"]) & (F.to_date(last) <= s["b"]))
        return df.withColumn("start_date", F.explode(F.transform(inside, lambda s: s["start_date"])))

    w = w1(spark, folder)
    rows = within(backtest.sides(totals.daily_totals(days(spark, folder))), "date", "date")
    groups = spark.range(1).select(F.explode(F.array(*[F.lit(a) for a, _ in bounds])).alias("start_date"))
    out = backtest.stats_table(rows, within(pairs.trades(w), "open_dt", "close_dt"), within(totals.weight_rows(w), "date", "date"), w, YEAR, SNAP, groups=groups)
    return out.select("side", *backtest.STATS[:-2], "start_date")


@query
def long_alpha_stats(spark, folder):
    return backtest.long_alpha(tot(spark, folder), YEAR, SNAP)


@query
def curves_voladj(spark, folder):
    rows = backtest.sides(tot(spark, folder))
    vol = rows.groupBy("side").agg((F.stddev_samp("ret") * YEAR**0.5).alias("vol"))
    scale = F.when(F.col("vol") > 0, 0.20 / F.when(F.col("vol") > 0, F.col("vol"))).otherwise(1.0)
    return totals.curves(rows.join(vol, "side").select("side", "date", (F.col("ret") * scale).alias("ret")), ["side"])


@query
def yearly_metrics(spark, folder):
    return verdict.yearly_metrics(verdict.volatility_adjusted(tot(spark, folder)))


@query
def verdict_history(spark, folder):
    return verdict.history(tot(spark, folder))


@query
def verdict_recent(spark, folder):
    return verdict.recent(tot(spark, folder))


# utilities


def _ensemble(name, **options):
    def f(spark, folder):
        return portfolio.ensemble(fixtures.strategies(spark, folder), ["w1", "w2", "w3"], **options)

    f.__name__ = f"ensemble_{name}"
    query(f)


_ensemble("mean", method="mean")
_ensemble("vote", method="vote")
_ensemble("sum_clip", method="sum_clip", clip_min=-0.5, clip_max=0.5)
_ensemble("only_long", method="mean", only_long=True)


@query
def trade_price(spark, folder):
    return portfolio.trade_prices(fixtures.klines(spark, folder), digits=3, windows=(5, 10))


@query
def strategy_summary(spark, folder):
    return portfolio.strategy_summary(w2(spark, folder))
