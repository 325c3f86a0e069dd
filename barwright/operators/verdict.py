"""Is a strategy worth keeping: rules over yearly, recent and whole-sample returns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators.performance import underwater

# What counts as a gain, and as volatility.
RETURN_EPSILON = 1e-9
VOL_EPSILON = 1e-12


def volatility_adjusted(totals: DataFrame, yearly_days: int = 252, target: float = 0.20) -> DataFrame:
    """Adds alpha: long returns less benchmark, each scaled to ``target`` annual volatility; null in
    all rows if either hardly moves."""
    every = Window.partitionBy()
    root = math.sqrt(yearly_days)
    long_vol, bench_vol = F.stddev_pop("long").over(every) * root, F.stddev_pop("benchmark").over(every) * root
    t = totals.withColumns({"_lv": long_vol, "_bv": bench_vol})
    fine = (F.col("_lv") >= VOL_EPSILON) & (F.col("_bv") >= VOL_EPSILON) & ~F.isnan("_lv") & ~F.isnan("_bv")
    return t.withColumn("alpha", F.when(fine, F.col("long") * (target / F.col("_lv")) - F.col("benchmark") * (target / F.col("_bv")))).drop("_lv", "_bv")


def check(**limits) -> None:
    for name, value in limits.items():
        if not math.isfinite(value) or value <= 0:
            raise ValueError(f"{name} must be finite and above 0")


def _depth(rows: DataFrame, group: list[str], ret: str) -> DataFrame:
    return underwater(rows, group, "date", ret).groupBy(*group).agg(F.max(-F.col("uw")).alias("dd"))


def yearly_metrics(alpha: DataFrame, min_year_days: int = 200, max_dd: float = 0.20) -> DataFrame:
    """year, abs_return, alpha_return, alpha_max_drawdown, days, is_complete_year, year_passed."""
    rows = alpha.select(F.year("date").alias("year"), "date", "strategy", F.col("alpha").isNull().alias("flat"), F.coalesce("alpha", F.lit(0.0)).alias("a"))
    y = rows.groupBy("year").agg(F.sum("strategy").alias("abs_return"), F.sum("a").alias("alpha_return"), F.count("*").alias("days"), F.max("flat").alias("flat"))
    y = y.join(_depth(rows, ["year"], "a"), "year").withColumn("is_complete_year", F.col("days") >= min_year_days)
    passed = (F.col("abs_return") > RETURN_EPSILON) | (~F.col("flat") & ((F.col("alpha_return") > RETURN_EPSILON) | (F.col("dd") < max_dd)))
    return y.select("year", "abs_return", "alpha_return", F.col("dd").alias("alpha_max_drawdown"), "days", "is_complete_year", (F.col("is_complete_year") & passed).alias("year_passed"))


def history(totals: DataFrame, yearly_days: int = 252, max_dd: float = 0.20, max_alpha_dd: float = 0.30, min_sharpe: float = 0.5, min_year_days: int = 200, target: float = 0.20) -> DataFrame:
    """One row: every complete year passes, the whole excess falls no deeper than ``max_alpha_dd``,
    and its Sharpe ratio is above ``min_sharpe``."""
    check(max_dd=max_dd, max_alpha_dd=max_alpha_dd, target=target)
    alpha = volatility_adjusted(totals, yearly_days, target)
    years = yearly_metrics(alpha, min_year_days, max_dd).agg(F.count_if("is_complete_year").alias("complete_year_count"), F.count_if(F.col("is_complete_year") & ~F.col("year_passed")).alias("failed")).withColumn("g", F.lit(0))
    one = alpha.withColumn("g", F.lit(0)).withColumn("a", F.coalesce("alpha", F.lit(0.0)))
    whole = one.groupBy("g").agg(F.max(F.col("alpha").isNull()).alias("alpha_degenerate"), F.avg("a").alias("m"), F.stddev_pop("a").alias("s")).join(_depth(one, ["g"], "a"), "g")
    sharpe = F.when(F.col("s") < VOL_EPSILON, 0.0).otherwise(F.col("m") / F.when(F.col("s") != 0, F.col("s")) * math.sqrt(yearly_days))
    w = whole.join(years, "g").withColumn("sharpe", sharpe)
    fine = ~F.col("alpha_degenerate")
    w = w.withColumns({"cond_yearly_passed": (F.col("complete_year_count") > 0) & (F.col("failed") == 0), "cond_history_dd_passed": fine & (F.col("dd") <= max_alpha_dd), "cond_history_sharpe_passed": fine & (F.col("sharpe") > min_sharpe)})
    return w.select(
        "complete_year_count",
        "alpha_degenerate",
        "cond_yearly_passed",
        F.when(fine, F.col("dd")).alias("history_alpha_max_drawdown"),
        F.when(fine, F.col("sharpe")).alias("history_alpha_sharpe"),
        "cond_history_dd_passed",
        "cond_history_sharpe_passed",
        (fine & F.col("cond_yearly_passed") & F.col("cond_history_dd_passed") & F.col("cond_history_sharpe_passed")).alias("is_good"),
    )


def recent(totals: DataFrame, yearly_days: int = 252, max_dd: float = 0.20, recent_days: int = 252, min_history_days: int = 60, target: float = 0.20) -> DataFrame:
    """One row: the last ``recent_days`` returns gain, or hardly fall, and fall less than before."""
    check(max_dd=max_dd, recent_days=recent_days, target=target)
    alpha = volatility_adjusted(totals, yearly_days, target).withColumn("a", F.coalesce("alpha", F.lit(0.0)))
    back = F.row_number().over(Window.orderBy(F.desc("date")))
    rows = alpha.withColumn("part", F.when(back <= recent_days, "recent").otherwise("before"))
    s = rows.groupBy("part").agg(F.min("date").alias("a0"), F.max("date").alias("a1"), F.count("*").alias("n"), F.sum("strategy").alias("abs"), F.sum("a").alias("al"), F.max(F.col("alpha").isNull()).alias("flat"))
    s = s.join(_depth(rows, ["part"], "a"), "part")
    x = s.groupBy(F.lit(0).alias("g")).agg(*[F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}") for p in ("recent", "before") for c in ("a0", "a1", "n", "abs", "al", "flat", "dd")])
    fine = ~F.col("recent_flat")
    long_enough = F.coalesce(F.col("before_n"), F.lit(0)) >= max(min_history_days, 1)
    old = F.when(fine & long_enough, F.col("before_dd"))
    gain = fine & ((F.col("recent_abs") > RETURN_EPSILON) | (F.col("recent_al") > RETURN_EPSILON) | (F.col("recent_dd") < max_dd))
    less = F.coalesce(F.col("recent_dd") < old, F.lit(False))
    return x.select(
        F.col("recent_a0").alias("recent_start_date"),
        F.col("recent_a1").alias("recent_end_date"),
        F.col("recent_n").alias("recent_actual_days"),
        F.col("recent_abs").alias("recent_abs_return"),
        F.when(fine, F.col("recent_al")).alias("recent_alpha_return"),
        F.when(fine, F.col("recent_dd")).alias("recent_alpha_max_drawdown"),
        old.alias("history_alpha_max_drawdown_excl_recent"),
        (~fine | ~long_enough).alias("history_window_empty"),
        F.col("recent_flat").alias("alpha_degenerate"),
        gain.alias("cond_recent_return_passed"),
        less.alias("cond_recent_dd_passed"),
        (gain & less).alias("is_good"),
    )
