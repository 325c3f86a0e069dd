"""Chinese labels of metrics and columns, as reports show them."""

from __future__ import annotations

# Labels of the statistics, and shorter ones of single series.
STATS = {
    "absolute_return": "绝对收益",
    "annual_return": "年化收益",
    "sharpe": "夏普比率",
    "calmar": "卡玛比率",
    "new_high_ratio": "新高占比",
    "single_profit_loss_ratio": "单笔盈亏比",
    "single_trade_profit": "单笔收益",
    "daily_win_rate": "日胜率",
    "week_win_rate": "周胜率",
    "month_win_rate": "月胜率",
    "quarter_win_rate": "季胜率",
    "year_win_rate": "年胜率",
    "max_drawdown": "最大回撤",
    "annual_volatility": "年化波动率",
    "downside_volatility": "下行波动率",
    "new_high_interval": "新高间隔",
    "trade_count": "交易次数",
    "annual_trade_count": "年化交易次数",
    "position_k_days": "持仓K线数",
    "trade_win_rate": "交易胜率",
    "long_rate": "多头占比",
    "short_rate": "空头占比",
    "symbols_count": "品种数量",
    "start_date": "开始日期",
    "end_date": "结束日期",
}
SERIES = {
    "absolute_return": "绝对收益",
    "annual_return": "年化",
    "sharpe": "夏普",
    "max_drawdown": "最大回撤",
    "calmar": "卡玛",
    "daily_win_rate": "日胜率",
    "daily_profit_loss_ratio": "日盈亏比",
    "daily_win_probability": "日赢面",
    "annual_volatility": "年化波动率",
    "downside_volatility": "下行波动率",
    "non_zero_coverage": "非零覆盖",
    "break_even_point": "盈亏平衡点",
    "new_high_interval": "新高间隔",
    "new_high_ratio": "新高占比",
    "drawdown_risk": "回撤风险",
    "annual_lin_reg_cumsum_return": "回归年度回报率",
    "length_adjusted_average_max_drawdown": "长度调整平均最大回撤",
}
TRADES = {
    "dir": "交易方向",
    "open_dt": "开仓时间",
    "close_dt": "平仓时间",
    "open_px": "开仓价格",
    "close_px": "平仓价格",
    "hold_bars": "持仓K线数",
    "event_seq": "事件序列",
    "profit_bp": "盈亏比例",
    "count": "持仓数量",
    "hold_days": "持仓天数",
}
SIDES = {"all": "多空", "long": "多头", "short": "空头", "benchmark": "基准", "excess": "超额"}
DIRECTIONS = {"long": "多头", "short": "空头"}


def labelled(found: dict, names: dict[str, str] = STATS) -> dict:
    return {names.get(k, k): v for k, v in found.items()}


def labelled_trades(pairs):
    """The trades' columns and directions in Chinese."""
    from pyspark.sql import functions as F

    side = F.when(F.col("dir") == "long", "多头").otherwise("空头")
    event = F.when(F.col("dir") == "long", "开多 -> 平多").otherwise("开空 -> 平空")
    out = pairs.withColumn("dir", side)
    if "event_seq" in out.columns:
        out = pairs.withColumn("event_seq", event).withColumn("dir", side)
    return out.withColumnsRenamed({k: v for k, v in TRADES.items() if k in out.columns})
