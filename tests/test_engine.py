import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from barwright.functions.scalars import rnd
from barwright.operators import bars, pairs, performance, portfolio, totals, verdict
from barwright.plans import backtest, labels
from barwright.sources import mock, weights

T0 = dt.datetime(2024, 1, 2, 9)


def table(spark, rows):
    return spark.createDataFrame(rows, "symbol string, dt timestamp_ntz, weight double, price double")


def random_rows(seed, symbols=3, n=60, levels=(-0.5, -0.25, 0.0, 0.25, 0.5)):
    draw = random.Random(seed)
    return [(f"S{s}", T0 + dt.timedelta(hours=6 * i), draw.choice(levels), round(100 + draw.gauss(0, 3), 2)) for s in range(symbols) for i in range(n)]


def stack_trades(rows):
    """Last in, first out, with a stack of lots."""
    out = []
    for symbol in sorted({r[0] for r in rows}):
        stack, mine = [], sorted(r for r in rows if r[0] == symbol)
        for i, (_, when, w, px) in enumerate(mine, 1):
            want = round(w * 100)
            have = sum(n for n, *_ in stack)
            if have and (want == 0 or (want > 0) != (have > 0)):
                close, opened = abs(have), want
            else:
                close, opened = max(0, abs(have) - abs(want)), want - have if abs(want) > abs(have) else 0
            while close:
                n, j, odt, opx = stack.pop()
                m = min(abs(n), close)
                close -= m
                if m < abs(n):
                    stack.append((n - m if n > 0 else n + m, j, odt, opx))
                side = 1 if n > 0 else -1
                gain = (px - opx) / opx * side * 1e6
                out.append((symbol, "long" if n > 0 else "short", odt, when, i - j + 1, math.floor(abs(gain) + 0.5) * (1 if gain >= 0 else -1) / 100, m))
            if opened:
                stack.append((opened, i, when, px))
    return sorted(out)


def test_rounding_is_half_away_from_zero(spark):
    got = spark.createDataFrame([(0.125,), (-0.125,), (2.5,), (0.005,)], "x double").select(rnd(F.col("x"), 2)).collect()
    assert [r[0] for r in got] == [0.13, -0.13, 2.5, 0.01]


def test_bars_by_hand(spark):
    rows = [("A", T0, 0.5, 100.0), ("A", T0 + dt.timedelta(hours=1), -0.25, 110.0), ("A", T0 + dt.timedelta(days=1), 0.0, 99.0), ("B", T0, 1.0, 5.0)]
    got = bars.bar_transitions(table(spark, rows), 0.0002).orderBy("dt").collect()
    assert len(got) == 2  # a symbol's first bar gives none
    assert got[0].n1b == pytest.approx(0.1) and got[0].edge == pytest.approx(0.05) and got[0].turnover == 0.75
    assert got[0]["return"] == pytest.approx(0.05 - 0.75 * 0.0002) and got[0].long_return + got[0].short_return == pytest.approx(got[0]["return"])
    assert got[1].short_edge == pytest.approx(-0.25 * -0.1) and got[1].long_edge == 0
    zero = bars.bar_transitions(table(spark, [("A", T0, 1.0, 0.0), ("A", T0 + dt.timedelta(hours=1), 1.0, 5.0)])).first()
    assert zero.n1b == 0.0


@pytest.mark.parametrize("seed", range(4))
def test_trades_equal_a_stack(spark, seed):
    rows = random_rows(seed, levels=(-0.5, -0.25, 0.0, 0.25, 0.5) if seed % 2 else [x / 100 for x in range(-30, 31)])
    got = pairs.trades(table(spark, rows)).collect()
    assert sorted((r.symbol, r.dir, r.open_dt, r.close_dt, r.hold_bars, r.profit_bp, r["count"]) for r in got) == stack_trades(rows)


def test_performance_by_hand(spark):
    rows = spark.createDataFrame([("g", dt.date(2024, 1, 1 + i), r) for i, r in enumerate([0.01, -0.005, 0.02])], "side string, date date, ret double")
    got = performance.daily_performance(rows, ["side"]).first()
    want = {"absolute_return": 0.025, "annual_return": 2.1, "sharpe": 10, "max_drawdown": 0.005, "calmar": 20, "daily_win_rate": 0.6667, "daily_profit_loss_ratio": 3.0, "break_even_point": 0.6667, "new_high_interval": 1}
    assert {k: got[k] for k in want} == pytest.approx(want)
    for flat in ([0.0, 0.0], [0.01, -0.01], [0.01]):
        r = performance.daily_performance(spark.createDataFrame([("g", dt.date(2024, 1, 1 + i), x) for i, x in enumerate(flat)], "side string, date date, ret double"), ["side"]).first()
        assert r.sharpe == 0 and r.max_drawdown == 0 and r.annual_lin_reg_cumsum_return is None


def test_drawdowns(spark):
    r = [0.02, -0.01, -0.02, 0.05, -0.01, 0.001]
    rows = spark.createDataFrame([(dt.date(2024, 1, 1 + i), x) for i, x in enumerate(r)], "date date, ret double")
    got = performance.top_drawdowns(rows, 5).orderBy("rank").collect()
    assert [(x.start.day, x.end.day, x.recovery and x.recovery.day, round(x.depth, 6), x.drawdown_days, x.recovery_days) for x in got] == [(1, 3, 4, -0.03, 2, 1), (4, 5, None, -0.01, 1, None)]


def test_rolling_windows(spark):
    draw = random.Random(1)
    series = [(dt.date(2022, 1, 1) + dt.timedelta(days=2 * i), draw.gauss(0, 0.01)) for i in range(60)]
    rows = spark.createDataFrame(series, "date date, ret double")
    got = performance.rolling_performance(rows, window=30, min_periods=20, yearly_days=252).collect()
    assert len(got) == 40
    for r in got:
        inside = [x for d, x in series if r.sdt <= d <= r.edt]
        assert r.absolute_return == pytest.approx(round(sum(inside), 4), abs=1e-4)
    assert performance.infer_yearly_days(rows) == 252
    with pytest.raises(ValueError):
        performance.infer_yearly_days(rows.limit(0))


def test_segments_and_key_trades(spark):
    rows = random_rows(7, n=200)
    agg = pairs.aggregated(pairs.trades(table(spark, rows)))
    flat, segments = agg.collect(), pairs.holding_segments(agg).collect()
    # a plain walk over shared opens and closes
    left, groups = list(range(len(flat))), 0
    while left:
        todo, groups = [left.pop()], groups + 1
        while todo:
            a = flat[todo.pop()]
            near = [i for i in left if flat[i].symbol == a.symbol and flat[i].dir == a.dir and (flat[i].open_dt == a.open_dt or flat[i].close_dt == a.close_dt)]
            left = [i for i in left if i not in near]
            todo += near
    assert len(segments) == groups and sum(r["count"] for r in segments) == len(flat)
    keys = pairs.key_trades(spark.createDataFrame(segments), 3).collect()
    best = sorted((r.profit_bp for r in segments), reverse=True)[:3]
    assert sorted((r.profit_bp for r in keys if r.kind == "best"), reverse=True) == best and len(keys) == min(6, len(segments))


def test_segments_where_bars_share_a_time(spark):
    rows = random_rows(11, n=399)
    rows = [(r[0], rows[i - i % 3][1], *r[2:]) for i, r in enumerate(rows)]  # three bars a time
    found = [pairs.aggregated(pairs.trades(table(spark, some))).orderBy("symbol", "dir", "open_dt", "close_dt").collect() for some in (rows, rows[::-1])]
    assert found[0] == found[1]  # whatever the order of the rows
    for batch in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        segments = pairs.holding_segments(spark.createDataFrame(found[0])).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        left, want = list(found[0]), []
        while left:  # a plain walk over shared opens and closes
            group = [left.pop()]
            for a in group:
                near = [b for b in left if (a.symbol, a.dir) == (b.symbol, b.dir) and (a.open_dt == b.open_dt or a.close_dt == b.close_dt)]
                left = [b for b in left if b not in near]
                group += near
            best = min(group, key=lambda r: (-r.hold_bars, r.open_dt, r.close_dt))
            want.append((best.symbol, best.dir, best.open_dt, best.close_dt, best.profit_bp, sum(r["count"] for r in group)))
        got = [(r.symbol, r.dir, r.open_dt, r.close_dt, r.profit_bp, r["count"]) for r in segments]
        assert sorted(got) == sorted(want)


def test_facade(spark, tmp_path):
    from barwright.plans.report import report
    from barwright.plans.result import Result, assert_same, dump_json, load_json, unwrap
    from barwright.plans.report import CARDS, write_report

    w = mock.mock_weights(spark, ["A", "B"], "1d", "20200101", "20211231", seed=3)
    assert w.collect() == mock.mock_weights(spark, ["A", "B"], "1d", "20200101", "20211231", seed=3).collect()
    bt = backtest.Backtest(w)
    s = bt.stats
    assert list(s) == list(backtest.STATS) and s["symbols_count"] == 2
    assert bt.segment_stats()["absolute_return"] == s["absolute_return"]
    assert bt.long_stats["short_rate"] == 0 and bt.short_stats["long_rate"] == 0
    both = bt.daily_totals.agg(F.max(F.abs(F.col("long") + F.col("short") - F.col("total")))).first()[0]
    assert both < 1e-12
    assert bt.top_symbols(1, "profit") != bt.top_symbols(1, "loss")
    assert set(labels.labelled(s)) == set(labels.STATS.values())
    assert "交易方向" in labels.labelled_trades(bt.pairs).columns
    assert bt.verdict()["mode"] == "history" and len(bt.verdict()["yearly_metrics"]) == 2
    assert len(bt.long_alpha_stats) == 14 and bt.verdict("recent")["recent_actual_days"] == 252
    result = Result(bt)
    dump_json(result, str(tmp_path / "r.json"), full=True)
    assert_same(load_json(str(tmp_path / "r.json")), result.to_dict(full=True))
    with pytest.raises(ValueError):
        unwrap({"format": "other"})
    page = report(result).render()
    assert page.count('class="panel grid"') == 5 and page.count("<h2>") == 18 and 'class="bad"' not in page
    assert page.count('class="card"') == len(CARDS) + 2 == 16 and "+2 sigma" in page and page.count("<footer>") == 1
    # the last year is the last 252 dates of the whole
    dates = result.daily["date"]
    assert list(result.segment_comparison) == ["all", "last_year"]
    assert result.segment_comparison["last_year"] == bt.segment_stats(dates[len(dates) - 252])
    best = result.key_trades["best"]
    assert set(best) == {2020, 2021} and all(len(t) == 3 and t[0]["pnl"] >= t[2]["pnl"] for t in best.values())
    top = max(r.profit_bp for r in bt.pairs.where(F.year("close_dt") == 2020).collect())
    assert best[2020][0]["pnl"] == pytest.approx(top / 10_000)
    assert sum(r["n"] for r in result.pairs_dist) == bt.aggregated_pairs.count()
    bt.close()
    assert write_report(w, str(tmp_path / "r.html"), spark=spark).endswith("r.html") and (tmp_path / "r.html").stat().st_size > 10_000
    for bad in (w.limit(0), w.drop("price"), w.withColumn("weight", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            write_report(bad, str(tmp_path / "none.html"))
    assert not (tmp_path / "none.html").exists()


def test_a_panel_that_fails_says_so():
    from barwright.plans.report import Page, bars, heatmap, histogram, lines, table

    def broken():
        raise KeyError("gone <b>")

    page = Page("T").css("b{}</style>").header({"a": 1}, "s").tab("one", [("x", broken, True), ("y", lambda: "fine", False)]).table("rows", [{"a": None}]).footer("end").render()
    assert 'class="bad">KeyError' in page and "gone &lt;b&gt;" in page and "fine" in page and page.count("</style>") == 1
    assert table([]) == lines({}) == bars({"a": []}, []) == histogram([], 0.0, 0.0) == "<p>-</p>"
    assert "rgba(192,57,43" in heatmap([{"year": 2020, "month": 1, "ret": 0.1}, {"year": 2020, "month": 2, "ret": -0.1}])
    days = [dt.date(2020, 12, 30), dt.date(2020, 12, 31), dt.date(2021, 1, 4)]
    assert lines({"a": [1.0, 2.0, 3.0]}, days).count("<line") == 1


def test_payloads_are_checked_and_compared():
    from barwright.plans.result import FORMAT, VERSION, assert_same, differences, faults, unwrap

    good = {"format": FORMAT, "format_version": VERSION, "payload": {"a": [1, {"b": None}], "c": {}}}
    assert unwrap(good) == good["payload"] and faults(good) == []
    for wrong in (None, [], {**good, "format": 1}, {**good, "format_version": True}, {**good, "format_version": 1.0}, {**good, "payload": []}, {**good, "payload": {"a": [float("nan")]}}, {**good, "payload": {1: 2}}, {**good, "payload": {"a": {"b": (1,)}}}):
        assert faults(wrong)
        with pytest.raises(ValueError):
            unwrap(wrong)
    assert len(faults({})) == 3
    assert differences({"a": 1, "b": [1, 2]}, {"a": 1.0, "b": [1]}) == [("payload.a", 1, 1.0), ("payload.b[1]", 2, "(absent)")]
    assert_same(good, {**good})
    with pytest.raises(AssertionError, match="payload.a"):
        assert_same({"a": True}, {"a": 1})


def test_linked_trades_of_nested_spans(spark):
    """Spans within spans, apart and linked by their ends in turn."""
    days = lambda *x: [T0 + dt.timedelta(days=i) for i in x]
    spans = [(1, 20), (1, 9), (3, 9), (3, 5), (4, 5), (10, 15), (11, 14), (11, 13), (16, 18), (30, 40), (31, 40), (33, 36)]
    rows = [("A", "long", *days(a, b), 1.0, 1.0, b - a + 1, 0.0, 1) for a, b in spans] + [("A", "short", *days(1, 9), 1.0, 1.0, 9, 0.0, 1)]
    agg = spark.createDataFrame(rows, "symbol string, dir string, open_dt timestamp_ntz, close_dt timestamp_ntz, open_px double, close_px double, hold_bars long, profit_bp double, count long")
    got = {(r.dir, (r.open_dt - T0).days, (r.close_dt - T0).days): r["count"] for r in pairs.holding_segments(agg).collect()}
    assert got == {("long", 1, 20): 5, ("long", 10, 15): 1, ("long", 11, 14): 2, ("long", 16, 18): 1, ("long", 30, 40): 2, ("long", 33, 36): 1, ("short", 1, 9): 1}


def test_times_within_strings(spark):
    df = spark.createDataFrame([("at 2024-01-02 03:04:05.678 UTC",), ("2024-01-02 03:04:05",)], "dt string")
    assert {r[0] for r in df.select(weights.as_timestamp(df)).collect()} == {dt.datetime(2024, 1, 2, 3, 4, 5)}
    with pytest.raises(Exception, match="2024/01/02"):
        df = spark.createDataFrame([("2024/01/02",)], "dt string")
        df.select(weights.as_timestamp(df)).collect()


def test_logged_warnings(spark, caplog):
    with caplog.at_level("INFO"):
        portfolio.log_strategy("none", table(spark, []))
        portfolio.log_strategy("some", table(spark, [("A", T0, 0.5, 1.0), ("B", T0, 0.5, 1.0)]))
        performance.infer_yearly_days(spark.createDataFrame([(dt.date(2024, 1, 1 + i),) for i in range(9)], "date date"))
    assert "none: no rows" in caplog.text and "2 symbols, 1 points in time" in caplog.text and "under a year" in caplog.text


def test_sources_and_checks(spark, tmp_path):
    rows = random_rows(2, n=10)
    df = table(spark, rows)
    pdf = df.toPandas()
    pdf.to_csv(tmp_path / "w.csv", index=False, date_format="%Y-%m-%d %H:%M:%S")
    pdf.to_parquet(tmp_path / "w.parquet")
    pdf.to_feather(tmp_path / "w.feather")
    want = backtest.Backtest(df).stats
    for source in (pdf, *(str(tmp_path / f"w.{e}") for e in ("csv", "parquet", "feather"))):
        assert backtest.Backtest(source, spark=spark).stats == want
    with pytest.raises(ValueError, match="missing"):
        weights.normalise(df.drop("price"))
    with pytest.raises(ValueError, match="null"):
        weights.normalise(df.withColumn("weight", F.when(F.col("weight") != 0, F.col("weight"))))
    with pytest.raises(ValueError):
        weights.read_weights(spark, "w.xlsx")
    with pytest.raises(ValueError):
        backtest.Backtest(df, weight_type="x")


def test_utilities(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (0.5, None, -0.5), (None, None, None)], "a double, b double, c double")
    get = lambda **o: [r.weight for r in portfolio.ensemble(df, ["a", "b", "c"], **o).collect()]
    assert get() == pytest.approx([1 / 3, 0, 0]) and get(method="vote") == [1, 0, 0]
    assert get(method="sum_clip", clip_min=-0.5, clip_max=0.5) == [0.5, 0, 0]
    with pytest.raises(ValueError):
        get(method="other")
    k = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=i), 100.0 + i, 101.0 + i, 10.0) for i in range(10)], "symbol string, dt timestamp_ntz, open double, close double, vol double")
    got = portfolio.trade_prices(k, windows=(3,)).orderBy("dt").collect()
    assert got[0].TP_TWAP3 == 103.0 and got[0].TP_NEXT_OPEN == 101.0
    assert [r.TP_TWAP3 for r in got[-3:]] == [r.close for r in got[-3:]]
    s = portfolio.strategy_summary(table(spark, [("A", T0, 0.0, 1.0), ("A", T0, None, 1.0)])).first()
    assert (s.n_rows, s.n_null, s.n_zero) == (2, 1, 1)


def test_flat_series_are_not_good(spark):
    days = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), 0.001, 0.0, 0.0, 0.001, 0.0) for i in range(300)]
    t = spark.createDataFrame(days, "date date, total double, long double, short double, strategy double, benchmark double")
    h = verdict.history(t).first()
    assert h.alpha_degenerate and not h.is_good and h.history_alpha_sharpe is None
    assert not verdict.recent(t).first().is_good
    with pytest.raises(ValueError):
        verdict.history(t, max_dd=0)


def test_streamed_days_equal_the_batch(spark, tmp_path):
    from barwright.streaming.live import bar_stream

    rows = random_rows(3, n=40)
    df = table(spark, rows)
    half = T0 + dt.timedelta(hours=6 * 20)
    source = str(tmp_path / "in")
    df.where(F.col("dt") < F.lit(half)).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    q = bar_stream(stream).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    df.where(F.col("dt") >= F.lit(half)).coalesce(1).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    got = spark.table("live").groupBy("symbol").agg(F.sum("return").alias("r"), F.count("*").alias("n")).collect()
    want = {r.symbol: r for r in bars.bar_transitions(df).groupBy("symbol").agg(F.sum("return").alias("r"), F.count("*").alias("n")).collect()}
    assert len(got) == 3
    for r in got:
        assert r.n == want[r.symbol].n and r.r == pytest.approx(want[r.symbol].r)


def test_live_days_and_late_bars(spark, tmp_path):
    from barwright.streaming.live import live_dailys, read_dailys

    rows = random_rows(4, n=40)
    df = table(spark, rows)
    half = F.lit(T0 + dt.timedelta(hours=6 * 20))
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "c"))
    parts = [df.where(F.col("dt") < half), df.where(F.col("dt") >= half).union(df.where("symbol = 'S0'").orderBy("dt").limit(2)), df.where("symbol = 'S1'").orderBy("dt").limit(3)]
    parts[0].coalesce(1).write.parquet(source)
    for i, more in enumerate(parts):
        if i:
            more.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        q = live_dailys(stream)(out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
    got = read_dailys(spark, out).where("`return` is not null").collect()
    want = {(r.symbol, r.date): r for r in bars.dailys(bars.bar_transitions(df)).collect()}
    assert {(r.symbol, r.date) for r in got} == set(want)
    for r in got:
        assert r["return"] == pytest.approx(want[r.symbol, r.date]["return"]) and r.cost == pytest.approx(want[r.symbol, r.date].cost)
    assert read_dailys(spark, out).agg(F.sum("late")).first()[0] == 2 + 3


def test_totals(spark):
    rows = random_rows(5)
    d = bars.dailys(bars.bar_transitions(table(spark, rows)))
    ts, cs = totals.daily_totals(d, "ts"), totals.daily_totals(d, "cs")
    j = ts.join(cs.select("date", F.col("total").alias("sum")), "date")
    assert j.where(F.abs(F.col("total") * F.col("n_symbols") - F.col("sum")) > 1e-12).count() == 0
    with pytest.raises(ValueError):
        totals.daily_totals(d, "xx")
    one = totals.effective_range(ts.limit(0), totals.weight_rows(table(spark, []))).first()
    assert one.start_date == dt.date(1970, 1, 1)
