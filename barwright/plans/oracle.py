"""The queries in DuckDB's SQL, written apart from the DataFrame code.

Common parts are named subqueries; ``_sql`` puts those that a query names before its body.
"""

from __future__ import annotations

# names of subqueries -> their text; a name in braces in a text pulls that one in first
_PART = {
    "w1": "select o_orderpriority symbol, o_orderdate dt, ((sum(o_orderkey)*37)%201-100)/1e2 weight, round((100+max(o_totalprice)/5e3)*1e4)/1e4 price from orders group by all",
    "w2": "select 'U'||(user_id%8) symbol, ts dt, ((event_id*37)%201-100)/1e2 weight, 100+value/1e1 price from events",
    "w3": "select 'U'||(user_id%8) symbol, ts dt, ((event_id%5)-2)*25/1e2 weight, 100+value/1e1 price from events",
    "kl": "select symbol, dt, coalesce(lag(price) over (partition by symbol order by dt), price) as open, price as close, 1+event_id%100 vol from (select 'U'||(user_id%8) symbol, ts dt, 100+value/1e1 price, event_id from events)",
    "en": "select symbol, dt, weight w1, -weight/2 w2, case when weight>0.5 then null else weight/4 end w3 from {w1}",
}


def _bars(w: str) -> None:
    p = f"{{{w}}}"
    _PART[f"b_{w}"] = (
        "select symbol, dt, n1b, pw*n1b edge, pw*n1b-abs(pw-w)*0.0002 as \"return\", abs(pw-w)*0.0002 as cost, abs(pw-w) turnover,"
        " pl*n1b long_edge, ps*n1b short_edge, abs(pl-l)*0.0002 long_cost, abs(ps-s)*0.0002 short_cost, abs(pl-l) long_turnover, abs(ps-s) short_turnover,"
        " pl*n1b-abs(pl-l)*0.0002 long_return, ps*n1b-abs(ps-s)*0.0002 short_return from ("
        " select symbol, dt, weight w, lw pw, greatest(weight,0) l, least(weight,0) s, greatest(lw,0) pl, least(lw,0) ps, case when lp=0 then 0 else price/lp-1 end n1b"
        f" from (select *, lag(weight) over x lw, lag(price) over x lp from {p} window x as (partition by symbol order by dt)) where lw is not null)"
    )
    sums = ", ".join(f'sum("{m}") as "{m}"' for m in _MEASURES)
    _PART[f"d_{w}"] = f"select symbol, dt::date as date, {sums} from {{b_{w}}} group by all"


_MEASURES = ("n1b", "edge", "return", "cost", "turnover", "long_edge", "short_edge", "long_cost", "short_cost", "long_turnover", "short_turnover", "long_return", "short_return")
for _w in ("w1", "w2"):
    _bars(_w)
_PART["t"] = 'select date, avg("return") total, avg(long_return) long, avg(short_return) short, avg("return") strategy, avg(n1b) benchmark, avg("return")-avg(n1b) excess, count(*) n_symbols from {d_w1} group by date'
_PART["rows"] = "select dt::date as date, count(*) filter (weight>0) n_long, count(*) filter (weight<0) n_short, count(*) n_rows from {w1} group by all"
_PART["sides"] = "select 'all' side, date, total ret from {t} union all select 'long', date, long from {t} union all select 'short', date, short from {t}"
_PART["adj"] = (
    "select *, long*(0.2/lv)-benchmark*(0.2/bv) alpha from (select *, stddev_pop(long) over ()*sqrt(252) lv, stddev_pop(benchmark) over ()*sqrt(252) bv from {t})"
)


def _trades(w: str) -> None:
    _PART[f"p_{w}"] = (
        "select symbol, dir, open_dt, close_dt, open_px, close_px, close_bar-open_bar+1 hold_bars, 'open_'||dir||' -> close_'||dir event_seq,"
        " case when open_px=0 then 0 else round((close_px-open_px)*(case dir when 'long' then 1 else -1 end)/open_px*10000.0*100)/100 end profit_bp, count,"
        " (epoch_us(close_dt)-epoch_us(open_dt))//86400000000 hold_days from ("
        " select symbol, dir, bar open_bar, cb close_bar, any_value(dt) open_dt, any_value(cdt) close_dt, any_value(price) open_px, any_value(cpx) close_px, sum(hi-lo) count from ("
        "  select *, lead(bar) over x cb, lead(dt) over x cdt, lead(price) over x cpx from ("
        f"   select s.*, lo, hi from {{s_{w}}} s join (select * from (select symbol, dir, hi, lag(hi) over (partition by symbol, dir order by hi) lo from ("
        f"     select symbol, dir, now hi from {{s_{w}}} union select symbol, dir, was from {{s_{w}}})) where lo is not null) i"
        "   on s.symbol=i.symbol and s.dir=i.dir and lo>=least(now,was) and hi<=greatest(now,was))"
        "  window x as (partition by symbol, dir, lo order by bar)) where now>was and cb is not null group by symbol, dir, bar, cb)"
    )
    _PART[f"s_{w}"] = (
        "select * from (select *, coalesce(lag(now) over (partition by symbol, dir order by bar),0) was from ("
        f" select symbol, d.dir, dt, price, row_number() over (partition by symbol, d.dir order by dt) bar, greatest(round(weight*100)::bigint*d.sign,0) now from {{{w}}}, (values ('long',1),('short',-1)) d(dir,sign))) where now<>was"
    )
    _PART[f"a_{w}"] = (
        "select symbol, min(dir) dir, open_dt, close_dt, min(open_px) open_px, min(close_px) close_px, max(hold_bars) hold_bars, round(sum(profit_bp*count)/sum(count)*100)/100 profit_bp, count(*) count"
        f" from {{p_{w}}} group by symbol, open_dt, close_dt"
    )


for _w in ("w1", "w2", "w3"):
    _trades(_w)


def _perf(name: str, rows: str, group: str, order: str = "date") -> None:
    """Metrics of ``rows`` (group, order, ret), as parts named after ``name``."""
    _PART[f"{name}_u"] = (
        f"select *, sum((uw>=0)::int) over (partition by {group} order by i rows unbounded preceding) ep from ("
        f" select *, cum-max(cum) over (partition by {group} order by i rows unbounded preceding) uw from ("
        f"  select {group}, {order} pos, ret, row_number() over x - 1 i, round(sum(ret) over (partition by {group} order by {order} rows unbounded preceding)*1e12)/1e12 cum"
        f"  from {rows} window x as (partition by {group} order by {order})))"
    )
    _PART[f"{name}_e"] = (
        f"select {group}, ep, depth, peak, valley, start, bottom, nxt recovery, days_under from ("
        f" select *, lead(start) over (partition by {group} order by ep) nxt from ("
        f"  select {group}, ep, min(uw) depth, min(i) peak, min(i) filter (uw=m) valley, min(pos) start, min(pos) filter (uw=m) bottom, count(*) filter (uw<0) days_under"
        f"  from (select *, min(uw) over (partition by {group}, ep) m from {{{name}_u}}) group by {group}, ep)) where depth<0"
    )
    _PART[f"{name}_m"] = (
        f"select b.{group}, round(total*1e4)/1e4 absolute_return, an annual_return, round(greatest(-5,least(10,mean/std*sqrt(252)))*1e4)/1e4 sharpe, round(mdd*1e4)/1e4 max_drawdown,"
        " round(greatest(-10,least(20,round((case when mdd<2.3e-16 then 10 else an/mdd end)*1e4)/1e4))*1e4)/1e4 calmar, wr daily_win_rate, pl daily_profit_loss_ratio,"
        " round((pl*wr-(1-wr))*1e4)/1e4 daily_win_probability, vol annual_volatility, round(coalesce(down,0)*sqrt(252)*1e4)/1e4 downside_volatility,"
        " round((n-zeros)/n*1e4)/1e4 non_zero_coverage, coalesce(round(paid_at/n*1e4)/1e4,1) break_even_point, longest::double new_high_interval, round(high*1e4)/1e4 new_high_ratio,"
        " round(mdd/vol*1e4)/1e4 drawdown_risk, round(slope*252*1e4)/1e4 annual_lin_reg_cumsum_return, round(top_days/5/252*1e4)/1e4 length_adjusted_average_max_drawdown from ("
        "  select *, round(mean*252*1e4)/1e4 an, round(wins/n*1e4)/1e4 wr, round(std*sqrt(252)*1e4)/1e4 vol,"
        "  round((case when n>wins and lost<>0 then (won/wins)/abs(lost/(n-wins)) else 5 end)*1e4)/1e4 pl from ("
        f"   select {group}, count(*)::double n, sum(ret) total, avg(ret) mean, stddev_pop(ret) std, count(*) filter (ret>=0) wins, count(*) filter (ret=0) zeros,"
        "   coalesce(sum(ret) filter (ret>0),0) won, coalesce(sum(ret) filter (ret<0),0) lost, stddev_pop(ret) filter (ret<0) down, regr_slope(cum,i) slope, avg((uw>=0)::int) high"
        f"   from {{{name}_u}} group by {group})) b"
        f" left join (select {group}, max(-depth) mdd, max(days_under) longest, sum(valley-peak) filter (k<=5)::double top_days from"
        f"   (select *, row_number() over (partition by {group} order by depth, valley) k from {{{name}_e}}) group by {group}) f on b.{group}=f.{group}"
        f" left join (select {group}, min(k) paid_at from (select {group}, row_number() over (partition by {group} order by ret) k, sum(ret) over (partition by {group} order by ret rows unbounded preceding) paid"
        f"   from {{{name}_u}}) where paid>0 group by {group}) q on b.{group}=q.{group}"
    )


_KEYS = {"week": "isoyear(date)*100+week(date)", "month": "year(date)*100+month(date)", "quarter": "year(date)*10+quarter(date)", "year": "year(date)"}


def _wins(name: str, rows: str) -> None:
    each = " union all ".join(f"select side, '{p}' p, sum(ret) s, count(*) n from {rows} group by side, {k}" for p, k in _KEYS.items())
    rate = ", ".join(f"coalesce(round(avg((s>0)::int) filter (p='{p}' and (p<>'year' or n>=126))*1e4)/1e4,0) {p}_win_rate" for p in _KEYS)
    _PART[name] = f"select side, {rate} from ({each}) group by side"


for _c in ("total", "long", "short", "excess", "benchmark"):
    _PART[f"r_{_c}"] = f"select '{_c}' side, date, {_c} ret from {{t}}"
    _perf(f"m_{_c}", f"{{r_{_c}}}", "side")
_perf("m_sides", "{sides}", "side")
_wins("wr_sides", "{sides}")
_PART["r_alpha"] = "select 'alpha' side, date, alpha ret from {adj}"
_perf("m_adj", "{r_alpha}", "side")
_wins("wr_adj", "{r_alpha}")
_PART["roll"] = (
    "select a.rn, b.rn o, b.ret from {numbered} a join {numbered} b on b.date between a.date - 252 and a.date and b.rn<=a.rn where a.rn>=100"
)
_PART["numbered"] = "select date, total ret, row_number() over (order by date)-1 rn from {t}"
_perf("m_roll", "{roll}", "rn", "o")


def _evaluation(trades: str) -> str:
    return (
        "select side, n::bigint trade_count, round((won+lost)*100)/100 total_profit, round((won+lost)/n*100)/100 single_trade_profit, wins::bigint win_trade_count, round(won*100)/100 sum_win,"
        " round(w1*1e4)/1e4 win_one, losses::bigint loss_trade_count, round(lost*100)/100 sum_loss, round(l1*1e4)/1e4 loss_one, round(wins/n*1e4)/1e4 win_rate,"
        " case when lost=0 then 0 else round(won/abs(lost)*1e4)/1e4 end total_profit_loss_ratio, case when l1=0 then 0 else round(w1/abs(l1)*1e4)/1e4 end single_profit_loss_ratio,"
        " case when won+lost<=0 then 1 else round(even/n*1e4)/1e4 end break_even_point, round(bars/n*100)/100 position_k_days from ("
        " select *, case when wins>0 then won/wins else 0 end w1, case when losses>0 then lost/losses else 0 end l1 from ("
        "  select side, sum(c) n, coalesce(sum(c) filter (p>=0),0) wins, coalesce(sum(p*c) filter (p>=0),0) won, coalesce(sum(c) filter (p<0),0) losses, coalesce(sum(p*c) filter (p<0),0) lost, sum(bars) bars,"
        "  min(case when gained+p*need>=0 then seen+need end) even from ("
        "   select *, case when p<=0 then c else least(greatest(ceil(-gained/p),1),c) end need from ("
        "    select *, coalesce(sum(p*c) over x,0) gained, coalesce(sum(c) over x,0) seen from ("
        "     select side, profit_bp p, sum(count)::double c, sum(hold_bars*count)::double bars from ("
        f"      select 'all' side, * from {trades} union all select dir, * from {trades}) group by all)"
        "    window x as (partition by side order by p rows between unbounded preceding and 1 preceding)))"
        "  group by side))"
    )


for _w in ("w1", "w2"):
    _PART[f"ev_{_w}"] = _evaluation(f"{{p_{_w}}}")

_STATS = (
    "m.side, absolute_return, annual_return, sharpe, calmar, new_high_ratio, coalesce(single_profit_loss_ratio,0) single_profit_loss_ratio, coalesce(single_trade_profit,0) single_trade_profit, daily_win_rate,"
    " week_win_rate, month_win_rate, quarter_win_rate, year_win_rate, max_drawdown, annual_volatility, downside_volatility, new_high_interval, trade_count,"
    " round(trade_count/(n_days/252)*100)/100 annual_trade_count, position_k_days, win_rate trade_win_rate,"
    " case m.side when 'short' then 0.0 else (select round(sum(n_long)/sum(n_rows)*1e4)/1e4 from {ROWS}) end long_rate,"
    " case m.side when 'long' then 0.0 else (select round(sum(n_short)/sum(n_rows)*1e4)/1e4 from {ROWS}) end short_rate,"
    " (select count(distinct symbol) from {w1}) symbols_count"
)


def _stats_of(perf: str, wins: str, sides: str, ev: str, rows: str, more: str = "") -> str:
    return (
        f"select {_STATS.replace('{ROWS}', rows)}{more} from {{{perf}}} m join {{{wins}}} w on w.side=m.side join (select side, count(*)::double n_days from {sides} group by side) d on d.side=m.side"
        f" left join {ev} e on e.side=m.side"
    )


_PART["stats"] = _stats_of("m_sides_m", "wr_sides", "{sides}", "{ev_w1}", "{rows}")
_SEGMENTS = (("g1", "1995-01-01", "1996-12-31"), ("g2", "1997-01-01", "1998-12-31"))
for _g, _a, _b in _SEGMENTS:
    _in = f"date between date '{_a}' and date '{_b}'"
    _PART[f"sides_{_g}"] = f"select * from {{sides}} where {_in}"
    _PART[f"rows_{_g}"] = f"select * from {{rows}} where {_in}"
    _PART[f"p_{_g}"] = f"select * from {{p_w1}} where open_dt::date>=date '{_a}' and close_dt::date<=date '{_b}'"
    _PART[f"ev_{_g}"] = _evaluation(f"{{p_{_g}}}")
    _perf(f"m_{_g}", f"{{sides_{_g}}}", "side")
    _wins(f"wr_{_g}", f"{{sides_{_g}}}")

_PART["under_year"] = (
    "select y, max(peak-cum) dd from (select *, max(cum) over (partition by y order by date rows unbounded preceding) peak from ("
    " select year(date) y, date, sum(alpha) over (partition by year(date) order by date rows unbounded preceding) cum from {adj})) group by y"
)
_PART["years"] = (
    "select year, abs_return, alpha_return, dd alpha_max_drawdown, n_days as \"days\", n_days>=200 is_complete_year, n_days>=200 and (abs_return>1e-9 or alpha_return>1e-9 or dd<0.2) year_passed from ("
    " select year(date) \"year\", sum(strategy) abs_return, sum(alpha) alpha_return, count(*) as n_days from {adj} group by 1) join {under_year} on y=year"
)
_PART["parts"] = "select *, case when row_number() over (order by date desc)<=252 then 'recent' else 'before' end part from {adj}"
_PART["parts_dd"] = (
    "select part, max(peak-cum) dd from (select *, max(cum) over (partition by part order by date rows unbounded preceding) peak from ("
    " select part, date, sum(alpha) over (partition by part order by date rows unbounded preceding) cum from {parts})) group by part"
)
_PART["all_dd"] = "select max(peak-cum) dd from (select *, max(cum) over (order by date rows unbounded preceding) peak from (select date, sum(alpha) over (order by date rows unbounded preceding) cum from {adj}))"


def _expand(text: str) -> str:
    """The query with all named parts that it needs, each once, before it."""
    import re

    order: list[str] = []

    def need(t: str) -> None:
        for name in re.findall(r"\{(\w+)\}", t):
            if name not in order:
                need(_PART[name])
                order.append(name)

    need(text)
    refer = lambda t: re.sub(r"\{(\w+)\}", r"q_\1", t)
    parts = ", ".join(f"q_{n} as materialized ({refer(_PART[n])})" for n in order)
    return f"with {parts} {refer(text)}" if parts else refer(text)


def _round(columns: str, source: str) -> str:
    """``columns``: names; those with a leading ~ to eight decimals, with a leading # as bigint."""
    out = []
    for c in columns.split():
        name = c.lstrip("~#")
        out.append(f'round("{name}"*1e8)/1e8 as "{name}"' if c[0] == "~" else f'"{name}"::bigint as "{name}"' if c[0] == "#" else f'"{name}"')
    return f"select {', '.join(out)} from ({source})"


_M17 = "~absolute_return ~annual_return ~sharpe ~max_drawdown ~calmar ~daily_win_rate ~daily_profit_loss_ratio ~daily_win_probability ~annual_volatility ~downside_volatility ~non_zero_coverage ~break_even_point ~new_high_interval ~new_high_ratio ~drawdown_risk ~annual_lin_reg_cumsum_return ~length_adjusted_average_max_drawdown"
_BARS = " ".join("~" + m for m in _MEASURES)
_TRADES = "symbol dir open_dt close_dt ~open_px ~close_px #hold_bars event_seq ~profit_bp #count #hold_days"
_EVAL = "side #trade_count ~total_profit ~single_trade_profit #win_trade_count ~sum_win ~win_one #loss_trade_count ~sum_loss ~loss_one ~win_rate ~total_profit_loss_ratio ~single_profit_loss_ratio ~break_even_point ~position_k_days"
_STAT_COLUMNS = "side ~absolute_return ~annual_return ~sharpe ~calmar ~new_high_ratio ~single_profit_loss_ratio ~single_trade_profit ~daily_win_rate ~week_win_rate ~month_win_rate ~quarter_win_rate ~year_win_rate ~max_drawdown ~annual_volatility ~downside_volatility ~new_high_interval #trade_count ~annual_trade_count ~position_k_days ~trade_win_rate ~long_rate ~short_rate #symbols_count"


def _wide(measure: str, agg: str = "avg") -> str:
    names = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    each = ", ".join(f"sum(\"{measure}\") filter (symbol='{s}') s{i}" for i, s in enumerate(names, 1))
    return _round("date ~s1 ~s2 ~s3 ~s4 ~s5 ~total", f'select date, {each}, {agg}("{measure}") total from {{d_w1}} group by date')


_CURVE = "select side, date, ret, cum, cum-max(cum) over (partition by side order by date rows unbounded preceding) drawdown from (select *, sum(ret) over (partition by side order by date rows unbounded preceding) cum from {ROWS})"
_WINRATES = "~week_win_rate ~month_win_rate ~quarter_win_rate ~year_win_rate"
_MEAN3 = "(coalesce(w1,0)+coalesce(w2,0)+coalesce(w3,0))"
_COUNT3 = "((w1 is not null)::int+(w2 is not null)::int+(w3 is not null)::int)"


def _ens(weight: str) -> str:
    return _round("symbol dt ~w1 ~w2 ~w3 ~weight", f"select *, {weight} weight from {{en}}")


def _tp(t: int) -> str:
    over = f"(partition by symbol order by dt rows between 1 following and {t} following)"
    return (
        f"coalesce(case when count(*) over {over}={t} then avg(close) over {over} end, close) \"TP_TWAP{t}\","
        f" coalesce(case when count(*) over {over}={t} then sum(vol*close) over {over}/sum(vol) over {over} end, close) \"TP_VWAP{t}\""
    )


_BEST = (
    "select * from (select year, case when best<=3 then 'best' when row_number() over (partition by year order by best<=3, profit_bp, open_dt, symbol, dir, close_dt)<=3 then 'worst' end kind,"
    " symbol, dir, open_dt, close_dt, open_px, close_px, hold_bars, profit_bp, count from ("
    " select *, year(close_dt) \"year\", row_number() over (partition by year(close_dt) order by profit_bp desc, open_dt, symbol, dir, close_dt) best from {SEG})) where kind is not null"
)


def _segments(w: str) -> str:
    """Connected trades by passing least numbers along shared opens and closes, in turn."""
    _PART[f"n_{w}"] = f"select *, row_number() over (order by symbol, dir, open_dt, close_dt) l0 from {{a_{w}}}"
    last = f"n_{w}"
    for i in range(1, 13):
        key = "open_dt" if i % 2 else "close_dt"
        _PART[f"n{i}_{w}"] = f"select *, min(l{i - 1}) over (partition by symbol, dir, {key}) l{i} from {{{last}}}"
        last = f"n{i}_{w}"
    _PART[f"seg_{w}"] = (
        "select symbol, dir, open_dt, close_dt, open_px, close_px, hold_bars, profit_bp, total count from ("
        f" select *, sum(count) over (partition by l12) total, row_number() over (partition by l12 order by hold_bars desc, open_dt, close_dt) k from {{{last}}}) where k=1"
    )
    return f"seg_{w}"


for _w in ("w1", "w3"):
    _segments(_w)

_TEXT = {
    "round_weight": _round("symbol dt ~weight", "select symbol, dt, round(weight*1e2)/1e2 weight from {w2}"),
    "symbol_dict": "select distinct symbol from {w1}",
    "bar_transition": _round(f"symbol dt {_BARS}", "select * from {b_w2}"),
    "dailys": _round(f"symbol date {_BARS}", "select * from {d_w1}"),
    "dailys_intraday": _round(f"symbol date {_BARS}", "select * from {d_w2}"),
    "dailys_one_symbol": _round(f"symbol date {_BARS}", "select * from {d_w2} where symbol='U3'"),
    "dailys_between": _round(f"symbol date {_BARS}", "select * from {d_w1} where date between date '1996-03-01' and date '1998-06-30'"),
    "daily_total_ts": _round("date ~total #n_symbols", "select * from {t}"),
    "daily_total_cs": _round("date ~total #n_symbols", 'select date, sum("return") total, count(*) n_symbols from {d_w1} group by date'),
    "daily_return_long": _round("date symbol ~ret", 'select date, symbol, "return" ret from {d_w1}'),
    "daily_return_wide": _wide("return"),
    "long_daily_return_wide": _wide("long_return"),
    "short_daily_return_wide_cs": _wide("short_return", "sum"),
    "long_short_daily": _round("date ~long ~short", "select * from {t}"),
    "alpha": _round("date ~excess ~strategy ~benchmark", "select * from {t}"),
    "weight_rows_per_day": "select * from {rows}",
    "weight_rates": _round("~long_rate ~short_rate", "select round(sum(n_long)/sum(n_rows)*1e4)/1e4 long_rate, round(sum(n_short)/sum(n_rows)*1e4)/1e4 short_rate from {rows}"),
    "effective_range": "select min(date) start_date, max(date) end_date from {t}",
    "symbol_returns": _round("symbol ~ret", 'select symbol, sum("return") ret from {d_w1} group by symbol'),
    "top_symbols_profit": _round("symbol ~ret", 'select symbol, sum("return") ret from {d_w2} group by symbol order by ret desc limit 3'),
    "top_symbols_loss": _round("symbol ~ret", 'select symbol, sum("return") ret from {d_w2} group by symbol order by ret limit 3'),
    "yearly_return": _round("#year symbol ~ret", "select year(date) \"year\", symbol, sum(r) ret from (select date, symbol, \"return\" r from {d_w1} union all select date, 'total', total from {t}) group by 1, 2 having count(r)>=120"),
    "monthly_heatmap": _round("#year #month ~ret", "select y \"year\", m \"month\", coalesce((select sum(total) from {t} where year(date)=y and month(date)=m),0) ret from (select distinct year(date) y from {t}), (select unnest(range(1,13)) m)"),
    "year_starts": _round("#year first_date", 'select year(date) "year", min(date) first_date from {t} group by 1'),
    "return_dist": _round("~mean_pct ~std_pct", "select avg(total*100) mean_pct, stddev_samp(total*100) std_pct from {t}"),
    "win_rates": _round(f"side {_WINRATES}", "select * from {wr_sides}"),
    **{f"daily_performance_{n}": _round(f"side {_M17}", f"select * from {{m_{c}_m}}") for c, n in (("total", "total"), ("long", "long"), ("short", "short"), ("excess", "alpha"), ("benchmark", "bench"))},
    "equity_curves": _round("side date ~ret ~cum ~drawdown", _CURVE.replace("{ROWS}", "{sides}")),
    "underwater": _round("date #i ~cum ~uw #ep", "select pos as date, i, cum, uw, ep from {m_total_u}"),
    "drawdown_episodes": _round("side #ep ~depth #peak #valley start bottom recovery #days_under", "select * from {m_total_e}"),
    "top_drawdowns": _round(
        "side #rank start end recovery ~depth #drawdown_days #recovery_days #new_high_days",
        "select side, rank, start, bottom as \"end\", recovery, depth, bottom-start drawdown_days, recovery-bottom recovery_days, recovery-start new_high_days from (select *, row_number() over (order by depth, valley) rank from {m_total_e}) where rank<=10",
    ),
    "rolling_daily_performance": _round(f"side {_M17} edt sdt", "select 'total' side, m.*, date edt, date-252 sdt from {m_roll_m} m join {numbered} n on n.rn=m.rn"),
    "cal_yearly_days": "select case when max(b)-min(a)<365 then 252 else least(max(n),365) end::bigint yearly_days from (select count(distinct date) n, min(date) a, max(date) b from {t} group by year(date))",
    "pairs_stepwise": _round(_TRADES, "select * from {p_w3}"),
    "pairs_intraday": _round(_TRADES, "select * from {p_w2}"),
    "pairs_daily": _round(_TRADES, "select * from {p_w1}"),
    "pairs_between": _round(_TRADES, "select * from {p_w1} where open_dt::date>=date '1996-03-01' and close_dt::date<=date '1998-06-30'"),
    **{f"pairs_eval_{s}": _round(_EVAL, f"select * from {{ev_w2}} where side='{s}'") for s in ("all", "long", "short")},
    "aggregated_pairs": _round("symbol dir open_dt close_dt ~open_px ~close_px #hold_bars ~profit_bp #count", "select * from {a_w3}"),
    "pairs_dist": _round("dir ~pnl_pct #hold_bars", "select dir, round(profit_bp/100*1e4)/1e4 pnl_pct, hold_bars from {a_w1}"),
    "holding_segments": _round("symbol dir open_dt close_dt ~open_px ~close_px #hold_bars ~profit_bp #count", "select * from {seg_w3}"),
    "key_trades": _round("#year kind symbol dir open_dt close_dt ~open_px ~close_px #hold_bars ~profit_bp #count", _BEST.replace("{SEG}", "{seg_w1}")),
    **{n: _round(_STAT_COLUMNS, f"select * from {{stats}} where side='{s}'") for n, s in (("stats", "all"), ("long_stats", "long"), ("short_stats", "short"))},
    "segment_stats": _round(_STAT_COLUMNS + " start_date", " union all ".join(_stats_of(f"m_{g}_m", f"wr_{g}", f"{{sides_{g}}}", f"{{ev_{g}}}", f"{{rows_{g}}}", f", '{a}' start_date") for g, a, _ in _SEGMENTS)),
    "long_alpha_stats": _round("~absolute_return ~annual_return ~sharpe ~calmar ~new_high_ratio ~daily_win_rate ~week_win_rate ~month_win_rate ~quarter_win_rate ~year_win_rate ~max_drawdown ~annual_volatility ~downside_volatility ~new_high_interval", "select * from {m_adj_m} m join {wr_adj} w on w.side=m.side"),
    "curves_voladj": _round("side date ~ret ~cum ~drawdown", _CURVE.replace("{ROWS}", "(select side, date, ret*0.2/(stddev_samp(ret) over (partition by side)*sqrt(252)) ret from {sides})")),
    "yearly_metrics": _round("#year ~abs_return ~alpha_return ~alpha_max_drawdown #days is_complete_year year_passed", "select * from {years}"),
    "verdict_history": _round(
        "#complete_year_count alpha_degenerate cond_yearly_passed ~history_alpha_max_drawdown ~history_alpha_sharpe cond_history_dd_passed cond_history_sharpe_passed is_good",
        "select *, cond_yearly_passed and cond_history_dd_passed and cond_history_sharpe_passed is_good from (select n complete_year_count, false alpha_degenerate, n>0 and bad=0 cond_yearly_passed, dd history_alpha_max_drawdown, sh history_alpha_sharpe, dd<=0.3 cond_history_dd_passed, sh>0.5 cond_history_sharpe_passed from (select count(*) filter (is_complete_year) n, count(*) filter (is_complete_year and not year_passed) bad from {years}), {all_dd}, (select avg(alpha)/stddev_pop(alpha)*sqrt(252) sh from {adj}))",
    ),
    "verdict_recent": _round(
        "recent_start_date recent_end_date #recent_actual_days ~recent_abs_return ~recent_alpha_return ~recent_alpha_max_drawdown ~history_alpha_max_drawdown_excl_recent history_window_empty alpha_degenerate cond_recent_return_passed cond_recent_dd_passed is_good",
        "select *, cond_recent_return_passed and cond_recent_dd_passed is_good from (select a0 recent_start_date, a1 recent_end_date, n recent_actual_days, ab recent_abs_return, al recent_alpha_return, r.dd recent_alpha_max_drawdown, case when o.n0>=60 then h.dd end history_alpha_max_drawdown_excl_recent, o.n0<60 history_window_empty, false alpha_degenerate, ab>1e-9 or al>1e-9 or r.dd<0.2 cond_recent_return_passed, coalesce(o.n0>=60 and r.dd<h.dd,false) cond_recent_dd_passed from (select min(date) a0, max(date) a1, count(*) n, sum(strategy) ab, sum(alpha) al from {parts} where part='recent'), (select dd from {parts_dd} where part='recent') r, (select dd from {parts_dd} where part='before') h, (select count(*) n0 from {parts} where part='before') o)",
    ),
    "ensemble_mean": _ens(f"{_MEAN3}/{_COUNT3}"),
    "ensemble_vote": _ens(f"sign({_MEAN3})::double"),
    "ensemble_sum_clip": _ens(f"greatest(-0.5,least(0.5,{_MEAN3}))"),
    "ensemble_only_long": _ens(f"greatest({_MEAN3}/{_COUNT3},0)"),
    "trade_price": "select symbol, dt, round(open*1e8)/1e8 as open, round(close*1e8)/1e8 as close, vol, "
    + ", ".join(f'round_even("{c}",3) "{c}"' for c in ("TP_CLOSE", "TP_NEXT_OPEN", "TP_NEXT_CLOSE", "TP_TWAP5", "TP_VWAP5", "TP_TWAP10", "TP_VWAP10"))
    + f" from (select *, close \"TP_CLOSE\", coalesce(lead(open) over x, close) \"TP_NEXT_OPEN\", coalesce(lead(close) over x, close) \"TP_NEXT_CLOSE\", {_tp(5)}, {_tp(10)} from {{kl}} window x as (partition by symbol order by dt))",
    "strategy_summary": _round("symbol #n_rows first_dt last_dt ~min_weight ~max_weight ~mean_weight #n_null #n_zero", "select symbol, count(*) n_rows, min(dt) first_dt, max(dt) last_dt, min(weight) min_weight, max(weight) max_weight, avg(weight) mean_weight, count(*)-count(weight) n_null, count(*) filter (weight=0) n_zero from {w2} group by symbol"),
}

SQL = {name: _expand(text) for name, text in _TEXT.items()}
