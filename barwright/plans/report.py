"""An HTML report of a result: cards, and tabs of charts (drawn as SVG) and tables. A panel that fails
says so; the rest stands."""

from __future__ import annotations

import html
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from barwright.plans.backtest import Backtest
from barwright.plans.labels import STATS
from barwright.plans.result import CURVES, Result
from barwright.sources.weights import from_any, normalise

_STYLE = """body{font-family:sans-serif;margin:2em;color:#222}table{border-collapse:collapse;margin:1em 0}td,th{padding:.3em .7em;border:1px solid #ccc;text-align:right}
.card{display:inline-block;padding:.7em 1em;margin:.3em;border:1px solid #ccc;border-radius:.4em}.up{color:#c0392b}.down{color:#2e8b57}.even{color:#2f6db5}.bad{color:#a00}svg{width:100%;height:16em}
.grid{display:flex;flex-wrap:wrap}.half{width:48%;margin-right:2%}.whole{width:100%}.tab>input{display:none}.tab>label{padding:.5em 1em;border:1px solid #ccc;display:inline-block;cursor:pointer}.panel{display:none}input:checked~.panel{display:block}"""
_COLOURS = ("#2f6db5", "#c0392b", "#2e8b57", "#8e6c3a", "#7d3c98", "#555555")
_PERCENT = ("return", "drawdown", "volatility", "rate", "coverage", "new_high_ratio", "pnl")
#: The cards: statistic, and from what value on it is good (None: neither good nor bad).
CARDS = (
    ("annual_return", 0.0), ("absolute_return", 0.0), ("sharpe", 0.0), ("calmar", 0.0), ("max_drawdown", float("inf")), ("annual_volatility", None), ("downside_volatility", None),
    ("single_trade_profit", 0.0), ("single_profit_loss_ratio", 1.0), ("trade_win_rate", 0.5), ("daily_win_rate", 0.5), ("position_k_days", None), ("long_rate", None), ("short_rate", None),
)
_NONE = "<p>-</p>"
Panel = tuple[str, Callable[[], str], bool]  # title, what draws it, whether over the whole width


def shown(key: str, value) -> str:
    """A number as text, by what its name says; whole numbers and dates as they are."""
    if value is None:
        return "-"
    if isinstance(value, float):
        return f"{value:.2%}" if any(p in key for p in _PERCENT) else f"{value:,.2f}"
    return str(value)


class Page:
    """Collects parts of a page, in order; ``render`` joins them. Every method returns the page."""

    def __init__(self, title: str, language: str = "en"):
        self.title, self.language, self.parts, self.tabs, self.styles = title, language, [f"<h1>{html.escape(title)}</h1>"], 0, [_STYLE]

    def css(self, text: str) -> Page:
        self.styles.append(text.replace("</", ""))
        return self

    def header(self, facts: dict, subtitle: str = "") -> Page:
        about = " | ".join(f"{html.escape(str(k))}: {html.escape(shown('', v))}" for k, v in facts.items())
        self.parts.append(f"<header><p>{html.escape(subtitle)}</p><p>{about}</p></header>")
        return self

    def metrics(self, found: dict, chosen=CARDS) -> Page:
        self.parts.append(cards(found, chosen))
        return self

    def section(self, title: str, make: Callable[[], str]) -> Page:
        self.parts.append(_panel(title, make))
        return self

    def table(self, title: str, rows: list[dict]) -> Page:
        return self.section(title, lambda: table(rows))

    def tab(self, name: str, panels: list[Panel]) -> Page:
        """Panels behind a label; those that are not whole share a line by twos. Tabs in a row belong
        together, and the first is open."""
        self.tabs += 1
        body = "".join(f'<div class="{"whole" if whole else "half"}">{_panel(title, make)}</div>' for title, make, whole in panels)
        self.parts.append(f'<div class="tab"><input type="checkbox" id="tab{self.tabs}"{" checked" if self.tabs == 1 else ""}><label for="tab{self.tabs}">{html.escape(name)}</label><div class="panel grid">{body}</div></div>')
        return self

    def footer(self, text: str) -> Page:
        self.parts.append(f"<footer>{html.escape(text)}</footer>")
        return self

    def render(self) -> str:
        head = f'<meta charset="utf-8"><title>{html.escape(self.title)}</title><style>{"".join(self.styles)}</style>'
        return f'<!DOCTYPE html><html lang="{html.escape(self.language)}"><head>{head}</head><body>{"".join(self.parts)}</body></html>'

    def save(self, path: str) -> str:
        Path(path).write_text(self.render(), encoding="utf-8")
        return path


def _panel(title: str, make: Callable[[], str]) -> str:
    try:
        body = make()
    except Exception as e:  # one panel must not take the others with it
        body = f'<p class="bad">{html.escape(type(e).__name__)}: {html.escape(str(e).splitlines()[0] if str(e) else "")}</p>'
    return f"<h2>{html.escape(title)}</h2>{body}"


def cards(found: dict, chosen=CARDS) -> str:
    def one(key: str, good: float | None) -> str:
        value = found.get(key)
        tone = "even" if good is None or not isinstance(value, (int, float)) else "up" if value > good else "down"
        return f'<div class="card"><div>{html.escape(STATS.get(key, key))}</div><b class="{tone}">{html.escape(shown(key, value))}</b></div>'

    return "".join(one(k, good) for k, good in chosen)


def table(rows: list[dict], tone: Callable[[str, object], str] | None = None) -> str:
    if not rows:
        return _NONE
    head = "".join(f"<th>{html.escape(STATS.get(str(k), str(k)))}</th>" for k in rows[0])

    def cell(k, v) -> str:
        style = tone(k, v) if tone else ""
        return f"<td{style}>{html.escape(shown(k, v))}</td>"

    return f"<table><tr>{head}</tr>{''.join('<tr>' + ''.join(cell(k, v) for k, v in r.items()) + '</tr>' for r in rows)}</table>"


def _svg(drawn: str) -> str:
    return f'<svg viewBox="0 0 1000 300" preserveAspectRatio="none">{drawn}</svg>'


def _upright(x: float, name: str, colour: str = "#bbb") -> str:
    return f'<line x1="{x:.1f}" x2="{x:.1f}" y1="0" y2="300" stroke="{colour}" stroke-dasharray="4"><title>{html.escape(name)}</title></line>'


def lines(series: dict[str, list[float]], dates: list | None = None) -> str:
    """Curves over the same days; with ``dates``, a line where a year begins."""
    values = [v for s in series.values() for v in s if v is not None]
    if not values:
        return _NONE
    low, high = min(values), max(values)
    span = (high - low) or 1.0
    drawn = []
    for i in range(1, len(dates or [])):
        if dates[i].year != dates[i - 1].year:
            drawn.append(_upright(1000 * i / max(len(dates) - 1, 1), str(dates[i].year)))
    for (name, s), colour in zip(series.items(), _COLOURS * 3):
        points = " ".join(f"{1000 * i / max(len(s) - 1, 1):.1f},{300 - 290 * (v - low) / span:.1f}" for i, v in enumerate(s) if v is not None)
        drawn.append(f'<polyline fill="none" stroke="{colour}" stroke-width="1.5" points="{points}"><title>{html.escape(name)}</title></polyline>')
    legend = " ".join(f'<span style="color:{c}">{html.escape(n)}</span>' for n, c in zip(series, _COLOURS * 3))
    return f"{_svg(''.join(drawn))}<p>{legend} ({low:.4f} to {high:.4f})</p>"


def bars(found: dict[str, list[float]], names: list[str]) -> str:
    """Groups of bars: one group for each name, one bar in it for each entry of ``found``."""
    high = max((abs(v) for s in found.values() for v in s), default=0) or 1.0
    if not names:
        return _NONE
    width = 1000 / len(names)
    own = 0.8 * width / len(found)
    drawn = []
    for k, ((name, s), colour) in enumerate(zip(found.items(), _COLOURS)):
        for i, v in enumerate(s):
            fill = colour if len(found) > 1 else _COLOURS[v < 0]
            drawn.append(f'<rect x="{i * width + k * own:.1f}" y="{150 - max(v, 0) / high * 145:.1f}" width="{own:.1f}" height="{abs(v) / high * 145:.1f}" fill="{fill}"><title>{html.escape(f"{names[i]} {name}: {v:.4f}")}</title></rect>')
    return _svg("".join(drawn))


def histogram(values: list[float], mean: float, std: float, bins: int = 40) -> str:
    """How often which return was, with lines at the mean and two deviations from it."""
    if not values:
        return _NONE
    low, high = min([*values, mean - 2 * std]), max([*values, mean + 2 * std])
    span = (high - low) or 1.0
    count = [0] * bins
    for v in values:
        count[min(bins - 1, int((v - low) / span * bins))] += 1
    top, width = max(count), 1000 / bins
    drawn = [f'<rect x="{i * width:.1f}" y="{300 - 290 * n / top:.1f}" width="{0.9 * width:.1f}" height="{290 * n / top:.1f}" fill="{_COLOURS[0]}"><title>{n}</title></rect>' for i, n in enumerate(count)]
    drawn += [_upright(1000 * (x - low) / span, f"{name} {x:.3f}%", "#c0392b") for name, x in (("mean", mean), ("-2 sigma", mean - 2 * std), ("+2 sigma", mean + 2 * std))]
    return f"{_svg(''.join(drawn))}<p>{low:.3f}% to {high:.3f}%, mean {mean:.3f}%, sigma {std:.3f}%</p>"


def heatmap(monthly: list[dict]) -> str:
    """Years by months, and the year; the deeper the colour, the larger the return."""
    years: dict[int, dict[int, float]] = {}
    for r in monthly:
        years.setdefault(r["year"], {})[r["month"]] = r["ret"]
    high = max((abs(v) for ms in years.values() for v in ms.values()), default=0) or 1.0

    def tone(_, v) -> str:
        if not isinstance(v, float):
            return ""
        return f' style="background:rgba({"192,57,43" if v > 0 else "46,139,87"},{min(1.0, abs(v) / high) * 0.7:.2f})"'

    return table([{"year": y} | {f"{m:02d} return": v for m, v in sorted(ms.items())} | {"year return": sum(ms.values())} for y, ms in years.items()], tone)


def _dist(dist: list[dict], key: str) -> str:
    """Trades by ``key``, a bar for long and one for short."""
    names = sorted({r[key] for r in dist})
    counts = {d: dict.fromkeys(names, 0.0) for d in ("long", "short")}
    for r in dist:
        counts[r["dir"]][r[key]] += r["n"]
    return bars({d: list(c.values()) for d, c in counts.items()}, [str(n) for n in names])


def verdicts(*found: dict) -> str:
    """A card for each verdict, and its conditions and figures as a table."""
    out = []
    for v in found:
        good = bool(v.get("is_good"))
        out.append(f'<div class="card"><div>{html.escape(v["mode"])}</div><b class="{"up" if good else "down"}">{"passed" if good else "not passed"}</b></div>')
        out.append(table([{"what": k, "value": shown(k, x)} for k, x in v.items() if not isinstance(x, list) and k != "mode"]))
        if v.get("yearly_metrics"):
            out.append(table(v["yearly_metrics"]))
    return "".join(out)


def _years(result: Result) -> str:
    years = result.verdict["yearly_metrics"]
    return bars({"absolute": [y["abs_return"] for y in years], "excess": [y["alpha_return"] for y in years]}, [str(y["year"]) for y in years])


def _trades(result: Result) -> str:
    return table([{"year": y, "kind": kind} | t for kind, years in result.key_trades.items() for y, trades in years.items() for t in trades])


def tabs(result: Result) -> list[tuple[str, list[Panel]]]:
    dates = result.daily["date"]

    def cumulative(found: dict) -> str:
        return lines({c: v["cum"] for c, v in found.items()}, dates)

    spread = lambda: histogram(result.return_dist["values_pct"], result.return_dist["mean_pct"], result.return_dist["std_pct"])
    symbols = lambda: bars({"return": [r["ret"] for r in result.symbol_returns]}, [r["symbol"] for r in result.symbol_returns])
    rolling = lambda key: lines({key: [r[key] for r in result.rolling]}, [r["edt"] for r in result.rolling])
    return [
        ("Overview", [("Drawdown", lambda: lines({"cum": result.curves["total"]["cum"], "drawdown": result.curves["total"]["drawdown"]}, dates), True), ("Daily returns", spread, True), ("Months", lambda: heatmap(result.monthly), True), ("Symbols", symbols, True)]),
        ("Verdict", [("Verdicts", lambda: verdicts(result.verdict, {"mode": "recent"} | result.verdict_recent), True), ("Deepest drawdowns", lambda: table(result.drawdowns), True), ("Statistics", lambda: table([{"what": STATS.get(k, k), "value": shown(k, v)} for k, v in result.stats.items()]), True)]),
        ("Robustness", [("Years", lambda: _years(result), True), *((f"Rolling {k}", lambda k=k: rolling(k), False) for k in ("annual_return", "annual_volatility", "sharpe")), ("Last year and all", lambda: table([{"segment": s} | v for s, v in result.segment_comparison.items()]), True)]),
        ("Sides", [("Cumulative returns", lambda: cumulative({c: result.curves[c] for c in CURVES[:-1]}), False), ("At equal volatility", lambda: cumulative(result.curves_voladj), False), ("Side by side", lambda: table([{"side": s} | v for s, v in result.stats_by_side.items() if s in ("long", "short")]), True)]),
        ("Trades", [("Profit in percent", lambda: _dist(result.pairs_dist, "pnl_pct"), False), ("Bars held", lambda: _dist(result.pairs_dist, "hold_bars"), False), ("Key trades", lambda: _trades(result), True)]),
    ]


def report(result: Result, title: str = "Backtest") -> Page:
    bt = result.bt
    page = Page(title).header({"weights": bt.weight_type, "fee": f"{bt.fee:.4%}", "digits": bt.digits, "days a year": bt.yearly_days, "symbols": len(bt.symbols), "from": result.stats["start_date"], "to": result.stats["end_date"]}, "Position weights, their returns and trades")
    page.metrics(result.stats)
    for name, panels in tabs(result):
        page.tab(name, panels)
    return page.footer("Returns are sums, not compounded; costs are taken off.")


def write_report(data, path: str = "backtest_report.html", title: str = "Backtest", spark: SparkSession | None = None, target_vol: float = 0.20, **options) -> str:
    """The report of a weight table as a file; its path. Checks the columns, that there are rows, and
    that no weight or price is missing before anything is computed."""
    spark = spark or (data.sparkSession if isinstance(data, DataFrame) else SparkSession.active())
    rows = from_any(spark, data)
    normalise(rows)
    if not rows.limit(1).count():
        raise ValueError("the weight table is empty")
    bt = Backtest(rows, spark=spark, **options)
    try:
        return report(Result(bt, target_vol), title).save(path)
    finally:
        bt.close()
