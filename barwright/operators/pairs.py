"""Trades: what was opened last is closed first.

With last-in-first-out matching, unit k of a side opens when the side's volume rises through k and
closes when it next falls through k. So trades are pairs of consecutive crossings of a level, with
no stack to keep. Levels between which a symbol's volume never stops are crossed together, so one
interval stands for all of them: a bar makes a row for each interval that it crosses, and no more.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalars import ratio, rnd


def trades(weights: DataFrame, digits: int = 2) -> DataFrame:
    """symbol, dir, open_dt, close_dt, open_px, close_px, hold_bars, event_seq, profit_bp, count (of
    units of 10^-digits weight), hold_days. What is open at the end makes no trade. Bars of one time
    are taken by price, then weight, so that reruns agree."""
    by = Window.partitionBy("symbol").orderBy("dt", "price", "weight")
    bars = weights.select("symbol", "dt", "price", F.row_number().over(by).cast("long").alias("bar"), F.round(F.col("weight") * 10.0**digits).cast("long").alias("vol"))
    sides = F.explode(F.array(F.struct(F.lit("long").alias("dir"), F.lit(1).alias("sign")), F.struct(F.lit("short").alias("dir"), F.lit(-1).alias("sign"))))
    s = bars.withColumn("x", sides).select("symbol", "x.dir", "bar", "dt", "price", F.greatest(F.col("vol") * F.col("x.sign"), F.lit(0)).alias("now"))
    # dealt by side of a symbol, for all that follows. The number is given, so that few bytes are not
    # joined into few tasks: crossings are many times the bars
    s = s.repartition(int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol", "dir")
    # levels are numbered by the volumes at which a symbol's side ever stops; 0 is one of them
    side = Window.partitionBy("symbol", "dir")
    s = s.withColumn("level", F.dense_rank().over(side.orderBy("now")) - F.when(F.min("now").over(side) > 0, 0).otherwise(1))
    by_bar = side.orderBy("bar")
    s = s.withColumn("from", F.coalesce(F.lag("level").over(by_bar), F.lit(0)))
    widths = s.groupBy("symbol", "dir", "level").agg(F.first("now").alias("top"))
    widths = widths.select("symbol", "dir", "level", (F.col("top") - F.coalesce(F.lag("top").over(side.orderBy("level")), F.lit(0))).alias("width")).where("level > 0")
    # a bar crosses the levels between its stop and the one before
    s = s.where("level <> from").withColumn("opens", F.col("level") > F.col("from"))
    x = s.withColumn("level", F.explode(F.sequence(F.least("level", "from") + 1, F.greatest("level", "from"))))
    at = Window.partitionBy("symbol", "dir", "level").orderBy("bar")
    x = x.withColumns({"close_bar": F.lead("bar").over(at), "close_dt": F.lead("dt").over(at), "close_px": F.lead("price").over(at)})
    x = x.where("opens and close_bar is not null").join(widths, ["symbol", "dir", "level"])
    t = x.groupBy("symbol", "dir", F.col("bar").alias("open_bar"), "close_bar").agg(
        F.first("dt").alias("open_dt"), F.first("close_dt").alias("close_dt"), F.first("price").alias("open_px"), F.first("close_px").alias("close_px"), F.sum("width").alias("count")
    )
    sign = F.when(F.col("dir") == "long", 1.0).otherwise(-1.0)
    gain = F.when(F.col("open_px") == 0, 0.0).otherwise(rnd(ratio((F.col("close_px") - F.col("open_px")) * sign, F.col("open_px")) * 10000.0, 2))
    return t.select(
        "symbol",
        "dir",
        "open_dt",
        "close_dt",
        "open_px",
        "close_px",
        (F.col("close_bar") - F.col("open_bar") + 1).alias("hold_bars"),
        F.concat(F.lit("open_"), F.col("dir"), F.lit(" -> close_"), F.col("dir")).alias("event_seq"),
        gain.alias("profit_bp"),
        "count",
        F.floor((F.unix_micros(F.col("close_dt").cast("timestamp")) - F.unix_micros(F.col("open_dt").cast("timestamp"))) / F.lit(86_400_000_000)).alias("hold_days"),
    )


def between(pairs: DataFrame, start=None, end=None) -> DataFrame:
    """Trades opened from ``start`` on and closed up to ``end`` (dates; None: no bound)."""
    if start is not None:
        pairs = pairs.where(F.to_date("open_dt") >= F.lit(start).cast("date"))
    if end is not None:
        pairs = pairs.where(F.to_date("close_dt") <= F.lit(end).cast("date"))
    return pairs


EVALUATION = (
    "trade_count",
    "total_profit",
    "single_trade_profit",
    "win_trade_count",
    "sum_win",
    "win_one",
    "loss_trade_count",
    "sum_loss",
    "loss_one",
    "win_rate",
    "total_profit_loss_ratio",
    "single_profit_loss_ratio",
    "break_even_point",
    "position_k_days",
)


def evaluate(pairs: DataFrame, directions: tuple[str, ...] = ("all", "long", "short"), groups: DataFrame | None = None) -> DataFrame:
    """A row for each of ``directions`` (all zeros where there is no trade), weighted by count.

    Trades are first summed by direction and profit, so that the order-dependent break-even point is
    found over distinct profits, not trades. With ``groups`` (a row for each value of its one column,
    which ``pairs`` has too) there is a row for each group and direction.
    """
    by = [*(groups.columns if groups is not None else []), "side"]
    each = pairs.where("count > 0").withColumn("side", F.explode(F.array(F.lit("all"), F.col("dir")))).where(F.col("side").isin(*directions))
    level = each.groupBy(*by, "profit_bp").agg(F.sum("count").cast("double").alias("c"), F.sum(F.col("hold_bars") * F.col("count")).alias("bars"))
    before = Window.partitionBy(*by).orderBy("profit_bp").rowsBetween(Window.unboundedPreceding, -1)
    p, c = F.col("profit_bp"), F.col("c")
    level = level.withColumns({"gained": F.coalesce(F.sum(p * c).over(before), F.lit(0.0)), "seen": F.coalesce(F.sum("c").over(before), F.lit(0.0))})
    need = F.when(p <= 0, c).otherwise(F.least(F.greatest(F.ceil(ratio(-F.col("gained"), p)).cast("double"), F.lit(1.0)), c))
    level = level.withColumn("even", F.when(F.col("gained") + p * need >= 0, F.col("seen") + need))
    win = p >= 0
    s = level.groupBy(*by).agg(
        F.sum("c").alias("n"),
        F.sum(F.when(win, c).otherwise(0.0)).alias("wins"),
        F.sum(F.when(win, p * c).otherwise(0.0)).alias("won"),
        F.sum(F.when(win, 0.0).otherwise(c)).alias("losses"),
        F.sum(F.when(win, 0.0).otherwise(p * c)).alias("lost"),
        F.sum("bars").alias("bars"),
        F.min("even").alias("even"),
    )
    spark = pairs.sparkSession
    sides = spark.range(1).select(F.explode(F.array(*map(F.lit, directions))).alias("side")) if groups is None else groups.withColumn("side", F.explode(F.array(*map(F.lit, directions))))
    s = sides.join(s, by, "left").fillna(0.0, ["n", "wins", "won", "losses", "lost"]).fillna(0, ["bars"])
    n, total = F.col("n"), F.col("won") + F.col("lost")
    win_one, loss_one = ratio(F.col("won"), F.col("wins")), ratio(F.col("lost"), F.col("losses"))
    metrics = {
        "trade_count": n.cast("long"),
        "total_profit": rnd(total, 2),
        "single_trade_profit": rnd(ratio(total, n), 2),
        "win_trade_count": F.col("wins").cast("long"),
        "sum_win": rnd(F.col("won"), 2),
        "win_one": rnd(win_one, 4),
        "loss_trade_count": F.col("losses").cast("long"),
        "sum_loss": rnd(F.col("lost"), 2),
        "loss_one": rnd(loss_one, 4),
        "win_rate": rnd(ratio(F.col("wins"), n), 4),
        "total_profit_loss_ratio": rnd(ratio(F.col("won"), F.abs("lost")), 4),
        "single_profit_loss_ratio": rnd(ratio(win_one, F.abs(loss_one)), 4),
        "break_even_point": F.when(n == 0, 0.0).when(total <= 0, 1.0).otherwise(rnd(ratio(F.coalesce("even", n), n), 4)),
        "position_k_days": rnd(ratio(F.col("bars").cast("double"), n), 2),
    }
    return s.select(*by, *[c.alias(k) for k, c in metrics.items()])


def aggregated(pairs: DataFrame) -> DataFrame:
    """One row for each symbol, open and close; ``count`` is of records, profit weighted by units."""
    key = ["symbol", "open_dt", "close_dt"]
    g = pairs.groupBy(*key).agg(
        F.min("dir").alias("dir"), F.min_by("open_px", "dir").alias("open_px"), F.min_by("close_px", "dir").alias("close_px"), F.max("hold_bars").alias("hold_bars"), F.sum(F.col("profit_bp") * F.col("count")).alias("pw"), F.sum("count").alias("w"), F.count("*").alias("n")
    )
    return g.select("symbol", "dir", "open_dt", "close_dt", "open_px", "close_px", "hold_bars", rnd(ratio(F.col("pw"), F.col("w")), 2).alias("profit_bp"), F.col("n").alias("count"))


def _segmenter():
    """Sent to the workers by value, so that they need not have this package."""

    def micros(column) -> np.ndarray:
        return (column.cast(pa.int32()) if pa.types.is_date32(column.type) else column).cast(pa.int64()).to_numpy()

    def linked(opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """The least row linked to each. Least numbers pass along shared opens and closes until none changes,
        each round from where the round before led."""
        groups = []
        for ends in (opens, closes):
            order = np.argsort(ends, kind="stable")
            new = np.diff(ends[order], prepend=-1) != 0
            of = np.empty(len(ends), np.int64)
            of[order] = np.cumsum(new) - 1
            groups.append((order, np.flatnonzero(new), of))
        label = np.arange(len(opens))
        while True:
            now = label
            for order, start, of in groups:
                now = np.minimum.reduceat(now[order], start)[of]
            now = now[now]
            if (now == label).all():
                return label
            label = now

    def segments(batches):
        """One row for each set of linked trades. ``batches`` are sorted by symbol, dir, open_dt; trades of a
        side that lie wholly after all before are linked to none of those, so rows are held up to there."""
        held, size, wait = [], 0, 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += len(batch)
                if size < wait:
                    continue
            if not size:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            times = np.concatenate([micros(t[c]) for c in ("open_dt", "close_dt")])
            rank = np.unique(times, return_inverse=True)[1].reshape(2, -1)
            names = [t[c].combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in ("symbol", "dir")]
            side = np.concatenate(([0], np.cumsum((np.diff(names[0]) != 0) | (np.diff(names[1]) != 0))))
            opens, closes = rank + side * (len(times) + 1)
            cuts = np.flatnonzero(opens[1:] > np.maximum.accumulate(closes)[:-1]) + 1
            done = size if batch is None else int(cuts[-1]) if len(cuts) else 0
            if done:
                part = linked(opens[:done], closes[:done])
                order = np.lexsort((closes[:done], opens[:done], -t["hold_bars"].to_numpy()[:done], part))
                first = np.flatnonzero(np.diff(part[order], prepend=-1))
                total = np.add.reduceat(t["count"].to_numpy()[:done][order], first)
                out = t.take(pa.array(order[first]))
                at = t.column_names.index("count")
                yield from out.set_column(at, t.schema.field(at), pa.array(total)).to_batches(max_chunksize=10_000)
            held = t.slice(done).to_batches()
            size -= done
            wait = 2 * size

    return segments


def holding_segments(agg: DataFrame) -> DataFrame:
    """Trades of a symbol and direction that share an open or a close, directly or through others,
    become one: the longest stands for all (of equal ones the earliest), counts add up.

    Times of opens and closes may meet, as they do where a symbol has several bars of one time.
    """
    parts = int(agg.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = agg.repartition(parts, "symbol", "dir").sortWithinPartitions("symbol", "dir", "open_dt", "close_dt")
    return rows.mapInArrow(_segmenter(), agg.schema)


def key_trades(segments: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` best and, of the others, worst trades of each year of closing; year and kind first."""
    rows = segments.withColumn("year", F.year("close_dt"))
    tie = [F.col("open_dt"), F.col("symbol"), F.col("dir"), F.col("close_dt")]
    by = Window.partitionBy("year")
    best = F.row_number().over(by.orderBy(F.desc("profit_bp"), *tie))
    rows = rows.withColumn("best", best)
    # worst: ranked again without the best
    worst = F.row_number().over(by.orderBy(F.col("best") <= top, F.asc("profit_bp"), *tie))
    rows = rows.withColumn("worst", worst)
    kind = F.when(F.col("best") <= top, "best").when(F.col("worst") <= top, "worst")
    return rows.withColumn("kind", kind).where("kind is not null").select("year", "kind", *segments.columns)
