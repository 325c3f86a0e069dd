"""Mixing sources to target weights, by Sainte-Laguë apportionment of equal blocks of words.

Each source has a target. Blocks of ``BLOCK`` words are seats: sources get them by the highest
quotients target / (2 s + 1), and a source's blocks go to its shards the same way by their words.
In a shard, documents stand in seeded order as one stream of words, cut into blocks; a quota takes
every block as often as it can be shared out evenly, and the rest from a seeded start at even steps.

DataFrame functions only. Sums and prefix counts are closed forms, so no row is made per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.shared import SPACE, SPACE_CHARS, written

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
BLOCK = 64
#: Words of a shard, about, and shards at most besides one for each source. Then shards are larger.
SHARD_WORDS, SHARDS = 200_000, 20_000
SEED = "mix-1"


def size_of(text: Column) -> Column:
    """Words in a text; null: 0."""
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"[{SPACE}]+"))).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to (source, source_size): ``share`` of all sizes by weight, none above ``cap``
    times its source's size. Weights go by code point of the source, null last.

    Sources fill up in the order of cap to weight; what is left goes to the rest by weight. The level
    at the first that does not fill up is that of all the rest (later rows compute lower ones). One
    row a source, so one task.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    s = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(cap))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    s = s.withColumn("level", left / weight)
    full = F.col("cap") / F.col("w") < F.col("level")
    s = s.withColumn("full", full).withColumn("open", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    return s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce("open", F.lit(0.0)) * F.col("w"))).select("source", "source_size", "target")


def apportion(cells: DataFrame, group: list[str], key: str, weight: str, seats: Column) -> DataFrame:
    """Adds ``quota``: ``seats`` (one number in each group) shared out by Sainte-Laguë.

    With n cells, rounding the shares of seats - n/2 gives no cell too much, and rounding those of
    seats + n/2 no cell too little; only the seats between are ranked, under 3 n of them. Ties go
    to the lesser ``key``.
    """
    by = Window.partitionBy(*group)
    c = cells.withColumn("_w", F.col(weight).cast("double")).withColumn("_seats", seats.cast("long"))
    c = c.withColumn("_all", F.sum("_w").over(by)).withColumn("_n", F.count("*").over(by))
    part = F.when(F.col("_all") > 0, F.col("_w") / F.col("_all")).otherwise(0.0)
    c = c.withColumn("_low", F.greatest(F.lit(0), F.floor(part * (F.col("_seats") - F.col("_n") / 2) + 0.5)).cast("long"))
    c = c.withColumn("_high", F.greatest("_low", F.floor(part * (F.col("_seats") + F.col("_n") / 2) + 0.5).cast("long") + 1))
    c = c.withColumn("_left", F.when(F.col("_all") > 0, F.col("_seats") - F.sum("_low").over(by)).otherwise(0))
    tried = c.select(*group, key, "_w", "_left", F.explode(F.sequence("_low", "_high")).alias("_s")).withColumn("_q", F.col("_w") / (2 * F.col("_s") + 1))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_q"), F.asc_nulls_last(key), "_s"))
    won = tried.withColumn("_r", rank).where((F.col("_r") <= F.col("_left")) & (F.col("_w") > 0)).groupBy(*group, key).agg(F.count("*").alias("_won"))
    names = list(dict.fromkeys([*group, key]))
    won = won.select(*[F.col(x).alias(f"_{x}") for x in names], "_won")
    on = [c[x].eqNullSafe(won[f"_{x}"]) for x in names]
    return c.join(won, on, "left").select(*cells.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def _selected(x: Column) -> Column:
    """Words among the first ``x`` of a shard's stream that the rest of its quota selects."""
    def blocks(k: Column) -> Column:
        return F.when(F.col("n_blocks") > 0, F.floor((k * F.col("rest") + F.col("lead")) / F.col("n_blocks"))).otherwise(0).cast("long")

    k = F.floor(x / BLOCK).cast("long")
    return blocks(k) * BLOCK + (x - k * BLOCK) * (blocks(k + 1) - blocks(k))


def placed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, keep: str | None = None) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, source_size, target, taken, and where it stands:
    start (in its shard's stream), passes, rest, lead, n_blocks.

    Null texts have size 0, null sources are one source, a null or repeated doc_id is a row of its
    own; an empty table gives none. Other columns are ignored, but for ``keep``.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of(docs["text"]).alias("size"), *([keep] if keep else []))
    rows = written(rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))), "mix-sizes")
    sources = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    shard_words = max(SHARD_WORDS, -(-total // SHARDS))
    seats = F.floor(F.sum("target").over(Window.partitionBy()) / BLOCK + 0.5)
    quotas = apportion(sources.withColumn("_one", F.lit(1)).withColumn("_total", seats), ["_one"], "source", "target", F.col("_total"))
    quotas = quotas.select(F.col("source").alias("s"), "source_size", "target", F.col("quota").alias("source_quota"))
    joined = rows.join(quotas, rows["source"].eqNullSafe(quotas["s"])).drop("s")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    joined = joined.withColumn("shard", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), shards))
    cells = joined.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"))
    cells = apportion(cells, ["source"], "shard", "words", F.col("source_quota"))
    cells = cells.withColumn("n_blocks", F.ceil(F.col("words") / BLOCK).cast("long")).withColumn("quota", F.least("quota", F.floor(F.col("n_blocks") * cap).cast("long")))
    cells = cells.withColumn("passes", F.when(F.col("n_blocks") > 0, F.floor(F.col("quota") / F.col("n_blocks"))).otherwise(0).cast("long"))
    cells = cells.withColumn("rest", F.col("quota") - F.col("passes") * F.col("n_blocks"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long")
    cells = cells.withColumn("lead", F.when(F.col("n_blocks") > 0, F.pmod(draw, F.col("n_blocks"))).otherwise(0))
    cells = written(cells.select(F.col("source").alias("s"), F.col("shard").alias("c"), "n_blocks", "passes", "rest", "lead"), "mix-cells")
    before = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    out = out.join(cells, out["source"].eqNullSafe(cells["s"]) & (out["shard"] == cells["c"])).drop("s", "c")
    taken = F.col("passes") * F.col("size") + _selected(F.col("start") + F.col("size")) - _selected(F.col("start"))
    extra = [keep] if keep else []
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "start", "passes", "rest", "lead", "n_blocks", *extra)


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed documents, with all columns: a row for each whole pass over a text, and one for the
    words that the rest of the quota selects from it (joined by spaces; the text as it is if all are).

    Texts without words are in no block and go. Needs doc_id to tell rows apart; rows without it
    count as repeats of one.
    """
    columns = docs.columns
    at = placed(docs, seed=seed).where("taken > 0").dropDuplicates(["doc_id", "size"])
    # under names that the table's other columns don't have
    at = at.select(*[F.col(c).alias(f"_mix_{c}") for c in ("doc_id", "size", "taken", "start", "passes", "rest", "lead", "n_blocks")])
    size, passes, rest, lead, n_blocks = (F.col(f"_mix_{c}") for c in ("size", "passes", "rest", "lead", "n_blocks"))
    both = docs.withColumn("_mix_n", size_of(docs["text"]))
    both = both.join(at, F.col("doc_id").cast("long").eqNullSafe(F.col("_mix_doc_id")) & (F.col("_mix_n") == size))
    part = F.col("_mix_taken") - passes * size
    words = F.split(F.btrim("text", F.lit(SPACE_CHARS)), f"[{SPACE}]+")

    def chosen(i: Column) -> Column:
        k = F.floor((F.col("_mix_start") + i) / BLOCK).cast("long")
        return F.floor(((k + 1) * rest + lead) / n_blocks) > F.floor((k * rest + lead) / n_blocks)

    text = F.when(part <= 0, None).when(part >= size, F.col("text")).otherwise(F.array_join(F.filter(words, lambda w, i: chosen(i)), " "))
    both = both.withColumn("_mix_part", text)
    whole = F.when(passes > 0, F.array_repeat(F.col("text"), passes.cast("int"))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(whole, F.when(F.col("_mix_part").isNotNull(), F.array("_mix_part")).otherwise(F.array().cast("array<string>")))
    return both.withColumn("_mix_text", F.explode(texts)).select(*[F.col("_mix_text").alias("text") if c == "text" else F.col(c) for c in columns])
