"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased characters, hashed to a fixed number
of places. On labelled texts each feature gets the log ratio of its smoothed shares in toxic and
other texts; features are scaled by it, and a logistic regression is fitted to the scaled features.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.shared import small_batches, written
from barwright.llm.tokens import batches, forget, give_back

ORDERS = (3, 4, 5)
PLACES = 1 << 18
#: Labelled rows to learn from, at most: those with the least hash of their doc_id.
SAMPLE = 4000
#: And so many bytes of their texts, in the same order; the driver holds some seven times that.
SAMPLE_BYTES = 24 << 20
#: A feature counts from so many sample texts on, and with so large a ratio.
LEAST_TEXTS, LEAST_RATIO = 3, 0.4
STEPS, RIDGE = 150, 1e-3
#: Features of sample texts that a step of the fit takes at a time.
BLOCK = 1 << 19
#: Bytes of text whose features are held at a time; they take some 25 times that.
AT_ONCE = 1 << 18


def features(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct feature numbers of each text. A text is framed by spaces; runs of white space
    count as one space."""
    last = np.full(PLACES, -1, np.int64)
    out = []
    for text in texts:
        framed = f" {' '.join((text or '').lower().split())} "
        codes = np.frombuffer(framed.encode("utf-32-le", "surrogatepass"), "<u4")
        found = []
        rolled = codes.astype(np.uint32)
        for n in range(2, ORDERS[-1] + 1):
            rolled = rolled[:-1] * np.uint32(0x01000193) + codes[n - 1 :] if len(rolled) > 1 else rolled[:0]
            if n in ORDERS:
                mixed = (rolled ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                found.append((mixed >> np.uint32(14)).astype(np.int64))
        places = np.concatenate(found)
        order = np.arange(len(places))
        last[places] = order
        out.append(places[last[places] == order])
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of each place, ratio and coefficient in one
    bias: float

    def score(self, places: np.ndarray) -> float:
        z = float(self.weights[places].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """``rows``: feature numbers of each text. With one class or no rows, the score is constant."""
    y = np.asarray(labels, np.float64)
    prior = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(PLACES, np.float32), float(np.log(prior / (1 - prior))))
    p, q = np.zeros(PLACES), np.zeros(PLACES)
    for r, toxic in zip(rows, y, strict=True):  # a text's features are distinct
        (p if toxic else q)[r] += 1
    ratio = np.log((p + 1) / (p.sum() + PLACES)) - np.log((q + 1) / (q.sum() + PLACES))
    used = (p + q >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO)
    names = np.flatnonzero(used)
    place = np.zeros(PLACES, np.int32)
    place[names] = np.arange(len(names))
    sizes = np.array([np.count_nonzero(used[r]) for r in rows])
    ends = np.concatenate(([0], np.cumsum(sizes)))
    column = np.empty(ends[-1], np.int32)
    for r, a, b in zip(rows, ends, ends[1:], strict=False):
        column[a:b] = place[r[used[r]]]
    value = ratio[names].astype(np.float32)
    # sums over texts and over features, some texts at a time: temporary arrays stay small
    cuts = np.unique(np.concatenate(([0], np.searchsorted(ends, np.arange(BLOCK, ends[-1], BLOCK)), [len(y)])))
    blocks = list(itertools.pairwise(cuts.tolist()))

    def by_text(x):
        return np.concatenate([np.bincount(np.repeat(np.arange(b - a), sizes[a:b]), x[column[ends[a] : ends[b]]], b - a) for a, b in blocks])

    def by_feature(x):
        return sum(np.bincount(column[ends[a] : ends[b]], np.repeat(x[a:b], sizes[a:b]), len(names)) for a, b in blocks)

    # gradient steps with momentum, each feature's step shortened by its weight in the sample
    coef, bias = np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    size = value.astype(np.float64) ** 2 * by_feature(np.ones(len(y))) / len(y)
    speed_c, speed_b = np.zeros(len(names)), 0.0
    reach = by_text(np.abs(value)).max(initial=1.0)
    rate = 4.0 / (np.sqrt(size.mean() + 1e-12) * reach)
    for _ in range(STEPS):
        z = by_text(value * coef) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        speed_c = 0.9 * speed_c - rate * (value * by_feature(error) / (np.sqrt(size) + 1e-3) + RIDGE * coef)
        speed_b = 0.9 * speed_b - 0.5 * error.sum()
        coef += speed_c
        bias += speed_b
    weights = np.zeros(PLACES, np.float32)
    weights[names] = ratio[names] * coef
    return Model(weights, bias)


def held_out(doc_id):
    """Rows that nothing is learned from; a null doc_id is one of them."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled rows (and ``SAMPLE_BYTES`` of text) that are not held out.

    Labels other than 0 and 1 are passed over; of several for one doc_id the larger counts. Of several
    texts for one doc_id that with the least hash counts, once. Null doc_ids are held out, null texts
    are empty, texts of any length are read whole, and without labelled rows (or with one class) the
    score is a constant. Other columns are ignored. The sample (doc_ids and labels only) is bounded
    and so may be broadcast; features are made where the texts are, and only they come to the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))

    def run(rows):
        forget()
        for batch in rows:
            for i in range(0, len(batch), 256):
                some = batch.slice(i, 256)
                # differences of sorted numbers pack well: the driver's JVM holds them several times
                found = [zlib.compress(np.diff(np.sort(f), prepend=0).astype("<u4").tobytes(), 1) for f in features(some.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(found, pa.binary())], names=["id", "y", "f"])

    # one text a doc_id; which ones fit into the bytes is decided before any text moves
    sizes = texts.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), F.octet_length(F.coalesce("t", F.lit(""))).alias("size"))).alias("of"))
    before = F.sum("of.size").over(Window.orderBy(F.xxhash64("id"), "id"))
    chosen = sizes.withColumn("upto", before).where(F.col("upto") <= SAMPLE_BYTES).select("id", "y", F.col("of.h").alias("h"))
    chosen = written(chosen, "toxic-sample")
    picked = texts.withColumn("h", F.xxhash64("t")).join(F.broadcast(chosen), ["id", "h"]).select("id", "t", "y").dropDuplicates(["id"])
    with small_batches(docs.sparkSession):
        rows = picked.mapInArrow(run, "id long, y int, f binary").collect()
    rows.sort(key=lambda r: r["id"])
    labels_ = np.array([r["y"] for r in rows], np.float64)
    found = [np.cumsum(np.frombuffer(zlib.decompress(r["f"]), "<u4"), dtype=np.int32) for r in rows]
    del rows
    model = fit(found, labels_)
    del found
    give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row; only the text matters. A null text is empty and has a
    score too, texts of any length are read whole, repeated and null doc_ids are rows of their own, and
    an empty table gives no rows. Other columns are ignored."""

    def run(rows):
        forget()
        for batch in rows:
            for i in range(0, len(batch), 512):
                some = batch.slice(i, 512)
                scores = [model.score(f) for f in features(some.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns (whatever their names), whose text scores below ``threshold``.
    A null text is empty; repeated rows and null doc_ids are judged each; an empty table stays empty."""
    at = docs.columns.index("text")

    def run(rows):
        forget()
        for batch in rows:
            texts = batch.column(at).cast(pa.string())
            for a, b in batches(texts, AT_ONCE):
                kept = [model.score(f) < threshold for f in features(texts.slice(a, b - a).to_pylist())]
                yield batch.slice(a, b - a).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
