"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing, exact reranking.

Rows are dealt into ranges by norm, so that a few long vectors do not crowd the others together.
Vectors of a range are scaled into the unit ball and given one more coordinate that makes them unit
vectors; the largest inner product is then the least Euclidean distance, which p-stable (Gaussian)
projections keep. ``FUNCTIONS`` orthogonal ones hash a vector to intervals of width ``WIDTH``. A query
visits its own bucket and those reached by moving single values to other intervals, in the order of
the squared distances to the crossed edges (the order of estimated success), as far as it must:
until a row as good as the query's k-th best so far lies in a visited bucket with probability
``SUCCESS`` at least. How far that is follows from the query's places within its intervals, by
``DRAWS`` random rows of that inner product. There is one table: to probe it farther takes fewer
products than to meet the same rows in several.

Many queries visit a bucket together, as one product of matrices; what reaches a query's k-th best
is reranked by exact inner products. Where a query would visit over ``MOST`` of a range, or where
under k rows are known, the range is scanned exactly.

The index is searched in waves, each about ``GROWTH`` times the rows of all before it. The k-th best of
a wave bounds the next one's search, so that large tables are probed less far than small ones. In the
first wave a sample of a part's rows (``SAMPLE`` at most) gives the bound. Every row is in the index,
and every part of it (some rows, as many as a task can hold) answers every query: the work still
grows with queries times rows.

Rows with equal vectors are one entry of the index, with the least ids of its members: no result
needs more of them than it returns, and one of them more for the query itself.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.shared import filesystem, written

TABLES, FUNCTIONS, WIDTH, SEED = 1, 10, 2.0, 20
#: Least probability that a row as good as the k-th candidate is among the candidates.
SUCCESS, DRAWS = 0.9, 256
#: Share of a range beyond which it is scanned.
MOST = 0.7
#: Ranges of norms: so many to a doubling. Ranges of fewer rows than ``FEW`` are one bucket.
RANGES, FEW = 4, 64
#: Bytes of vectors in a part of the index, about: what a task holds at once.
PART_BYTES = 128 << 20
#: Rows by which the first wave's bounds are found, at most, and growth from wave to wave.
SAMPLE, GROWTH = 16_384, 8
#: Queries answered together, buckets whose visitors are found together, and products held at once.
QUERIES, BUCKETS, PRODUCTS = 8192, 256, 1 << 21
#: Parts into which the members of a group of equal vectors are ranked first.
SALT = 64


def _moves(most: int) -> np.ndarray:
    """All moves of up to so many values by one interval."""
    out = []
    for count in range(most + 1):
        for places in itertools.combinations(range(FUNCTIONS), count):
            for ways in itertools.product((-1, 1), repeat=count):
                move = np.zeros(FUNCTIONS, np.int64)
                move[list(places)] = ways
                out.append(move)
    return np.array(out)


#: Intervals are numbered from -32 to 31; what lies beyond counts to the last one, which costs a query less.
_RADIX = 64 ** np.arange(FUNCTIONS - 1, -1, -1, dtype=np.int64)


class Hashes:
    """The table's functions; the same for the same dimension and seed."""

    def __init__(self, dim: int, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.a = draw.normal(size=(TABLES, dim + 1, FUNCTIONS))
        for a in self.a:
            for first in range(0, FUNCTIONS, dim + 1):
                a[:, first : first + dim + 1] = np.linalg.qr(a[:, first : first + dim + 1])[0] * math.sqrt(dim + 1)
        self.b = draw.uniform(0, WIDTH, size=(TABLES, 1, FUNCTIONS))
        self.drawn = draw.normal(size=(DRAWS, dim + 1))
        self.drawn /= np.linalg.norm(self.drawn, axis=1, keepdims=True)

    def places(self, x: np.ndarray, scale: float | None = None) -> np.ndarray:
        """Of queries, if no ``scale``."""
        if scale is None:
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            more = np.zeros((len(x), 1))
        else:
            unit = x / scale
            more = np.sqrt(np.maximum(0.0, 1 - (unit * unit).sum(1, keepdims=True)))
        return (np.concatenate((unit, more), axis=1) @ self.a + self.b) / WIDTH

    def codes(self, x: np.ndarray, scale: float) -> np.ndarray:
        """Bucket of each vector, of norm ``scale`` at most, in each table."""
        return (np.clip(np.floor(self.places(x, scale)), -32, 31).astype(np.int64) + 32) @ _RADIX

    def probes(self, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first buckets of each query in each table, likeliest first; their costs; and the places
        of the query within its own intervals."""
        places, moves = self.places(x), _moves(4)
        base = np.floor(places)
        below = (places - base) ** 2
        above = (1 - places + base) ** 2
        cost = below @ (moves == -1).T + above @ (moves == 1).T
        first = np.argsort(cost, axis=2, kind="stable")[..., :count]
        return ((base.astype(np.int64) + 32) @ _RADIX)[..., None] + (moves @ _RADIX)[first], np.take_along_axis(cost, first, 2), places - base

    def limits(self, unit: np.ndarray, places: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """The cost up to which each query (a unit vector) must visit buckets, to meet a row at that cosine
        with probability ``SUCCESS``. Such a row is the query's share of it and a random rest."""
        if not len(unit):
            return np.zeros(0, np.float32)
        b, out = (self.b[0] / WIDTH).astype(np.float32), []
        drawn = (self.drawn @ self.a[0] / WIDTH).astype(np.float32)
        for i in range(0, len(unit), 512):
            own, c = places[i : i + 512].astype(np.float32), cosine[i : i + 512, None]
            along = unit[i : i + 512] @ self.drawn[:, :-1].T
            rest = np.sqrt(np.maximum(0.0, 1 - c * c) / np.maximum(1e-9, 1 - along * along))
            there = (c - rest * along).astype(np.float32)[..., None] * (own - b)[:, None]
            there += rest.astype(np.float32)[..., None] * drawn
            there += b
            np.floor(there, out=there)
            there -= own[:, None]
            far = np.maximum(there, -1 - there)
            np.maximum(far, 0, out=far)
            far *= far
            cost = far.sum(axis=2)
            at = math.ceil(SUCCESS * DRAWS) - 1
            out.append(np.partition(cost, at, axis=1)[:, at])
        return np.concatenate(out) * np.float32(1.0001) + np.float32(1e-4)


class Range:
    """Rows of a part whose norms are alike, in the order of their buckets."""

    def __init__(self, hashes: Hashes, rows: np.ndarray, vectors: np.ndarray, norm: float):
        self.norm = norm
        code = hashes.codes(vectors[rows], norm)[0] if len(rows) >= FEW else np.zeros(len(rows), np.int64)
        self.hashed = len(rows) >= FEW
        self.order = np.argsort(code, kind="stable")
        self.rows = rows[self.order]
        self.names, start = np.unique(code[self.order], return_index=True)
        self.start = np.append(start, len(rows))
        self.unit = (vectors[self.rows] / norm).astype(np.float32)
        #: Which (function, interval) pairs there are, and which of them each bucket has.
        pairs = self.names[:, None] // _RADIX % 64 + 64 * np.arange(FUNCTIONS)
        self.pairs, at = np.unique(pairs, return_inverse=True)
        self.has = np.zeros((len(self.names), len(self.pairs)), np.float32)
        np.put_along_axis(self.has, at.reshape(pairs.shape), 1, axis=1)

    def candidates(self, probes: np.ndarray) -> np.ndarray:
        """The rows (by place in the range) of the buckets that one query visits."""
        return np.sort(np.concatenate([self.order[a:b] for n, a, b in zip(self.names, self.start, self.start[1:], strict=False) if n in probes] or [self.order[:0]]))

    def costs(self, places: np.ndarray) -> np.ndarray:
        """Of the intervals in use: squared distance of each query's place to each."""
        there = (self.pairs % 64 - 32).astype(np.float32) - places.astype(np.float32)[:, self.pairs // 64]
        far = np.maximum(0, np.maximum(there, -1 - there))
        return np.ascontiguousarray((far * far).T)


class Part:
    """Some rows of the index, in memory."""

    def __init__(self, hashes: Hashes, ids: np.ndarray, vectors: np.ndarray):
        self.hashes, self.ids, self.vectors = hashes, ids, vectors
        norms = np.concatenate([np.linalg.norm(vectors[i : i + 65536].astype(np.float64), axis=1) for i in range(0, len(vectors), 65536)])
        kind = np.floor(np.log2(norms / norms.max()) * RANGES + 0.5)
        self.ranges = [Range(hashes, rows, vectors, float(norms[rows].max())) for rows in (np.flatnonzero(kind == x) for x in np.unique(kind)[::-1])]
        self.scans = self.visited = 0

    def nearest(self, queries: np.ndarray, k: int):
        """Ids and scores of the best ``k`` candidates of each query."""
        which, ids, scores = self.search(queries, k)
        cuts = np.searchsorted(which, np.arange(len(queries) + 1))
        for a, b in itertools.pairwise(cuts):
            yield ids[a:b], scores[a:b]

    def _bounds(self, queries: np.ndarray, k: int) -> np.ndarray:
        """The k-th best of a sample of the rows: no query's k-th best is less."""
        n = len(self.ids)
        if n < k:
            return np.full(len(queries), -math.inf)
        size = min(n, SAMPLE, max(n // 8, 2 * k))
        some = self.vectors[np.arange(size) * n // size].astype(np.float64).T
        out = [np.partition(queries[i : i + 256] @ some, size - k, axis=1)[:, size - k] for i in range(0, len(queries), 256)]
        least = np.concatenate(out)
        return least - np.abs(least) * 1e-12

    def search(self, queries: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, ids and scores: the best ``k`` candidates of each query, by query, best
        first. ``bound``: scores that are of no use if less; NaN where none is known. Only rows of
        visited buckets, and of ranges to be scanned, are multiplied with a query."""
        queries = queries.astype(np.float64)
        bound = np.full(len(queries), np.nan) if bound is None else bound.copy()
        new = np.flatnonzero(np.isnan(bound))
        if len(new):
            bound[new] = self._bounds(queries[new], k)
        length = np.linalg.norm(queries, axis=1)
        unit, places = queries / length[:, None], self.hashes.places(queries)[0]
        near = unit.astype(np.float32)
        held: list[tuple[np.ndarray, np.ndarray]] = []  # queries and rows
        best = (np.zeros(0, np.int64), np.zeros(0, self.ids.dtype), np.zeros(0))
        size = 0
        for r in self.ranges:  # the longest first; no product is over that of the norms
            if size > PRODUCTS:
                best, held, size = self._merged(best, held, queries, k, bound), [], 0
            asks = np.flatnonzero(r.norm * length * (1 + 1e-9) >= bound)
            if not len(asks):
                continue
            cosine = np.clip(bound[asks] / (r.norm * length[asks]), -1, 1)
            known = bound[asks] > -math.inf
            limit = np.full(len(asks), math.inf, np.float32)
            costs = r.costs(places[asks])
            if r.hashed:
                limit[known] = self.hashes.limits(unit[asks[known]], places[asks[known]], cosine[known])
                some = np.arange(0, len(r.names), -(-len(r.names) // 256))
                weight = np.diff(r.start)[some].astype(np.float32)
                limit[weight @ (r.has[some] @ costs <= limit) > MOST * weight.sum()] = math.inf
            self.scans += int(np.isinf(limit).sum()) if r.hashed else 0
            enough = np.where(known, cosine - 1e-5, -math.inf).astype(np.float32)
            for first in range(0, len(r.names), BUCKETS):
                visits = r.has[first : first + BUCKETS] @ costs <= limit
                for bucket, visit in enumerate(visits, first):
                    at = np.flatnonzero(visit)
                    if not len(at):
                        continue
                    self.visited += len(at) * int(r.start[bucket + 1] - r.start[bucket])
                    for a in range(r.start[bucket], r.start[bucket + 1], 1024):
                        rows = r.unit[a : min(a + 1024, r.start[bucket + 1])].T
                        step = PRODUCTS // rows.shape[1]
                        for some in (at[i : i + step] for i in range(0, len(at), step)):
                            hit = np.flatnonzero(near[asks[some]] @ rows >= enough[some, None])
                            if len(hit):
                                held.append((asks[some[hit // rows.shape[1]]], r.rows[a + hit % rows.shape[1]]))
                                size += len(hit)
                            if size > PRODUCTS:
                                best, held, size = self._merged(best, held, queries, k, bound), [], 0
                                enough = np.maximum(enough, (bound[asks] / (r.norm * length[asks]) - 1e-5).astype(np.float32))
        return self._merged(best, held, queries, k, bound)

    def _merged(self, best: tuple, held: list, queries: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best ``k`` of each query among those found before and the rows met since, by their exact
        scores; raises ``bound`` to the k-th."""
        which, ids, scores = ([x] for x in best)
        for asked, rows in held:
            for i in range(0, len(rows), 65536):
                q, v = asked[i : i + 65536], rows[i : i + 65536]
                which.append(q), ids.append(self.ids[v])
                scores.append((self.vectors[v].astype(np.float64) * queries[q]).sum(axis=1))
        which, ids, scores = np.concatenate(which), np.concatenate(ids), np.concatenate(scores)
        order = np.lexsort((ids, -scores, which))
        rank = np.arange(len(order)) - np.searchsorted(which[order], which[order])
        kept, last = order[rank < k], order[rank == k - 1]
        bound[which[last]] = np.maximum(bound[which[last]], scores[last] - np.abs(scores[last]) * 1e-12)
        return which[kept], ids[kept], scores[kept]


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) without repeated rows: vectors of finite numbers, not all zero, as long as the
    one of the least vec_id, single floats where the column has these. Rows without vec_id take no part."""
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "float" if single else "double"
    v = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0))
    dim = v.agg(F.min_by(F.size("v"), "vec_id")).first()[0] or 0
    # 0.0 + x: so that -0.0 and 0.0 are one number
    return v.where(F.size("v") == dim).select("vec_id", F.transform("v", lambda x: (x + F.lit(0.0)).cast(kind)).alias("v"))


def _blocks(paths: list[str], dim: int, size: int):
    """gid, vectors and bounds of the queries in files, about ``size`` at a time."""
    held, n = [], 0

    def joined():
        table = pa.Table.from_batches(held).combine_chunks()
        gid, bound = (table[c].to_numpy() for c in ("gid", "bound"))
        return gid, table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim), bound.astype(np.float64)

    for path in paths:
        store, at = filesystem(path)
        with store.open_input_file(at) as file:
            for batch in pq.ParquetFile(file).iter_batches(size, columns=["gid", "v", "bound"]):
                held.append(batch)
                n += len(batch)
                if n >= size:
                    yield joined()
                    held, n = [], 0
    if n:
        yield joined()


def _waves(parts: int) -> list[int]:
    """Parts done after each wave."""
    out = [parts]
    while out[0] >= GROWTH:
        out.insert(0, out[0] // GROWTH)
    return out


def _answers(files: list[str], dim: int, k: int, slices: int):
    """What a task does: for each of its parts, the ``k`` + 1 best of the queries in files; those of one
    of so many ``slices``."""

    def answer(part: int, held: list[tuple[np.ndarray, np.ndarray]]):
        built = Part(Hashes(dim), *(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        size = QUERIES if slices == 1 else QUERIES // 16
        for i, (gid, v, bound) in enumerate(_blocks(files, dim, size)):
            if i % slices == part % slices:
                which, ids, scores = built.search(v, k + 1, bound)
                for a in range(0, len(which), 65536):
                    some = slice(a, a + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(gid[which[some]]), pa.array(ids[some]), pa.array(scores[some])], names=["qid", "gid", "score"])

    def run(batches):
        at, held = None, []
        for batch in batches:
            p, gid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "gid"))
            v = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            for rows in np.split(np.arange(len(p)), np.flatnonzero(p[1:] != p[:-1]) + 1):
                if len(rows) and p[rows[0]] != at:
                    if held:
                        yield from answer(at, held)
                    at, held = p[rows[0]], []
                if len(rows):
                    held.append((gid[rows], v[rows]))
        if held:
            yield from answer(at, held)

    return run


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, part_bytes: int = PART_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by ``every``
    its ``k`` nearest found among all other rows, ties to the smaller vec_id.

    Vectors that are null, zero, of another length, or hold null or non-finite numbers take no part.
    A row that repeats another counts once; a query is never its own neighbour. An empty table has
    no rows. Other columns are ignored.
    """
    rows = written(usable(embeddings).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.reverse("v"), F.lit(1))}).select("vec_id", "k1", "k2", "v"), "nn-rows")
    ids = rows.select("vec_id", "k1", "k2").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALT)))
    for by in (("k1", "k2", "salt"), ("k1", "k2")):
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("r") <= k + 1)
    members = ids.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    is_query = F.col("vec_id") % every == 0
    groups = rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("gid"), F.max(is_query).alias("asks"), F.first("v").alias("v"))
    groups = written(groups.join(members, ["k1", "k2"]), "nn-groups")
    total = groups.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = total["n"], total["dim"] or 1
    parts = max(1, -(-n * dim * 8 // part_bytes))

    cores = embeddings.sparkSession.sparkContext.defaultParallelism
    asked, best, done = groups.where("asks").select("gid", "v"), None, 0
    for until in _waves(parts):
        bounds = asked.withColumn("bound", F.lit(None).cast("double"))
        if best is not None:
            known = best.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(F.col("n") > k)
            bounds = asked.join(known.select(F.col("qid").alias("gid"), "bound"), "gid", "left")
        files = sorted(written(bounds, "nn-queries").inputFiles())
        # few parts: several tasks have a part each and share its queries
        slices = max(1, cores // (until - done))
        dealt = groups.select(F.pmod(F.xxhash64("gid"), F.lit(parts)).cast("int").alias("part"), "gid", "v").where((F.col("part") >= done) & (F.col("part") < until))
        first = (F.col("part") - done) * slices
        dealt = dealt.select(F.explode(F.sequence(first, first + (slices - 1))).alias("part"), "gid", "v")
        found = dealt.repartition((until - done) * slices, "part").sortWithinPartitions("part", "gid").mapInArrow(_answers(files, dim, k, slices), "qid long, gid long, score double")
        found = found if best is None else found.union(best)
        by = Window.partitionBy("qid").orderBy(F.desc("score"), "gid")
        best = written(found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).drop("r"), "nn-best")
        done = until
    found = best
    found = found.join(groups.select("gid", "members"), "gid").select("qid", "score", F.explode("members").alias("vec_id"))
    # ascending by minus score, then vec_id; at most (k + 1) squared entries
    listed = found.groupBy("qid").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id", "score"))), 1, k + 1).alias("best"))
    asking = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct()
    asking = asking.join(groups.select("k1", "k2", F.col("gid").alias("qid")), ["k1", "k2"]).join(listed, "qid")
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asking.select("query_id", F.posexplode(own).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
