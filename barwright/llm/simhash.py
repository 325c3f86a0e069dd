"""SimHash near-duplicates: fingerprints, links by a self-join of binary tries, components.

Fingerprints within ``BUDGET`` bits of each other agree on one of ``BUDGET + 1`` blocks of bits. So
distinct fingerprints are dealt out by (block, bits of the block); in each group the trie of the
remaining bits is joined with itself: pairs of nodes are walked down together, differing bits add
up, and a pair over the budget is dropped with all below it. Large groups are dealt out once more
by the blocks of the remaining bits, and what is still large is joined piece by piece, a pair of
pieces a task. Each task passes on only which fingerprints belong together (a star per component),
so a group of many near copies gives as many rows as it has members, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.shared import joined_with_one, one_struct, written
from barwright.llm.tokens import forget

WORDS = 4
SEED = 42
BUDGET = 4
BITS = 64
#: Fingerprints of a group that one task joins; larger groups are dealt out further.
GROUP = 4000
#: Rows of groups that are joined at a time, about.
AT_ONCE = 100_000
#: Pairs of nodes walked at a time.
FRONTIER = 1 << 18

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float64)
_COLUMNS = (np.arange(8) * 256)[None, :]


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint. ASCII letters count in lower case; words are what stands
    between ASCII white space. A bit is set where over half of the shingles' XXH64 values have it.
    A text of fewer words is one shingle; without any word the fingerprint is 0."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[:-words].tolist()]
    hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _COLUMNS).reshape(-1), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits(counts.reshape(-1) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text, by which rows of one doc_id are told apart) and fp (the fingerprint
    as a signed long) of every row."""

    def run(rows):
        forget()
        for batch in rows:
            for i in range(0, len(batch), 1024):
                some = batch.slice(i, 1024)
                fps = np.array([fingerprint(t) for t in some.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "hash", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("hash")).mapInArrow(run, "doc_id long, hash long, fp long")


def _forest(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Component labels (least member number) after linking u with v."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def trie_components(groups: np.ndarray, codes: np.ndarray, sides: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each row the least row number it is linked to, directly or through others.

    Rows of a group whose ``codes`` differ in at most ``budget`` bits are linked. ``sides``: 0 for
    rows to be joined with all rows of their group; rows of side 1 are joined with rows of side 2
    only. A node is a range of the rows, sorted by group, side and code; its next bit splits it.
    """
    n = len(codes)
    labels = np.arange(n)
    if n < 2:
        return labels
    order = np.lexsort((codes, sides, groups))
    code, group, side = codes[order], groups[order], sides[order]
    cut = np.flatnonzero((group[1:] != group[:-1]) | (side[1:] != side[:-1])) + 1
    low = np.concatenate(([0], cut))
    high = np.concatenate((cut, [n]))
    own = side[low] == 0
    first = np.flatnonzero(side[low[:-1]] == 1) if len(low) > 1 else np.zeros(0, np.int64)
    first = first[(group[low[first]] == group[low[first + 1]]) & (side[low[first + 1]] == 2)]
    start = [np.concatenate((x[own], y)) for x, y in ((low, low[first]), (high, high[first]), (low, low[first + 1]), (high, high[first + 1]))]
    stack = [(BITS - 1, *start, np.zeros(len(start[0]), np.int64))]
    ones = {}

    def ones_before(bit: int) -> np.ndarray:
        if bit not in ones:
            if len(ones) > 8:
                ones.clear()
            ones[bit] = np.concatenate(([0], np.cumsum((code >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        return ones[bit]

    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(bit, al[:half], ah[:half], bl[:half], bh[:half], err[:half]), (bit, al[half:], ah[half:], bl[half:], bh[half:], err[half:])]
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if bit < 0:  # all bits are walked: every row of one node is linked with every row of the other
            wide = np.flatnonzero(~single)
            for i in wide:
                rows = np.concatenate((np.arange(al[i], ah[i]), np.arange(bl[i], bh[i])))
                labels = _forest(labels, rows, np.full(len(rows), rows[0]))
            labels = _forest(labels, al[single], bl[single])
            continue
        if single.any():  # two leaves: what is left of their paths at once
            u, v = al[single], bl[single]
            u, v = u[u != v], v[u != v]
            near = np.bitwise_count(code[u] ^ code[v]) <= budget
            labels = _forest(labels, u[near], v[near])
            rest = ~single
            al, ah, bl, bh, err = al[rest], ah[rest], bl[rest], bh[rest], err[rest]
        if not len(al):
            continue
        c = ones_before(bit)
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        self_pair = al == bl
        cross = ~self_pair
        made = [
            (al, am, bl, bm, err, None),  # 0 and 0
            (am, ah, bm, bh, err, None),  # 1 and 1
            (al, am, bm, bh, err + 1, None),  # 0 and 1
            (am, ah, bl, bm, err + 1, cross),  # 1 and 0; of a node with itself the same as before
        ]
        nxt = []
        for xl, xh, yl, yh, e, only in made:
            keep = (xl < xh) & (yl < yh) & (e <= budget)
            if only is not None:
                keep &= only
            nxt.append((xl[keep], xh[keep], yl[keep], yh[keep], e[keep]))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*nxt, strict=True))))
    back = np.empty(n, np.int64)
    back[order] = order[labels]
    return back


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of ``parts`` runs that make up ``bits`` bits."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _value(fp, shift: int, width: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def links(fps: DataFrame, budget: int = BUDGET, group: int = GROUP, at_once: int = AT_ONCE) -> DataFrame:
    """``fps``: distinct fp, id. Stars (u, v) of ids whose fingerprints are linked; u < v."""
    blocks = _blocks(BITS, budget + 1)
    keyed = fps.select("fp", "id", F.explode(F.array(*[F.struct(F.lit(i).alias("b1"), _value(F.col("fp"), s, w).alias("k1")) for i, (s, w) in enumerate(blocks)])).alias("x")).select("fp", "id", "x.*")
    keyed = written(keyed, "simhash-keys")
    sizes = keyed.groupBy("b1", "k1").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > group).select("b1", "k1", F.lit(True).alias("deep"))
    marked = keyed.join(large, ["b1", "k1"], "left")
    small = marked.where("deep is null").select("fp", "id", F.struct("b1", "k1", F.lit(-1).alias("b2"), F.lit(0).cast("long").alias("k2"), F.lit(0).alias("p"), F.lit(0).alias("q")).alias("key"), F.lit(0).alias("side"))
    if not large.limit(1).count():
        dealt = small
    else:
        # once more, by the blocks of the bits outside block b1
        inner = []
        for i, (s, w) in enumerate(blocks):
            rest = F.shiftleft(_value(F.col("fp"), s + w, BITS - s - w), s).bitwiseOR(_value(F.col("fp"), 0, s)) if s + w < BITS else _value(F.col("fp"), 0, s)
            inner.append(F.array(*[F.struct(F.lit(j).alias("b2"), _value(rest, a, b).alias("k2")) for j, (a, b) in enumerate(_blocks(BITS - w, budget + 1))]))
        pick = F.element_at(F.array(*inner), F.col("b1") + 1)
        deep = marked.where("deep").select("fp", "id", "b1", "k1", F.explode(pick).alias("x")).select("fp", "id", "b1", "k1", "x.*")
        parts = deep.groupBy("b1", "k1", "b2", "k2").agg(F.ceil(F.count("*") / F.lit(group)).cast("int").alias("m"))
        deep = deep.join(parts, ["b1", "k1", "b2", "k2"])
        part = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
        # piece c is joined with itself and, as one side or the other, with each other piece
        others = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least(F.col("c"), o).alias("p"), F.greatest(F.col("c"), o).alias("q"), F.when(F.col("c") == o, 0).when(F.col("c") < o, 1).otherwise(2).alias("side")))
        deep = deep.withColumn("c", part).select("fp", "id", "b1", "k1", "b2", "k2", F.explode(others).alias("x"))
        deep = deep.select("fp", "id", F.struct("b1", "k1", "b2", "k2", "x.p", "x.q").alias("key"), F.col("x.side").alias("side"))
        dealt = small.unionByName(deep)

    def join(parts):
        ids, fp, gr, side = (np.concatenate(x) for x in zip(*parts, strict=True))
        by_id = np.argsort(ids, kind="stable")  # so that a star's centre is its least id
        ids, fp, gr, side = ids[by_id], fp[by_id].view(np.uint64), gr[by_id], side[by_id]
        root = trie_components(gr, fp, side)
        spoke = root != np.arange(len(root))
        u, v = ids[root[spoke]], ids[spoke]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    def run(rows):
        """Whole groups, some at a time: a group has ``group`` rows, or two pieces of about that."""
        held, size = [], 0
        for batch in rows:
            part = tuple(batch.column(c).to_numpy() for c in ("id", "fp", "grp", "side"))
            last = np.flatnonzero(part[2] != part[2][-1])
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on
            if size and (cut or held[-1][2][-1] != part[2][0]) and size + cut >= at_once:
                # up to the end of a group that lies in this batch, or at the batch's start
                yield join([*held, tuple(x[:cut] for x in part)] if cut else held)
                held, size = [], 0
                part = tuple(x[cut:] for x in part)
            held.append(part)
            size += len(part[0])
        if size:
            yield join(held)

    # a group's number: two keys with one hash would only be joined for nothing, never linked wrongly
    spread = dealt.select("fp", "id", F.xxhash64("key").alias("grp"), "side").repartition("grp").sortWithinPartitions("grp")
    return spread.mapInArrow(run, "u long, v long").where("u < v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id of an edge (u, v).

    Least labels pass along edges, a smaller label also goes to the root of the old one and so to
    all that have it, and each label is followed to its own label, until none changes. Regions
    merge whole, so the rounds grow with the logarithm of a chain's length. Each round is written
    to the shared folder.
    """
    both = written(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "component-edges")
    total = both.count()
    labels = written(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("label"), F.count("*").alias("n")), "component-labels")
    while True:
        # a vertex of very many edges, and a label of very many vertices, are dealt out
        seen = joined_with_one(both, labels.select(F.col("id").alias("v"), "label", "n"), ["v"], total)
        near = seen.groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        stepped = written(labels.join(near, "id").select("id", "n", F.col("label").alias("was"), F.least("label", "near").alias("label")), "component-steps")
        hooked = stepped.groupBy("was").agg(F.min(F.when(F.col("label") < F.col("was"), F.col("label"))).alias("hook"), F.count("*").alias("n"))
        further = labels.select("id", "label").join(hooked, F.col("id") == F.col("was")).select("was", F.least("label", "hook").alias("on"), "n")
        after = joined_with_one(stepped.withColumnRenamed("n", "edges"), further, ["was"], total)
        after = written(after.select("id", "was", F.least("label", "on").alias("label"), F.col("edges").alias("n")), "component-labels")
        if not after.where("label <> was").limit(1).count():
            return after.select("id", F.col("label").alias("component"))
        labels = after.select("id", "label", "n")


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, hash, fp and component_id of every row."""
    marked = written(fingerprints(docs), "simhash")
    numbered = marked.where("doc_id is not null")
    fps = written(numbered.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "simhash-distinct")
    found = components(links(fps.select("fp", "id")))
    named = fps.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"), "n")
    # a fingerprint of very many rows is not shuffled to one task
    out = joined_with_one(numbered, named, ["fp"], numbered.count()).select("doc_id", "hash", "fp", "component_id")
    return out.unionByName(marked.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable by links) of every row.

    A null or empty text has fingerprint 0 and is linked like any other; a text of any length is read
    whole. A repeated doc_id has a row each time, with the fingerprint of its own text. A row without
    doc_id links nothing and has no component. An empty table gives no rows. Other columns are ignored.
    """
    return _named(docs).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row, with all its columns (whatever their names), of each component: that of the least
    doc_id, and of several texts for it that with the least hash. Of rows that agree in both that with
    the least hash of all columns stays, once. Rows without a doc_id all stay. A null or empty text is
    a text like any other, and an empty table stays empty."""
    named = _named(docs).where("doc_id is not null")
    best = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "hash")).alias("best")).select(F.col("best").alias("of"))
    # how often the rows that stay are there; only those there more than once are looked at again
    counts = named.groupBy(F.struct("doc_id", "hash").alias("of")).agg(F.count("*").alias("n")).join(best, "of")
    counts = written(counts, "simhash-kept")
    place = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("hash")).alias("place")
    rows = docs.where("doc_id is not null").select(place, one_struct(docs))
    once = rows.join(counts.where("n = 1"), F.col("place") == F.col("of"), "left_semi").select("row.*")
    more = rows.join(counts.where("n > 1"), F.col("place") == F.col("of"), "left_semi")
    more = more.groupBy("place").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return once.unionByName(more).unionByName(docs.where("doc_id is null"))
