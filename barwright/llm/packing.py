"""Packing documents into windows of a fixed number of tokens, best fit decreasing.

A document longer than a window is first cut into full windows. The rest of each document goes, in
decreasing order of length, into the open window that it fills most tightly. That window is found
in a segment tree whose leaves are remaining capacities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.shared import in_larger_parts
from barwright.llm.tokens import batches, encoder, give_back

#: Tokens that are packed together, about: what a task holds at once. A group leaves one or two
#: windows open, so this many keep padding well under a thousandth.
GROUP_TOKENS = 6_000_000
#: Bytes of text that a task packs at least, about: one or two groups.
PART_BYTES = 32 << 20


class CapacityTree:
    """Windows by remaining capacity; ``tightest(n)`` is the least capacity of at least ``n``."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = self.leaves + capacity
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, capacity: int) -> int:
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            node = self.leaves + capacity
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return window

    def tightest(self, n: int) -> int | None:
        node = self.leaves + n
        if self.any[node]:
            return n
        while node > 1:  # the first subtree to the right that has a window
            if not node & 1 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """The window and the offset of each piece (of 1 to ``window`` tokens), and the windows used.

    Longer pieces first, equal ones in their order."""
    tree, used = CapacityTree(window), 0
    at, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        capacity = tree.tightest(n)
        if capacity is None:
            at[i], capacity = used, window
            used += 1
        else:
            at[i] = tree.take(capacity)
        offset[i] = window - capacity
        if capacity > n:
            tree.put(capacity - n, at[i])
    return at, offset, used


_PIECES = "doc_id long, piece int, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """A row for each piece of each document, with its ids (little-endian unsigned 32-bit).

    Tasks pack groups of some ``GROUP_TOKENS`` tokens on their own, so nothing is shuffled and a
    repeated task gives the same rows; ``sequence_id`` is the task's number and the window's number
    in it. A null text is empty and has the end id alone; a repeated or null doc_id is a document
    of its own; an empty table has no pieces. Other columns are ignored.
    """

    def run(rows):
        from pyspark import TaskContext

        give_back()
        tok, base = encoder(tokenizer), TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def close():
            nonlocal base
            whole, rest, lengths = [], [], []
            for d, (_, ids) in enumerate(held):
                full = len(ids) // window * window
                whole += [(d, s) for s in range(0, full, window)]
                if full < len(ids):
                    rest.append((d, full))
                    lengths.append(len(ids) - full)
            at, offset, used = best_fit(lengths, window)
            made = [(d, s, window, used + k, 0) for k, (d, s) in enumerate(whole)]
            made += [(d, s, n, w, o) for (d, s), n, w, o in zip(rest, lengths, at, offset, strict=True)]
            made.sort()
            for i in range(0, len(made), 128):
                some = made[i : i + 128]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([held[d][0] for d, *_ in some], pa.int64()),
                        pa.array([s // window for _, s, *_ in some], pa.int32()),
                        pa.array([s for _, s, *_ in some], pa.int64()),
                        pa.array([n for _, _, n, *_ in some], pa.int64()),
                        pa.array([len(held[d][1]) for d, *_ in some], pa.int64()),
                        pa.array([base + w for *_, w, _ in some], pa.int64()),
                        pa.array([o for *_, o in some], pa.int64()),
                        pa.array([held[d][1][s : s + n].tobytes() for d, s, n, *_ in some], pa.binary()),
                    ],
                    names=[c.split()[0] for c in _PIECES.split(", ")],
                )
            base += used + len(whole)
            held.clear()

        for batch in rows:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in batches(texts):
                ids, counts = tok.encode(texts.slice(a, b - a))
                ends = np.cumsum(counts)
                ids = np.insert(ids.astype("<u4"), ends, end_id)
                held += zip(keys[a:b], np.split(ids, (ends + np.arange(1, len(ends) + 1))[:-1]), strict=True)
                size += len(ids)
                if size >= GROUP_TOKENS:
                    yield from close()
                    size = 0
        if held:
            yield from close()

    rows = in_larger_parts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "text", PART_BYTES)
    return rows.mapInArrow(run, _PIECES)
