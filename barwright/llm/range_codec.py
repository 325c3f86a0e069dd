"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks. Each block starts from the same model, carries a CRC-32, and is coded
without regard to any other block. What the blocks share is a prior: the ids that there are, with
rough frequencies. The ``COMMON`` most frequent ids have an entry each in the model, the others one
entry together; which of them it is, by their frequencies in the prior, is in words of its own after
the block's others.

Within a block three predictions are mixed for each next entry:

* order 0: frequencies of the block's entries so far, added to those of the prior,
* order 1: the entry that last followed the previous one, with a confidence of 0 to 3,
* order 2: the same for the previous two (hashed).

An entry's probability is the sum of what the three give it, each by its share. Entries lie in order,
and each as wide as its sum, on the line of a 64-bit range coder with carries. The shares, one pair for each pair of confidences, and the
frequencies are learnt from the block as it is coded: both are brought up to date after 24 entries,
and then whenever half as many more have been coded, to the block's end.

Since blocks are independent, many are coded in step: element ``i`` of every array belongs to
block ``i``, and each numpy call advances all blocks by a part of one id. All numbers are integers (one
quotient is rounded down from a float that holds it exactly enough).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids in a block at most, and blocks coded in step.
BLOCK = 4096
LANES = 3072
#: Ids with an entry of their own, at most. An entry and its confidence fit 16 bits.
COMMON = 511
FREQ_BITS, SHARE_BITS = 12, 7
TOTAL_BITS = FREQ_BITS + SHARE_BITS
CONTEXT_BITS = 11
CONTEXTS = 1 << CONTEXT_BITS
#: Entries that the prior counts for, and sixteenths as the unit of counts.
PRIOR, UNIT = 500, 16
#: Entries of each block whose intervals are found at a time; blocks whose frequencies are.
ROWS, GROUP = 64, 128
_HEAD = struct.Struct("<4sIII")  # magic, ids, words of code, words of rare ids
_MAGIC = b"CMR3"


class BlockError(ValueError):
    """A block's checksum or layout is wrong."""


def _refreshes(steps: int) -> list[int]:
    out, at = [], 24
    while at < steps:
        out.append(at)
        at += at // 2
    return out


def _learnt(e: np.ndarray, x4: np.ndarray) -> np.ndarray:
    """Predictions (entry and confidence) after the entry that came (times four): a right one gains
    confidence up to 3, a wrong one loses some or, with none left, gives way to that entry."""
    apart = (e ^ x4).view(np.uint16)  # the confidence, if right
    wrong, doubtful = apart > 3, (e & 3) == 0
    new = e + (apart < 3).view(np.int8)
    new -= wrong.view(np.int8)
    doubtful &= wrong
    x4 = new ^ x4
    x4 &= -doubtful.view(np.int8)
    new ^= x4
    return new


class Prior:
    """The ids of a run of blocks, most frequent first, with rough frequencies."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        """``codes``: of each id, in ascending order; two bits of mantissa and a power of two."""
        self.ids, self.codes = ids, codes
        weight = (4 + (codes.astype(np.int64) & 3)) << (codes.astype(np.int64) >> 2)
        order = np.argsort(-weight, kind="stable")
        self.names, weight = ids[order], weight[order]
        self.k = min(len(ids), COMMON + 1)
        self.wide = max(self.k, 1)
        #: The last entry stands for ids without an entry of their own.
        self.rest = COMMON if len(ids) > COMMON + 1 else None
        share = weight[: self.k].copy()
        if self.rest is not None:
            share[COMMON] = weight[COMMON:].sum()
            rare = weight[COMMON:]
            self.rare_bits = max(12, int(len(rare) - 1).bit_length() + 2)
            size = 1 + rare * ((1 << self.rare_bits) - len(rare)) // int(rare.sum())
            size[0] += (1 << self.rare_bits) - size.sum()
            self.rare_size, self.rare_start = size.astype(np.uint64), (np.cumsum(size) - size).astype(np.uint64)
        self.entries = np.maximum(1, share * (PRIOR * UNIT) // max(1, int(share.sum()))).astype(np.int32)

    @classmethod
    def of(cls, ids: np.ndarray) -> Prior:
        if len(ids) and int(ids.max()) >= 1 << 22:
            found, counts = np.unique(ids, return_counts=True)
        else:
            counts = np.bincount(ids)
            found = np.flatnonzero(counts)
            counts = counts[found]
        power = np.zeros(len(found), np.int64)
        rest = counts.astype(np.int64)
        for bits in (32, 16, 8, 4, 2, 1):  # the power of two at or below each count
            high = rest >> bits > 0
            power[high] += bits
            rest[high] >>= bits
        mantissa = (counts.astype(np.int64) << 2 >> power) & 3
        return cls(found.astype(np.uint32), (power * 4 + mantissa).astype(np.uint8))

    def pack(self) -> bytes:
        body = np.diff(self.ids.astype(np.int64), prepend=0).astype("<u4").tobytes()
        planes = np.frombuffer(body, np.uint8).reshape(-1, 4).T.tobytes()
        return struct.pack("<I", len(self.ids)) + zlib.compress(planes + self.codes.tobytes(), 9)

    @classmethod
    def unpack(cls, data: bytes) -> Prior:
        (n,) = struct.unpack_from("<I", data)
        body = zlib.decompress(data[4:])
        steps = np.frombuffer(np.frombuffer(body, np.uint8, 4 * n).reshape(4, n).T.tobytes(), "<u4")
        return cls(np.cumsum(steps, dtype=np.int64).astype(np.uint32), np.frombuffer(body, np.uint8, n, 4 * n))

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        """The place of each id among ``names``, in two bytes where they fit."""
        kind = np.uint16 if len(self.ids) <= 1 << 16 else np.int32
        if len(self.ids) and int(self.ids[-1]) < 1 << 22:
            table = np.zeros(int(self.ids[-1]) + 1, kind)
            table[self.names] = np.arange(len(self.names))
            return table[ids]
        order = np.argsort(self.names, kind="stable").astype(kind)
        return order[np.searchsorted(self.ids, ids)]


class _Model:
    """The state of all blocks that are coded in step."""

    def __init__(self, prior: Prior, n: int, decoding: bool = False):
        self.n, self.k = n, prior.wide
        self.prior = prior.entries[None] if len(prior.ids) else np.ones((1, 1), np.int32)
        lane = np.arange(n, dtype=np.int64)
        self.at1, self.at2, self.at_share = lane * self.k, n * self.k + lane * CONTEXTS, lane << 4
        self.table = np.zeros(n * (self.k + CONTEXTS), np.int16)  # order 1, then order 2
        self.b = np.zeros(n, np.int16)
        self.where = self.places(self.b, self.b, np.zeros((2, n), np.int64))
        self.found = np.zeros((2, n), np.int16)
        self.counts, self.freq = np.zeros((n, self.k), np.int32), np.zeros((n, self.k), np.int32)
        self.starts = self.freq.reshape(-1)  # start and frequency of each entry
        self.met = np.zeros((n, 64), np.int32)  # by confidences: entries that no order, order 1, 2 or both foretold
        self.slots = np.zeros(n << FREQ_BITS, np.int16) if decoding else None
        self.refresh(0)

    def refresh(self, step: int, x: np.ndarray | None = None, seen: np.ndarray | None = None) -> None:
        """Frequencies and shares after ``step`` entries. The arrays have a row for each entry since
        the last time: entries (or more, for ids that share the last one), and what :func:`_seen` gives."""
        spare = (1 << FREQ_BITS) - self.k
        scale = np.int32((spare << 15) // (step * UNIT + int(self.prior[0].sum())))
        entries = np.broadcast_to(np.arange(self.k, dtype=np.int16), (GROUP, self.k)).reshape(-1)
        for first in range(0, self.n, GROUP):  # small parts stay in caches
            part = slice(first, first + GROUP)
            counts, met, freq = self.counts[part], self.met[part], self.freq[part]
            if x is not None:
                lane = np.arange(len(counts))
                names = np.minimum(x[:, part], self.k - 1) + lane * self.k
                counts += np.bincount(names.reshape(-1), minlength=counts.size).reshape(counts.shape)
                met += np.bincount((seen[:, part] + (lane << 6)).reshape(-1), minlength=met.size).reshape(met.shape)
            np.multiply(counts, np.int32(UNIT), out=freq)
            freq += self.prior
            freq *= scale
            freq >>= 15
            freq += 1
            freq[:, 0] += (1 << FREQ_BITS) - freq.sum(axis=1, dtype=np.int32)
            if self.slots is not None:
                self.slots[first << FREQ_BITS : first + GROUP << FREQ_BITS] = np.repeat(entries[: freq.size], freq.reshape(-1))
            start = np.cumsum(freq, axis=1, dtype=np.int32)
            start -= freq
            start <<= FREQ_BITS + 1
            freq |= start
        none, one, two, both = self.met.reshape(-1, 4).T
        met, hit2, hit1 = none + one + two + both, two + both, one
        w2 = np.clip((10 * hit2 + 3 << SHARE_BITS) // (10 * met + 30), 1, 108)
        w1 = np.minimum(np.maximum((10 * hit1 + 3 << SHARE_BITS) // (10 * met + 30), 1), 120 - w2)
        self.shares = (w2 << 24 | w1 << 16 | (1 << SHARE_BITS) - w2 - w1).astype(np.int32)

    def places(self, x: np.ndarray, older: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Where orders 1 and 2 keep what follows the entries ``x`` and those before them."""
        np.add(self.at1, x, out=out[..., 0, :])
        mixed = x.astype(np.uint16)
        mixed *= np.uint16(30011)
        mixed += older.astype(np.uint16) * np.uint16(40503)
        mixed >>= 16 - CONTEXT_BITS
        np.add(self.at2, mixed, out=out[..., 1, :])
        return out

    def predict(self) -> np.ndarray:
        """What orders 1 and 2 foretell: entry and confidence, a row for each order."""
        return self.table.take(self.where, out=self.found, mode="clip")

    def learn(self, x: np.ndarray) -> None:
        """``x``: the entry that came (16 bits)."""
        self.table[self.where] = _learnt(self.found, x << 2)
        older, self.b = self.b, x
        self.places(self.b, older, self.where)


_FREQ = (1 << FREQ_BITS + 1) - 1


def _seen(found: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Both confidences and which orders foretold the entry, as one number."""
    out = (found[..., 1, :].astype(np.int8) & 3) << 2
    out |= found[..., 0, :].astype(np.int8) & 3
    out <<= 1
    out |= hit[..., 1, :].view(np.int8)
    out <<= 1
    out |= hit[..., 0, :].view(np.int8)
    return out


def _added(shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What orders 1 and 2 add to the entries that they foretell, and the share of order 0."""
    return shares >> (16 - FREQ_BITS) & 0x7F << FREQ_BITS, shares >> (24 - FREQ_BITS) & 0x7F << FREQ_BITS, shares & 0xFF


def _intervals(model: _Model, x: np.ndarray, e: np.ndarray):
    """Start and size of entries ``x``, and what is seen of them.

    The entries are in order, each as wide as the three predictions together make it. What orders 1
    and 2 add to an entry comes at the beginning of its interval."""
    p = e >> 2
    hit, less = p == x[:, None], p < x[:, None]
    seen = _seen(e, hit)
    by1, by2, w0 = _added(model.shares[(seen >> 2) + model.at_share])
    t = model.starts[x + model.at1]
    size = (t & _FREQ) * w0
    size += by1 * hit[:, 0]
    size += by2 * hit[:, 1]
    t >>= FREQ_BITS + 1
    t *= w0
    t += by1 * less[:, 0]
    t += by2 * less[:, 1]
    return t.astype(np.uint64), size.astype(np.uint64), seen


_SHORT, _WORD = np.uint64(1 << 32), np.uint64(32)


class _Writer:
    """The range coders of all blocks, and the words that they have written."""

    def __init__(self, n: int, words: int):
        self.size = words + 2 * ROWS
        self.words = np.zeros(n * self.size, np.uint32)
        self.first = np.arange(n, dtype=np.int64) * self.size
        self.at = self.first.copy()
        self.low = np.zeros(n, np.uint64)
        self.width = np.full(n, 2**64 - 1, np.uint64)

    def _carry(self, lanes: np.ndarray) -> None:
        back = self.at[lanes] - 1
        while len(back):
            self.words[back] += np.uint32(1)
            back = back[self.words[back] == 0] - 1

    def make_room(self) -> None:
        """For a word in each of the next ``ROWS`` steps."""
        used = self.at - self.first
        if used.max() + ROWS > self.size:
            words = self.words.reshape(-1, self.size)
            self.words = np.concatenate((words, np.zeros_like(words)), axis=1).reshape(-1)
            self.size *= 2
            self.first = np.arange(len(words), dtype=np.int64) * self.size
            self.at = self.first + used

    def put(self, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        """An entry of each of the first blocks."""
        n = len(start)
        unit = self.width[:n] >> np.uint64(bits)
        start *= unit
        low = self.low[:n]
        low += start
        carried = low < start
        width = np.multiply(size, unit, out=self.width[:n])
        if carried.any():
            self._carry(np.flatnonzero(carried))
        short = width < _SHORT
        lanes = np.flatnonzero(short)
        if len(lanes):
            self.words[self.at[lanes]] = low[lanes] >> _WORD
            self.at[:n] += short
            shift = short * _WORD
            low <<= shift
            width <<= shift

    def end(self, lane: int) -> np.ndarray:
        low = int(self.low[lane])
        return np.concatenate((self.words[self.first[lane] : self.at[lane]], np.array([low >> 32, low & 0xFFFFFFFF], np.uint32)))


def _rare(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Of the ids that share an entry: step, block, and place in an order by their number in the block,
    then by blocks, those with most of them first; where each number begins there; the blocks' ranks."""
    steps, n = symbols.shape
    at = np.flatnonzero(np.ascontiguousarray((symbols >= COMMON).T))
    lane, step = np.divmod(at, steps)
    counts = np.bincount(lane, minlength=n)
    rank = np.empty(n, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(n)
    left = n - np.searchsorted(np.sort(counts), np.arange(int(counts.max())), "right")  # blocks with more than so many
    begin = np.concatenate(([0], np.cumsum(left)))
    nr = np.arange(len(at)) - (np.cumsum(counts) - counts)[lane]
    return step, lane, begin[nr] + rank[lane], begin.tolist(), rank


def _code_rare(prior: Prior, symbols: np.ndarray) -> list[np.ndarray]:
    """The words of each block's ids that share an entry; none where there are no such ids."""
    none = [np.zeros(0, np.uint32)] * symbols.shape[1]
    if prior.rest is None:
        return none
    step, lane, place, begin, rank = _rare(symbols)
    names = np.empty(len(place), symbols.dtype)
    names[place] = symbols[step, lane] - COMMON
    out = _Writer(len(rank), len(begin) * prior.rare_bits // 32)
    for i, (a, b) in enumerate(zip(begin, begin[1:], strict=False)):
        if i % ROWS == 0:
            out.make_room()
        name = names[a:b]
        out.put(prior.rare_start[name], prior.rare_size[name], prior.rare_bits)
    some = begin[1] if len(begin) > 1 else 0
    return [out.end(r) if r < some else none[0] for r in rank.tolist()]


def _code(prior: Prior, symbols: np.ndarray, last: int) -> list[np.ndarray]:
    """The words of each block, but for its rare ids. ``symbols``: steps x blocks, of which the last
    block has ``last``."""
    steps, n = symbols.shape
    model, out = _Model(prior, n), _Writer(n, steps * TOTAL_BITS // 64)
    past = np.zeros((ROWS + 2, n), np.int16)  # before the first entry come two of number 0
    where, found = np.zeros((ROWS, 2, n), np.int64), np.zeros((ROWS, 2, n), np.int16)
    kept: list[np.ndarray] = []
    for first, end in zip([0, *_refreshes(steps)], [*_refreshes(steps), steps], strict=True):
        seen = np.zeros((end - first, n), np.int8)
        for a in range(first, end, ROWS):
            out.make_room()
            names = symbols[a : min(a + ROWS, end)]
            m = len(names)
            np.minimum(names, prior.wide - 1, out=past[2 : m + 2], casting="unsafe")
            model.places(past[1 : m + 1], past[:m], where[:m])
            part = past[2 : m + 2]
            for at, e, x4 in zip(where, found, part << 2, strict=False):
                model.table.take(at, out=e, mode="clip")
                model.table[at] = _learnt(e, x4)
            start, size, seen[a - first : a - first + m] = _intervals(model, part, found[:m])
            for i in range(m):
                if a + i == last < steps:  # the last block is shorter
                    kept.append(out.end(n - 1))
                out.put(start[i], size[i], TOTAL_BITS)
            past[:2] = past[m : m + 2].copy()
        if end < steps:
            model.refresh(end, symbols[first:end], seen)
    return [out.end(i) for i in range(n - 1)] + (kept or [out.end(n - 1)])


class _Reader:
    """The range coders of all blocks as they are read. A block that is shorter than others reads on in
    words that mean nothing."""

    def __init__(self, coded: list[np.ndarray]):
        words = np.zeros((len(coded), max(map(len, coded)) + 3), np.uint32)
        for i, w in enumerate(coded):
            words[i, : len(w)] = w
        self.at = np.arange(len(coded), dtype=np.int64) * words.shape[1]
        self.words = words.reshape(-1)
        self.ahead = (self.words[self.at].astype(np.uint64) << _WORD) | self.words[self.at + 1]
        self.at += 2
        self.width = np.full(len(coded), 2**64 - 1, np.uint64)

    def look(self, bits: int, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The unit of each of the first ``n`` blocks, and which of the units comes."""
        unit = self.width[:n] >> np.uint64(bits)
        v = self.ahead[:n] // unit
        return unit, np.minimum(v, np.uint64((1 << bits) - 1), out=v)

    def take(self, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        n = len(unit)
        ahead = self.ahead[:n]
        ahead -= unit * start
        width = np.multiply(unit, size, out=self.width[:n])
        short = width < _SHORT
        at = np.flatnonzero(short)
        if len(at):
            ahead[at] = ahead[at] << _WORD | self.words.take(self.at[at], mode="clip")
            self.at[:n] += short
            width <<= short * _WORD


def _decode_rare(prior: Prior, coded: list[np.ndarray], out: np.ndarray) -> None:
    """Puts the ids that share an entry in ``out`` (steps x blocks)."""
    step, lane, place, begin, rank = _rare(out)
    source = _Reader([coded[i] for i in np.argsort(rank)])
    names = np.empty(len(place), out.dtype)
    slots = np.repeat(np.arange(len(prior.rare_size), dtype=out.dtype), prior.rare_size.astype(np.int64)) if prior.rare_bits <= 20 else None
    for a, b in zip(begin, begin[1:], strict=False):
        unit, v = source.look(prior.rare_bits, b - a)
        name = slots[v.astype(np.int64)] if slots is not None else np.searchsorted(prior.rare_start, v, "right") - 1
        source.take(prior.rare_start[name], prior.rare_size[name], unit)
        names[a:b] = name
    names += COMMON
    out[step, lane] = names[place]


def _decode(prior: Prior, coded: list[np.ndarray], rare: list[np.ndarray], steps: int) -> np.ndarray:
    n = len(coded)
    model, source = _Model(prior, n, decoding=True), _Reader(coded)
    at_slot = np.arange(n, dtype=np.int64) << FREQ_BITS
    out = np.zeros((steps, n), np.uint16 if len(prior.ids) <= 1 << 16 else np.int32)
    hit, less = np.zeros((2, n), bool), np.zeros((2, n), bool)
    for first, end in zip([0, *_refreshes(steps)], [*_refreshes(steps), steps], strict=True):
        seen = np.zeros((end - first, n), np.int8)
        for i in range(end - first):
            found = model.predict()
            pair = (found[1] & 3) << 2
            pair |= found[0] & 3
            by1, by2, w0 = _added(model.shares[pair + model.at_share])
            p = found >> 2
            c = model.starts[p + model.at1]
            c >>= FREQ_BITS + 1
            c1, c2 = c
            behind = c2 < c1
            c *= w0
            unit, v = source.look(TOTAL_BITS)
            v = v.astype(np.int32)
            # without what order 1 adds, then without what order 2 does, it is a place of order 0
            c1 += by2 * behind
            for c_, by in ((c1, by1), (c2, by2)):
                np.subtract(v, c_, out=c_)
                np.maximum(c_, 0, out=c_)
                np.minimum(c_, by, out=c_)
                v -= c_
            slot = v.astype(np.float32)  # below 2**19, so the quotient's whole part is exact
            slot /= w0.astype(np.float32)
            x = model.slots[slot.astype(np.int64) + at_slot]
            t = model.starts[x + model.at1]
            np.equal(p, x, out=hit)
            np.less(p, x, out=less)
            size = t & _FREQ
            size *= w0
            size += by1 * hit[0]
            size += by2 * hit[1]
            t >>= FREQ_BITS + 1
            t *= w0
            t += by1 * less[0]
            t += by2 * less[1]
            source.take(t.astype(np.uint64), size.astype(np.uint64), unit)
            pair <<= 1
            pair |= hit[1]
            pair <<= 1
            pair |= hit[0]
            seen[i] = pair
            out[first + i] = x
            model.learn(x)
        if end < steps:
            model.refresh(end, out[first:end], seen)
    if prior.rest is not None:
        _decode_rare(prior, rare, out)
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[bytes]]:
    """The prior and the coded blocks of ``ids`` (unsigned, up to 32 bits), in order. No ids: no blocks."""
    if not 1 <= block <= BLOCK:
        raise ValueError(f"a block holds 1 to {BLOCK} ids")
    ids, out = np.asarray(ids), []
    prior = Prior.of(ids)
    for first in range(0, len(ids), block * LANES):
        part = ids[first : first + block * LANES]
        n, steps = -(-len(part) // block), min(block, len(part))
        symbols = prior.symbols(part)
        symbols.resize(n, steps, refcheck=False)
        symbols = np.ascontiguousarray(symbols.T)
        last = len(part) - (n - 1) * steps
        sizes = [steps] * (n - 1) + [last]
        for size, words, rare in zip(sizes, _code(prior, symbols, last), _code_rare(prior, symbols), strict=True):
            body = _HEAD.pack(_MAGIC, size, len(words), len(rare)) + words.astype("<u4").tobytes() + rare.astype("<u4").tobytes()
            out.append(body + struct.pack("<I", zlib.crc32(body)))
    return prior.pack(), out


def decode(prior: bytes, blocks: list[bytes]) -> np.ndarray:
    """The ids of coded blocks, in the blocks' order; :class:`BlockError` if one is damaged."""
    known, out = Prior.unpack(prior), []
    for first in range(0, len(blocks), LANES):
        sizes, coded, rare = [], [], []
        for data in blocks[first : first + LANES]:
            if len(data) < _HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
                raise BlockError("a block's checksum is wrong")
            magic, n, w, r = _HEAD.unpack_from(data)
            if magic != _MAGIC or len(data) != _HEAD.size + 4 * (w + r) + 4:
                raise BlockError("a block's layout is wrong")
            sizes.append(n)
            coded.append(np.frombuffer(data, "<u4", w, _HEAD.size))
            rare.append(np.frombuffer(data, "<u4", r, _HEAD.size + 4 * w))
        got = _decode(known, coded, rare, max(sizes)).T
        out += [known.names[row[:n]] for n, row in zip(sizes, got, strict=True)]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
