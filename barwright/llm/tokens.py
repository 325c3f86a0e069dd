"""Token ids of whole texts, with a memory of the ids of space-separated pieces."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

#: Places of the table of short pieces, and how many of them are filled at most. Pieces met later are
#: encoded anew for each batch of texts.
PLACES = 1 << 22
REMEMBERED = PLACES * 5 // 8
#: Longer pieces remembered at most.
LONG = 100_000

#: Single words whose lower case and composed form are single words too.
_PLAIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTER, _MARK, _CUT = (np.isin(np.arange(256), [ord(c) for c in x]) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", ",.;:!?", " \n,.;:!?"))
#: The first bytes of a piece that a key keeps, by its length.
_KEPT = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(16)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _byte_letters() -> dict[int, str]:
    """The printable characters that stand for bytes in byte-level vocabularies: Latin-1's printable
    ones for themselves, the others from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(0x100 + i) for i, b in enumerate(rest)}}


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces of the joined texts ``data`` (UTF-8) start: at the texts' own ``starts``; at each
    space or line feed that follows a character that is not white space; between a line feed that is
    all white space there is and an ASCII letter; at each common mark that follows a letter."""
    first = np.zeros(len(data) + 1, bool)
    at = np.flatnonzero(_CUT[data])
    at = at[at > 0]
    before, own = data[at - 1], data[at]
    letter = _LETTER[before]
    # the second byte of C3: Latin-1's letters, but for U+00D7 and U+00F7
    letter |= (before >= 0x80) & (data[at - 2] == 0xC3) & (before != 0x97) & (before != 0xB7) & (at > 1)
    solid = letter | (before > 0x20) & (before < 0x7F)
    wide = np.flatnonzero((before >= 0x80) & ~letter)
    if len(wide):  # no white space: U+0085, U+00A0, U+3000, and all of U+1000 to U+2FFF to be safe
        x = at[wide]
        one, two, three = data[x - 1], data[x - 2], data[np.maximum(x - 3, 0)]
        solid[wide] = ~((two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) | (three == 0xE2) | (three == 0xE3) & (two == 0x80))
    first[at[np.where(_MARK[own], letter, solid)]] = True
    feeds = at[(own == 0x0A) & solid] + 1
    feeds = feeds[feeds < len(data)]
    first[feeds[_LETTER[data[feeds]]]] = True
    first[starts] = True
    return np.flatnonzero(first[:-1])


class Encoder:
    """Encodes whole texts with a tokenizer file of the ``tokenizers`` library.

    At the places that :func:`cuts` gives, both kinds of pre-tokenizer used here (byte-level BPE,
    word-end BPE) start a new word, and no rule looks past them. So the ids of a text are the joined
    ids of its pieces. Every piece is encoded by the library when it is met, and looked up afterwards:
    pieces of up to 15 bytes are their own exact keys in an open-addressing table, so that a batch of
    texts is looked up by a few array operations. An added token that stands in a text is that token,
    as the library has it with ``add_special_tokens=False``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab()
        #: Ids are kept in two bytes each where they fit.
        self.kind = np.uint16 if max(words.values()) < 1 << 16 else np.uint32
        self.key1, self.key2 = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.uint64)
        self.value = np.zeros(PLACES, np.int32)  # number of the piece; 0: a free place
        self.long: dict[bytes, int] = {}
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, self.kind)
        self.pieces, self.used, self.short = 1, 0, 0
        # ids that end a word, or that begin with a space; either tells the words of a text apart
        self.ends = self._marked(words, lambda w: w.endswith("</w>"))
        self.starts = self._marked(words, lambda w: w.startswith("Ġ"))
        # the same model, for words that need neither normalizing nor patterns to be told apart
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = str.maketrans(_byte_letters())
        some = [w for w in ("".join(x[0] for x in re.findall("[A-Za-z]|é", w)) for w in sorted(words)[:: max(1, len(words) // 300)]) if w] + ["Été", "The", "don"]
        self.fast = (self.ends is None) != (self.starts is None) and all(self._same(some, x) for x in (True, False))

    def _same(self, words: list[str], spaced: bool) -> bool:
        """Whether the shorter way gives the library's ids."""
        (ids, size), want = self._apart(words, spaced), self._whole([" " * spaced + w for w in words])
        return size.tolist() == [len(x) for x in want] and np.array_equal(ids, np.concatenate(want))

    @staticmethod
    def _marked(words: dict[str, int], test) -> np.ndarray | None:
        flags = np.zeros(max(words.values()) + 1, bool)
        flags[[i for w, i in words.items() if test(w)]] = True
        return flags if flags.sum() > 1000 else None

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, words: list[str], spaced: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, each as with a leading space (or without), joined, and how many each
        has: encoded as one text and told apart there."""
        text = " ".join(words)
        if self.ends is not None:
            text = text.lower()
        text = text.encode().decode("latin-1").translate(self.letters)  # a space becomes the letter for it
        space = chr(0x120)
        if self.ends is not None:
            text = text.replace(space, " ")
        elif spaced:
            text = space + text.replace(space, " " + space)
        else:
            text = text.replace(space, " ! ") + " !"
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        if self.ends is not None:
            return ids, np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
        if spaced:
            return ids, np.diff(np.flatnonzero(self.starts[ids]), append=len(ids))
        last = ids == ids[-1]
        return ids[~last], np.diff(np.flatnonzero(last), prepend=-1) - 1

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Encodes pieces met for the first time; their numbers, after those that are remembered."""
        texts = [p.decode() for p in pieces]
        groups: list[list[int]] = [[], [], []]  # plain words with a leading space, those without, the rest
        for i, t in enumerate(texts):
            groups[2 if not (self.fast and _PLAIN.fullmatch(t)) else 0 if t[0] == " " else 1].append(i)
        ids, size = [], []
        for spaced, group in zip((True, False), groups[:2], strict=True):
            if group:
                found = self._apart([texts[i][spaced:] for i in group], spaced)
                if len(found[1]) == len(group):
                    ids.append(found[0]), size.append(found[1])
                    continue
            groups[2] += group
            group.clear()
        whole = self._whole([texts[i] for i in groups[2]])
        ids = np.concatenate((*ids, *whole))
        size = np.concatenate((*size, np.array([len(x) for x in whole], np.int64)))
        while self.pieces + len(size) > len(self.at):
            self.at, self.size = np.concatenate((self.at, np.zeros_like(self.at))), np.concatenate((self.size, np.zeros_like(self.size)))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        rows = slice(self.pieces, self.pieces + len(size))
        self.at[rows], self.size[rows] = self.used + np.cumsum(size) - size, size
        numbers = np.empty(len(size), np.int64)
        numbers[[i for g in groups for i in g]] = np.arange(self.pieces, self.pieces + len(size))
        self.pieces, self.used = self.pieces + len(size), self.used + len(ids)
        return numbers

    def _place(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        mixed = (one * _MIX[0]) ^ (two * _MIX[1])
        return ((mixed ^ (mixed >> np.uint64(29))) * _MIX[0] >> np.uint64(64 - 22)).astype(np.int64) & (PLACES - 1)

    def _look_up(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Numbers of short pieces; 0 where unknown."""
        at = self._place(one, two)
        out = self.value[at]
        rest = np.flatnonzero((out > 0) & ((self.key1[at] != one) | (self.key2[at] != two)))
        at = at[rest]
        while len(rest):
            at = (at + 1) & (PLACES - 1)
            found = self.value[at]
            out[rest] = found
            wrong = (found > 0) & ((self.key1[at] != one[rest]) | (self.key2[at] != two[rest]))
            rest, at = rest[wrong], at[wrong]
        return out

    def _remember(self, one: np.ndarray, two: np.ndarray, numbers: np.ndarray) -> None:
        at, rest = self._place(one, two), np.arange(len(one))
        while len(rest):
            free = self.value[at] == 0
            self.value[at[free]] = numbers[rest[free]]
            own = free & (self.value[at] == numbers[rest])  # of several for one place the last has it
            self.key1[at[own]], self.key2[at[own]] = one[rest[own]], two[rest[own]]
            rest, at = rest[~own], (at[~own] + 1) & (PLACES - 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, joined, and how many each text has. A null text is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        if not n:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        edges = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[edges[0] : edges[-1]] if buffer else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(n, np.int64)
        start = cuts(data, edges[:-1][edges[1:] > edges[:-1]])
        size = np.diff(start, append=len(data))
        number = np.zeros(len(start), np.int64)
        data = np.concatenate((data, np.zeros(16, np.uint8)))
        eight = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))
        short = size <= 15
        every = bool(short.all())
        s, z = (start, size) if every else (start[short], size[short])
        one = eight[s] & _KEPT[z]
        two = np.where(z > 8, eight[s + 8] & _KEPT[np.maximum(z - 8, 0)], np.uint64(0)) | (z.astype(np.uint64) << np.uint64(56))
        found = self._look_up(one, two).astype(np.int64)
        kept = (self.pieces, self.used)
        raw = data.tobytes()
        if not every:
            keys = {raw[a : a + b] for a, b in zip(start[~short].tolist(), size[~short].tolist(), strict=True)}
            new = sorted(k for k in keys if k not in self.long)
            known = self.long
            if new:
                made = dict(zip(new, self._add(new).tolist(), strict=True))
                if len(known) + len(made) <= LONG:
                    known.update(made)
                    kept = (self.pieces, self.used)
                else:
                    known = {**known, **made}
            number[~short] = [known[raw[a : a + b]] for a, b in zip(start[~short].tolist(), size[~short].tolist(), strict=True)]
        missing = np.flatnonzero(found == 0)
        if len(missing):
            order = missing[np.lexsort((two[missing], one[missing]))]
            o, t = one[order], two[order]
            fresh = np.concatenate(([True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])))
            firsts = order[fresh]
            numbers = self._add([raw[a : a + b] for a, b in zip(s[firsts].tolist(), z[firsts].tolist(), strict=True)])
            found[order] = numbers[np.cumsum(fresh) - 1]
            if self.short + len(firsts) <= REMEMBERED and kept[0] == numbers.min():
                self._remember(one[firsts], two[firsts], numbers)
                self.short += len(firsts)
                kept = (self.pieces, self.used)
        if every:
            number = found
        else:
            number[short] = found
        sizes = self.size[number].astype(np.int64)
        ends = np.cumsum(sizes)
        place = np.repeat(self.at[number] - ends + sizes, sizes) + np.arange(ends[-1])
        out = self.ids[place]
        total = np.concatenate(([0], ends))
        counts = np.diff(total[np.searchsorted(start, edges)])
        self.pieces, self.used = kept
        return out, counts

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        ids, counts = self.encode(pa.array(texts, pa.string()))
        return np.split(ids.astype("<u4"), np.cumsum(counts)[:-1]) if len(counts) else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Gives back the memory of a worker that turns from encoding to other work."""
    _encoders.clear()
    give_back()


def give_back() -> None:
    """Returns what earlier tasks freed to the system, where the C library can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def default_path(name: str) -> str:
    """Where the public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def batches(texts: pa.Array, size: int = 1 << 20):
    """(first, end) of slices of ``texts`` of about so many bytes; a longer text is one of its own."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, n = 0, len(texts)
    while first < n:
        done = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, done + size, "right")))
        yield first, end
        first = end
