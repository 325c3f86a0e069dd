import os
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barwright.llm import packing, range_codec, token_store, tokens

BYTES, WORDS = tokens.default_path("byte_bpe_50k.json"), tokens.default_path("word_bpe_49k.json")
END = 2
FOLDER = "/root/testdata/sf0.01"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 5), max_size=300), st.integers(1, 50))
def test_round_trip(ids, block):
    prior, coded = range_codec.encode(np.array(ids, np.uint32), block)
    assert range_codec.decode(prior, coded).tolist() == ids
    # blocks are independent: any of them alone, and all in another grouping
    assert [x for b in coded for x in range_codec.decode(prior, [b]).tolist()] == ids


@pytest.mark.parametrize("distinct", [1, 2, 510, 511, 512, 513, 700, 5000, 70_000])
def test_round_trip_by_distinct_ids(distinct):
    """With and without ids that share an entry; blocks of several lengths in step."""
    draw = np.random.default_rng(distinct)
    ids = np.concatenate((np.arange(distinct), draw.integers(0, distinct, 9000))).astype(np.uint32) * 3
    prior, coded = range_codec.encode(ids, 1500)
    assert (range_codec.decode(prior, coded) == ids).all()
    assert (range_codec.decode(prior, coded[::-1]) == np.concatenate([ids[i : i + 1500] for i in range(0, len(ids), 1500)][::-1])).all()


def test_large_round_trip_and_compression():
    draw = np.random.default_rng(3)
    ids = np.minimum(draw.zipf(1.3, 40_000), 50_000).astype(np.uint32)
    ids[20_000:] = np.tile(ids[:200], 100)
    prior, coded = range_codec.encode(ids)
    assert (range_codec.decode(prior, coded) == ids).all()
    assert sum(map(len, coded)) + len(prior) < 1.0 * len(ids)  # repeats cost next to nothing


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_real_documents_take_less_than_a_static_table():
    """Under the entropy of the ids' own frequencies, which no code of order 0 for the whole can beat."""
    texts = pq.read_table(f"{FOLDER}/documents.parquet", columns=["text"]).column(0).combine_chunks()
    ids, counts = tokens.encoder(BYTES).encode(texts)
    assert len(counts) == len(texts)
    prior, coded = range_codec.encode(ids)
    assert (range_codec.decode(prior, coded) == ids).all()
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert 8 * (sum(map(len, coded)) + len(prior)) < len(ids) * -(share * np.log2(share)).sum()


def test_each_order_pays():
    """What the two entries before foretell costs far less than order 0 alone could give."""
    draw = np.random.default_rng(8)
    pairs = draw.integers(0, 40, 2000)
    ids = np.stack((pairs, pairs + 40, np.full(2000, 99), pairs + 100), 1).reshape(-1).astype(np.uint32)
    prior, coded = range_codec.encode(ids)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert 8 * sum(map(len, coded)) < 0.6 * len(ids) * -(share * np.log2(share)).sum()


def test_damage_is_found():
    prior, coded = range_codec.encode(np.arange(100, dtype=np.uint32))
    with pytest.raises(range_codec.BlockError):
        range_codec.decode(prior, [coded[0][:-10] + b"x" + coded[0][-9:]])
    data = token_store.pack_file([1, None], [60, 40], np.arange(100, dtype=np.uint32), END)
    docs, counts, ids = token_store.unpack_file(data)
    assert (docs, counts.tolist(), ids.tolist()) == ([1, None], [60, 40], list(range(100)))
    with pytest.raises(range_codec.BlockError):
        token_store.unpack_file(data[:30] + b"?" + data[31:])


PLAIN = {path: Tokenizer.from_file(path) for path in (BYTES, WORDS)}  # as the library has them, nothing set


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([*"aéßΣ×÷ 'sT.,;\n\t\x0c\x00  1İ<|>Ā\u2028\u3000\u0085\u0301漢😀", "  ", "\n\n", ".\nNo", "<|endoftext|>", "<|startoftext|>", "don't", "thanreing", " Wörter, "]), max_size=25).map("".join), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(path, texts):
    e = tokens.encoder(path)
    for _ in range(2):  # met for the first time, and remembered
        assert [x.tolist() for x in e(texts)] == [PLAIN[path].encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_real_documents_and_a_full_memory(path, monkeypatch):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    texts = pq.read_table(f"{FOLDER}/documents.parquet", columns=["text"]).column(0).combine_chunks()
    want = [x.ids for x in PLAIN[path].encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
    monkeypatch.setattr(tokens, "REMEMBERED", 3000)
    monkeypatch.setattr(tokens, "LONG", 20)
    e = tokens.Encoder(path)
    assert e.fast
    for a, b in tokens.batches(texts, 20_000):
        ids, counts = e.encode(texts.slice(a, b - a))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[a:b]
    assert e.short <= 3000 and len(e.long) <= 20


def test_batches_hold_all_texts():
    texts = pa.array(["a" * n for n in (0, 5, 100, 3, 0, 7)] + [None])
    assert list(tokens.batches(texts, 10)) == [(0, 2), (2, 3), (3, 7)]
    assert list(tokens.batches(texts.slice(0, 0), 10)) == []


def ids_of(path, text):
    return PLAIN[path].encode(text or "", add_special_tokens=False).ids + [END]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


MORE_ROWS = [(6, "the same number, another text <|endoftext|> and more", "en", "a"), (8, "<|startoftext|>x<|endoftext|>", "en", "a"), (None, None, None, None)]


def test_files_hold_all_ids_in_order(documents, hard_rows):
    rows = hard_rows + MORE_ROWS
    got = token_store.read_ids(token_store.write_ids(documents(rows), BYTES)).select("doc_id", "start", "n_ids", F.crc32("ids")).collect()
    want = Counter((d, len(i := ids_of(BYTES, t)), crc(i)) for d, t, *_ in rows)
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    got.sort(key=lambda r: r[1])
    assert [r[0] is not None for r in got] == sorted(r[0] is not None for r in got)
    assert [r[0] for r in got if r[0] is not None] == sorted(d for d, *_ in rows if d is not None)
    assert [r[1] for r in got] == [sum(g[2] for g in got[:i]) for i in range(len(got))]


def test_several_files_and_parts(documents, monkeypatch):
    monkeypatch.setattr(token_store, "PART_BYTES", 10_000)
    rows = [(i, f"text {i} " * (i % 50), "en", "a") for i in range(300)]
    files = token_store.write_ids(documents(rows), BYTES)
    assert files.count() > 4
    got = sorted(token_store.read_ids(files).select("start", "doc_id", F.crc32("ids")).collect())
    assert [(r[1], r[2]) for r in got] == [(d, crc(ids_of(BYTES, t))) for d, t, *_ in rows]


def test_pieces_fill_windows(documents, hard_rows):
    rows = hard_rows + MORE_ROWS + [(100 + i, "a b c " * (i % 700), "en", "a") for i in range(300)]
    got = packing.pack(documents(rows), WORDS, window=512).collect()
    by_seq, pieces = {}, Counter()
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[r.doc_id, r.start, r.doc_tokens, bytes(r.ids)] += 1
    want = Counter()  # the cuts are free, so they are taken from the result; what lies between is not
    edges = {}
    for d, start, n, _ in pieces:
        edges.setdefault((d, n), set()).update((start, n))
    for d, text, *_ in rows:
        ids = ids_of(WORDS, text)
        at = sorted(edges[d, len(ids)])
        for a, b in zip(at, at[1:]):
            want[d, a, len(ids), np.array(ids[a:b], "<u4").tobytes()] += 1
    assert pieces == want
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 512
    assert len(by_seq) <= 1.02 * sum(r.length for r in got) / 512 + 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_decreasing_against_a_plain_search(lengths):
    at, offset, used = packing.best_fit(lengths, 64)
    left: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [c for c in left if c >= lengths[i]]
        if not fits:
            left.append(64)
            fits = [64]
        left[left.index(min(fits))] -= lengths[i]
    assert used == len(left)
    fill = [0] * used
    for i in sorted(range(len(lengths)), key=lambda i: (at[i], offset[i])):
        assert offset[i] == fill[at[i]]
        fill[at[i]] += lengths[i]
    assert sorted(64 - f for f in fill) == sorted(left)


def test_empty_tables(documents):
    assert token_store.read_ids(token_store.write_ids(documents([]), BYTES)).count() == 0
    assert packing.pack(documents([]), WORDS).count() == 0


def test_a_prediction_learns():
    """Every entry and confidence, against the rule spelled out."""
    e, x = (a.reshape(-1).astype(np.int16) for a in np.meshgrid(np.arange(2048)[::7], np.arange(512)))
    e = np.concatenate((e, x << 2 | e & 3))  # right ones too
    x = np.concatenate((x, x))
    want = [(p << 2 | min(c + 1, 3)) if p == y else (p << 2 | c - 1) if c else y << 2 for p, c, y in zip((e >> 2).tolist(), (e & 3).tolist(), x.tolist(), strict=True)]
    assert range_codec._learnt(e, x << 2).tolist() == want


def test_contexts_of_many_steps_are_those_of_single_ones():
    """The coder finds contexts ahead, the decoder one by one."""
    model = range_codec._Model(range_codec.Prior.of(np.arange(600, dtype=np.uint32)), 3)
    x = np.random.default_rng(4).integers(0, 512, (70, 3)).astype(np.int16)
    past = np.concatenate((np.zeros((2, 3), np.int16), x)).astype(np.int32)
    ahead = model.places(past[1:-1], past[:-2], np.zeros((70, 2, 3), np.int64))
    for now, then in zip(x, ahead, strict=True):
        model.predict()
        assert np.array_equal(model.where, then)
        model.learn(now)


def test_coding_holds_few_bytes_an_id():
    """Beside the ids: an executor's two workers code files of 12.6 million ids at a time."""
    draw = np.random.default_rng(6)
    ids = np.minimum(draw.zipf(1.3, 1024 * range_codec.BLOCK), 5000).astype(np.uint16)

    def peak(f, *args):
        tracemalloc.start()
        try:
            return f(*args), tracemalloc.get_traced_memory()[1] / len(ids)
        finally:
            tracemalloc.stop()

    (prior, coded), most = peak(range_codec.encode, ids)
    assert most < 11
    got, most = peak(range_codec.decode, prior, coded)
    assert most < 11 and (got == ids).all()


def test_rare_ids_by_block():
    """Blocks with none, few and nothing but ids that share an entry; names beyond 16 bits."""
    draw = np.random.default_rng(7)
    for distinct in (600, 70_000):
        ids = np.concatenate((np.zeros(100), np.arange(distinct), np.zeros(50), draw.integers(0, distinct, 80), np.arange(distinct)[::-1], np.zeros(30))).astype(np.uint32)
        prior, coded = range_codec.encode(ids, 50)
        assert (range_codec.decode(prior, coded) == ids).all()
        some = coded[1::7]
        assert (range_codec.decode(prior, some) == np.concatenate([ids[50 * i : 50 * i + 50] for i in range(1, len(coded), 7)])).all()
