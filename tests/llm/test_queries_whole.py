"""The registered queries of the operators without SQL, on a whole small table, against plain versions."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_codec_and_tokens import BYTES, PLAIN, WORDS
from test_documents import plain_components, plain_fingerprint

from barwright.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    rows = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return sorted((r["doc_id"], r["text"] or "") for r in rows)


def ids_of(path, text):
    return np.array([*PLAIN[path].encode(text, add_special_tokens=False).ids, 2], "<u4")


def test_op1(spark, docs):
    at, want = 0, []
    for d, t in docs:
        ids = ids_of(BYTES, t)
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op1_token_ids"](spark, FOLDER).collect())) == want


def test_op2(spark, docs):
    ids = {d: ids_of(WORDS, t) for d, t in docs}
    at, fill = Counter(), Counter()
    rows = sorted(queries.QUERIES["op2_packing"](spark, FOLDER).collect(), key=lambda r: (r.doc_id, r.start))
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.start, r.doc_tokens, len(part), r.ids_crc32) == (at[r.doc_id], len(ids[r.doc_id]), r.length, zlib.crc32(part.tobytes()))
        at[r.doc_id] += r.length
    assert at == Counter({d: len(x) for d, x in ids.items()})
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096


def plain_base(text):
    """The three base kinds, each place tried in turn."""
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    out, low, i = [], "".join(c.lower() if c.isascii() else c for c in text), 0
    while i < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "apikey", "api_key") if low.startswith(w, i)), None)
        j = i + len(word) if word else i
        if word:
            j += text[j : j + 1] in ("'", '"')
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] in (":", "="):
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ("'", '"')
                end = j
                while end < len(text) and text[end] in value:
                    end += 1
                if end > j:
                    out += [(i, 0, end)] if end - j >= 8 else []
                    i = end
                    continue
        i += 1
    for kind, head, letters, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), (2, "", set("0123456789abcdef"), 32)):
        i = 0
        while i < len(text):
            j = i + len(head)
            while text.startswith(head, i) and j < len(text) and text[j] in letters:
                j += 1
            if text.startswith(head, i) and j > i + len(head):
                out += [(i, kind, j)] if j - i >= least else []
                i = j
            else:
                i += 1
    return [(s, ("assign", "access", "hex")[k], e) for s, k, e in sorted(out)]


def test_op3(spark):
    folder = FOLDER.replace("0.001", "0.01")  # the smallest table with secrets
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    found = 0
    for r in queries.QUERIES["op3_secrets"](spark, folder).collect():
        want = plain_base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in want) for x in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in want).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for s, k, e in want} <= set(r.spans.split(","))
        found += len(want)
    assert found


def test_base_spans_of_random_texts():
    from barwright.llm import secrets

    draw = np.random.default_rng(4)
    parts = ["token", "API_KEY", "apikey", "Secret", "=", ":", " ", '"', "'", "abcdefgh", "A1", "AKIA", "AKIAABCDEFGHIJKL", "0f" * 16, "0f", "x", "\n", "é", "ſecret=", "passwd"]
    for _ in range(2000):
        text = "".join(draw.choice(parts, 14))
        assert sorted((s, secrets.BASE.index(k), e) for s, e, k in secrets.base_spans(text)[0]) == [(s, secrets.BASE.index(k), e) for s, k, e in plain_base(text)]


@pytest.mark.parametrize("unit", ["aB3", "AKIA", "user=", "pwd ", "token ", "a.", "0f", "x://", "token=short "])
def test_a_long_text_takes_time_in_proportion(unit):
    import time

    from barwright.llm import secrets

    text = unit * (1_000_000 // len(unit))
    start = time.process_time()
    secrets.redact_text(text)
    assert time.process_time() - start < 60


def test_op5(spark, docs):
    fps = [plain_fingerprint(t) for _, t in docs]
    want = [(d, f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, plain_components([d for d, _ in docs], fps), strict=True)]
    assert sorted(map(tuple, queries.QUERIES["op5_simhash"](spark, FOLDER).collect())) == want


def test_op6(spark, docs):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()}
    rows = queries.QUERIES["op6_toxicity"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == [d for d, _ in docs]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    known = [r for r in rows if labels.get(r.doc_id) in (0, 1)]
    assert np.mean([r.predicted == labels[r.doc_id] for r in known]) > 0.9


def test_features_and_ratios_against_plain_ones():
    """Distinct 3- to 5-grams of the framed text; places differ from n-grams by chance collisions only."""
    draw = np.random.default_rng(2)
    texts = ["".join(draw.choice(list("abcde fgé\n"), draw.integers(0, 80))) for _ in range(60)] + ["", None]
    grams = []
    for t in texts:
        framed = " " + " ".join((t or "").lower().split()) + " "
        grams.append({framed[i : i + n] for n in toxicity.ORDERS for i in range(len(framed) - n + 1)})
    found = toxicity.features(texts)
    place = {}
    for g in sorted({x for s in grams for x in s}):
        only = [set(f) for f, s in zip(found, grams, strict=True) if g in s]
        place[g] = set.intersection(*only)
        assert place[g]  # each gram has a place of its own in every text that has the gram
    for f, s in zip(found, grams, strict=True):
        assert len(set(f)) == len(f) <= len(s) and len(f) >= len(s) - 2
    y = np.array([i % 3 == 0 for i in range(len(texts))], float)
    model = toxicity.fit(found, y)
    p = Counter(x for f, t in zip(found, y, strict=True) if t for x in f.tolist())
    q = Counter(x for f, t in zip(found, y, strict=True) if not t for x in f.tolist())
    for x in {*p, *q}:
        ratio = np.log((p[x] + 1) / (sum(p.values()) + toxicity.PLACES)) - np.log((q[x] + 1) / (sum(q.values()) + toxicity.PLACES))
        if p[x] + q[x] < toxicity.LEAST_TEXTS or abs(ratio) < toxicity.LEAST_RATIO:
            assert model.weights[x] == 0
    z = np.array([model.weights[f].sum() + model.bias for f in found])
    assert np.mean((z > 0) == (y > 0)) > np.mean(y == 0)  # better than calling none toxic
    assert re.fullmatch(r"\d\.\d+(e-\d+)?", str(model.score(found[0])))
