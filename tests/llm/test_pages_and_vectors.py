import base64
import hashlib
import io
import zipfile
from collections import Counter

import numpy as np
import pytest

from barwright.llm import neighbours, warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha1 string, first int")


def test_records_and_revisits(spark):
    rows = [(5, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (9, None, None), (1, "http://c/", ""), (7, "u", "z" * 300_000), (7, "u", "z" * 300_000), (None, "n", "<p>é</p>")]
    got = warc.read_archives(warc.write_archives(pages(spark, rows))).collect()
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = Counter()
    for p, _, h in rows:
        body = (h or "").encode()
        same = p == first[h or ""]
        want[p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if same else "revisit", None if same else first[h or ""], body if same else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in got) == want
    assert warc.read_archives(warc.write_archives(pages(spark, []))).count() == 0
    large = warc.read_archives(warc.write_archives(pages(spark, rows), least_bytes=100)).collect()
    assert all(r.record_type == "response" for r in large)


def open_bytes(data):
    return warc.Package(lambda s, n: data[s : s + n], len(data))


def test_directory_against_the_standard_library():
    data = warc.package([(1, warc.gzip_member(warc.record(1, "u", b"body", warc.digest(b"body")))), (None, warc.gzip_member(warc.record(None, None, b"", warc.digest(b""))))])
    p = open_bytes(data)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist() == list(p.members)
        start, size = p.stored_at(warc.DATA)
        assert data[start : start + size] == z.read(warc.DATA)
    assert [b.rpartition(b"\r\n\r\n")[2] for _, b in p.records()] == [b"body", b""]


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = warc.package([(i, warc.gzip_member(warc.record(i, "u", b"x" * i, warc.digest(b"x" * i)))) for i in range(5)])
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    assert [len(b.rpartition(b"\r\n\r\n")[2]) for _, b in open_bytes(data).records()] == list(range(5))


def test_comment_damage_and_packed_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.INDEX, '- 0 {"offset": "0", "length": "1", "filename": "x"}\n' * 50)
        z.comment = b"a comment with PK\x05\x06 in it" + b"\0" * 30
    p = open_bytes(out.getvalue())
    with pytest.raises(warc.ArchiveError):
        p.index()
    with pytest.raises(warc.ArchiveError):
        open_bytes(b"no archive" * 10)


def test_several_archives_and_one_that_no_index_covers():
    def member(i):
        return warc.gzip_member(warc.record(i, "u", b"x" * i, warc.digest(b"x" * i)))

    def packed(covered):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i in (3, 5):
                z.writestr(f"archive/part-{i}.warc.gz", member(i))
                if i in covered:
                    z.writestr(f"indexes/part-{i}.cdx", f'- 0 {{"offset": "0", "length": "{len(member(i))}", "filename": "part-{i}.warc.gz"}}\n')
        return open_bytes(out.getvalue())

    assert [len(b.rpartition(b"\r\n\r\n")[2]) for _, b in packed((3, 5)).records()] == [3, 5]
    for covered in ((3,), ()):
        with pytest.raises(warc.ArchiveError):
            list(packed(covered).records())


def test_a_very_common_payload(spark):
    """Over a thousandth of all rows: its payloads are not shuffled to one task."""
    df = spark.createDataFrame([(i, "u", "" if i % 3 else f"own {i}") for i in range(3000)], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(df)).groupBy("record_type", "refers_to").count().collect()
    assert {(r.record_type, r.refers_to): r["count"] for r in got} == {("response", None): 1001, ("revisit", 1): 1999}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "q", 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, gid string, score double")


def exact(rows, k):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for i, q in zip(ids, m, strict=True):
        if i % 20 == 0:
            s = m @ q
            out[int(i)] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def test_nearest_against_all_rows(spark):
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + 0.4 * draw.normal(size=24)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[20][1]) for i in range(90)]  # more copies than a result has rows
    odd = [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] + [1.0] * 23), (1060, [float("inf")] + [1.0] * 23), (1080, [1.0, 2.0]), (1100, [None] + [1.0] * 23), (1120, [])]
    got = {}
    for r in neighbours.nearest(vectors(spark, rows + odd + rows[:3]), part_bytes=150 * 24 * 8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(rows, 20)
    assert set(got) == set(want)
    found = total = 0
    for q, best in want.items():
        assert [r for r, *_ in got[q]] == list(range(1, len(got[q]) + 1))
        assert [(-s, v) for _, v, s in got[q]] == sorted((-s, v) for _, v, s in got[q])
        found += len({v for _, v, _ in got[q]} & {v for v, _ in best})
        total += len(best)
    assert found >= 0.9 * total
    # equal vectors: exact, with ties to the smaller id
    assert [v for _, v, _ in got[20]] == [v for v, _ in want[20]]


def test_few_and_no_vectors(spark):
    got = neighbours.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])])).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)][0] == (0, 1, 2, 1.0)
    assert neighbours.nearest(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["lognormal norms", "one long row", "384 dimensions"])
def test_recall_on_other_norms_and_dimensions(kind):
    draw = np.random.default_rng(1)
    v = draw.normal(size=(3000, 384 if kind == "384 dimensions" else 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "lognormal norms":
        v *= draw.lognormal(0, 1, (len(v), 1))
    if kind == "one long row":
        v[777] *= 1000
    part = neighbours.Part(neighbours.Hashes(v.shape[1]), np.arange(len(v)), v)
    asked = range(0, len(v), 50)
    found = 0
    for i, (ids, _) in zip(asked, part.nearest(v[asked], 21), strict=True):
        own = [x for x in ids if x != i][:20]
        assert len(own) == 20
        found += len({*own} & {x for x in np.argsort(-(v @ v[i]))[:21] if x != i})
    assert found >= 0.95 * 20 * len(asked)
    assert part.scans or part.visited < 0.8 * len(v) * len(asked)  # only rows of visited buckets are looked at


def test_candidates_are_the_rows_of_visited_buckets():
    draw = np.random.default_rng(3)
    v = draw.normal(size=(500, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hashes = neighbours.Hashes(16)
    index = neighbours.Range(hashes, np.arange(500), v, 1.0)
    probes, _, _ = hashes.probes(v[:20], 40)
    codes = hashes.codes(v, 1.0)
    for j in range(20):
        want = [i for i in range(500) if any(codes[t, i] in probes[t, j] for t in range(len(codes)))]
        assert index.candidates(probes[:, j]).tolist() == want and len(want) < 500
        assert codes[0, j] == probes[0, j, 0]  # the own bucket comes first


def test_a_known_bound_saves_visits(monkeypatch):
    """What earlier rows gave bounds the search of later ones; compacting on the way changes nothing."""
    draw = np.random.default_rng(6)
    v = draw.normal(size=(6000, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    queries, rows = v[:40], v[40:]
    scores = queries.astype(float) @ rows.astype(float).T
    bound = np.sort(scores, axis=1)[:, -5]
    part = neighbours.Part(neighbours.Hashes(16), np.arange(len(rows)), rows)
    part.search(queries, 20)
    alone, part.visited = part.visited, 0
    which, ids, found = part.search(queries, 20, bound - 1e-9)
    assert part.visited < 0.7 * alone
    assert len(which) >= 0.9 * 5 * len(queries) and (found >= bound[which] - 1e-6).all()
    monkeypatch.setattr(neighbours, "PRODUCTS", 500)
    again = part.search(queries, 20, bound - 1e-9)
    assert all(np.array_equal(x, y) for x, y in zip(again, (which, ids, found), strict=True))


def test_nearest_in_waves(spark):
    """Parts are searched in waves; later ones know what the earlier found."""
    assert neighbours._waves(3) == [3] and neighbours._waves(20) == [2, 20] and neighbours._waves(100) == [1, 12, 100]
    draw = np.random.default_rng(9)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(draw.normal(size=(2000, 12)) * draw.lognormal(0, 0.3, (2000, 1)))]
    got = {}
    for r in neighbours.nearest(vectors(spark, rows), part_bytes=200 * 12 * 8).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    want = exact(rows, 20)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert sum(len(got[q].keys() & {v for v, _ in best}) for q, best in want.items()) >= 0.9 * 20 * len(want)
    assert all(abs(got[q].get(v, s) - s) < 1e-9 for q, best in want.items() for v, s in best)
