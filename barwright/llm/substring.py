"""Repeated passages, by hashing lines and sentences.

A text's units are its lines, and the sentences of lines that have several. A unit is normalised
(lower case, ASCII white space runs as one space) and hashed to 128 bits. Of each digest the earliest
occurrence (least rank, then place) is kept; every other one is a later occurrence. Later occurrences
that follow each other in a text form a run, and runs are removed, however short. A caller may keep
runs of under ``least`` words. Runs keep their code-point offsets in the original text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.llm.shared import SPACE_CHARS, joined_with_one, one_struct, written

#: A unit ends after a line feed, or after blanks behind the end of a sentence.
UNIT = r"""[^\n]*?(?:[.!?]["')\]]*[ \t]+|\n)|[^\n]+"""
_UNIT = re.compile(UNIT)
_SPACE = re.compile(f"[{SPACE_CHARS}]+")


def units(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit with a word; offsets count code points."""
    out = []
    for m in _UNIT.finditer(text or ""):
        words = [w for w in _SPACE.split(m[0]) if w]
        if words:
            out.append((m.start(), m.end(), len(words), xxhash.xxh128_digest(" ".join(words).lower().encode("utf-8", "surrogatepass"))))
    return out


def runs(found: list[tuple[int, int, int, int]], least: int) -> list[tuple[int, int]]:
    """Offsets of runs of repeats. ``found``: (number of the unit, start, end, words), sorted."""
    out, held = [], []
    for unit in [*found, (-1, 0, 0, 0)]:
        if held and unit[0] != held[-1][0] + 1:
            if sum(u[3] for u in held) >= least:
                out.append((held[0][1], held[-1][2]))
            held = []
        held.append(unit)
    return out


def _keyed(docs: DataFrame, rank: str | None) -> DataFrame:
    """Place in the order of documents, text, and the row: rank (null last), doc_id (null last), and
    the text's hash, by which documents of one doc_id are told apart and ordered."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    text = F.col("text").cast("string")
    first = F.coalesce(F.col(rank).cast("long"), F.lit(2**63 - 1)) if rank else F.lit(0).cast("long")
    place = F.struct(first.alias("rank"), F.col("doc_id").isNull().alias("none"), doc.alias("doc"), F.xxhash64(text).alias("hash"))
    return docs.select(place.alias("place"), text.alias("text"), one_struct(docs))


_PLACE = "struct<rank:bigint,none:boolean,doc:bigint,hash:bigint>"


def later_units(keyed: DataFrame) -> DataFrame:
    """place and nrs: for each document the units (by number) that an earlier document has.

    Only a text's first unit of a digest is sent out, as digest, place and number; that later ones in
    the same text repeat it is plain in the text itself. The join's rows are written before they are
    gathered by document.
    """

    def run(rows):
        for batch in rows:
            for i in range(0, len(batch), 1024):
                some = batch.slice(i, 1024)
                at, nrs, digests = [], [], []
                for row, t in enumerate(some.column(1).to_pylist()):
                    first = {}
                    for nr, (*_, digest) in enumerate(units(t)):
                        first.setdefault(digest, nr)
                    at += [row] * len(first)
                    nrs += first.values()
                    digests += first
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at, pa.int64())), pa.array(nrs, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["place", "nr", "d1", "d2"])

    made = written(keyed.select("place", "text").mapInArrow(run, f"place {_PLACE}, nr int, d1 long, d2 long"), "units")
    first = made.groupBy("d1", "d2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = joined_with_one(made, first, ["d1", "d2"], made.count()).where("place > first").select("place", "nr")
    return written(later, "units-later").groupBy("place").agg(F.collect_set("nr").alias("nrs"))


def spans_of(text: str | None, later: list[int], least: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Runs of later occurrences in a text, given the units that earlier documents have; and those of
    them that are to be removed."""
    found = units(text)
    gone = {found[nr][3] for nr in later}
    seen, repeated = set(), []
    for nr, (start, end, words, digest) in enumerate(found):
        if digest in gone or digest in seen:
            repeated.append((nr, start, end, words))
        seen.add(digest)
    return runs(repeated, 1), runs(repeated, least)


def without_repeats(docs: DataFrame, rank: str | None = None, least: int = 1) -> DataFrame:
    """All rows and columns, with removed runs cut from ``text``; ``later``, the spans of all later
    occurrences in the original text; and ``removed``, those of them that were cut (equal to ``later``
    unless ``least`` is above 1). Both are empty if there are none.

    Documents rank by ``rank`` (a column, null last; none: all alike), then doc_id (null last), then
    the text's hash; places in a text follow. Rows with equal rank, doc_id and text are one document:
    they are repeats of others, not of each other. A doc_id with several texts is several documents.
    Null and empty texts have no unit, texts of any length are read whole, and an empty table gives no
    rows. Columns named ``later`` or ``removed`` are replaced; other names cannot clash.
    """
    keyed, extra = _keyed(docs, rank), ("later", "removed")
    nrs = later_units(keyed).select(F.col("place").alias("of"), "nrs")
    joined = keyed.join(nrs, F.col("place") == F.col("of"), "left").select("row", "nrs")
    kept = [f for f in docs.schema.fields if f.name not in extra]
    schema = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in kept])
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    for name in extra:
        schema = schema.add(name, spans)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    places, at = [docs.columns.index(f.name) for f in kept], docs.columns.index("text")

    def run(rows):
        for batch in rows:
            for i in range(0, len(batch), 1024):
                some = batch.slice(i, 1024)
                columns = some.column(0).flatten()
                texts = columns[at].cast(pa.string()).to_pylist()
                found: tuple[list, list] = ([], [])
                for j, nrs_ in enumerate(some.column(1).to_pylist()):
                    later, removed = spans_of(texts[j], nrs_ or [], least)
                    for out, x in zip(found, (later, removed), strict=True):
                        out.append([{"start": s, "end": e} for s, e in x])
                    for s, e in reversed(removed):
                        texts[j] = texts[j][:s] + texts[j][e:]
                made = [pa.array(texts, pa.string()) if p == at else columns[p] for p in places]
                yield pa.RecordBatch.from_arrays([*made, *(pa.array(x, kind) for x in found)], names=schema.names)

    return joined.mapInArrow(run, schema)


def repeats(docs: DataFrame, rank: str | None = None, least: int = 1) -> DataFrame:
    """doc_id and spans (start, end) of every row that has a removed run."""
    out = without_repeats(docs.select("doc_id", "text", *([rank] if rank and rank not in ("doc_id", "text") else [])), rank, least)
    return out.select("doc_id", F.col("removed").alias("spans")).where("size(spans) > 0")
