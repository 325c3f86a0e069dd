"""Token-id files: whole texts as ids in coded blocks, written in order of doc_id and read back.

A file holds a run of documents:

    "ACM3" | documents (u32) | end id (u32) | blocks (u32)
    size of directory (u32) | directory, deflated: doc_ids (i64 each), whether null (u8 each), ids (u64 each)
    size of prior (u32) | what the blocks' models start from
    for each block: size (u32), block of :mod:`range_codec`
    CRC-32 of all before (u32)

Files are written by executors under names no other attempt uses, in the shared folder. A table
beside them, written by Spark, lists the files that belong to the result; a file of a lost or
repeated attempt is in no table.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm import range_codec
from barwright.llm.shared import filesystem, put_file, workspace, written
from barwright.llm.tokens import batches, encoder, forget, give_back

_MAGIC = b"ACM3"
#: Ids in a file, about: what a task holds at once, and as many as are coded in step. A longer document
#: has a file of its own.
FILE_IDS = range_codec.BLOCK * range_codec.LANES
#: Bytes of text that a task encodes, about: at some 2.4 an id, most tasks write one file.
PART_BYTES = 27 << 20

_LISTED = "part int, nr int, path string, first_doc long, n_docs long, n_ids long, n_bytes long"


def pack_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, end_id: int) -> bytes:
    prior, blocks = range_codec.encode(ids)
    directory = zlib.compress(
        np.array([d or 0 for d in doc_ids], "<i8").tobytes()
        + np.array([d is None for d in doc_ids], np.uint8).tobytes()
        + np.asarray(counts, "<u8").tobytes()
    )
    parts = [_MAGIC, struct.pack("<IIII", len(doc_ids), end_id, len(blocks), len(directory)), directory, struct.pack("<I", len(prior)), prior]
    for b in blocks:
        parts += [struct.pack("<I", len(b)), b]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, all ids; :class:`range_codec.BlockError` if damaged."""
    if data[:4] != _MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise range_codec.BlockError("not a whole token file")
    n, _, n_blocks, size = struct.unpack_from("<IIII", data, 4)
    at = 20 + size
    directory = zlib.decompress(data[20:at])
    docs = np.frombuffer(directory, "<i8", n)
    null = np.frombuffer(directory, np.uint8, n, 8 * n)
    counts = np.frombuffer(directory, "<u8", n, 9 * n).astype(np.int64)
    (length,) = struct.unpack_from("<I", data, at)
    prior = data[at + 4 : at + 4 + length]
    at, blocks = at + 4 + length, []
    for _ in range(n_blocks):
        (length,) = struct.unpack_from("<I", data, at)
        blocks.append(data[at + 4 : at + 4 + length])
        at += 4 + length
    return [None if x else int(d) for d, x in zip(docs, null, strict=True)], counts, range_codec.decode(prior, blocks)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encodes every text and writes the ids, ``end_id`` after each document.

    Rows go by doc_id (null first) into sorted ranges, as many as the texts' bytes ask for; each task
    writes one or more files. Repeated doc_ids stay separate documents, in the order of their texts'
    hashes; a null text is empty and has the end id alone. Texts of any length are whole: one that is
    longer than a file has a file of its own. An empty table gives no file. Other columns are ignored.
    Returns the list of files in order.
    """
    folder = folder or workspace(docs.sparkSession, "ids")

    def encode(rows):
        from pyspark import TaskContext

        give_back()
        part, nr, tok = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        held: list[np.ndarray] = []
        names: list[int | None] = []
        counts: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal nr
            ids = np.concatenate(held)
            held.clear()
            data = pack_file(names, np.concatenate(counts), ids, end_id)
            put_file(path := f"{folder}/part-{part:06d}-{nr:05d}-{uuid.uuid4().hex}.acm", [data])
            row = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "nr": pa.array([nr], pa.int32()), "path": [path], "first_doc": pa.array([names[0]], pa.int64()), "n_docs": [len(names)], "n_ids": [len(ids)], "n_bytes": [len(data)]}
            )
            nr += 1
            names.clear(), counts.clear()
            return row

        for batch in rows:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in batches(texts):
                found, n = tok.encode(texts.slice(a, b - a))
                if size and size + len(found) + len(n) > FILE_IDS:
                    yield close()
                    size = 0
                kind = found.dtype if end_id <= np.iinfo(found.dtype).max else np.uint32
                held.append(np.insert(found.astype(kind, copy=False), np.cumsum(n), end_id))
                names.extend(ids.slice(a, b - a).to_pylist())
                counts.append(n + 1)
                size += len(held[-1])
        if names:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    full, cores = -(-total // PART_BYTES), docs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, full, min(cores, -(-8 * total // PART_BYTES)))  # fewer texts still go to all cores
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    return written(rows.mapInArrow(encode, _LISTED), "ids-files")


def read_ids(files: DataFrame) -> DataFrame:
    """Documents of the listed files: doc_id, start (ids of all documents before it), n_ids, ids
    (little-endian unsigned 32-bit). Some files to a task, whole; a damaged one raises."""
    order = Window.orderBy("part", "nr").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    n = max(1, files.count())  # a row for each file, of some 11 million ids

    def decode(rows):
        forget()  # a worker that wrote files holds their encoder
        for batch in rows:
            for path, size, base in zip(*(batch.column(c).to_pylist() for c in ("path", "n_bytes", "base")), strict=True):
                store, at = filesystem(path)
                with store.open_input_file(at) as file:
                    data = file.read(size)
                docs, counts, ids = unpack_file(data)
                ends = np.cumsum(counts)
                for i in range(0, len(docs), 2048):
                    e = ends[i : i + 2048]
                    s = e - counts[i : i + 2048]
                    some = ids[s[0] : e[-1]].astype("<u4").tobytes()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(docs[i : i + 2048], pa.int64()),
                            "start": pa.array(base + s),
                            "n_ids": pa.array(counts[i : i + 2048]),
                            "ids": pa.array([some[4 * (a - s[0]) : 4 * (b - s[0])] for a, b in zip(s, e, strict=True)], pa.binary()),
                        }
                    )

    return placed.select("path", "n_bytes", "base").repartition(n).mapInArrow(decode, "doc_id long, start long, n_ids long, ids binary")
