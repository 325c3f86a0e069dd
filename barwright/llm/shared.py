"""What several operators need: the shared folder, written intermediate tables, file access."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators count words: space, tab, line feed, VT, FF, carriage return.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a single machine (master ``local``), where the session names none, a temporary folder is
    set. Elsewhere that is an error: executors would write to disks that others do not see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="barwright-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Within it, jobs pass rows to Python in batches of ``rows`` whole texts at most (and of 64 MB, as
    Spark has it anyway), where the session has the default of 10,000: both sides hold some batches at
    a time. The session's setting is as before afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if before == "10000":
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before == "10000":
            spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and no longer dependent on
    shuffle files of executors that may be lost."""
    spark, path = df.sparkSession, workspace(df.sparkSession, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined_with_one(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` (``total`` of them) with ``keys``: one row a key, whose column ``n`` says
    how many rows have it.

    A key with over a thousandth of all rows would fill one task. There are under a thousand such
    keys, so they are broadcast and their rows stay where they are; the others are shuffled.
    """
    many = F.col("n") * 1000 > total
    hot, rest = keys.where(many).drop("n"), keys.where(~many).drop("n")
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on)
    return cold.unionByName(rows.join(F.broadcast(hot), on))


def columns_of(df: DataFrame) -> list:
    """All columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def one_struct(df: DataFrame, name: str = "row"):
    """All columns as one, so that no other column's name can clash with theirs."""
    return F.struct(*columns_of(df)).alias(name)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI that every executor reaches. ``s3a`` means ``s3``."""
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    if "://" not in uri:
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: list[bytes]) -> None:
    """Writes a file under a name that no other attempt uses, so a retried task never meets it."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        for part in data:
            out.write(part)


def get_bytes(uri: str, start: int, length: int) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_file(path) as file:
        return file.read_at(length, start)


def in_larger_parts(df: DataFrame, column: str, part_bytes: int) -> DataFrame:
    """Joins input splits (without a shuffle) until each holds about ``part_bytes`` of the column, as
    summed over all rows. For operators whose result is better over a larger group of rows."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // part_bytes)))
