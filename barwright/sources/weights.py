"""Reading and checking weight tables: symbol, dt, weight, price."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.functions.scalars import rnd

REQUIRED = ("symbol", "dt", "weight", "price")
_TIME = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
CSV = "dt string, symbol string, weight double, price double"


def as_timestamp(df: DataFrame, name: str = "dt"):
    """The column as a timestamp without zone. Whole numbers are epoch seconds; in a string the first
    ``yyyy-MM-dd HH:mm:ss`` counts, whatever stands around it, and a string without one is an error."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        return c
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(kind, T.IntegralType):
        return F.timestamp_seconds(c).cast("timestamp_ntz")
    if isinstance(kind, T.StringType):
        found = F.regexp_extract(c, _TIME, 0)
        return F.to_timestamp_ntz(F.when(found != "", found).otherwise(c), F.lit("yyyy-MM-dd HH:mm:ss"))
    raise ValueError(f"dt can't be of type {kind.simpleString()}")


def normalise(df: DataFrame, digits: int = 2, check: bool = True) -> DataFrame:
    """The four columns, typed, weights rounded. With ``check``, one pass finds nulls in them."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = df.select(
        F.col("symbol").cast("string").alias("symbol"),
        as_timestamp(df).alias("dt"),
        rnd(F.col("weight").cast("double"), digits).alias("weight"),
        F.col("price").cast("double").alias("price"),
    )
    if check:
        bad = out.where(" or ".join(f"{c} is null" for c in REQUIRED) + " or isnan(weight) or isnan(price)").limit(1).count()
        if bad:
            raise ValueError("null in symbol, dt, weight or price")
    return out


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    """Also files with nanosecond times, as pandas writes them; Spark reads those as whole numbers."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "NANOS" not in str(e):
            raise
    key = "spark.sql.legacy.parquet.nanosAsLong"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        found = spark.read.parquet(path).schema
    finally:
        spark.conf.set(key, before)
    # with the schema given, whole numbers are read without the setting
    return spark.read.schema(found).parquet(path).withColumn("dt", F.timestamp_micros(F.floor(F.col("dt") / 1000)).cast("timestamp_ntz"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """A weight table from a CSV (with header), Parquet, or Feather/Arrow file, by its extension."""
    kind = os.path.splitext(path)[1].lower()
    if kind == ".csv":
        header = spark.read.option("header", True).csv(path).columns
        schema = ", ".join(f"`{c}` {dict(x.split(' ') for x in CSV.split(', ')).get(c, 'string')}" for c in header)
        return spark.read.schema(schema).option("header", True).csv(path)
    if kind == ".parquet":
        return _parquet(spark, path)
    if kind in (".feather", ".arrow", ".ipc"):
        from pyarrow import feather

        return spark.createDataFrame(feather.read_table(path))  # Spark has no Feather source
    raise ValueError(f"unsupported file type: {kind or path}")


def from_any(spark: SparkSession, data) -> DataFrame:
    """A Spark, pandas or Arrow table, anything with ``to_arrow()``, or the path of a file."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, (str, os.PathLike)):
        return read_weights(spark, os.fspath(data))
    if hasattr(data, "collect") and hasattr(data, "collect_schema"):  # a lazy frame
        data = data.collect()
    if hasattr(data, "to_arrow"):
        data = data.to_arrow()
    return spark.createDataFrame(data)
