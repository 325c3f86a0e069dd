import pytest


@pytest.fixture
def documents(spark):
    """Builds a documents table; extra columns clash with names that operators use inside."""

    def make(rows, clash=True):
        df = spark.createDataFrame(
            [(d, t, lang, s, len(t or "")) for d, t, lang, s in rows],
            "doc_id long, text string, lang string, source string, n_chars long",
        )
        if clash:
            from pyspark.sql import functions as F

            for name in ("fp", "id", "size", "start", "words", "shard", "h", "component_id", "spans", "sha1", "_doc"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture
def hard_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    same = "one two three four five six seven eight nine ten eleven twelve. And some more words here to be long enough for a passage of its own."
    return [
        (0, same, "en", "a"),
        (1, same, "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (4, " \t\n", "fr", "b"),
        (5, long, "de", "c"),
        (6, "short", "es", None),
        (6, "short", "es", None),
        (7, same + " tail", "en", "zé"),
        (None, "no number", "en", "a"),
    ]


NO_ROWS: list = []
