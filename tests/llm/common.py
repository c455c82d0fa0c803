"""Small tables that hold the awkward cases every corpus operator must survive."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.IntegerType()), T.StructField("row", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("gone", T.IntegerType()), T.StructField("_text", T.StringType()),
])


def docs(spark, rows):
    """rows: (doc_id, text, source); the further columns clash with inner names."""
    return spark.createDataFrame([(i, t, None if s is None else "en", s, None if t is None else len(t), "x", "y", 3, "z") for i, t, s in rows], DOCS)


LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
AWKWARD = [(1, None, "a"), (2, "", "a"), (3, "  \n\t\n", None), (None, "no id at all, mail a@b.org", "b"), (5, LONG, "b"), (6, "same text here", "c"), (6, "same text here", "c"), (7, "same text here", None), (8, "😀 éè password = hunter2hunter2", "c")]


def records(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
