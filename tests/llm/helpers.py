"""Small tables that every operator must survive, and plain versions to compare with."""

from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEXTS = [
    (1, "The first line.\nThe second line, with more words in it."),
    (2, "The first line. The second line, with more words in it."),
    (3, "The  first line.\tThe second line, with more words in it.  "),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "one"),
    (8, "ONE"),
    (9, "One two three"),
    (10, LONG),
    (11, LONG + " tail"),
    (12, "Größe, naïve café, 😀 and \x85 odd ​ signs   end"),
    (13, "a" * 5000),
    (14, "1" * 5000),
    (7, "one"),
    (7, "one"),
    (None, "a text without an id, with enough words to make shingles"),
    (None, None),
    (15, "a text without an id, with enough words to make shingles"),
]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for their own columns
    *[T.StructField(n, T.StringType()) for n in ("key", "kept", "score", "ids", "digest", "shard", "slot", "pii", "secrets", "n", "_text", "label")],
])


def documents(spark, rows=None):
    rows = TEXTS if rows is None else rows
    data = [(k, t, "en", None, None if t is None else len(t), *["x"] * 12) for k, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
