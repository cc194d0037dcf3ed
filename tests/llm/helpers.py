"""Small tables and plain reference forms that the tests share."""

import duckdb
from pyspark.sql.types import LongType, StringType, StructField, StructType

DATA = "/root/testdata/sf0.001"

DOCS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
    # names that operators give to columns of their own
    StructField("score", StringType()), StructField("spans", StringType()), StructField("fp", StringType()),
    StructField("host", StringType()), StructField("length", StringType()),
])


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1]) if r[1] is not None else None, *["x"] * 5) for r in rows]
    return spark.createDataFrame(full, DOCS)


#: Null and empty texts, white space, other scripts, repeated rows, a null id, and a very long text.
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "日本語 のテキスト です"), (5, "one two three"), (5, "one two three"),
    (None, "one two three"), (6, "word " * 60_000), (7, "!!! *** 123"), (8, "a\u0085b  c 　 d"), (9, "One  TWO three"),
]


def given(name):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet' ORDER BY 1").fetchall()
