import datetime as dt

import pytest
from pyspark.sql import types as T

#: Columns that operators use inside, as extra columns of the input.
CLASHING = "kept component_id keep_id size taken target n_words ids start score text_sha256 key group first bucket n row at rank"

DOCS = [
    (7, "one two three four five six seven", "en", "a"),
    (3, "One two\tthree  four five six SEVEN", "en", "b"),
    (5, None, "en", "b"),
    (6, "", None, None),
    (None, "one two three four five six seven", "de", "a"),
    (9, " \n\t ", "en", "a"),
    (11, "short text", "en", "c"),
    (12, "short text", "en", "c"),
    (12, "short text", "en", "c"),
    (13, " ".join(f"w{i}" for i in range(60000)), "en", "a"),
    (14, " ".join(f"w{i}" for i in range(30000, 60000)), "en", "a"),
    (15, "line one of this text has ten words or more\nélan 日本語 😀\n\nline one of this text has ten words or more", "en", "é"),
    (16, "line one of this text has ten words or more\nother", "en", "b"),
    (-4, "x", "en", "b"),
]


def documents(spark, rows):
    names = CLASHING.split()
    base = [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
    schema = T.StructType(base + [T.StructField(n, T.DateType()) for n in names])
    full = [(*r, None if r[1] is None else len(r[1]), *[dt.date(2020, 1, 1)] * len(names)) for r in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])


def texts_of(sf_dir):
    import duckdb

    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY 1").fetchall()
