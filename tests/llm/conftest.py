"""The documents of the smallest table, with rows of every odd kind added."""

import pyarrow.parquet as pq
import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, doc int, n string, size string, words string, token string, score string, key string"


@pytest.fixture(scope="session")
def rows():
    t = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    base = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in t[:120]]
    long = " ".join(f"w{i % 37}x{i * i % 101}" for i in range(9000))
    odd = [
        (9001, None, "en", "src0"),
        (9002, "", None, None),
        (9003, " \t\n", "en", "src1"),
        (9004, "one two", "en", "src1"),
        (9005, long, "en", "src0"),
        (9006, long + " tail", None, "src0"),
        (9007, base[3][1], "en", None),
        (9008, base[3][1].upper(), "en", "src2"),
        (9004, "one two", "en", "src1"),
        (9009, "one two", "fr", "src1"),
        (None, base[5][1], "en", "src3"),
        (None, None, None, None),
        (9010, "café\u00a0x \u2003 naïve # $ !! " * 6, "fr", "src9"),
    ]
    return base + odd


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, "y", "z", "w", "t", "s", "k") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet").union(spark.createDataFrame([(None, 1, 0), (9005, None, None), (9006, 1, 0), (9006, 0, 0)], "doc_id long, quality int, toxic int"))
