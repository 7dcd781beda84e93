"""CSV by record: round trips, files of other writers, records across blocks."""

import csv
import os
import random
import tempfile

import pandas as pd
import pytest

from loanlens.sources import csv_records as C
from loanlens.sources import io as lio

TEXTS = ["plain", 'say "hi", ok', "two\nlines", "", None, " pad ", "cr\r\nlf", "lone\rcr", '"', '""', "\n", ",", "a\n\n\nb", "\\", '\\"', "ä 日本", "NULL",
         "# x", "\t", " ", "'", "id,s,x", "x" * 5000 + '\n"' + "y" * 5000]
SCHEMA = "id long, s string, x double"


def _new():
    return os.path.join(tempfile.mkdtemp(prefix="loanlens-csv-"), "f")


@pytest.fixture()
def small_blocks(spark):
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _rows(n=200):
    rng = random.Random(n)
    return [(i, TEXTS[i % len(TEXTS)] if i < len(TEXTS) else "".join(rng.choice('ab",\n\r \\') for _ in range(rng.randint(0, 30))), i / 2) for i in range(n)]


def test_round_trip_keeps_every_text(spark):
    rows, path = _rows(), _new()
    lio.write_dataset(spark.createDataFrame(rows, SCHEMA).repartition(3), path, "csv")
    assert sorted(tuple(r) for r in lio.read_dataset(spark, path, "csv", SCHEMA).collect()) == rows


def test_records_across_blocks_of_one_file(spark, small_blocks):
    rows, path = _rows(400), _new()
    lio.write_dataset(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, "csv")
    assert C._lines(spark, [path]).select("block").distinct().count() > 10
    assert sorted(tuple(r) for r in lio.read_dataset(spark, path, "csv", SCHEMA).collect()) == rows


def test_files_of_other_writers(spark):
    rows, path = _rows(60), _new() + ".csv"
    pd.DataFrame(rows, columns=["id", "s", "x"]).to_csv(path, index=False)
    want = [(i, s or None, x) for i, s, x in rows]  # it writes empty text and null alike
    assert sorted(tuple(r) for r in lio.read_dataset(spark, path, "csv", SCHEMA).collect()) == want
    crlf = _new() + ".csv"
    with open(crlf, "w", newline="") as f:
        w = csv.writer(f, lineterminator="\r\n")
        w.writerows([["id", 'a "b", c'], [1, "x\r\ny"], [2, "z"]])
    assert [tuple(r) for r in lio.read_dataset(spark, crlf).orderBy("id").collect()] == [(1, "x\r\ny"), (2, "z")]
    assert lio.read_dataset(spark, crlf).columns == ["id", 'a "b", c']


def test_one_column(spark):
    path = _new()
    with pytest.raises(ValueError, match="one column"):
        lio.write_dataset(spark.createDataFrame([(None,), ("",)], "s string"), path, "csv")
    lio.write_dataset(spark.createDataFrame([("",), ("a\n",)], "s string").coalesce(1), path, "csv")
    assert {r.s for r in lio.read_dataset(spark, path, "csv", "s string").collect()} == {"", "a\n"}
    with open(path + ".csv", "w") as f:
        f.write("s\nx\n\n\"\"\n")
    assert sorted((r.s for r in lio.read_dataset(spark, path + ".csv", "csv", "s string").collect()), key=str) == ["", None, "x"]


def test_inferred_types(spark):
    path = _new()
    rows = [(1, 2**40, 1.5, True, "2024-01-31", "x\ny", None), (2, 1, 2.0, False, "2024-02-01", "", None)]
    lio.write_dataset(spark.createDataFrame(rows, "a int, b long, c double, d boolean, e string, f string, g string"), path, "csv")
    assert [t for _, t in lio.read_dataset(spark, path).dtypes] == ["int", "bigint", "double", "boolean", "date", "string", "string"]


def test_malformed_records_are_kept_apart(spark):
    for text in ('a,b\n1,x\nz,y\n2\n3,q,r\n4,"m"\n', 'a,b\n1,x\nz,y\n2\n3,q,r\n4,"m\nn"\n'):
        path = _new()
        with open(path, "w") as f:
            f.write(text)
        got = lio.read_dataset(spark, path, "csv", "a int, b string", malformed="bad").collect()
        assert {r.bad for r in got} == {None, "z,y", "2", "3,q,r"} and len(got) == 5
        assert {(r.a, r.b) for r in got if r.bad is None} == {(1, "x"), (4, text[text.index('"') + 1:-2])}
    with pytest.raises(Exception):
        lio.read_dataset(spark, _new(), "csv")


def test_header_alone(spark):
    path = _new()
    with open(path, "w") as f:
        f.write("a,b\n")
    got = lio.read_dataset(spark, path)
    assert got.columns == ["a", "b"] and got.collect() == []
