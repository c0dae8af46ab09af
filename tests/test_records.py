"""Delimited files against a plain reader: quotes, empty fields, line breaks, splits and line ends."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from ledgerlens.sources import records, tables

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("a", T.StringType()),
                       T.StructField("b", T.StringType())])


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def written(rows, end="\n"):
    def field(value, rng):
        if value is None:
            return ""
        text = str(value)
        if text == "" or any(c in text for c in ',"\n\r') or rng.random() < 0.3:
            return '"' + text.replace('"', '""') + '"'
        return text

    rng = random.Random(1)
    return "id,a,b" + end + "".join(",".join(field(v, rng) for v in row) + end for row in rows)


def made(seed, breaks=True):
    rng = random.Random(seed)
    odd = ["", None, "x", 'say "hi"', "a,b", "\\", "é🙂", '"', '""', "long " * rng.randint(1, 60)]
    if breaks:
        odd += ["two\nlines", "\n", 'q"\n"\n\nend', "\n" * 400, "r\r\nn", 'x\n"",""\n']
    return [(i, rng.choice(odd), rng.choice(odd)) for i in range(120)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("breaks", [True, False])
def test_equal_to_what_was_written(spark, tmp_path, small_splits, seed, breaks):
    rows = made(seed, breaks)
    path = tmp_path / "t.csv"
    path.write_bytes(written(rows).encode())
    assert records.breaks_in_quotes(spark, str(path)) == breaks
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 3
    got = tables.read_csv(spark, str(path), SCHEMA)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    # A plain reader agrees, but cannot tell NULL from the empty text.
    plain = list(csv.reader(io.StringIO(path.read_bytes().decode(), newline="")))[1:]
    assert sorted((str(r.id), r.a or "", r.b or "") for r in got.collect()) == sorted(map(tuple, plain))


def test_several_files_and_carriage_returns(spark, tmp_path, small_splits):
    (tmp_path / "in").mkdir()
    rows = [(i, f"l{i}\nm", "" if i % 2 else None) for i in range(60)]
    for part in range(3):
        (tmp_path / "in" / f"{part}.csv").write_bytes(written(rows[part * 20:part * 20 + 20], "\r\n").encode())
    got = tables.read_csv(spark, str(tmp_path / "in"), SCHEMA).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("text", ['1,"x\ny",z\nw,b,c\n', '1,"x\ny",z\n2,b\n', '1,"x\ny",z\n"",b,c\n'])
def test_malformed_records_stop(spark, tmp_path, text):
    path = tmp_path / "t.csv"
    path.write_text("id,a,b\n" + text)
    with pytest.raises(Exception):
        tables.read_csv(spark, str(path), SCHEMA).collect()


def test_no_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,a,b\n")
    assert tables.read_csv(spark, str(path), SCHEMA).collect() == []
    path.write_text('id,"a\na",b\n')
    assert tables.read_csv(spark, str(path), SCHEMA).collect() == []
