"""Quoted CSV in many blocks, against Spark's reader of whole files."""

import random

import pytest
from pyspark.sql.types import StructType

from scorewright.sources.quoted_csv import read_quoted_csv

SCHEMA = StructType().add("id", "long").add("reason", "string").add("p", "double")
OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
BLOCK = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get(BLOCK)
    costs = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda size: spark.conf.set(BLOCK, size)
    spark.conf.set(BLOCK, before)
    spark.conf.set("spark.sql.files.openCostInBytes", costs)


def both(spark, path):
    key = lambda r: (r["id"] is None, r["id"] or 0, r["reason"] or "", r["p"] or 0)
    want = sorted(spark.read.schema(SCHEMA).options(**OPTIONS).csv(path).collect(), key=key)
    got = sorted(read_quoted_csv(spark, path, SCHEMA).collect(), key=key)
    return got, want


@pytest.mark.parametrize("size", ["64b", "333b", "1m"])
def test_records_are_those_of_the_reader_of_whole_files(spark, tmp_path, small_blocks, size):
    rng = random.Random(size)
    bits = ["plain", 'a "quoted" word', "two\nlines", "\n\n", ",", '"', "é世", "x" * 150, "", "end\n", '""', "\r\n in it"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(4))), i / 4) for i in range(120)]
    rows += [(1000, None, None), (None, "no id", 1.0)]
    path = str(tmp_path / "log")
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.options(**OPTIONS).csv(path)
    small_blocks(size)
    got, want = both(spark, path)
    assert got == want and len(got) == 122
    if size == "64b":
        assert spark.read.text(path).rdd.getNumPartitions() > 20


def test_odd_files(spark, tmp_path, small_blocks):
    files = {
        "empty": "",
        "header": "id,reason,p\n",
        "blank": 'id,reason,p\n\n1,a,2.0\n\n\n2,"b\n\nc",3.0',
        "crlf": 'id,reason,p\r\n1,a,2.0\r\n2,"b",3.0\r\n',
        "long": 'id,reason,p\n1,"' + "line\n" * 200 + '",2.0\n3,after,4.0\n',
        "bad": "id,reason,p\nx,y,z\n1\n",
    }
    for name, text in files.items():
        path = tmp_path / f"{name}.csv"
        path.write_bytes(text.encode())
        small_blocks("50b")
        got, want = both(spark, str(path))
        assert got == want, name


def test_several_tasks_read_one_file(spark, tmp_path, small_blocks):
    path = tmp_path / "one.csv"
    path.write_text("id,reason,p\n" + "".join(f'{i},"a\n""b""\n",1.5\n' for i in range(500)))
    small_blocks("1k")
    df = read_quoted_csv(spark, str(path), SCHEMA)
    assert df.rdd.getNumPartitions() > 5
    assert df.count() == 500 and df.filter('reason = "a\\n\\"b\\"\\n"').count() == 500
