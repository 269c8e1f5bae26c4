"""One CSV file of many partitions: its bytes are those of one plain writer; nothing else stays, failures leave the old file."""

import csv
import io
import os

import pytest
from pyspark.sql import functions as F

from critmill.sources.csv_file import export_csv_file


def plain(header, rows):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue().encode()


def table(spark, n):
    texts = F.element_at(F.array(*map(F.lit, ["plain", 'a "q"', "x,y", "two\nlines", "é漢", "cr\rlf"])), (F.col("id") % 6 + 1).cast("int"))
    return spark.range(n).select("id", texts.alias("text"), F.when(F.col("id") % 5 > 0, F.col("id") * 2).alias("n"))


def test_bytes_of_many_partitions(spark, tmp_path):
    t = table(spark, 3000).repartition(7).orderBy("id")
    path = f"{tmp_path}/deep/out.csv"
    for _ in range(2):  # the second replaces the first
        export_csv_file(t, path, ["id", "a, b", "n"])
        rows = [(r.id, r.text, r.n) for r in t.collect()]
        with open(path, "rb") as f:
            assert f.read() == plain(["id", "a, b", "n"], rows)
        assert os.listdir(f"{tmp_path}/deep") == ["out.csv"]
    export_csv_file(t.orderBy(F.desc("id")).filter("id < 10"), f"file://{path}")
    with open(path, "rb") as f:
        assert f.read() == plain(["id", "text", "n"], rows[9::-1])


def test_empty_table_has_its_header(spark, tmp_path):
    for t in (table(spark, 10).filter("id < 0"), spark.createDataFrame([], "id long, text string, n long")):
        export_csv_file(t, f"{tmp_path}/out.csv")
        assert (tmp_path / "out.csv").read_bytes() == b"id,text,n\r\n"


def test_failed_task_leaves_the_old_file(spark, tmp_path):
    export_csv_file(table(spark, 3), f"{tmp_path}/out.csv")
    before = (tmp_path / "out.csv").read_bytes()
    broken = table(spark, 100).repartition(3).withColumn("n", F.when(F.col("id") == 57, F.raise_error(F.lit("broken"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken"):
        export_csv_file(broken, f"{tmp_path}/out.csv")
    assert (tmp_path / "out.csv").read_bytes() == before and os.listdir(tmp_path) == ["out.csv"]
