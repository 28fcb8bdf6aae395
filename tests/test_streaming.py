"""Streams that are stopped and taken up again, and lines that don't parse."""

import pytest

from viaduct.sources.lines import read_lines, write_lines
from viaduct.streaming.progress import chunks, deliver, upsert

SCHEMA = "k string, v long"


def test_files_seen_are_skipped_and_state_goes_on(spark, tmp_path):
    from pyspark.sql import functions as F

    path, root = str(tmp_path / "in"), str(tmp_path / "job")
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    counts = lambda: upsert(chunks(spark, path, SCHEMA).groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")), "k", root=root)
    add([("a", 1), ("b", 2)])
    assert sorted(map(tuple, counts().collect())) == [("a", 1, 1), ("b", 1, 2)]
    add([("a", 7), (None, None)])
    assert sorted(map(str, counts().collect())) == sorted(["Row(k='a', n=2, top=7)", "Row(k='b', n=1, top=2)", "Row(k=None, n=1, top=None)"])


def test_delivery_gives_each_file_once(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "job")
    for i in range(3):
        spark.createDataFrame([("x", i)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    for _ in range(2):
        found = deliver(chunks(spark, path, SCHEMA), root=root)
        assert sorted(r.v for r in found.collect()) == [0, 1, 2]
    assert found.select("batch").distinct().count() == 3


def test_lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = [("a", 1), (None, 2), ("", None)]
    write_lines(spark.createDataFrame(rows, SCHEMA), path)
    assert sorted(map(str, map(tuple, read_lines(spark, path, SCHEMA).collect()))) == sorted(map(str, rows))
    (tmp_path / "bad.json").write_text('\n{"k": "a", "v": 1}\n\n{"k": ')
    with pytest.raises(Exception, match="MALFORMED|parse"):
        read_lines(spark, str(tmp_path / "bad.json"), SCHEMA).collect()
