"""Captured pages: following cursors, offsets over restarts, and writes that fail."""

import json

import pytest
from pyspark.sql import functions as F

from lakeloom.sources import captured


def pages(spark, *rows):
    return spark.createDataFrame([(n, json.dumps({"next": after, "items": list(found)})) for n, after, found in rows], "name string, content string")


def read(df):
    return [(r.page, r.position, r["item"]) for r in df.collect()]


def test_cursors_are_followed_as_far_as_pages_are(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    captured.capture(pages(spark, ("a", "x", [1, {"k": "é"}]), ("x", "b", []), ("b", "missing", ["z"]), ("other", None, [9])), path)
    assert sorted(read(captured.items(spark, path, "a"))) == [("a", 0, "1"), ("a", 1, '{"k": "é"}'), ("b", 0, '"z"')]
    assert read(captured.items(spark, path, "nowhere")) == []
    captured.capture(pages(spark, ("missing", None, [3]), ("b", "missing", ["new"])), path)
    assert sorted(read(captured.items(spark, path, "b"))) == [("b", 0, '"new"'), ("missing", 0, "3")]


def test_pages_are_dealt_to_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    captured.capture(pages(spark, *((f"p{i}", f"p{i + 1}", [i]) for i in range(9))), path)
    df = captured.items(spark, path, "p0")
    assert df.rdd.getNumPartitions() == 1 and df.count() == 9
    few = spark.read.format("captured").option("path", path).option("first", "p0").option("pages", 2).load()
    assert few.rdd.getNumPartitions() == 5 and few.count() == 9
    with pytest.raises(Exception, match="at least"):
        spark.read.format("captured").option("path", path).option("first", "p0").option("pages", 0).load().count()


def test_a_ring_of_pages_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    captured.capture(pages(spark, ("a", "b", [1]), ("b", "a", [2])), path)
    with pytest.raises(Exception, match="comes again"):
        captured.items(spark, path, "a").count()


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    captured.capture(pages(spark, ("a", "b", [1])), path)
    bad = pages(spark, *((f"q{i}", None, [i]) for i in range(20))).repartition(4).withColumn("content", F.when(F.col("name") == "q7", F.raise_error(F.lit("torn"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="torn|abort|fail"):
        captured.capture(bad, path)
    with pytest.raises(Exception, match="name of a page"):
        captured.capture(pages(spark, ("b", None, [2]), ("../x", None, [3])), path)
    assert len(list((tmp_path / "c" / "writes").iterdir())) == len(list((tmp_path / "c" / "pages").iterdir())) == 1
    assert read(captured.items(spark, path, "a")) == [("a", 0, "1")]
    with pytest.raises(Exception, match="only added"):
        pages(spark, ("a", None, [])).write.format("captured").mode("overwrite").option("path", path).save()


def drain(spark, path, first, out, checkpoint):
    q = captured.items(spark, path, first, stream=True).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()
    assert not q.exception()
    return sorted(r["item"] for r in spark.read.parquet(out).collect())


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("c", "out", "checkpoint"))
    captured.capture(pages(spark, ("a", "b", [1, 2]), ("b", "c", [3])), path)
    assert drain(spark, path, "a", out, checkpoint) == ["1", "2", "3"]
    assert drain(spark, path, "a", out, checkpoint) == ["1", "2", "3"]  # nothing new
    captured.capture(pages(spark, ("c", "d", [4]), ("d", None, [5])), path)
    assert drain(spark, path, "a", out, checkpoint) == ["1", "2", "3", "4", "5"]
    for f in (tmp_path / "c" / "progress").iterdir():
        f.unlink()  # the folder's note of the progress is no more than a shortcut
    assert drain(spark, path, "a", out, checkpoint) == ["1", "2", "3", "4", "5"]
