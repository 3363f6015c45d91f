"""The data source of document pages: ranges, retries, error rows, and streams that resume."""

import os
import time

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from lodestone.sources import pages

TRIES: dict = {}


class Book:
    """A text file whose pages are parted by form feeds; a page that says so fails always or once."""

    def __init__(self, f):
        body = bytes(f.read())
        if body.startswith(b"broken"):
            raise ValueError("not a document")
        self.parts = body.split(b"\f") if body else []
        self.pages = len(self.parts)

    def text(self, i):
        part = self.parts[i].decode()
        if part == "!":
            raise RuntimeError("broken page")
        if part == "?" and not TRIES.setdefault((TaskContext.get().taskAttemptId(), i), 0):
            TRIES[TaskContext.get().taskAttemptId(), i] = 1
            raise OSError("once")
        return part


@pytest.fixture()
def books(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(pages.page_source(Book, "books"))


def put(folder, name, *parts):
    (folder / name).write_bytes("\f".join(parts).encode())
    time.sleep(0.01)


def test_ranges_retries_and_errors(spark, books, tmp_path):
    put(tmp_path, "a.book", "one", "!", "two", "?")
    put(tmp_path, "b.book", "broken")
    put(tmp_path, "c.book")
    put(tmp_path, ".hidden", "x")
    big = [f"p{i}" for i in range(10_000)]
    put(tmp_path, "big.book", *big)
    read = spark.read.format("books").option("path", str(tmp_path)).option("large", 20_000).option("pages", 500).load()
    got = {(os.path.basename(r.path), r.page_no): (r.text, r.error) for r in read.where("path NOT LIKE '%big.book'").collect()}
    assert got == {("a.book", 1): ("one", None), ("a.book", 2): ("", "RuntimeError: broken page"), ("a.book", 3): ("two", None), ("a.book", 4): ("?", None), ("b.book", 0): ("", "ValueError: not a document")}
    large = read.where("path LIKE '%big.book'")
    tasks = large.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(tasks) == 20 and all(r["count"] == 500 for r in tasks)
    assert [r.text for r in large.orderBy("page_no").collect()] == big
    (tmp_path / "none").mkdir()
    assert spark.read.format("books").option("path", str(tmp_path / "none")).load().count() == 0


def test_a_stream_resumes_at_its_offset(spark, books, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("books").option("path", str(folder)).option("pages", 2).load()
        query = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.schema(pages.SCHEMA).parquet(f"file://{tmp_path}/out").collect()
        return sorted((os.path.basename(r.path), r.page_no, r.text) for r in rows)

    put(folder, "z.book", "1", "2", "3")
    first = run()
    assert first == [("z.book", 1, "1"), ("z.book", 2, "2"), ("z.book", 3, "3")]
    put(folder, "a.book", "x", "y")
    assert run() == sorted([*first, ("a.book", 1, "x"), ("a.book", 2, "y")])
    assert len(run()) == 5
