"""Whole texts are read, and handed to Python, in short batches."""

from __future__ import annotations

import pytest

from blocktrace.llm import common, quality

ARROW, READER = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


@pytest.fixture()
def unset(spark):
    before = {name: spark.conf.get(name, None) for name in (ARROW, READER)}
    for name in before:
        spark.conf.unset(name)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_reader_and_python_batches_are_bounded(spark, unset):
    common.bounded(spark.range(1))
    assert int(spark.conf.get(READER)) == common.READ_ROWS < 4096
    assert int(spark.conf.get(ARROW)) == common.BATCH_BYTES


def test_smaller_settings_stay(spark, unset):
    spark.conf.set(READER, "64")
    spark.conf.set(ARROW, "1000")
    common.bounded(spark.range(1))
    assert (spark.conf.get(READER), spark.conf.get(ARROW)) == ("64", "1000")


def test_rows_of_many_read_batches_are_whole(spark, unset, tmp_path):
    rows = 3 * common.READ_ROWS + 7
    spark.range(rows).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1).write.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    found = quality.score_quality(spark.read.parquet(str(tmp_path / "d")), labels).collect()
    assert int(spark.conf.get(READER)) == common.READ_ROWS
    assert sorted(r["doc_id"] for r in found) == list(range(rows))
