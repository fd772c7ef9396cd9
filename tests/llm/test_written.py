"""What a written table leaves behind: no garbage of the driver, and no shuffle files."""

import gc
import time
import weakref

import pytest
from pyspark.sql import functions as F

from lectern.llm import common


def test_driver_collects_after_every_written_table(spark):
    class Node:
        pass

    gc.disable()  # so that only the writes collect
    try:
        for _ in range(3):
            gone = Node()
            gone.itself, told = gone, weakref.ref(gone)
            del gone
            common.materialise(spark.range(1), "few")
            assert told() is None
    finally:
        gc.enable()


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_shuffle_files_go_as_the_write_ends(spark, monkeypatch):
    monkeypatch.setattr(common, "COLLECT", 1 << 40)  # so that no collection takes them away
    setting, before = spark.conf.get(common.CLEANUP, "false"), _shuffled(spark)
    df = spark.range(1000, numPartitions=4).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    told = common.materialise(df, "sums")
    end = time.time() + 10
    while _shuffled(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not _shuffled(spark) - before
    assert {(r.k, r.n) for r in told.collect()} == {(k, sum(range(k, 1000, 7))) for k in range(7)} == {(r.k, r.n) for r in df.collect()}
    with pytest.raises(Exception, match="ZERO"):
        common.materialise(spark.range(3).select(F.expr("1 / id").alias("x")), "fails")
    assert spark.conf.get(common.CLEANUP, "false") == setting
