"""Saved tables stay while a plan reads them, and go afterwards."""

import gc
import os
import time

from tessera import storage


def _swept(spark, path, tries=10):
    for _ in range(tries):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
        storage.sweep(spark)
        if not os.path.exists(path):
            return True
    return False


def test_saved_tables_go_when_nothing_reads_them(spark):
    table = storage.saved(spark.range(100).selectExpr("id", "id % 3 k"))
    path = table._saved_at.removeprefix("file:")
    derived = table.groupBy("k").count()
    del table
    assert not _swept(spark, path, 3) and derived.count() == 3
    del derived
    assert _swept(spark, path)


def test_forgotten_tables_are_gone_at_once(spark):
    table = storage.saved(spark.range(5).toDF("id"), by=[])
    path = table._saved_at.removeprefix("file:")
    assert os.path.exists(path) and table.count() == 5
    storage.forget(table)
    assert not os.path.exists(path) and table._saved_at not in storage._TRACKED
