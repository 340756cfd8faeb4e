"""Sessions: settings for a new one, batches of bounded size, and this package's code for the workers of any."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
#: Bytes and rows in one Arrow batch; texts can be megabytes long, so it is the bytes that bound a Python worker.
ARROW_BYTES, ARROW_ROWS = 4 << 20, 4096


def session(name: str = "tessera", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by name, with ``__`` for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers through Spark's own file server, once a session."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera-code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_HERE):
            for x in names:
                if x.endswith(".py"):
                    full = os.path.join(folder, x)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, _HERE)))
    context.addPyFile(path)
    context._tessera_shipped = True
    return spark


def long_rows(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts: a Python worker holds one batch of each stage at a time.

    Batches are sized when a query runs and not when it is built, so the setting is left to the session; it is only ever
    lowered.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)):
        now = str(spark.conf.get(key))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
