"""Session settings every job relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(app: str = "poledger", master: str | None = None, partitions: int | None = None):
    """A session with UTC time, AQE with skew handling, and sizes fit for the machine.

    On a cluster the master, memory and shuffle partitions come from the submit command; here
    they are set only when given.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
        b = b.config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
