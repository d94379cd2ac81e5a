"""Written tables leave nothing but themselves."""

import os

from pyspark.sql import functions as F

from poledger.plans import staging


def shuffle_files(spark):
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.startswith("shuffle_") for t in top for _, _, names in os.walk(t) for f in names)


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    sums = lambda: spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().orderBy("k")
    before = shuffle_files(spark)
    sums().write.parquet(f"{tmp_path}/plain")
    plain = shuffle_files(spark)
    back = staging.settle(sums(), "sums")
    assert plain > before  # what a plain write leaves until the driver collects its garbage
    assert shuffle_files(spark) <= plain
    assert spark.conf.get(staging.CLEANUP, "false") == "false"  # only while a table is written
    assert [r["count"] for r in back.orderBy("k").collect()] == [143] * 6 + [142]
