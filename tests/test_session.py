"""Kept results leave nothing behind them on disk, and what they were made of stays usable."""

import os
import time

from pyspark.sql import functions as F

from latticework.session import CLEANUP, settle


def shuffled(spark):
    """Names of the shuffle files that Spark holds."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name for top in dirs for _, _, names in os.walk(top.getPath()) for name in names if name.startswith("shuffle_")}


def test_kept_results_drop_their_shuffles(spark):
    base = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    cached = spark.range(50).groupBy((F.col("id") % 3).alias("k")).count().cache()
    want = sorted(base.collect())  # df has a query, and shuffle files, of its own
    counted = sorted(cached.collect())
    before = shuffled(spark)
    setting = spark.conf.get(CLEANUP, None)
    kept = settle(base.join(cached, "k", "left").repartition(5, "s"))
    assert spark.conf.get(CLEANUP, None) == setting
    for _ in range(100):
        if not (made := shuffled(spark) - before):
            break
        time.sleep(0.1)
    assert not made
    assert sorted((r.k, r.s) for r in kept.collect()) == [tuple(r) for r in want]
    again = settle(base)
    assert sorted(base.collect()) == sorted(again.collect()) == want and sorted(cached.collect()) == counted
    cached.unpersist()
