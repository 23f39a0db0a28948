"""Session helpers that every query shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Spark's switch for dropping a query's shuffle files once it has run (from 4.1; older ones ignore it).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from a source checkout.

    An installed wheel or ``spark.submit.pyFiles`` makes this unnecessary; it
    only prepends the checkout to the workers' module path.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept as replicated files, so lost executors cost no recomputation.

    They go to the session's checkpoint folder (``spark.checkpoint.dir``).  On one
    machine a temporary one is made where none is set; a cluster must name one
    that all of it shares.

    The size that Catalyst guessed for ``df`` is forgotten: a guess for a join is
    the product of its sides', and carried from one kept result into the next
    it grows to numbers of millions of digits.

    The shuffle files behind the rows go at once.  Else they stay until the
    driver happens to collect its garbage, and a plan of many small steps holds
    all of its steps' files on disk.  Only those of this one run go: ``df`` and
    what is built on it keep theirs.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lattice-checkpoint-"))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        kept = df.select("*").checkpoint(eager=True)._jdf  # a query of its own, which nobody runs again
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    rows = kept.queryExecution().analyzed().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept.schema(), False), spark)
