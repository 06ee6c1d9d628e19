"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    Where the session names none, a temporary one is set if all executors run
    on this machine; on a cluster they couldn't read it, so that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="clausewright-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, placed: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read from there.

    Used where a frame that feeds several branches must be the same in each
    (range partitioning samples anew in every plan) and must outlive executors.
    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes a
    copy once nothing refers to it any more. With ``placed`` it is planned
    without adaptive execution, since only then Spark still knows afterwards by
    which columns the copy is partitioned.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if not placed:
        return df.checkpoint(eager=True)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
