"""Session helpers: reading tables, a shared checkpoint folder, bounded driver-side lookups."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder of tables (a file or a directory of parts)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The folder that the cluster names in ``spark.checkpoint.dir`` is shared by all executors and is used when
    given. Only in local mode a temporary folder stands in for it; on a cluster its absence is an error, as a folder of
    one machine is lost with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="diskloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared checkpoint folder and read it from there; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
