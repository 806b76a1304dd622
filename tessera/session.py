"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a written table goes when nothing refers to it any more
}


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tessera")
    defaults = SETTINGS | {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a folder is made on one machine; on a cluster, whose
    executors would not share it, that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many partitions as there are cores: a small file is one partition, too few for costly work by row.

    Inputs of ordinary size have more partitions than that and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
