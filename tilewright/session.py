"""Session helpers: lineage cuts and the Spark settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings a caller may apply when building a session. All of them are plain Spark options.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def apply_recommended_conf(spark: SparkSession) -> None:
    for key, value in RECOMMENDED_CONF.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session.

    The folder named by ``spark.checkpoint.dir`` (or set on the context) is used. Only a local master without either
    gets a temporary folder; on a cluster such a folder would vanish with its machine, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running this operator")
        configured = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and read it back from there.

    Used where several branches read one expensive frame, where an iteration would grow its lineage, and where
    partition ids must not change if a stage is run again. The data survives lost executors. It is Parquet and not
    ``checkpoint()``: columns are pruned, and Spark plans with its real size, whereas a checkpoint goes on with the
    product of the sizes that were once joined, whose digits double in every round of an iteration.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
