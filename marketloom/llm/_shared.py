"""What several operators of this subpackage share: durable intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode.

    On a cluster without that setting this raises, as a machine-local folder is
    out of the other executors' sight.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="marketloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage.

    Used for narrow tables (ids, digests, features) that several later steps
    read; a lost executor costs no recomputation of what lies before.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet into the shared folder and read again, and where it lies."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discarded(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made and that nothing reads any more, wherever it is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of plans that nothing refers to any more.

    It does so when the driver collects garbage, which an idle driver may put off
    while a job of many steps fills the disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def spread(scan: DataFrame) -> DataFrame:
    """A table scan dealt out evenly if it has fewer partitions than there are cores.

    For small inputs in one file, whose rows would otherwise pass one Python
    worker; a scan of many splits is left as it is. Only for plain scans: asking a
    plan with shuffles for its partitions would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def with_columns(df: DataFrame, **columns) -> DataFrame:
    """Add columns; one of the same name in the input gives way, whatever its case."""
    taken = {c.lower() for c in columns}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def text_or_empty(column: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
