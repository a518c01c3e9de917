"""The folder that all executors share, for tables that cut lineage and for checkpoints of streams."""

from __future__ import annotations

import atexit
import logging
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset and everything runs in this one process, as in tests, a folder made
    for it; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _OWN:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN.append(tempfile.mkdtemp(prefix="qissaflow-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the cluster has cores, if its files give fewer: heavy work on each row then doesn't run
    in one task where a table is one row group. A table of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as e:  # the session may be gone by now
        logging.getLogger(__name__).debug("%s was not removed: %s", path, e)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later steps neither repeat its work nor
    depend on an executor that made it. The table is removed by ``forget``, or when the process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/qissaflow-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that were ``written`` and that nothing reads any more."""
    for df in tables:
        if path := df.__dict__.pop("written_path", None):
            _remove(df.sparkSession, path)
