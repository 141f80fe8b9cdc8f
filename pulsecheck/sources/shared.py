"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session, which is never changed here.

    A local master may leave it unset: the tables then go to a folder that is deleted when Python ends.
    Any other master has to set it, and to a folder that every executor can reach.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="pulsecheck-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet and read it back: cuts the lineage, survives the loss of any executor,
    and later scans read only the columns they use."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_settled(spark: SparkSession) -> int:
    """Delete the tables that this application has settled so far; what still reads them must be done. The number deleted."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    paths = _written.pop(spark.sparkContext.applicationId, [])
    return sum(bool(hadoop(path).getFileSystem(conf).delete(hadoop(path), True)) for path in paths)
