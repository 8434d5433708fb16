"""Session helpers: the shared scratch folder and the spreading of small inputs."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session may fall back to a folder of its own: on a cluster the
    executors would not see it, so there the setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return sc.getCheckpointDir()
    if not re.match(r"local($|\[)", sc.master):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="reasonloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def _delete_on_exit(spark: SparkSession, folder: str) -> None:
    """Have the driver's JVM remove a folder when it ends, also after a failure."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)


_SCRATCH: dict[str, str] = {}  # the folder of each application


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a table written once and read back, new on every call.

    All lie below one folder per application, which goes when the driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        folder = f"{ensure_checkpoint_dir(spark)}/reasonloom-{uuid.uuid4().hex}"
        _delete_on_exit(spark, folder)
        _SCRATCH[app] = folder
    return f"{_SCRATCH[app]}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of the application; results that still read them must be done."""
    folder = _SCRATCH.pop(spark.sparkContext.applicationId, None)
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For a costly result that is read several times. Later reads fetch only the
    columns they need, and a lost executor costs no recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread an input of fewer splits than cores over all cores.

    A large scan already has more splits than cores and is returned unchanged,
    so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """Keep the optimizer from writing the named columns out again in later filters.

    A filter on a computed column is moved below its computation with the whole
    expression copied into it, and a filter is also inferred for every explode,
    so costly text work would run twice or more. A one-row generator stays where it is.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names))))
