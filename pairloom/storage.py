"""Where intermediate results go: the shared folder named by the session."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for a single-machine session."""
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    app = sc.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="pairloom-")
        sc.setCheckpointDir(_local_dirs[app])
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path given by :func:`scratch_path`, after its last reader has written its own result.

    Other paths are refused; a path that is not there is left alone.
    """
    if os.path.dirname(path) != os.path.join(checkpoint_dir(spark), "tables"):
        raise ValueError(f"{path} is no scratch path of this session")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def materialise(df: DataFrame) -> DataFrame:
    """Compute once and keep reliably; for results that several later steps read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
