"""Session factory and the helpers that touch storage outside a query."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and dynamic partition overwrite."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    In local mode, where driver and executor are one process, a session without that setting gets a
    folder of its own, which goes when the process ends. On a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


_MADE: dict[tuple[str, str], object] = {}


def once(spark: SparkSession, key: str, make):
    """What ``make()`` gave when it was first asked for in this session, until ``release``."""
    found = (spark.sparkContext.applicationId, key)
    if found not in _MADE:
        _MADE[found] = make()
    return _MADE[found]


def release(spark: SparkSession) -> None:
    """Delete what ``fresh_path`` has handed out in this session. Tables read from there are gone then."""
    _MADE.clear()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quire-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so that a lost executor costs no rerun."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    The planner then knows how many bytes it has, and broadcasts it only below its own threshold.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_with_tasks(module: str) -> None:
    """Send the functions of a module along with the tasks that use them.

    Executors then run them without having this package installed.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])
