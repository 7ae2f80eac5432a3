"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# What tasks use of this module goes to them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Settings the results depend on (time zone) or that keep large runs healthy.
#: Partition counts and memory belong to the cluster and are left alone.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hash the narrow side of a join, where all its partitions turn out this small,
    # rather than sort the texts of the other side.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def build_session(app_name: str = "ticketlens", master: str | None = None, **conf: str) -> SparkSession:
    """Create or fetch a session; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def one_row(spark: SparkSession) -> DataFrame:
    """A row to select literals from, in a single task."""
    return spark.range(0, 1, 1, 1)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and tasks are one process, and so see the same local files."""
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


@lru_cache(maxsize=None)
def _own_folder(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="ticketlens-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and driver and tasks are one process, a folder is made for the
    session. A cluster must name one: files in a machine's own folder die with the machine
    and are seen by no other. Whether a ``file:`` folder is mounted everywhere only the
    cluster knows; the machines' temporary folders are refused.
    """
    configured, app_id = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.app.id")
    if not configured:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        return _own_folder(app_id)
    plain = re.sub("/+", "/", configured.removeprefix("file:")).rstrip("/")
    if not is_local(spark) and plain in (tempfile.gettempdir(), "/tmp", "/var/tmp"):
        raise ValueError(f"{configured} is a folder of each machine: set spark.checkpoint.dir to a shared one")
    return f"{configured.rstrip('/')}/ticketlens/{app_id}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a name that Hadoop gives a file, for Python in tasks, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def scratch_folder(spark: SparkSession, name: str):
    """A fresh path below the shared folder, removed with all files in it afterwards."""
    path = scratch_path(spark, name)
    try:
        yield path
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written files.

    Readers of the result never run the plan behind ``df`` again, whatever
    executors are lost, and still get column pruning and filter pushdown. The files
    stay, unless ``folder`` is one that goes (``scratch_folder``).
    """
    spark = df.sparkSession
    path = f"{folder}/{name}" if folder else scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def session_conf(spark: SparkSession, **conf: str):
    """Set SQL settings for the actions inside the block, then put them back."""
    keys = {key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shuffles_dropped(spark: SparkSession):
    """Remove the shuffle files of each action inside the block when it ends.

    For writes, whose rows are read from the written files from then on. Otherwise shuffle files
    stay until the driver happens to collect its garbage, so that a build which moves the
    texts in several steps would hold the files of all of them at once.
    """
    return session_conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")
