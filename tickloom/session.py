"""Session settings and the shared staging folder."""

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on; the shuffle width stays the user's."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` where the cluster names one.

    Only under a ``local`` master, where driver and executors are one process, a temporary
    folder may stand in. Anywhere else the missing setting is an error, since each executor
    would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
    return sc.getCheckpointDir().rstrip("/")


def clean_staged(spark: SparkSession) -> bool:
    """Delete what ``stage`` has written in this application; tables read from it end with it."""
    _views.clear()
    return _delete(spark, _run_dir(spark))


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tickloom/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder not used before, below the shared folder of this application."""
    return f"{_run_dir(spark)}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Writes in here delete their shuffle files when they end, as nothing reads them again. Else
    those of all steps stay on disk until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage without keeping anything on an executor: a lost executor only means the
    files are read again.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    for steps in _open_steps:
        steps.append(path)
    return spark.read.schema(df.schema).parquet(path)


# Folders staged so far by each ``staged_once`` that is at work, outermost first.
_open_steps: list[list[str]] = []


_views: dict[tuple[str, str, str], DataFrame] = {}


def staged_once(spark: SparkSession, source: str, name: str, build) -> DataFrame:
    """Stage ``build()`` once per application and source folder, then reuse the table.

    What it staged on the way goes when the table is there; tables that other calls keep stay.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _views:
        _open_steps.append(steps := [])
        try:
            _views[key] = stage(build(), name)
        finally:
            _open_steps.pop()
        kept = steps.pop()
        for outer in _open_steps:
            # This table is no step of those that asked for it, and its own steps are gone.
            outer[:] = [path for path in outer if path != kept and path not in steps]
        for path in steps:
            _delete(spark, path)
    return _views[key]


def _delete(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
