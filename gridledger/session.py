"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "gridledger", **conf: str) -> SparkSession:
    """A session with adaptive execution on; `conf` adds or overrides settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediate tables.

    A cluster names it in `spark.checkpoint.dir`. Only a local session may fall back to a
    temporary folder: on a cluster the executors would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _FALLBACK:
        _FALLBACK[context.applicationId] = tempfile.mkdtemp(prefix="gridledger-")
    return _FALLBACK[context.applicationId]


def new_table_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table, below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Large inputs are taken through a shuffle in slices of about so many bytes as they lie on disk.
SLICE_BYTES = 512 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def lean_writes(spark: SparkSession) -> Iterator[None]:
    """Writes in here remove their shuffle files when they end.

    Otherwise these stay until the driver happens to collect garbage. Only for writes: each is an execution of
    its own, while a frame that is collected twice would have to be shuffled again.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or folder, on whatever file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def n_slices(n_bytes: int) -> int:
    return max(1, -(-n_bytes // SLICE_BYTES))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote and no longer needs, on whatever file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
