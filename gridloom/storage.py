"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster
    without it is an error, since no local folder is visible to every executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(shared_dir, "made", None):
        shared_dir.made = tempfile.mkdtemp(prefix="gridloom-")
    return shared_dir.made


#: Folders of tables that are staged and not yet released.
_staged: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage: what is stored survives the loss of any executor and is
    computed once however often it is used. Shuffle files of the job go with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{uuid.uuid4().hex}/{label}"
    schema = df.schema
    with shuffles_removed(spark):
        df.write.parquet(path)
    _staged.add(path)
    out = spark.read.schema(schema).parquet(path)
    out.staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no plan reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.staged_path)


def release_all(spark: SparkSession) -> None:
    """Delete every staged table that is left: for callers that have stored their results, as lazy ones read some of these."""
    for path in list(_staged):
        _delete(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def _delete(spark: SparkSession, path: str) -> None:
    remove(spark, path.rpartition("/")[0])
    _staged.discard(path)
