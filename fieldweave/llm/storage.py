"""Shared storage for intermediate tables.

Lineage is cut by writing to the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver can read it, so losing an
executor never loses an intermediate table. Tables staged inside ``scratch`` are deleted at its
end, all others when the application ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Paths of the staged tables of each open scope, outermost first.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes")
_lasting: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Where none is set, a local master gets a temporary folder of its own, and a cluster the warehouse if that lies
    in a shared store. A warehouse in a ``file:`` folder is one folder on each machine, so it raises instead.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    folder = unset_folder(spark.sparkContext.master, spark.conf.get("spark.sql.warehouse.dir"), _scheme)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def unset_folder(master: str, warehouse: str, scheme) -> str:
    """The folder for a session that names none; ``scheme`` tells the kind of store a path lies in."""
    if master == "local" or master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="fieldweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        return folder
    if scheme(warehouse) == "file":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share; the warehouse lies in a local folder")
    return warehouse.rstrip("/") + "/_staged"


def _file_system(path: str):
    context = SparkContext._active_spark_context
    conf = context._jsc.hadoopConfiguration() if context else SparkContext._jvm.org.apache.hadoop.conf.Configuration()
    there = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(conf), there


def _scheme(path: str) -> str:
    return _file_system(path)[0].getUri().getScheme()


def _delete(paths: list[str]) -> None:
    while paths:
        files, there = _file_system(paths.pop())
        files.delete(there, True)


@atexit.register
def _delete_at_exit() -> None:
    if _lasting and SparkContext._gateway is not None:
        try:
            _delete(_lasting)
        except Exception:  # the JVM may be gone; then the cluster clears its checkpoint folder
            _lasting.clear()


@contextmanager
def scratch() -> Iterator[None]:
    """Tables staged inside are deleted at the end, so what is built on them must be written or collected before."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(()), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        _delete(paths)


def stage_at(df: DataFrame, name: str, outlive: bool = False) -> tuple[DataFrame, str]:
    """As ``stage``, with the path of the table, for ``drop``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes.get(())
    scopes = scopes[:-1] if outlive else scopes
    (scopes[-1] if scopes else _lasting).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str = "table", outlive: bool = False) -> DataFrame:
    """Write ``df`` to shared storage as Parquet and read it back: columnar, prunable and independent of executors. With ``outlive`` it outlives the innermost ``scratch``."""
    return stage_at(df, name, outlive)[0]


def drop(path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    for paths in (*_scopes.get(()), _lasting):
        if path in paths:
            paths.remove(path)
            _delete([path])
