"""Places for stored fields that a run makes on its way, and small files beside them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

_made: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``, which all executors share; a local master without one gets a temporary folder, a cluster raises.

    What is written there goes when the application ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fieldweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@atexit.register
def _clear() -> None:
    if SparkContext._active_spark_context is not None and SparkContext._gateway is not None:
        for path in _made:
            for end in ("", ".h5"):
                try:
                    delete(path + end)
                except Exception:  # the JVM may be gone; then the cluster clears its checkpoint folder
                    return


def _file_system(path: str):
    there = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(SparkContext._active_spark_context._jsc.hadoopConfiguration()), there


def delete(path: str) -> None:
    """Delete a file or folder, if it is there."""
    files, there = _file_system(path)
    files.delete(there, True)


def stored_bytes(path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    files, there = _file_system(path)
    return files.getContentSummary(there).getLength() if files.exists(there) else 0


def write_text(path: str, text: str) -> None:
    """A small file, which is there whole or not at all."""
    files, there = _file_system(path)
    _, part = _file_system(f"{path}.{uuid.uuid4().hex}.part")
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(there, False)
    if not files.rename(part, there):
        raise OSError(f"{path} could not be written")


def read_texts(folder: str, suffix: str) -> list[str]:
    """The small files of a folder whose names end so; none if there is no such folder."""
    files, there = _file_system(folder)
    if not files.exists(there):
        return []
    out = []
    for status in files.listStatus(there):
        if status.getPath().getName().endswith(suffix):
            raw = files.open(status.getPath())
            try:
                out.append(bytes(raw.readAllBytes()).decode())
            finally:
                raw.close()
    return out
