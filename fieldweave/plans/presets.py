"""Spark settings by size of machine or cluster."""

from __future__ import annotations

_COMMON = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: Shuffle partitions, bytes of a scan's partition, bytes of a shuffle's.
_SIZES = {"laptop": (8, "32m", "32m"), "workstation": (64, "64m", "64m"), "cluster": (4096, "256m", "128m")}


def preset(name: str) -> dict[str, str]:
    """Settings for ``SparkSession.builder.config(map=...)``."""
    if name not in _SIZES:
        raise ValueError(f"known presets are {sorted(_SIZES)}")
    shuffle, scan, part = _SIZES[name]
    return _COMMON | {"spark.sql.shuffle.partitions": str(shuffle), "spark.sql.files.maxPartitionBytes": scan, "spark.sql.adaptive.advisoryPartitionSizeInBytes": part}
