"""Shuffle width from the size of the input, without touching the caller's session."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: One shuffle partition per this much input: sessions are about a tenth of their events.
INPUT_PER_PARTITION = 2 << 30
WIDTH = "spark.sql.shuffle.partitions"


@lru_cache(maxsize=256)
def stored_bytes(spark: SparkSession, *paths: str) -> int:
    """The size of all files below the paths, from a listing; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def width_for(spark: SparkSession, *paths: str) -> int:
    """Shuffle partitions for this input, never fewer than the session asks for."""
    return max(int(spark.conf.get(WIDTH)), stored_bytes(spark, *paths) // INPUT_PER_PARTITION)


def sized_session(spark: SparkSession, *paths: str) -> SparkSession:
    """A session with the caller's settings and as many shuffle partitions as the input needs.

    Too many are harmless, as adaptive execution merges small ones; it cannot split an aggregation's. The
    caller's own session stays as it is, and is returned itself if it is wide enough.
    """
    width = width_for(spark, *paths)
    if width == int(spark.conf.get(WIDTH)):
        return spark
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name) and own.conf.get(name, None) != value:
            own.conf.set(name, value)
    own.conf.set(WIDTH, str(width))
    return own
