"""Tables written between two stages of a job, in a folder the cluster shares.

The folder is the one named by ``spark.checkpoint.dir``, else a folder below the session's warehouse.
Results that read such tables stay valid until ``release`` drops them: either at the end of a
``scratch_scope`` or for the whole session.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_written: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, or else one below the warehouse."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/prepkit-scratch").rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/prepkit/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete tables written to the shared folder (all of this application's, if none are named)."""
    known = _written.get(spark.sparkContext.applicationId, [])
    gone = list(known) if paths is None else [p for p in paths if p in known]
    for path in gone:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        known.remove(path)
    return len(gone)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Drop at the end what was written inside; use the results before the block ends."""
    known = _written.setdefault(spark.sparkContext.applicationId, [])
    before = set(known)
    try:
        yield
    finally:
        release(spark, [p for p in known if p not in before])


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write the frame as Parquet and read it back.

    Later passes over it then scan a pruned columnar table instead of repeating the shuffle
    behind it, and a lost executor costs a re-read of one split at most. Names Parquet readers
    do not take as they are (dots, spaces, quotes) travel as ordinals.
    """
    path = scratch_path(df.sparkSession, label)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    read = df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    read._scratch_path = path
    return read


def discard(*frames: DataFrame) -> None:
    """Drop the tables of frames that ``materialize`` returned and that no later result reads; others are left alone."""
    for frame in frames:
        if path := getattr(frame, "_scratch_path", None):
            release(frame.sparkSession, [path])
