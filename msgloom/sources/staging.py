"""Frames written to the folder that the driver and all executors share, so that their lineage ends there."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: The folder of each local application that has none set, and where each staged frame is.
_OWN: dict[str, str] = {}
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below the folder that the cluster names in spark.checkpoint.dir.

    Without that setting the checkpoint folder of the session counts, and on one machine
    (tests, a laptop) a folder of its own. On a cluster without either this is an error,
    since executors would write to disks that the others don't see.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        root = _OWN[context.applicationId]
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame, *done: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    The files of the staged frames ``done``, which nothing reads from now on, are deleted.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[found] = path
    discard(*done)
    return found


def discard(*frames: DataFrame) -> None:
    """Deletes the files of staged frames that nothing reads from now on."""
    for df in frames:
        place = _PLACES.pop(df, None)
        if place is not None:
            session = df.sparkSession
            path = session._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
