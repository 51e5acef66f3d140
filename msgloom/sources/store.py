"""W4's store on disk: events by owner bucket, of which a run reads and rewrites only those that its rows touch.

``data/version=V/bucket=B`` holds the files of a bucket as version V wrote them;
``manifest/version=V`` says for each bucket which version holds it. A version counts from the
moment its manifest is complete, so a run that dies leaves the one before in force and the
next run writes its folders over; readers of an older version keep their files until
``vacuum``. One run writes at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.operators.events import merge_events

#: Buckets of a store, fixed when it is made; the driver lists as many numbers.
BUCKETS = 256


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, the newest last."""
    folder, files = _files(spark, f"{path}/manifest")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    found = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
    return sorted(v for v in found if files.exists(_files(spark, f"{path}/manifest/version={v}/_SUCCESS")[0]))


def manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """The version that holds each bucket that has events."""
    rows = spark.read.schema("bucket int, held_by long").parquet(f"{path}/manifest/version={version}").collect()
    return {r.bucket: r.held_by for r in rows}


def read_store(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame | None:
    """All stored events, or those of some buckets; None where there are none."""
    known = versions(spark, path)
    held = manifest(spark, path, known[-1]) if known else {}
    places = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
    return spark.read.parquet(*places) if places else None


def merge_into_store(events: DataFrame, path: str, owner: tuple[str, ...], buckets: int = BUCKETS) -> int:
    """W4 into the store at ``path``: the number of the version that has the events.

    ``events`` are as ``merge_events`` takes them. An owner's events are in one bucket. No
    events make no version; the version in force is given, 0 where there is none.
    """
    spark = events.sparkSession
    place = F.pmod(F.xxhash64(*owner), F.lit(buckets)).cast("int")
    touched = [r[0] for r in events.select(place.alias("bucket")).distinct().collect()]
    known = versions(spark, path)
    if not touched:
        return known[-1] if known else 0
    held = manifest(spark, path, known[-1]) if known else {}
    version = known[-1] + 1 if known else 1
    merged = merge_events(events, read_store(spark, path, touched), owner).withColumn("bucket", place)
    merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    rows = sorted((held | dict.fromkeys(touched, version)).items())
    spark.createDataFrame(rows, "bucket int, held_by long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    return version


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes the older versions but the last ``keep``, and the buckets that only they read."""
    known = versions(spark, path)
    used = {(b, v) for kept in known[-keep:] for b, v in manifest(spark, path, kept).items()}
    for old in known[:-keep]:
        gone, files = _files(spark, f"{path}/manifest/version={old}")
        for b, v in manifest(spark, path, old).items():
            if (b, v) not in used:
                files.delete(_files(spark, f"{path}/data/version={v}/bucket={b}")[0], True)
        files.delete(gone, True)
