"""The stored index as versioned snapshots.

``path/data/<load>/_bucket=n`` holds the rows of the sources that fall into bucket n (by a
hash of the source), written once and never changed; ``path/versions/<number>.json`` says
which load's folder each bucket of a version is read from. A load writes the buckets that
its sources touch to a folder of its own and then renames one finished version file into
place. So:

* a reader opens one version and keeps it, whatever is loaded meanwhile;
* a load that dies before the rename leaves the version before (its folder is never read);
* of two loads that start from one version one is renamed, the other starts again.

A version file has at most ``BUCKETS`` entries, however many sources and rows there are, and
is all that passes the driver. A rename that refuses an existing target must be atomic in
the file system, as it is in HDFS.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from refinery.operators import search

#: Buckets of an index. A load rewrites the buckets of its sources and reads no others.
BUCKETS = 256

#: Times a load starts again after another one was first.
ATTEMPTS = 5

_VERSION = re.compile(r"(\d{12})\.json")


class Overtaken(RuntimeError):
    """Another load was published from the same version."""


def bucket_of(source: str | None) -> int:
    return 0 if source is None else zlib.crc32(source.encode()) % BUCKETS


def _bucket(source: Column) -> Column:
    return F.coalesce(F.crc32(source.cast("string")) % BUCKETS, F.lit(0)).cast("int")


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return jvm, at, at.getFileSystem(conf), conf


def _names(spark: SparkSession, path: str) -> list[str]:
    _, at, fs, _ = _files(spark, path)
    return sorted(status.getPath().getName() for status in fs.listStatus(at)) if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, oldest first."""
    found = (_VERSION.fullmatch(name) for name in _names(spark, f"{path}/versions"))
    return [int(m.group(1)) for m in found if m]


def _manifest(spark: SparkSession, path: str, version: int | None) -> dict:
    if version is None:
        version = max(versions(spark, path), default=0)
    if version == 0:
        return {"version": 0, "schema": None, "buckets": {}}
    jvm, at, fs, _ = _files(spark, f"{path}/versions/{version:012d}.json")
    stream = fs.open(at)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, manifest: dict) -> int:
    """Rename a finished version file into place; Overtaken if that version exists."""
    draft = f"{path}/versions/.{uuid.uuid4().hex}"
    jvm, at, fs, conf = _files(spark, draft)
    out = fs.create(at, False)
    out.write(bytearray(json.dumps(manifest), "utf-8"))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{manifest['version']:012d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    plainly = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(at, target, plainly)
    except Py4JJavaError as failed:
        fs.delete(at, False)
        if fs.exists(target):
            raise Overtaken(f"version {manifest['version']} of {path} is another load's") from failed
        raise
    return manifest["version"]


def _open(spark: SparkSession, path: str, manifest: dict, buckets=None) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    folders = [f"{path}/data/{load}/_bucket={b}" for b, load in manifest["buckets"].items()
               if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None, sources: list[str] | None = None) -> DataFrame:
    """The rows of a version (default: the newest). With ``sources``, theirs only: no other
    bucket is listed or read. ValueError where nothing was ever loaded."""
    manifest = _manifest(spark, path, version)
    if manifest["version"] == 0:
        raise ValueError(f"no index at {path}")
    if sources is None:
        return _open(spark, path, manifest)
    return _open(spark, path, manifest, {bucket_of(s) for s in sources}).where(F.col("source_id").isin(*sources))


def _write(rows: DataFrame, path: str, manifest: dict, touched: set[int]) -> int:
    """Publish the version after ``manifest`` in which the touched buckets hold ``rows``."""
    spark = rows.sparkSession
    load = uuid.uuid4().hex
    # rebalance: a bucket with a third of the rows is split over tasks, small ones share one
    rows.withColumn("_bucket", _bucket(F.col("source_id"))).hint("rebalance", "_bucket") \
        .write.partitionBy("_bucket").parquet(f"{path}/data/{load}")
    written = {name.partition("=")[2] for name in _names(spark, f"{path}/data/{load}") if name.startswith("_bucket=")}
    kept = {b: of for b, of in manifest["buckets"].items() if int(b) not in touched}
    return _publish(spark, path, {"version": manifest["version"] + 1, "schema": rows.schema.jsonValue(),
                                  "buckets": kept | dict.fromkeys(written, load)})


def _again(change):
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return change()
        except Overtaken:
            if attempt == ATTEMPTS:
                raise


def upsert(spark: SparkSession, path: str, load: DataFrame) -> int:
    """Merge a load into the index (``search.upsert``: per doc_id the highest load_seq wins);
    returns the version. The first load makes the index. A load without rows makes a version
    equal to the one before."""
    touched = {row.b for row in load.select(_bucket(F.col("source_id")).alias("b")).distinct().collect()}

    def change() -> int:
        manifest = _manifest(spark, path, None)
        before = [_open(spark, path, manifest, touched)] if manifest["schema"] else []
        return _write(search.upsert(load, *before).select(*load.columns), path, manifest, touched)
    return _again(change)


def delete_source(spark: SparkSession, path: str, source_id: str) -> int:
    """Remove a source; returns the number of rows removed. Only its bucket is rewritten, and
    nothing where it has no rows."""
    def change() -> int:
        manifest = _manifest(spark, path, None)
        if not manifest["schema"]:
            return 0
        rows = _open(spark, path, manifest, {bucket_of(source_id)})
        keep, counted = search.delete_source(rows, source_id)
        deleted = counted.first()["deleted"] or 0
        if deleted:
            _write(keep, path, manifest, {bucket_of(source_id)})
        return deleted
    return _again(change)


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` versions and the loads only they were read from;
    returns the versions deleted. Not to be run beside a load or a reader of an old version."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    known = versions(spark, path)
    gone, stay = known[:-keep], known[-keep:]
    jvm, _, fs, _ = _files(spark, path)
    for version in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{version:012d}.json"), False)
    used = {load for v in stay for load in _manifest(spark, path, v)["buckets"].values()}
    for load in set(_names(spark, f"{path}/data")) - used:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/data/{load}"), True)
    return gone
