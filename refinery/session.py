"""Session construction, table loading and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# The driver-provided tables (one parquet file/directory each).
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Confs every session gets. AQE re-plans joins/partition counts at run time and
# splits skewed join partitions; the rest pins semantics the operators rely on.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
}


def build_session(master: str | None = None, app_name: str = "refinery",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's baseline confs.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` to roughly (shuffle bytes / 128 MB) — AQE then
    coalesces small partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``; ValueError
    where none is configured (a folder of one machine would not be shared)."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder (``spark.checkpoint.dir``) and read it
    back: lineage is cut, and losing an executor afterwards costs no recomputation. Where no
    folder is configured one is set on a local master, and on a cluster it is an error."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="refinery-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    path = f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder (reliable, survives
    executor loss) and return a DataFrame reading it back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``refinery`` importable by Python workers (``addPyFile`` of a zip of
    this package, once per application).

    Operators that run Python in tasks (``mapInPandas``, ``applyInPandasWithState``)
    pickle their functions by module reference, so executors must import the
    package whatever the driver's working directory or the cluster layout.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    path = os.path.join(tempfile.mkdtemp(prefix="refinery-pyfiles-"), "refinery.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)


_COLUMNS: dict[tuple, object] = {}


def cached_columns(key: tuple, build):
    """Build Column expression trees once per application and key.

    Only for trees that reference columns by *name* (``F.col``): those are
    plain unresolved expressions, reusable across DataFrames, and rebuilding a
    large rule tree costs hundreds of Python-to-JVM calls per query.
    """
    from pyspark import SparkContext
    full = (SparkContext._active_spark_context.applicationId,) + key
    if full not in _COLUMNS:
        _COLUMNS[full] = build()
    return _COLUMNS[full]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table as a DataFrame, listed afresh at each call."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    """Register each table as a temp view (the catalogue that SQL entry points see)."""
    out = {}
    for n in names:
        df = read_table(spark, sf_dir, n)
        df.createOrReplaceTempView(n)
        out[n] = df
    return out
