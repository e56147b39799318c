"""Sources: a registry from source type to Spark reader, and catalogue views
(tables, schemas, counts, health) expressed as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FILE_FORMATS = ("parquet", "csv", "json", "orc", "text")
# JDBC flavours: type -> driver class name (the driver jar must be on the classpath).
_JDBC_DRIVERS = {
    "jdbc": None,
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "derby": "org.apache.derby.iapi.jdbc.AutoloadedDriver",
}
_OWN: dict[str, Callable[..., DataFrame]] = {}


def register_source(source_type: str, opener: Callable[..., DataFrame]) -> None:
    """Add a source type: ``opener(spark, **options)`` returns a DataFrame (for
    instance by ``spark.read.format`` of a Python data source)."""
    _OWN[source_type] = opener


def source_types() -> tuple[str, ...]:
    return (*_FILE_FORMATS, *_JDBC_DRIVERS, *_OWN)


def open_source(spark: SparkSession, source_type: str, **options) -> DataFrame:
    """Source registry: type string -> DataFrame; unknown type -> ValueError.

    File sources take ``path`` (+ reader options, e.g. ``header`` for csv).
    JDBC sources take ``url`` and ``dbtable`` or ``query``; pass
    ``partitionColumn/lowerBound/upperBound/numPartitions`` so the scan is split
    across executors instead of running through one connection.
    """
    if source_type in _FILE_FORMATS:
        opts = dict(options)
        path = opts.pop("path")
        schema = opts.pop("schema", None)
        reader = spark.read.format(source_type).options(**opts)
        if schema is not None:
            reader = reader.schema(schema)
        return reader.load(path)
    if source_type in _JDBC_DRIVERS:
        opts = {k: str(v) for k, v in options.items()}
        driver = _JDBC_DRIVERS[source_type]
        if driver and "driver" not in opts:
            opts["driver"] = driver
        return spark.read.format("jdbc").options(**opts).load()
    if source_type in _OWN:
        return _OWN[source_type](spark, **options)
    raise ValueError(f"no reader for source type {source_type!r}; known types: {', '.join(source_types())}")


def list_tables(spark: SparkSession) -> DataFrame:
    """Name-sorted table list of the session catalogue (temp views included)."""
    names = sorted({t.name for t in spark.catalog.listTables()})
    schema = T.StructType([T.StructField("table_name", T.StringType(), False)])
    return spark.createDataFrame([(n,) for n in names], schema).orderBy("table_name")


def table_schema(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, column_name, data_type) in ordinal order — metadata
    only, built on the driver from ``df.schema`` (size = number of columns)."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i + 1, f.name, f.dataType.simpleString())
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    schema = "table_name string, ordinal int, column_name string, data_type string"
    return spark.createDataFrame(rows, schema)


def schema_text(columns: DataFrame) -> DataFrame:
    """'name (type), ...' per table, in ordinal order, from a table_schema frame."""
    items = F.sort_array(F.collect_list(F.struct("ordinal", F.format_string("%s (%s)", "column_name", "data_type").alias("s"))))
    return columns.groupBy("table_name").agg(F.concat_ws(", ", F.transform(items, lambda x: x["s"])).alias("schema_text"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table: one aggregate per table, unioned (parquet counts
    come from footers, so no data pages are read)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def source_health(tables: dict[str, DataFrame], source_name: str = "source") -> DataFrame:
    """Connectivity probe for one source: every table is opened (schema read)
    and counted in one union of aggregates; the result is one row
    (source, connected, message, sample_tables) with the first 20 table names.
    A table that cannot be opened makes the source 'not connected' with the
    error as message, instead of raising."""
    spark = next(iter(tables.values())).sparkSession
    schema = "source string, connected boolean, message string, sample_tables array<string>"
    names = sorted(tables)
    try:
        counts = table_counts(tables)
        total = counts.agg(F.sum("row_count").alias("n")).first()["n"] or 0
    except Exception as e:  # noqa: BLE001 - the probe reports the failure as data
        return spark.createDataFrame([(source_name, False, str(e).splitlines()[0], None)], schema)
    msg = f"Connected. {len(names)} tables, {total} records total."
    return spark.createDataFrame([(source_name, True, msg, names[:20])], schema)


def json_safe(df: DataFrame) -> DataFrame:
    """Keep numbers, strings and booleans; render everything else as text
    (timestamps as ISO text, nested values as JSON); nulls stay null."""
    keep = (T.NumericType, T.StringType, T.BooleanType)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, keep) and not isinstance(f.dataType, T.DecimalType):
            cols.append(c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            # microseconds only where there are any, as Python prints them
            text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
            cols.append(F.regexp_replace(text, r"\.000000$", "").alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            cols.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(c, {"ignoreNullFields": "false"}).alias(f.name))
        else:
            cols.append(c.cast("string").alias(f.name))
    return df.select(*cols)
