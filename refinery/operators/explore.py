"""explore: probe a source, run a guarded query over it, profile the result — in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refinery import sources
from refinery.operators import profile, query


def explore(spark: SparkSession, tables: dict[str, DataFrame], sql: str, name: str = "source",
            exact_distinct: bool = True) -> DataFrame:
    """One row per column of the query's result: the probe's verdict (``source``,
    ``connected``, ``message``) beside the column's profile.

    The tables are registered as views of their names, and the query passes the read-only
    guard. A source that cannot be opened gives one row, not connected, with the error as
    message and no profile; its query is not run. The result is profiled in the same
    distributed aggregate as any table; none of its rows passes the driver.
    """
    probe = sources.source_health(tables, name).first()
    verdict = [F.lit(probe.source).alias("source"), F.lit(probe.connected).alias("connected"),
               F.lit(probe.message).alias("message")]
    if not probe.connected:
        empty = profile.profile(spark.createDataFrame([], "none string"), name)
        return spark.range(1).select(*verdict, *[F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields])
    for table, rows in tables.items():
        rows.createOrReplaceTempView(table)
    return profile.profile(query.run_sql(spark, sql), name, exact_distinct).select(*verdict, "*")
