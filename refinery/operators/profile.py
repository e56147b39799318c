"""context.summarize (data part): per-column profile and top values.

One aggregate pass per table computes every column's statistics together; the
wide result row becomes an array of structs that is exploded into one row per
column, so the table is scanned once. Arrays, maps and structs are profiled by
their JSON text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _numeric(dt) -> bool:
    return isinstance(dt, T.NumericType)


def _as_text(c, dt):
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def profile(df: DataFrame, table_name: str, exact_distinct: bool = True) -> DataFrame:
    """(table_name, column_name, data_type, n_rows, n_nulls, n_distinct,
    min_num, max_num, mean_num, min_str, max_str) for every column.

    ``exact_distinct=False`` swaps ``count(DISTINCT)`` (an Expand + shuffle of
    every distinct value) for HyperLogLog++ sketches merged map-side.
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        aggs.append(F.count(c).alias(f"nn{i}"))
        aggs.append((F.countDistinct(c) if exact_distinct else F.approx_count_distinct(c)).alias(f"nd{i}"))
        if _numeric(f.dataType):
            aggs += [F.min(c).cast("double").alias(f"mn{i}"), F.max(c).cast("double").alias(f"mx{i}"),
                     F.avg(c).alias(f"av{i}")]
        else:
            aggs += [F.min(_as_text(F.col(f"`{f.name}`"), f.dataType)).alias(f"mn{i}"),
                     F.max(_as_text(F.col(f"`{f.name}`"), f.dataType)).alias(f"mx{i}")]
    wide = df.agg(*aggs)
    parts = []
    for i, f in enumerate(fields):
        num = _numeric(f.dataType)
        none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
        parts.append(F.struct(
            F.lit(table_name).alias("table_name"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("__n").alias("n_rows"), (F.col("__n") - F.col(f"nn{i}")).alias("n_nulls"),
            F.col(f"nd{i}").cast("bigint").alias("n_distinct"),
            (F.col(f"mn{i}") if num else none_d).alias("min_num"),
            (F.col(f"mx{i}") if num else none_d).alias("max_num"),
            (F.round(F.col(f"av{i}"), 4) if num else none_d).alias("mean_num"),
            (none_s if num else F.col(f"mn{i}")).alias("min_str"),
            (none_s if num else F.col(f"mx{i}")).alias("max_str")))
    return wide.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def top_values(df: DataFrame, table_name: str, columns: list[str], k: int = 5) -> DataFrame:
    """Most frequent values per column (count desc, value asc), top ``k``.

    Counting is a partial aggregate; the rank filter is planned as
    WindowGroupLimit, so only k candidates per column and task are shuffled.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns
    ])).alias("kv")).select("kv.*")
    counts = stacked.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value").asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select(F.lit(table_name).alias("table_name"), "column_name", "value", "n", "rank")
