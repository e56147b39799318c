"""pipeline.deduplicate: keep the first record per key (or per whole record).

Expressed as ``groupBy(fingerprint).agg(min(struct(order..., rest...)))``:
``min`` is algebraic, so Spark does a partial (map-side) aggregate before the
single hash exchange. A hot key that holds a third of all rows is collapsed to
one row per map task before it is shuffled, so no task ever receives the
whole hot group. Grouping is null-safe (nulls form one group), unlike string
fingerprints which conflate ``None`` with the text "None".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _q(name: str) -> str:
    return f"`{name}`"


def _split(df: DataFrame, keys, order_by):
    order_by = [order_by] if isinstance(order_by, str) else list(order_by or [])
    missing = [k for k in list(keys or []) + order_by if k not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s): {missing}")
    if keys:
        group = list(keys)
    else:  # whole record, ignoring the ordering columns
        group = [c for c in df.columns if c not in order_by]
    rest = [c for c in df.columns if c not in group and c not in order_by]
    return group, order_by, rest


def deduplicate(df: DataFrame, keys: list[str] | None = None,
                order_by: list[str] | str | None = None) -> DataFrame:
    """Survivor = the row with the smallest ``order_by`` within its group.

    Without ``order_by`` the survivor is the smallest remaining row, which is
    deterministic (Spark has no "input order" to honour).
    """
    group, order_by, rest = _split(df, keys, order_by)
    payload = order_by + rest
    if not payload:
        return df.select(*[_q(c) for c in group]).distinct()
    if len(payload) == 1 and not isinstance(df.schema[payload[0]].dataType, (T.StructType, T.ArrayType, T.MapType)):
        # a single ordering column: plain min() keeps a fixed-width buffer, so the
        # aggregate is hash-based (no sort of the wide grouping keys)
        return df.groupBy(*[F.col(_q(c)) for c in group]).agg(F.min(_q(payload[0])).alias(payload[0])) \
            .select(*[_q(c) for c in df.columns])
    first = F.min(F.struct(*[F.col(_q(c)) for c in payload])).alias("_first")
    agg = df.groupBy(*[F.col(_q(c)) for c in group]).agg(first)
    cols = [F.col(_q(c)) if c in group else F.col("_first").getField(c).alias(c) for c in df.columns]
    return agg.select(*cols)


def dedup_report(df: DataFrame, keys: list[str] | None = None,
                 order_by: list[str] | str | None = None) -> DataFrame:
    """records_in, records_out, duplicates_removed from one aggregation."""
    group, _, _ = _split(df, keys, order_by)
    per_group = df.groupBy(*[F.col(_q(c)) for c in group]).count()
    return per_group.agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("records_in"),
        F.count(F.lit(1)).alias("records_out"),
    ).withColumn("duplicates_removed", F.col("records_in") - F.col("records_out"))
