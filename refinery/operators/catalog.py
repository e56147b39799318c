"""Source registry state as an append-only change log.

Inserts, status updates and deletes are events (source_id, ..., status,
event_time); the current state is the latest event per source and a delete is
a tombstone. Every read is an aggregate over the log — nothing is updated in
place, so concurrent writers only ever append.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOMBSTONE = "deleted"


def current_state(log: DataFrame, key: str = "source_id", order_cols=("event_time", "doc_id")) -> DataFrame:
    """Latest event per key (last write wins), tombstoned keys removed.

    ``max(struct(order..., payload...))`` is a partial aggregate, so a key with
    a long history is reduced map-side instead of being sorted in one task.
    """
    payload = [c for c in log.columns if c != key and c not in order_cols]
    latest = log.groupBy(key).agg(
        F.max(F.struct(*order_cols, *payload)).alias("_last"),
        F.min(order_cols[0]).alias("created_at"),
        F.count(F.lit(1)).alias("n_events"))
    out = latest.select(key, *[F.col(f"_last.{c}").alias(c) for c in payload],
                        "created_at", F.col(f"_last.{order_cols[0]}").alias("updated_at"), "n_events")
    return out.where(F.col("status") != TOMBSTONE)


def list_sources(state: DataFrame, tenant_col: str = "api_key") -> DataFrame:
    """Every tenant's sources, newest first (``pos`` = 1 is the newest)."""
    w = Window.partitionBy(tenant_col).orderBy(F.col("created_at").desc(), F.col("source_id"))
    return state.select(tenant_col, "source_id", "source_type", "name", "status", "created_at") \
        .withColumn("pos", F.row_number().over(w))
