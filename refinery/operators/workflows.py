"""Composed workflows: clean -> deduplicate -> redact in one lazy plan.

The report comes from the same job as the data: clean audit columns are summed
inside the dedup aggregate (so counts cover every input row), redaction audits
the survivors, and one final aggregate folds everything into a single row.
Exactly one shuffle (the dedup) is planned for the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinery.operators import clean as cl
from refinery.operators import redact as rd

_AUDIT = ("_n_in", "_nulls", "_changed")


def curate_with_audit(df: DataFrame, rules: dict[str, str] | None, dedup_keys: list[str] | None,
                      order_by: list[str], redact_fields: list[str] | None = None,
                      replacement: str = "[REDACTED]", mode: str = "all") -> DataFrame:
    """Clean, keep the first row per key (or whole record minus ``order_by``),
    then redact: every PII pattern by default (``mode="first"`` keeps the
    one-pattern-per-value behaviour). Output = data columns + audit columns (see ``curate_report``)."""
    cleaned = cl.clean_with_audit(df, rules)
    data_cols = df.columns
    group = list(dedup_keys) if dedup_keys else [c for c in data_cols if c not in order_by]
    payload = order_by + [c for c in data_cols if c not in group and c not in order_by]
    aggs = [F.count(F.lit(1)).alias("_n_in"), F.sum(cl.NULLS_COL).alias("_nulls"),
            F.sum(cl.CHANGED_COL).alias("_changed")]
    if payload:
        aggs.insert(0, F.min(F.struct(*payload)).alias("_first"))
    agg = cleaned.groupBy(*group).agg(*aggs)
    survivors = agg.select(*[F.col(c) if c in group else F.col("_first").getField(c).alias(c) for c in data_cols],
                           *_AUDIT)
    return rd.redact_with_audit(survivors, redact_fields, replacement, mode, passthrough=_AUDIT)


def curate(df: DataFrame, *args, **kwargs) -> DataFrame:
    return curate_with_audit(df, *args, **kwargs).drop(*_AUDIT, rd.REDACTED_COL, rd.TYPES_COL)


def curate_report(audited: DataFrame) -> DataFrame:
    """Before/after summary of the whole workflow in one aggregate."""
    return audited.agg(
        F.coalesce(F.sum("_n_in"), F.lit(0)).cast("bigint").alias("records_in"),
        F.count(F.lit(1)).alias("records_out"),
        F.coalesce(F.sum("_nulls"), F.lit(0)).cast("bigint").alias("nulls_filled"),
        F.coalesce(F.sum("_changed"), F.lit(0)).cast("bigint").alias("formats_standardized"),
        F.coalesce(F.sum(rd.REDACTED_COL), F.lit(0)).cast("bigint").alias("fields_redacted"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(rd.TYPES_COL)))).alias("pii_types_found"),
    ).withColumn("duplicates_removed", F.col("records_in") - F.col("records_out"))
