"""pipeline.redact_pii: whole-field redaction of named PII fields plus regex
redaction inside every other string column. Narrow (no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinery.functions import pii
from refinery.session import cached_columns

REDACTED_COL = "_fields_redacted"
TYPES_COL = "_pii_types"


def detect_pii_fields(df: DataFrame) -> list[str]:
    return [n for n in df.columns if pii.classify_field(n)]


def redact_with_audit(df: DataFrame, fields: list[str] | None = None,
                      replacement: str = pii.DEFAULT_REPLACEMENT,
                      mode: str = "first", passthrough=()) -> DataFrame:
    """``fields=None`` auto-detects by name; ``fields=[]`` means regex scan only.
    ``passthrough`` columns are carried unchanged and never scanned.

    mode="first" keeps the reference behaviour (only the first matching pattern
    is substituted in a value); mode="all" substitutes every pattern.
    """
    if mode not in ("first", "all"):
        raise ValueError("mode must be 'first' or 'all'")
    if fields is None:
        fields = detect_pii_fields(df.drop(*passthrough))
    fields = [f for f in fields if f in df.columns and f not in passthrough]
    scanned = [f.name for f in df.schema.fields
               if isinstance(f.dataType, T.StringType) and f.name not in fields and f.name not in passthrough]
    # Helper columns get a prefix that no column of the input has.
    pre = "__pii"
    while any(c.startswith(pre) for c in df.columns):
        pre += "_"
    columns = list(df.schema.fields)
    if mode == "first" and scanned:
        # which pattern hits each scanned value, computed once per value
        df = df.select("*", *[cached_columns(("pii_index", n), lambda n=n: pii.first_match_index(F.col(f"`{n}`")))
                              .alias(f"{pre}{i}") for i, n in enumerate(scanned)])
    if mode == "all" and scanned:
        # one projection per pattern: each step reads the previous step's value
        # (materialised once per row) and records whether its pattern hit
        for step, name in enumerate(pii.ALL_MODE_ORDER):
            p = pii.java_pattern(name)
            repl = pii.quote_replacement(replacement)
            cols = []
            for f in df.columns:
                if f in scanned:
                    c = F.col(f"`{f}`")
                    guard = (F.instr(c, "@") > 0) if name == "email" else c.rlike(r"(?U)\d")
                    hit = guard & c.rlike(p)
                    cols.append(F.when(hit, F.regexp_replace(c, p, repl)).otherwise(c).alias(f))
                    cols.append(F.coalesce(hit, F.lit(False)).alias(f"{pre}{scanned.index(f)}_{step}"))
                else:
                    cols.append(F.col(f"`{f}`"))
            df = df.select(*cols)
    index_of = {n: F.col(f"{pre}{i}") for i, n in enumerate(scanned)}
    counts, kinds, out = [], [], []
    for f in columns:
        c = F.col(f"`{f.name}`")
        if f.name in passthrough:
            out.append(c)
        elif f.name in fields:
            out.append(F.when(c.isNotNull(), F.lit(replacement)).alias(f.name))
            original = c.cast("string")
            counts.append((c.isNotNull() & (original != F.lit(replacement))).cast("int"))
            field_type = pii.classify_field(f.name)
            if field_type:
                kinds.append(F.when(c.isNotNull(), F.array(F.lit(field_type))))
        elif isinstance(f.dataType, T.StringType):
            if mode == "first":
                idx = index_of[f.name]
                i = scanned.index(f.name)
                out.append(cached_columns(("pii_replace", f.name, pre, i, replacement),
                                          lambda c=c, idx=idx: pii.replace_by_index(c, idx, replacement)).alias(f.name))
                counts.append(idx.isNotNull().cast("int"))
                kinds.append(F.when(idx.isNotNull(), F.array(pii.type_by_index(idx))))
            else:
                i = scanned.index(f.name)
                hits = [F.col(f"{pre}{i}_{step}") for step in range(len(pii.ALL_MODE_ORDER))]
                found = F.filter(F.array(*[F.when(h, F.lit(n)) for h, n in zip(hits, pii.ALL_MODE_ORDER)]),
                                 lambda x: x.isNotNull())
                out.append(c)
                counts.append(F.greatest(*[h.cast("int") for h in hits]))
                kinds.append(found)
        else:  # non-string values are never scanned
            out.append(c)
    empty = F.array().cast("array<string>")
    out.append((sum(counts[1:], counts[0]) if counts else F.lit(0)).alias(REDACTED_COL))
    type_arrays = [F.coalesce(k, empty) for k in kinds]
    out.append((F.array_distinct(F.concat(*type_arrays)) if type_arrays else empty).alias(TYPES_COL))
    return df.select(*out)


def redact(df: DataFrame, fields: list[str] | None = None,
           replacement: str = pii.DEFAULT_REPLACEMENT, mode: str = "first") -> DataFrame:
    return redact_with_audit(df, fields, replacement, mode).drop(REDACTED_COL, TYPES_COL)


def redact_report(audited: DataFrame) -> DataFrame:
    """records_in, fields_redacted, pii_types_found (sorted distinct array).

    ``collect_set`` of the per-row type arrays is bounded by the number of
    pattern combinations (a few dozen), never by the row count.
    """
    return audited.agg(
        F.count(F.lit(1)).alias("records_in"),
        F.coalesce(F.sum(REDACTED_COL), F.lit(0)).cast("bigint").alias("fields_redacted"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(TYPES_COL)))).alias("pii_types_found"),
    )


def field_audit(df: DataFrame, table_name: str, columns) -> DataFrame:
    """Per text column: the PII family of its name and how many of its values match
    each pattern. One scan and one aggregate of the table."""
    names = [n for n, _ in pii.PII_PATTERNS]
    aggs = [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)]
    for i, c in enumerate(columns):
        for n in names:
            value = F.col(f"`{c}`")
            guard = (F.instr(value, "@") > 0) if n == "email" else value.rlike(r"(?U)\d")
            aggs.append(F.count(F.when(guard & value.rlike(pii.java_pattern(n)), 1)).alias(f"{n}{i}"))
    rows = [F.struct(F.lit(table_name).alias("table_name"), F.lit(c).alias("column_name"),
                     F.lit(pii.classify_field(c)).cast("string").alias("name_type"), F.col(f"n{i}").alias("n_values"),
                     *(F.col(f"{n}{i}").alias(f"n_{n}") for n in names)) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
