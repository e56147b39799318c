"""context.build: rows -> JSON lines -> per-table chunks -> token-budget packing.

All steps are relational: a per-table top-n window (planned as
WindowGroupLimit, so only n rows per table and map task are shuffled), a
bounded ``collect_list`` of at most n lines per chunk, and a running-sum window
per context (a context holds a handful of chunks).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values (must match the reference): tables per source, rows per chunk,
# default budget and the chars-per-token estimate.
TABLES_PER_SOURCE = 5
ROWS_PER_CHUNK = 10
DEFAULT_BUDGET = 4000
CHARS_PER_TOKEN = 4


def json_line(df: DataFrame, cols: list[str]):
    """Row as compact JSON with nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), {"ignoreNullFields": "false"})


def schema_line(df: DataFrame, cols: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"{c} ({types[c]})" for c in cols)


def build_chunks(df: DataFrame, source_col: str, table_col: str, order_col: str,
                 cols: list[str] | None = None, tables_per_source: int = TABLES_PER_SOURCE,
                 rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """One chunk per (source, table): header lines + the first ``rows_per_chunk``
    rows (by ``order_col``) as JSON lines; the first ``tables_per_source``
    tables of a source by name. relevance_score is 1.0 (no query ranking)."""
    cols = cols or df.columns
    header_schema = schema_line(df, cols)
    w_rows = Window.partitionBy(source_col, table_col).orderBy(order_col)
    top = df.withColumn("_rn", F.row_number().over(w_rows)).where(F.col("_rn") <= rows_per_chunk)
    lines = top.select(source_col, table_col, "_rn", json_line(df, cols).alias("_line"))
    grouped = lines.groupBy(source_col, table_col).agg(
        F.sort_array(F.collect_list(F.struct("_rn", "_line"))).alias("_rows"))
    w_tab = Window.partitionBy(source_col).orderBy(table_col)
    tables = grouped.withColumn("table_pos", F.row_number().over(w_tab)).where(F.col("table_pos") <= tables_per_source)
    body = F.concat_ws("", F.transform("_rows", lambda r: F.concat(r["_line"], F.lit("\n"))))
    content = F.concat(F.lit("Table: "), F.col(table_col), F.lit("\nSchema: "), F.lit(header_schema),
                       F.lit("\nColumns: "), F.lit(", ".join(cols)), F.lit("\n"), body)
    return tables.select(F.col(source_col).alias("source"), F.col(table_col).alias("table_name"), "table_pos",
                         F.size("_rows").alias("n_rows"), content.alias("content"),
                         F.lit(1.0).alias("relevance_score"))


def pack(chunks: DataFrame, context_col: str, order_cols: list[str], budget: int = DEFAULT_BUDGET) -> DataFrame:
    """Fit chunks into ``budget`` tokens (len // 4 per chunk) in chunk order.

    A chunk is kept while the tokens before it are below the budget; the chunk
    that crosses the budget is cut to the remaining tokens * 4 characters.
    Per-chunk token floors are used throughout and empty cut-offs are dropped.
    """
    if budget <= 0:
        raise ValueError("budget must be positive")
    tok = F.floor(F.length("content") / CHARS_PER_TOKEN).cast("bigint")
    w = Window.partitionBy(context_col).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    c = chunks.withColumn("_tok", tok).withColumn("_before", F.coalesce(F.sum("_tok").over(w), F.lit(0)))
    room = F.lit(budget) - F.col("_before")
    kept = c.where(F.col("_before") < budget)
    cut = F.col("_before") + F.col("_tok") > budget
    return kept.withColumn("content", F.when(cut, F.substring("content", 1, room * CHARS_PER_TOKEN))
                           .otherwise(F.col("content"))) \
               .withColumn("tokens", F.when(cut, room).otherwise(F.col("_tok"))) \
               .withColumn("truncated", cut) \
               .drop("_tok", "_before")


def totals(chunks: DataFrame, context_col: str, order_cols: list[str], budget: int = DEFAULT_BUDGET) -> DataFrame:
    """Per context: chunk count, character total and the len//4 estimate before
    packing, plus tokens and chunks after packing, from one pass over the chunks."""
    size = F.length("content")
    tok = F.floor(size / CHARS_PER_TOKEN).cast("bigint")
    w = Window.partitionBy(context_col).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    c = chunks.select(context_col, size.alias("_size"), tok.alias("_tok"), F.coalesce(F.sum(tok).over(w), F.lit(0)).alias("_before"))
    kept = F.col("_before") < budget
    out = c.groupBy(context_col).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("_size").cast("bigint").alias("total_chars"),
        F.count(F.when(kept, 1)).alias("n_packed"),
        F.sum(F.when(kept, F.least(F.col("_tok"), F.lit(budget) - F.col("_before")))).cast("bigint").alias("packed_tokens"))
    return out.select(context_col, "n_chunks", "total_chars",
                      F.floor(F.col("total_chars") / CHARS_PER_TOKEN).cast("bigint").alias("tokens_estimate"),
                      "n_packed", "packed_tokens")


def union_chunks(tables: dict[str, DataFrame], source: str, order_cols: dict[str, str],
                 rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Chunks of several tables of one source, each with the schema line of its own
    table; ``table_pos`` follows the names. ``order_cols`` names each table's order."""
    parts = []
    for pos, name in enumerate(sorted(tables), 1):
        df = tables[name]
        rows = df.withColumn("_source", F.lit(source)).withColumn("_table", F.lit(name))
        chunk = build_chunks(rows, "_source", "_table", order_cols[name], df.columns, 1, rows_per_chunk)
        parts.append(chunk.withColumn("table_pos", F.lit(pos)))
    return reduce(DataFrame.unionByName, parts)


def rank_chunks(chunks: DataFrame, queries: DataFrame | None, query_id: str = "item_id",
                query_text: str = "text") -> DataFrame:
    """Chunks once per query (``query_id``) with their TF-IDF relevance to it; without
    queries the chunks as they are (relevance 1.0). Packed with ``relevance_score
    desc`` the most relevant ones come first in the budget."""
    if queries is None:
        return chunks
    from refinery.operators import textsearch
    keyed = chunks.withColumn("_chunk_id", F.concat_ws("\u0000", "source", "table_name"))
    return textsearch.rank_by_text(keyed, "_chunk_id", "content", queries, query_id, query_text).drop("_chunk_id")


def to_contexts(packed: DataFrame, context_col: str, order_cols: list[str]) -> DataFrame:
    """Nest packed chunks into one row per context (chunks array + token count),
    the shape written by :func:`write_contexts`. A context holds few chunks."""
    item = F.struct(*[F.col(c) for c in order_cols], "content", "source", "relevance_score", "table_name")
    g = packed.groupBy(context_col).agg(F.sort_array(F.collect_list(item)).alias("_items"),
                                        F.sum("tokens").cast("bigint").alias("token_count"))
    chunk = lambda x: F.struct(x["content"].alias("content"), x["source"].alias("source"),
                               x["relevance_score"].alias("relevance_score"),
                               F.create_map(F.lit("table"), x["table_name"]).alias("metadata"))
    return g.select(F.col(context_col).alias("context_id"), F.transform("_items", chunk).alias("chunks"),
                    "token_count")


BUCKETS = 64  # folders of a context sink


def _bucket(context_id):
    return F.pmod(F.xxhash64(context_id), F.lit(BUCKETS)).cast("int")


def write_contexts(contexts: DataFrame, path: str) -> None:
    """Append, in folders by a hash of the context id, so that reading one context
    lists and scans one folder."""
    contexts.withColumn("bucket", _bucket(F.col("context_id").cast("string"))).write.mode("append") \
        .partitionBy("bucket").parquet(path)


def read_context(spark, path: str, context_id: str) -> DataFrame:
    bucket = spark.range(1).select(_bucket(F.lit(str(context_id))).alias("b")).first()["b"]
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("context_id") == context_id)).drop("bucket")
