"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Each query reads the driver tables (or data Spark derives from them) in full;
limits appear only where they are the feature (top-k, paging, chunk sampling).
The equivalent SQL for the DuckDB oracle lives in ``refinery.plans.oracle``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refinery import sources
from refinery.operators import (
    catalog, clean, context, dedup, explore, ivf, ledger, pages, profile, query, redact, search, workflows,
)
from refinery.plans import derived
from refinery.session import TABLES, read_table, register_tables, saved

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark, d, name):
    return read_table(spark, d, name)


# ---------------------------------------------------------------------------
# SQL pass-through, joins, aggregates, set operations
# ---------------------------------------------------------------------------
TOPK_SQL = """
SELECT c.c_custkey, c.c_name, n.n_name, c.c_acctbal
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
ORDER BY c.c_acctbal DESC, c.c_custkey
LIMIT 5"""

JOIN_AGG_SQL = """
SELECT n.n_name, r.r_name,
       COUNT(*) AS n_lines,
       CAST(SUM(l.l_quantity) AS DOUBLE) AS sum_qty,
       ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY n.n_name, r.r_name"""

ROLLUP_SQL = """
SELECT l_returnflag, l_linestatus,
       CAST(GROUPING(l_returnflag) + 2 * GROUPING(l_linestatus) AS INT) AS grouping_level,
       COUNT(*) AS n_lines,
       CAST(SUM(l_quantity) AS DOUBLE) AS sum_qty,
       ROUND(SUM(l_extendedprice), 2) AS sum_price,
       ROUND(SUM(l_discount), 2) AS sum_disc
FROM lineitem
GROUP BY ROLLUP (l_returnflag, l_linestatus)"""

CUBE_SQL = """
SELECT l_returnflag, l_linestatus,
       CAST(GROUPING(l_returnflag) + 2 * GROUPING(l_linestatus) AS INT) AS grouping_level,
       COUNT(*) AS n_lines,
       COUNT(DISTINCT l_orderkey) AS n_orders,
       PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY l_quantity) AS median_qty
FROM lineitem
GROUP BY CUBE (l_returnflag, l_linestatus)
HAVING COUNT(*) > 100"""

PROJECTION_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       o_totalprice > 100000 AS is_large,
       CAST(YEAR(o_orderdate) AS INT) AS order_year,
       UPPER(o_orderpriority) AS priority
FROM orders"""

COUNT_SQL = "SELECT COUNT(*) AS count FROM lineitem"

DEFAULT_LIMIT_SQL = """
SELECT o_orderkey, o_custkey, o_totalprice
FROM orders
ORDER BY o_totalprice DESC, o_orderkey"""

WHERE_PREDICATE = ("l_quantity >= 10 AND l_discount <= 0.05 AND l_returnflag != 'N' "
                   "AND l_tax > 0.02 AND l_quantity < 40")


def _views(spark, d, sql: str) -> None:
    """Register the driver tables a SQL text names as temp views."""
    register_tables(spark, d, [t for t in TABLES if re.search(rf"\b{t}\b", sql, re.IGNORECASE)])


def _sql(text: str, limit: int = query.MAX_ROWS) -> Query:
    def run(spark, d):
        _views(spark, d, text)
        return query.run_query(spark, text, mode="sql", limit=limit)
    return run


def _sql_uncapped(text: str) -> Query:
    """Analytic SQL through the batch entry point: same guard, no row cap."""
    def run(spark, d):
        _views(spark, d, text)
        return query.run_sql(spark, text)
    return run


def q_where_conjunction(spark, d):
    li = _t(spark, d, "lineitem")
    return li.where(WHERE_PREDICATE).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                                            "l_returnflag")


def q_crm_orders_by_nation(spark, d):
    """customer <- orders, nation dimension: orders and their value per nation and status."""
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = _t(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    n = _t(spark, d, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("order_value"))


def q_sql_set_ops(spark, d):
    """Customers with orders, customers in BUILDING: union / intersect / except."""
    with_orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("custkey"))
    building = _t(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING") \
        .select(F.col("c_custkey").alias("custkey"))
    # Each customer once, with the sides it is on: all three sets in one aggregate.
    sides = with_orders.select("custkey", F.lit(1).alias("a"), F.lit(0).alias("b")) \
        .union(building.select("custkey", F.lit(0), F.lit(1))) \
        .groupBy("custkey").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counts = sides.agg(F.count(F.lit(1)).alias("u"), F.sum(F.col("a") * F.col("b")).alias("i"),
                       F.sum((1 - F.col("a")) * F.col("b")).alias("e"))
    return counts.select(F.explode(F.array(
        *(F.struct(F.lit(op).alias("op"), F.coalesce(c, F.lit(0)).cast("long").alias("n"))
          for op, c in (("union", F.col("u")), ("intersect", F.col("i")), ("except", F.col("e")))))).alias("r")).select("r.*")


# ---------------------------------------------------------------------------
# fetch, catalogue
# ---------------------------------------------------------------------------
def q_fetch_filtered(spark, d):
    return query.fetch_rows(_t(spark, d, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 7},
                            limit=query.MAX_ROWS, order_by=["c_custkey"])


def q_fetch_page(spark, d):
    return query.fetch_rows(_t(spark, d, "orders"), {"o_orderstatus": "F"}, limit=50, offset=100,
                            order_by=["o_orderkey"])


def q_fetch_deep_page(spark, d):
    """A page in the middle of the line items by price, located by counts."""
    li = _t(spark, d, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber", "l_shipdate")
    return pages.page(li, ["l_extendedprice", "l_orderkey", "l_linenumber"], offset=5000, limit=50, sorted_rows=200)


def q_fetch_total_available(spark, d):
    return query.total_available(_t(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


def _all_tables(spark, d):
    return {n: _t(spark, d, n) for n in TABLES}


def q_table_counts(spark, d):
    return sources.table_counts(_all_tables(spark, d))


def q_source_tables(spark, d):
    tables = _all_tables(spark, d)
    counts = sources.table_counts(tables)
    ncols = spark.createDataFrame([(n, len(df.columns)) for n, df in tables.items()], "table_name string, n_columns int")
    return counts.join(ncols, "table_name").orderBy("table_name")


def q_json_safe_rows(spark, d):
    return sources.json_safe(_t(spark, d, "orders"))


def q_source_current_state(spark, d):
    st = catalog.current_state(derived.source_log(spark, d))
    return st.select("source_id", "api_key", "status", "created_at", "updated_at", "n_events")


def q_source_catalog(spark, d):
    return catalog.list_sources(catalog.current_state(derived.source_log(spark, d)))


def q_query_router(spark, d):
    r = query.route_queries(derived.query_log(spark, d))
    return r.select("conv_id", "turn", "first_word", "is_natural_language")


def q_query_guard_audit(spark, d):
    r = query.route_queries(derived.query_log(spark, d))
    return r.select("conv_id", "turn", "forbidden_keyword",
                    F.when(F.col("forbidden_keyword").isNotNull(), "rejected").otherwise("allowed").alias("verdict"))


# ---------------------------------------------------------------------------
# clean
# ---------------------------------------------------------------------------
def q_clean_date(spark, d):
    o = derived.dated_orders(spark, d)
    return clean.clean(o.withColumn("clean_date", F.col("raw_date")), {"clean_date": "date"})


def _dc(spark, d):
    return derived.dirty_customer(spark, d)


def q_clean_phone(spark, d):
    c = _dc(spark, d).select("c_custkey", "contact_phone", F.col("contact_phone").alias("phone"))
    return clean.clean(c, {"phone": "phone"})


def q_clean_email(spark, d):
    c = _dc(spark, d).select("c_custkey", "contact_email", F.col("contact_email").alias("email"))
    return clean.clean(c, {"email": "email"})


def q_clean_text_case(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit("\t")).alias("name_lower"),
                                    F.concat(F.lit("  "), "p_type").alias("type_upper"))
    return clean.clean(p, {"name_lower": "text_lower", "type_upper": "text_upper"})


def q_clean_nulls(spark, d):
    c = _dc(spark, d).select("c_custkey", "c_mktsegment", "balance_amount")
    return clean.clean(c, {"c_mktsegment": "text_upper", "balance_amount": "currency"})


def q_clean_auto_detect(spark, d):
    return clean.clean(_dc(spark, d))  # rules from field names


def q_clean_currency(spark, d):
    li = derived.priced_lineitem(spark, d)
    return clean.clean(li.withColumn("amount", F.col("raw_amount")), {"amount": "currency"})


def q_clean_stats(spark, d):
    return clean.clean_report(clean.clean_with_audit(_dc(spark, d)))


# ---------------------------------------------------------------------------
# PII
# ---------------------------------------------------------------------------
def q_pii_redact_text(spark, d):
    doc = _t(spark, d, "documents").select("doc_id", "text")
    out = redact.redact_with_audit(doc, fields=[], passthrough=("doc_id",))
    return out.select("doc_id", "text", F.try_element_at(redact.TYPES_COL, F.lit(1)).alias("pii_type"))


def q_pii_stats(spark, d):
    rep = redact.redact_report(redact.redact_with_audit(_t(spark, d, "documents")))
    return rep.select("records_in", "fields_redacted", F.concat_ws(",", "pii_types_found").alias("pii_types_found"))


def q_pii_redact_fields(spark, d):
    c = _dc(spark, d).select("c_custkey", "c_name", "contact_email", "contact_phone", "c_mktsegment")
    out = redact.redact_with_audit(c, passthrough=("c_custkey",))
    return out.select("c_custkey", "c_name", "contact_email", "contact_phone", "c_mktsegment",
                      F.col(redact.REDACTED_COL).alias("fields_redacted"))


AUDITED = {"customer": ("c_name", "c_mktsegment"), "supplier": ("s_name",), "part": ("p_name", "p_brand", "p_type"),
           "documents": ("text", "lang", "source"), "conversations": ("role", "text"), "pages": ("url",)}


def q_pii_field_audit(spark, d):
    """Per text column: its name's family beside the number of values each pattern matches."""
    return reduce(DataFrame.unionByName, (redact.field_audit(_t(spark, d, t), t, cols) for t, cols in AUDITED.items()))


def q_pii_redact_all(spark, d):
    """Every pattern replaced, with the number of values changed and the types found."""
    doc = _t(spark, d, "documents").select("doc_id", "text", "source")
    out = redact.redact_with_audit(doc, fields=[], mode="all", passthrough=("doc_id",))
    return out.select("doc_id", "text", "source", F.col(redact.REDACTED_COL).alias("fields_redacted"))


# ---------------------------------------------------------------------------
# dedup
# ---------------------------------------------------------------------------
def q_dedup_full(spark, d):
    doc = _t(spark, d, "documents").select("doc_id", "text", "lang")
    return dedup.deduplicate(doc, order_by="doc_id")


def q_dedup_keys(spark, d):
    ev = _t(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return dedup.deduplicate(ev, keys=["user_id", "event_type"], order_by=["ts", "event_id"])


def q_dedup_stats(spark, d):
    doc = _t(spark, d, "documents").select("doc_id", "text", "lang")
    return dedup.dedup_report(doc, order_by="doc_id")


# ---------------------------------------------------------------------------
# vector index and search
# ---------------------------------------------------------------------------
def _index(spark, d):
    doc = _t(spark, d, "documents")
    load1 = search.index_records(doc, F.col("source"), "documents", "text", 1)
    load2 = search.index_records(doc.where(F.col("lang").isin("fr", "de")), F.col("source"), "documents", "text", 2)
    return search.upsert(load1, load2)


def q_index_upsert(spark, d):
    return _index(spark, d).select("doc_id", "source_id", "table_name", F.length("content").alias("content_chars"),
                                   "load_seq")


def q_index_delete_source(spark, d):
    _, removed = search.delete_source(_index(spark, d), "src3")
    return removed


def _exemplar(spark, d, label: int):
    emb = _t(spark, d, "embeddings")
    row = emb.where(F.col("label") == label).agg(F.min_by("embedding", "vec_id").alias("v")).first()
    return list(row["v"])


def q_search_topk(spark, d):
    emb = _t(spark, d, "embeddings")
    return search.search_vector(emb, _exemplar(spark, d, 0), k=10).select("vec_id", "label", "score")


def q_search_topk_filtered(spark, d):
    emb = _t(spark, d, "embeddings")
    return search.search_vector(emb, _exemplar(spark, d, 0), k=10, where=F.col("label") == 3) \
        .select("vec_id", "label", "score")


def q_search_topk_batch(spark, d):
    emb = _t(spark, d, "embeddings")
    qs = search.label_exemplars(emb)
    res = search.search_batch(emb, qs, k=10, keep=["vec_id", "label"])
    return res.select(F.col("query_id").cast("int").alias("query_label"), "vec_id", "label", "score",
                      F.col("rank").cast("int").alias("rank"))


def q_search_text_tfidf(spark, d):
    from refinery.operators import textsearch
    return textsearch.tfidf_search(_t(spark, d, "documents"), _t(spark, d, "benchmark"), k=5)


def q_search_index_text(spark, d):
    """data.search: benchmark passages against the index, sources src1 only."""
    from refinery.operators import textsearch
    found = textsearch.search_index(_index(spark, d), _t(spark, d, "benchmark"), k=3, source="src1")
    return found.select("query_id", "rank", "doc_id", "source_id", "score", F.length("content").alias("content_chars"),
                        F.col("metadata")["table"].alias("table_name"))


def q_search_ann_recall(spark, d):
    """Inverted-file search asked for every hundredth vector against all rows: the exact k-th
    score of each query, and whether the index' mean recall reaches 0.9."""
    emb = _t(spark, d, "embeddings")
    asked = emb.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    out = saved(ivf.recall(emb, asked, k=10), "recall")
    reached = out.agg(F.avg("recall") >= 0.9).scalar()
    return out.select("query_id", "n_neighbours", "kth_score", reached.alias("recall_reached"))


# ---------------------------------------------------------------------------
# context
# ---------------------------------------------------------------------------
DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def _chunks(spark, d):
    doc = _t(spark, d, "documents")
    return context.build_chunks(doc, "source", "lang", "doc_id", DOC_COLS)


def q_context_chunks(spark, d):
    return _chunks(spark, d)


def _packed(spark, d, ch=None):
    ch = ch if ch is not None else _chunks(spark, d)
    return context.pack(ch.withColumnRenamed("source", "context_id").withColumn("source", F.col("context_id")),
                        "context_id", ["table_pos"], budget=context.DEFAULT_BUDGET)


def q_context_pack(spark, d):
    return _packed(spark, d).select("context_id", "table_pos", "table_name", "tokens", "truncated", "content")


def q_context_pack_ranked(spark, d):
    """For every benchmark passage as a topic: the chunks that share a term with it,
    most relevant first in each context's budget."""
    ranked = context.rank_chunks(_chunks(spark, d), _t(spark, d, "benchmark"))
    ranked = ranked.withColumn("context_id", F.concat_ws("/", F.col("query_id").cast("string"), "source"))
    packed = context.pack(ranked, "context_id", [F.col("relevance_score").desc(), F.col("table_pos")],
                          budget=context.DEFAULT_BUDGET)
    return packed.select(F.col("query_id").alias("item_id"), F.col("source").alias("context_id"), "table_pos", "table_name",
                         "relevance_score", "tokens", "truncated")


def q_context_totals(spark, d):
    return context.totals(_chunks(spark, d).withColumnRenamed("source", "context_id"), "context_id", ["table_pos"])


def q_context_chunks_multi(spark, d):
    """One context over tables of different schema, packed."""
    tables = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "nation": "n_nationkey"}
    chunks = context.union_chunks({t: _t(spark, d, t).drop("o_orderdate", "c_acctbal", "o_totalprice", "p_retailprice")
                                   for t in tables}, "warehouse", tables)
    packed = context.pack(chunks.withColumn("context_id", F.col("source")), "context_id", ["table_pos"], budget=1000)
    return packed.select("context_id", "table_pos", "table_name", "n_rows", "tokens", "truncated", "content")


# ---------------------------------------------------------------------------
# profile
# ---------------------------------------------------------------------------
def q_dataset_profile(spark, d):
    return profile.profile(_t(spark, d, "lineitem"), "lineitem").unionByName(
        profile.profile(_t(spark, d, "customer"), "customer"))


EXPLORE_SQL = """
SELECT c.c_mktsegment, c.c_nationkey, o.o_orderstatus, o.o_orderpriority, o.o_totalprice
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_totalprice > 1000"""


def q_explore_source(spark, d):
    """Probe, guarded query, profile of what it returns."""
    tables = {t: _t(spark, d, t) for t in ("customer", "orders")}
    return explore.explore(spark, tables, EXPLORE_SQL, "crm")


def q_dataset_top_values(spark, d):
    return profile.top_values(_t(spark, d, "lineitem"), "lineitem", ["l_returnflag", "l_linestatus", "l_quantity"]) \
        .unionByName(profile.top_values(_t(spark, d, "customer"), "customer", ["c_mktsegment", "c_nationkey"]))


# ---------------------------------------------------------------------------
# ledger
# ---------------------------------------------------------------------------
def q_credit_balance(spark, d):
    return ledger.balances(derived.ledger(spark, d))


def q_credit_balance_plan(spark, d):
    return ledger.balances_with_plan(derived.ledger(spark, d), derived.agents(spark, d))


def q_credit_running_balance(spark, d):
    return ledger.running_balance(derived.ledger(spark, d)).select("id", "api_key", "delta", "created_at",
                                                                 "balance_after")


def q_credit_history_topn(spark, d):
    return ledger.history(derived.ledger(spark, d), n=50)


def q_credit_check_balance(spark, d):
    return ledger.check_balance(derived.ledger(spark, d), derived.agents(spark, d), n=10)


def q_low_balance_alerts(spark, d):
    return ledger.low_balance_alerts(derived.ledger(spark, d), derived.subscriptions(spark, d))


def q_usage_cost_rollup(spark, d):
    return ledger.tool_cost_rollup(derived.usage_events(spark, d))


def q_credit_reason_rollup(spark, d):
    return ledger.usage_rollup(derived.ledger(spark, d))


def q_credit_refunds(spark, d):
    return ledger.refunds(derived.usage_events(spark, d))


def q_credit_pricing(spark, d):
    u = derived.usage_events(spark, d).where(F.col("kind") == "purchase")
    return ledger.pricing(u, derived.credit_packs(spark))


def q_credit_admission(spark, d):
    return ledger.admission_summary(ledger.admission(derived.usage_events(spark, d)))


def q_credit_admission_events(spark, d):
    """Every event with its verdict and the balance after it."""
    return ledger.admission(derived.usage_events(spark, d)).select("api_key", "event_id", "kind", "admitted", "balance_after")


def q_metered_ledger(spark, d):
    return derived.metered_ledger(spark, d).select("id", "api_key", "delta", "reason", "created_at")


def q_metered_balance(spark, d):
    return ledger.balances(derived.metered_ledger(spark, d))


def q_payment_settlement(spark, d):
    s = ledger.settlements(derived.payment_events(spark, d))
    # the pack table is a fixed 5-row dimension: broadcast, no second pass over s
    priced = s.join(F.broadcast(derived.credit_packs(spark)), "credits", "left")
    return priced.select("payment_id", "api_key", "credits",
                         F.coalesce(F.col("price_cents") / 100.0,
                                    F.round(F.col("credits") * derived.PER_CREDIT_USD, 2)).alias("price_usd"),
                         "settled_status", "settled_at")


# ---------------------------------------------------------------------------
# workflow
# ---------------------------------------------------------------------------
def _curate(spark, d, mode="all"):
    doc = _t(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return workflows.curate_with_audit(doc, {"lang": "text_upper", "source": "text_lower"},
                                       dedup_keys=["text"], order_by=["doc_id"], redact_fields=[], mode=mode)


def q_curate_records(spark, d):
    return _curate(spark, d).select("doc_id", "text", "lang", "source")


def q_curate_records_first(spark, d):
    """The same with one pattern per value replaced."""
    return _curate(spark, d, "first").select("doc_id", "text", "lang", "source")


def q_curate_report(spark, d):
    rep = workflows.curate_report(_curate(spark, d, "first"))
    return rep.withColumn("pii_types_found", F.concat_ws(",", "pii_types_found"))


QUERIES: dict[str, Query] = {
    "query_topk": _sql(TOPK_SQL),
    "query_default_limit": _sql(DEFAULT_LIMIT_SQL, limit=100),
    "sql_join_agg": _sql_uncapped(JOIN_AGG_SQL),
    "sql_rollup": _sql_uncapped(ROLLUP_SQL),
    "sql_cube_having": _sql_uncapped(CUBE_SQL),
    "sql_projection": _sql_uncapped(PROJECTION_SQL),
    "sql_set_ops": q_sql_set_ops,
    "count_star": _sql_uncapped(COUNT_SQL),
    "where_conjunction": q_where_conjunction,
    "crm_orders_by_nation": q_crm_orders_by_nation,
    "fetch_filtered": q_fetch_filtered,
    "fetch_page": q_fetch_page,
    "fetch_deep_page": q_fetch_deep_page,
    "fetch_total_available": q_fetch_total_available,
    "table_counts": q_table_counts,
    "source_tables": q_source_tables,
    "json_safe_rows": q_json_safe_rows,
    "source_current_state": q_source_current_state,
    "source_catalog": q_source_catalog,
    "query_router": q_query_router,
    "query_guard_audit": q_query_guard_audit,
    "clean_date": q_clean_date,
    "clean_phone": q_clean_phone,
    "clean_email": q_clean_email,
    "clean_text_case": q_clean_text_case,
    "clean_nulls": q_clean_nulls,
    "clean_auto_detect": q_clean_auto_detect,
    "clean_currency": q_clean_currency,
    "clean_stats": q_clean_stats,
    "pii_redact_text": q_pii_redact_text,
    "pii_stats": q_pii_stats,
    "pii_redact_fields": q_pii_redact_fields,
    "pii_field_audit": q_pii_field_audit,
    "pii_redact_all": q_pii_redact_all,
    "dedup_full": q_dedup_full,
    "dedup_keys": q_dedup_keys,
    "dedup_stats": q_dedup_stats,
    "index_upsert": q_index_upsert,
    "index_delete_source": q_index_delete_source,
    "search_topk": q_search_topk,
    "search_topk_filtered": q_search_topk_filtered,
    "search_topk_batch": q_search_topk_batch,
    "search_text_tfidf": q_search_text_tfidf,
    "search_index_text": q_search_index_text,
    "search_ann_recall": q_search_ann_recall,
    "context_chunks": q_context_chunks,
    "context_pack": q_context_pack,
    "context_pack_ranked": q_context_pack_ranked,
    "context_totals": q_context_totals,
    "context_chunks_multi": q_context_chunks_multi,
    "dataset_profile": q_dataset_profile,
    "dataset_top_values": q_dataset_top_values,
    "explore_source": q_explore_source,
    "credit_balance": q_credit_balance,
    "credit_balance_plan": q_credit_balance_plan,
    "credit_running_balance": q_credit_running_balance,
    "credit_history_topn": q_credit_history_topn,
    "credit_check_balance": q_credit_check_balance,
    "low_balance_alerts": q_low_balance_alerts,
    "usage_cost_rollup": q_usage_cost_rollup,
    "credit_reason_rollup": q_credit_reason_rollup,
    "credit_refunds": q_credit_refunds,
    "credit_pricing": q_credit_pricing,
    "credit_admission": q_credit_admission,
    "credit_admission_events": q_credit_admission_events,
    "metered_ledger": q_metered_ledger,
    "metered_balance": q_metered_balance,
    "payment_settlement": q_payment_settlement,
    "curate_records": q_curate_records,
    "curate_records_first": q_curate_records_first,
    "curate_report": q_curate_report,
}
