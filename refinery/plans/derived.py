"""Inputs derived from the driver tables for the curation operators.

The driver tables are clean; the operators need dirty text, a credit ledger,
a query log and so on. Every derivation is a narrow projection (or one
aggregate) over a given table, so its size grows with the table. The same
rules are restated independently in SQL in ``refinery.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refinery.constants import CREDIT_PACKS, FREE_CREDITS, PER_CREDIT_USD, TOOL_COSTS  # noqa: F401
from refinery.operators import ledger as ledger_ops
from refinery.session import read_table

DATE_RENDER = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd",
               "dd-MM-yyyy", "MM-dd-yyyy", "MMMM dd, yyyy", "MMM dd, yyyy")
QUERY_PREFIXES = ("", "select ", "SELECT ", "with ", "drop ", "DELETE ", "update ",
                  "insert ", "create ", "alter ", "truncate ", "grant ", "revoke ", "   Select\t")
SOURCE_TYPES = ("postgresql", "mock_crm", "csv", "json")
SOURCE_STATUS = ("connected", "connected", "error", "disconnected", "deleted")
PAYMENT_STATUS = ("waiting", "confirming", "confirmed", "sending", "finished")


def _pick(index: Column, values) -> Column:
    """values[index] as a CASE expression."""
    out = F.when(index == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], 1):
        out = out.when(index == i, F.lit(v))
    return out


def api_key(user: Column) -> Column:
    return F.concat(F.lit("ak_"), F.lpad(user.cast("string"), 6, "0"), F.lit("_key"))


def money_text(x: Column) -> Column:
    """Absolute amount as text with thousands separators and 2 decimals."""
    # half-up on the non-negative double (same as SQL round() here, without BigDecimal)
    cents = F.floor(F.abs(x) * 100 + 0.5).cast("bigint")
    whole = F.floor(cents / 100).cast("bigint")
    frac = F.lpad((cents % 100).cast("string"), 2, "0")
    millions = F.floor(whole / 1000000).cast("bigint")
    thousands = F.floor(whole / 1000).cast("bigint") % 1000
    units = whole % 1000
    body = (F.when(whole >= 1000000, F.concat(millions.cast("string"), F.lit(","),
                                              F.lpad(thousands.cast("string"), 3, "0"), F.lit(","),
                                              F.lpad(units.cast("string"), 3, "0")))
             .when(whole >= 1000, F.concat(thousands.cast("string"), F.lit(","), F.lpad(units.cast("string"), 3, "0")))
             .otherwise(whole.cast("string")))
    return F.concat(body, F.lit("."), frac)


def render_date(d: Column, selector: Column) -> Column:
    return F.coalesce(*[F.when(selector == i, F.date_format(d, fmt)) for i, fmt in enumerate(DATE_RENDER)])


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders.o_orderdate rendered in one of 8 text formats (space padded for some)."""
    o = read_table(spark, sf_dir, "orders")
    raw = render_date(F.col("o_orderdate"), F.col("o_orderkey") % 8)
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("  "), raw, F.lit(" "))).otherwise(raw)
    return o.select("o_orderkey", raw.alias("raw_date"))


def priced_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem.l_extendedprice as currency text: $ / € / £ prefixes, separators, junk, empty."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", money_text(F.col("l_extendedprice")).alias("_body"))
    sel = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    body = F.col("_body")
    raw = (F.when(sel == 0, F.concat(F.lit("$"), body))
            .when(sel == 1, F.concat(F.lit("€"), body))
            .when(sel == 2, F.concat(F.lit("£ "), body))
            .when(sel == 3, F.lit("n/a"))
            .when(sel == 4, F.lit(""))
            .otherwise(F.regexp_replace(body, ",", "")))
    return li.select("l_orderkey", "l_linenumber", raw.alias("raw_amount"))


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with messy contact fields whose names trigger rule auto-detection."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.col("c_name")
    cased = F.when(k % 3 == 0, F.upper(name)).when(k % 3 == 1, name).otherwise(F.lower(name))
    pad = _pick(k % 4, ["  ", "\t", "", " "])
    email = F.concat(pad, cased, F.lit("@Example.COM"), F.when(k % 5 == 0, F.lit(" \n")).otherwise(F.lit("")))
    email = F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, F.lit("")).otherwise(email)
    d7 = F.lpad(((k * 7919) % 10000000).cast("string"), 7, "0")
    a, b = F.substring(d7, 1, 3), F.substring(d7, 4, 4)
    sel = k % 6
    phone = (F.when(sel == 0, F.concat(F.lit("+1 (555) "), a, F.lit("-"), b))
              .when(sel == 1, F.concat(F.lit("555."), a, F.lit("."), b))
              .when(sel == 2, F.concat(F.lit(" 555 "), a, F.lit(" "), b, F.lit(" ")))
              .when(sel == 3, F.lit("n/a"))
              .when(sel == 4, F.concat(F.lit("+44-20-"), d7))
              .otherwise(F.lit("")))
    phone = F.when(k % 23 == 0, F.lit(None)).otherwise(phone)
    day = F.date_add(F.lit("2020-01-01").cast("date"), ((k * 37) % 1500).cast("int"))
    signup = render_date(day, k % 8)
    signup = F.when(k % 9 == 0, F.concat(F.lit(" "), signup, F.lit("  "))).otherwise(signup)
    c = c.withColumn("_body", money_text(F.col("c_acctbal")))
    bal = F.col("c_acctbal")
    sign = F.when(bal < 0, F.lit("-")).otherwise(F.lit(""))
    body = F.col("_body")
    s7 = k % 7
    amount = (F.when(s7 == 0, F.concat(sign, F.lit("$"), body))
               .when(s7 == 1, F.concat(sign, F.lit("€"), body))
               .when(s7 == 2, F.concat(sign, F.lit("£"), body))
               .when(s7 == 3, F.lit("call us"))
               .when(s7 == 4, F.lit(""))
               .when(s7 == 5, F.concat(sign, F.regexp_replace(body, ",", "")))
               .otherwise(F.concat(sign, F.floor(F.abs(bal)).cast("bigint").cast("string"))))
    seg = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit("")).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", "c_name", email.alias("contact_email"), phone.alias("contact_phone"),
                    signup.alias("signup_date"), amount.alias("balance_amount"), seg.alias("c_mktsegment"))


def tool_costs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(TOOL_COSTS)],
                                 "tool_idx int, tool string, cost int")


def credit_packs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CREDIT_PACKS), "credits int, price_cents int")


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as metered tool calls: user -> api_key, event_id -> tool (and its
    cost, via a broadcast of the 12-row cost table), purchase -> credit top-up
    (a 100-credit pack for every 40th event id, else floor(value) mod 10)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    costs = F.broadcast(tool_costs(spark))
    ev = ev.withColumn("tool_idx", (F.col("event_id") % len(TOOL_COSTS)).cast("int"))
    ev = ev.join(costs, "tool_idx").drop("tool_idx")
    kind = F.when(F.col("event_type") == "purchase", F.lit("purchase")) \
            .when(F.col("event_type") == "error", F.lit("failed_call")).otherwise(F.lit("call"))
    return ev.select("event_id", "ts", api_key(F.col("user_id")).alias("api_key"), "event_type",
                     kind.alias("kind"),
                     F.when(F.col("event_type") == "purchase", F.lit(None)).otherwise(F.col("tool")).alias("tool"),
                     F.when(F.col("event_type") == "purchase", F.lit(0)).otherwise(F.col("cost")).alias("cost"),
                     F.when(F.col("event_type") != "purchase", F.lit(0))
                      .when(F.col("event_id") % 40 == 0, F.lit(100))
                      .otherwise((F.floor("value") % 10).cast("int")).alias("credits"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only credit ledger (id, api_key, delta, reason, created_at): sign-up
    grant, tool-call charges, refunds of failed calls and purchases."""
    u = usage_events(spark, sf_dir)
    # One pass over the usage: an event makes up to two rows.
    def row(id_, delta, reason):
        return F.struct(id_.cast("long").alias("id"), delta.cast("int").alias("delta"), F.lit(reason).alias("reason"))

    even, odd = F.col("event_id") * 2, F.col("event_id") * 2 + 1
    charged = (F.col("kind") != "purchase") & (F.col("cost") > 0)
    rows = F.array(
        F.when(charged, row(even, -F.col("cost"), "tool_call")),
        F.when(charged & (F.col("kind") == "failed_call"), row(odd, F.col("cost"), "refund_failed_operation")),
        F.when(F.col("kind") == "purchase", row(even, F.col("credits"), "credit_purchase")))
    moves = u.select("api_key", F.col("ts").alias("created_at"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")) \
        .select("r.id", "api_key", "r.delta", "r.reason", "created_at")
    grants = u.groupBy("api_key").agg(F.min("ts").alias("first_ts"), F.min("event_id").alias("first_id")).select(
        (-(F.col("first_id") * 2) - 1).alias("id"), "api_key", F.lit(FREE_CREDITS).alias("delta"),
        F.lit("free_tier_signup").alias("reason"),
        (F.col("first_ts") - F.expr("INTERVAL 1 SECOND")).alias("created_at"))
    return grants.unionByName(moves)


def metered_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger that follows from admission: sign-up grants and purchases, a charge
    for every admitted call, a refund for every admitted call that failed."""
    u = usage_events(spark, sf_dir)
    return ledger_ops.metered(ledger_ops.admission(u))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent/plan dimension derived from customer (only some segments have an agent row)."""
    c = read_table(spark, sf_dir, "customer")
    plan = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("pro")) \
            .when(F.col("c_mktsegment") == "MACHINERY", F.lit("basic")).otherwise(F.lit("free"))
    return c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE")).select(
        api_key(F.col("c_custkey")).alias("api_key"), F.col("c_name").alias("agent_name"), plan.alias("plan"))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook subscriptions with the event list stored as JSON text."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    events = _pick(k % 3, ['["low_balance"]', '["payment_received", "low_balance"]', '["payment_received"]'])
    return c.select(api_key(k).alias("api_key"),
                    F.concat(F.lit("https://hooks.example.test/"), k.cast("string")).alias("url"),
                    events.alias("events_json"))


def payment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crypto-payment status events: one per lineitem, payment = its order."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    status = _pick((F.col("l_orderkey") + F.col("l_linenumber")) % 5, PAYMENT_STATUS)
    packs = [p for p, _ in CREDIT_PACKS]
    ev = li.join(o, li.l_orderkey == o.o_orderkey)
    return ev.select(
        F.col("l_orderkey").alias("payment_id"),
        api_key(F.col("o_custkey")).alias("api_key"),
        _pick(F.col("l_orderkey") % 5, packs).alias("credits"),
        status.alias("status"),
        F.col("l_linenumber").alias("seq"),
        F.timestamp_add("MINUTE", F.col("l_linenumber"), F.col("l_shipdate")).alias("event_ts"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns turned into incoming queries (some prefixed with SQL verbs)."""
    cv = read_table(spark, sf_dir, "conversations")
    prefix = _pick((F.col("conv_id") + F.col("turn")) % len(QUERY_PREFIXES), QUERY_PREFIXES)
    return cv.select("conv_id", "turn", F.concat(prefix, F.col("text")).alias("query"))


def source_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a change log of registered sources (insert/status/tombstone)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    num = F.substring(F.col("source"), 4, 10).cast("int")
    return d.select(
        "doc_id",
        F.col("source").alias("source_id"),
        api_key(num % 3).alias("api_key"),
        _pick(num % 4, SOURCE_TYPES).alias("source_type"),
        F.concat(F.lit("Source "), F.col("source")).alias("name"),
        _pick(F.col("doc_id") % 5, SOURCE_STATUS).alias("status"),
        F.timestamp_add("MINUTE", F.col("doc_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("event_time"))
