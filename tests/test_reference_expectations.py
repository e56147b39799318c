"""The reference's own expectations, restated as DataFrame tests."""

import pytest
from pyspark.sql import functions as F

from refinery import sources
from refinery.functions import sqlguard
from refinery.operators import clean, dedup, ledger, query, redact


PRODUCTS = [(i, f"product {i}", ("tools", "paper", "paint")[i % 3], 1.5 * i) for i in range(1, 13)]
SALES = [(i, 1 + i % 12, ("open", "paid", "lost", "paid")[i % 4], 10.0 * i) for i in range(1, 21)]
SALES_SCHEMA = "id int, product_id int, state string, total double"


@pytest.fixture()
def shop(spark):
    """Two small tables of our own, as views and DataFrames."""
    tables = {"products": spark.createDataFrame(PRODUCTS, "id int, name string, kind string, price double"),
              "sales": spark.createDataFrame(SALES, SALES_SCHEMA)}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


# --- dedup -----------------------------------------------------------------
def test_dedup_full_record(spark):
    df = spark.createDataFrame([(0, "Alice", "alice@test.com"), (1, "Bob", "bob@test.com"),
                                (2, "Alice", "alice@test.com")], "seq int, name string, email string")
    out = dedup.deduplicate(df, order_by="seq")
    assert out.count() == 2
    assert sorted(r.seq for r in out.collect()) == [0, 1]  # the first copy survives
    rep = dedup.dedup_report(df, order_by="seq").first()
    assert (rep.records_in, rep.records_out, rep.duplicates_removed) == (3, 2, 1)


def test_dedup_by_key(spark):
    df = spark.createDataFrame([(0, "Alice", "alice@test.com", 30), (1, "Alice", "alice@test.com", 31)],
                               "seq int, name string, email string, age int")
    out = dedup.deduplicate(df, keys=["email"], order_by="seq").collect()
    assert len(out) == 1 and out[0].age == 30


def test_dedup_no_duplicates(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert dedup.dedup_report(df).first().duplicates_removed == 0


def test_dedup_null_keys_are_one_group_not_the_text_none(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, "None")], "seq int, k string")
    assert dedup.deduplicate(df, keys=["k"], order_by="seq").count() == 2


def test_dedup_unknown_key_raises(spark):
    df = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError):
        dedup.deduplicate(df, keys=["nope"])


# --- clean -----------------------------------------------------------------
def test_date_standardization(spark):
    df = spark.createDataFrame([("03/15/2024",), ("2024-03-16",)], "created_at string")
    out = [r.created_at for r in clean.clean(df, {"created_at": "date"}).collect()]
    assert out == ["2024-03-15", "2024-03-16"]


def test_email_lowercase(spark):
    df = spark.createDataFrame([("  Alice@Test.COM  ",)], "email string")
    assert clean.clean(df, {"email": "email"}).first().email == "alice@test.com"


def test_currency_parsing(spark):
    df = spark.createDataFrame([("$1,234.56",)], "amount string")
    assert clean.clean(df, {"amount": "currency"}).first().amount == 1234.56


def test_auto_detect(spark):
    df = spark.createDataFrame([("TEST@foo.com", "(555) 123-4567", "$100")], "email string, phone string, revenue string")
    audited = clean.clean_with_audit(df)
    rep = clean.clean_report(audited).first()
    assert rep.records_out == 1
    row = clean.clean(df).first()
    assert (row.email, row.phone, row.revenue) == ("test@foo.com", "5551234567", 100.0)
    assert rep.formats_standardized == 3  # "$100" -> 100.0 is a change


def test_auto_detect_substring_quirk():
    # field names only, in order date -> phone -> email -> currency
    from refinery.functions.text import detect_rule
    assert detect_rule("hotel_price") == "phone"   # contains "tel"
    assert detect_rule("updated_value") == "date"
    assert detect_rule("c_name") is None


def test_nulls_filled_not_counted_as_standardized(spark):
    df = spark.createDataFrame([(None, ""), ("x", "5")], "note string, amount string")
    audited = clean.clean_with_audit(df, {"note": "text_upper", "amount": "currency", "missing": "date"})
    rows = clean.clean(df, {"note": "text_upper", "amount": "currency"}).collect()
    assert rows[0].note == "" and rows[0].amount == 0.0
    rep = clean.clean_report(audited).first()
    assert rep.nulls_filled == 2 and rep.formats_standardized == 2


# --- PII -------------------------------------------------------------------
def test_pii_auto_fields(spark):
    df = spark.createDataFrame([("Alice", "alice@test.com", "+1-555-0101")], "name string, email string, phone string")
    row = redact.redact(df).first()
    assert row.email == "[REDACTED]" and row.name == "[REDACTED]" and row.phone == "[REDACTED]"
    rep = redact.redact_report(redact.redact_with_audit(df)).first()
    assert rep.fields_redacted == 3 and rep.pii_types_found == ["email", "name", "phone"]


def test_pii_explicit_fields(spark):
    df = spark.createDataFrame([("Bob", "Acme")], "name string, company string")
    row = redact.redact(df, fields=["name"]).first()
    assert row.name == "[REDACTED]" and row.company == "Acme"


def test_pii_regex_in_text(spark):
    df = spark.createDataFrame([("Contact me at bob@example.com for details",)], "note string")
    assert "[REDACTED]" in redact.redact(df, fields=[]).first().note


def test_pii_custom_replacement_is_literal(spark):
    df = spark.createDataFrame([("test@test.com", "mail bob@example.com")], "email string, note string")
    row = redact.redact(df, replacement="$1 ***\\").first()
    assert row.email == "$1 ***\\" and row.note == "mail $1 ***\\"


def test_pii_first_mode_leaves_second_pattern(spark):
    df = spark.createDataFrame([("a@b.com or 5551234567",)], "note string")
    first = redact.redact(df, fields=[]).first().note
    every = redact.redact(df, fields=[], mode="all").first().note
    assert first == "[REDACTED] or 5551234567"
    assert every == "[REDACTED] or [REDACTED]"


def test_pii_non_string_never_scanned(spark):
    df = spark.createDataFrame([(5551234567,)], "amount bigint")
    assert redact.redact(df, fields=[]).first().amount == 5551234567


# --- sources ---------------------------------------------------------------
def test_tables_and_filters(spark, shop):
    assert query.fetch_rows(shop["products"], {"kind": "tools"}).count() == 4
    assert query.run_query(spark, "SELECT * FROM sales WHERE state = 'paid'").count() == 10
    assert query.run_query(spark, "SELECT COUNT(*) AS n FROM products").first().n == 12
    assert query.total_available(shop["products"], {"kind": "paint"}).first()[0] == 4


def test_registry_takes_own_sources(spark):
    sources.register_source("counter", lambda spark, n: spark.range(int(n)))
    assert sources.open_source(spark, "counter", n=7).count() == 7
    assert "counter" in sources.source_types()
    with pytest.raises(ValueError, match="oracle"):
        sources.open_source(spark, "oracle")


def test_csv_json_roundtrip(spark, shop, scratch):
    shop["sales"].write.mode("overwrite").option("header", True).csv(scratch + "/c")
    shop["sales"].write.mode("overwrite").json(scratch + "/j")
    c = sources.open_source(spark, "csv", path=scratch + "/c", header="true", schema=SALES_SCHEMA)
    j = sources.open_source(spark, "json", path=scratch + "/j", schema=SALES_SCHEMA)
    assert c.exceptAll(shop["sales"]).count() == 0 and j.exceptAll(shop["sales"]).count() == 0


def test_jdbc_derby_pushdown(spark, shop):
    url = "jdbc:derby:memory:refinery_test;create=true"
    shop["sales"].write.mode("overwrite").format("jdbc").options(
        url=url, dbtable="sales", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    df = sources.open_source(spark, "derby", url=url, dbtable="sales", partitionColumn="ID",
                             lowerBound=1, upperBound=21, numPartitions=2)
    one = df.where(F.col("PRODUCT_ID") == 1)
    assert one.count() == 1
    assert "EqualTo(product_id,1)" in one._jdf.queryExecution().executedPlan().toString()


# --- query routing and guard ----------------------------------------------
@pytest.mark.parametrize("text,natural", [
    ("list the best customers", True), ("how much was sold?", True), ("", True), ("selection of goods", True),
    ("SELECT * FROM sales", False), ("select count(*) from sales", False), ("\t With x AS (SELECT 1) SELECT * FROM x", False),
])
def test_router(text, natural):
    assert sqlguard.is_natural_language(text) is natural


@pytest.mark.parametrize("sql", [
    "DROP VIEW sales", "/* c */ DROP VIEW sales", "-- note\nDROP TABLE sales", "CREATE TABLE t2 USING parquet AS SELECT 1 AS a",
    "WITH x AS (SELECT 1 AS a) INSERT INTO sales SELECT * FROM x", "INSERT OVERWRITE DIRECTORY '/tmp/x' USING csv SELECT 1",
    "FROM sales INSERT INTO t1 SELECT id INSERT INTO t2 SELECT id", "TRUNCATE TABLE sales", "CACHE TABLE sales",
    "SET spark.sql.shuffle.partitions=3", "CREATE OR REPLACE TEMP VIEW sales AS SELECT 1",
])
def test_guard_refuses_whatever_changes_something(spark, shop, sql):
    for run in (lambda: query.run_query(spark, sql, mode="sql"), lambda: query.run_sql(spark, sql)):
        with pytest.raises(sqlguard.NotReadOnly):
            run()
    assert spark.table("sales").count() == 20


@pytest.mark.parametrize("sql", [
    "SELECT reflect('java.lang.System', 'setProperty', 'guard.probe', 'x')",
    "SELECT id FROM sales WHERE Java_Method('java.lang.System', 'setProperty', 'guard.probe', 'x') IS NULL",
    "WITH x AS (SELECT try_reflect('java.lang.System', 'setProperty', 'guard.probe', 'x') AS v) SELECT * FROM x",
    "SELECT (WITH x AS (SELECT reflect('java.lang.System', 'setProperty', 'guard.probe', 'x') AS v) SELECT v FROM x) AS v",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM sales", "EXECUTE IMMEDIATE 'DROP VIEW sales'",
    "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM sales WHERE id IN (SELECT value FROM TEXT.`/etc/hostname`)",
    "WITH x AS (SELECT * FROM text.`/etc/hostname`) SELECT * FROM x", "SELECT own_code(id) FROM sales",
    "SELECT * FROM own_rows(3)", "SELECT * FROM sales |> WHERE reflect('java.lang.System', 'setProperty', 'guard.probe', 'x') = ''",
    "SELECT id FROM sales LATERAL VIEW own_rows(3) AS v",
])
def test_guard_refuses_code_and_paths(spark, shop, sql):
    spark.udf.register("own_code", lambda v: v)
    for run in (lambda: query.run_query(spark, sql, mode="sql"), lambda: query.run_sql(spark, sql)):
        with pytest.raises(sqlguard.NotReadOnly):
            run()
    assert spark.sparkContext._jvm.java.lang.System.getProperty("guard.probe") is None


@pytest.mark.parametrize("sql,rows", [
    ("SELECT s.id FROM sales s JOIN sales t USING (id) WHERE s.id BETWEEN 1 AND 3 AND EXISTS (SELECT 1 FROM range(2))", 3),
    ("SELECT x, count(*) FILTER (WHERE x > 1) AS n FROM range(3) LATERAL VIEW explode(array(1, 2)) AS x GROUP BY ALL", 2),
    ("SELECT transform(array(id), x -> x + 1)[0], row_number() OVER (ORDER BY id), extract(year FROM current_date) FROM sales", 20),
    ("SELECT stack(2, 1, 2) AS v", 2), ("SELECT id::string || 'a', date '2020-01-01' + interval 1 day FROM sales |> LIMIT 4", 4),
    ("EXPLAIN SELECT * FROM sales", 1), ("SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY id) AS m FROM sales GROUP BY CUBE (state) HAVING count(*) > 0 LIMIT 1", 1),
    ("WITH x AS (SELECT * FROM sales) SELECT * FROM x", 20), ("SELECT * FROM sales UNION ALL SELECT * FROM sales", 40),
    ("VALUES (1), (2)", 2), ("SHOW TABLES LIKE 'sales'", 1), ("SELECT (SELECT max(id) FROM sales) AS m", 1),
])
def test_guard_lets_reading_pass(spark, shop, sql, rows):
    assert query.run_query(spark, sql, mode="sql").count() == rows
    assert query.run_sql(spark, sql).count() == rows


def test_natural_language_without_translator(spark):
    with pytest.raises(NotImplementedError):
        query.run_query(spark, "show me sales")


def test_limits(spark, shop):
    spark.range(700).createOrReplaceTempView("many")
    assert query.run_query(spark, "SELECT id AS credit_limit FROM sales", limit=3).count() == 3
    assert query.run_query(spark, "SELECT id FROM many").count() == 100
    assert query.run_query(spark, "SELECT id FROM many LIMIT 500").count() == 500
    assert query.run_query(spark, "WITH m AS (SELECT id FROM many) SELECT id FROM m ORDER BY id LIMIT 300").count() == 300
    assert query.run_query(spark, "SELECT id FROM (SELECT id FROM many LIMIT 500)").count() == 100


# --- ledger ----------------------------------------------------------------
def test_ledger_balance_and_admission(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    ledger_df = spark.createDataFrame([(1, "k1", 25, "free_tier_signup", t0)],
                                      "id long, api_key string, delta int, reason string, created_at timestamp_ntz")
    assert ledger.balances(ledger_df).first().balance == 25
    usage = spark.createDataFrame(
        [("k1", 1, t0 + dt.timedelta(seconds=1), "call", 5, 0),
         ("k1", 2, t0 + dt.timedelta(seconds=2), "call", 100, 0)],
        "api_key string, event_id long, ts timestamp_ntz, kind string, cost int, credits int")
    rows = sorted(ledger.admission(usage).collect(), key=lambda r: r.event_id)
    assert [r.admitted for r in rows] == [True, False]
    assert [r.balance_after for r in rows] == [20, 20]


def test_last_write_wins_change_logs(spark):
    """Agent plan and payment status updates as append-only logs (S-13b)."""
    import datetime as dt
    from refinery.operators import catalog
    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [("k1", "free", "active", t0, 1), ("k1", "pro", "active", t0 + dt.timedelta(days=1), 2),
         ("k2", "basic", "active", t0, 3), ("k2", "basic", "deleted", t0 + dt.timedelta(days=2), 4),
         ("k3", "free", "active", t0, 5)],
        "api_key string, plan string, status string, event_time timestamp_ntz, doc_id int")
    state = {r.api_key: r.plan for r in catalog.current_state(log, key="api_key").collect()}
    assert state == {"k1": "pro", "k3": "free"}


def test_all_mode_operator_matches_expression(spark):
    from refinery.functions import pii as pf
    doc = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    staged = redact.redact_with_audit(doc, fields=[], mode="all", passthrough=("doc_id",))
    value, found = pf.redact_all(F.col("text"))
    direct = doc.select("doc_id", value.alias("text"), F.array_distinct(found).alias("_pii_types"))
    a = staged.select("doc_id", "text", "_pii_types")
    assert a.exceptAll(direct).count() == 0 and direct.exceptAll(a).count() == 0
    assert staged.agg(F.sum("_fields_redacted")).first()[0] == direct.where(F.size("_pii_types") > 0).count()


def test_keyset_paging_covers_table_once(spark, shop):
    seen, last = [], None
    while True:
        page = [r.id for r in query.fetch_after(shop["sales"], "id", last, limit=6).collect()]
        if not page:
            break
        seen += page
        last = page[-1]
    assert seen == list(range(1, 21))


def test_offset_pages_are_disjoint_and_ordered(spark, shop):
    p1 = [r.id for r in query.fetch_rows(shop["sales"], limit=3, offset=0, order_by=["id"]).collect()]
    p2 = [r.id for r in query.fetch_rows(shop["sales"], limit=3, offset=3, order_by=["id"]).collect()]
    assert p1 == [1, 2, 3] and p2 == [4, 5, 6]
    with pytest.raises(ValueError):
        query.fetch_rows(shop["sales"], limit=0)
    with pytest.raises(ValueError):
        query.fetch_rows(shop["sales"], filters={"no_such": 1})


def test_natural_language_path_uses_translator_and_guard(spark, shop):
    df = query.run_query(spark, "how many sales are there", nl_to_sql=lambda q: "SELECT COUNT(*) AS n FROM sales")
    assert df.first().n == 20
    with pytest.raises(ValueError):
        query.run_query(spark, "remove all sales", nl_to_sql=lambda q: "DELETE FROM sales")


def test_list_tables_and_json_safe(spark, shop):
    import datetime as dt
    for i in range(25):
        spark.range(1).createOrReplaceTempView(f"view_{i:02d}")
    names = [r.table_name for r in sources.list_tables(spark).collect()]
    assert names == sorted(names) and {"products", "sales", "view_00", "view_24"} <= set(names)
    df = spark.createDataFrame([(1, [1, 2], {"a": None}, None, dt.datetime(2024, 1, 2, 3, 4, 5),
                                 dt.datetime(2024, 1, 2, 3, 4, 5, 60))],
                               "id int, xs array<int>, m map<string,string>, s string, t timestamp, u timestamp")
    row = sources.json_safe(df).first()
    assert (row.id, row.xs, row.m, row.s) == (1, "[1,2]", '{"a":null}', None)
    assert (row.t, row.u) == ("2024-01-02 03:04:05", "2024-01-02 03:04:05.000060")


def test_schema_helpers(spark, shop):
    text = {r.table_name: r.schema_text for r in sources.schema_text(sources.table_schema(shop)).collect()}
    assert text["sales"] == "id (int), product_id (int), state (string), total (double)"


def test_source_health_reports_failure_as_data(spark, shop, scratch):
    ok = sources.source_health({"sales": shop["sales"]}, "shop").first()
    assert ok.connected and ok.sample_tables == ["sales"]
    import os
    os.makedirs(scratch + "/corrupt")
    with open(scratch + "/corrupt/part-0.parquet", "w") as fh:
        fh.write("not a parquet file")
    corrupt = spark.read.schema("x int").parquet(scratch + "/corrupt")  # fails only when read
    bad = sources.source_health({"corrupt": corrupt}, "broken").first()
    assert bad.connected is False and bad.message


def test_packing_budget_edges(spark):
    """D-13: per-chunk token floors, cut-offs cut to the remaining budget,
    and no empty chunk when the budget is already used up exactly."""
    from refinery.operators import context
    rows = [("c", 1, "a" * 401), ("c", 2, "b" * 403), ("c", 3, "x" * 40),   # 100 + 100 + 10 tokens
            ("d", 1, "a" * 400), ("d", 2, "b" * 400), ("d", 3, "z" * 400)]  # exact budget after two
    chunks = spark.createDataFrame(rows, "ctx string, pos int, content string")
    got = {(r.ctx, r.pos): (r.tokens, len(r.content), r.truncated)
           for r in context.pack(chunks, "ctx", ["pos"], budget=200).collect()}
    assert got == {("c", 1): (100, 401, False), ("c", 2): (100, 403, False),
                   ("d", 1): (100, 400, False), ("d", 2): (100, 400, False)}
    got = {(r.ctx, r.pos): (r.tokens, len(r.content)) for r in context.pack(chunks, "ctx", ["pos"], budget=150).collect()}
    assert got[("c", 2)] == (50, 200) and ("c", 3) not in got


def test_unknown_rule_keeps_the_type(spark):
    df = spark.createDataFrame([(5, None, "x"), (None, "", "y")], "a int, b string, c string")
    out = clean.clean(df, {"a": "no_such_rule", "b": "no_such_rule"})
    assert dict(out.dtypes)["a"] == "int" and [tuple(r) for r in out.collect()] == [(5, "", "x"), (None, "", "y")]


def test_redaction_keeps_columns_with_odd_names(spark):
    df = spark.createDataFrame([("mail a@b.com", "x", "y")], "note string, __pii0 string, __all0_1 string")
    for mode in ("first", "all"):
        out = redact.redact(df, fields=[], mode=mode)
        assert out.columns == df.columns and tuple(out.first()) == ("mail [REDACTED]", "x", "y")


def test_read_table_sees_new_files(spark, scratch):
    from refinery.session import read_table
    spark.range(5).write.parquet(scratch + "/t.parquet")
    assert read_table(spark, scratch, "t").count() == 5
    spark.range(7).write.mode("append").parquet(scratch + "/t.parquet")
    assert read_table(spark, scratch, "t").count() == 12


def test_curated_text_matches_no_pattern(spark):
    from refinery.functions import pii as pf
    from refinery.operators import workflows
    doc = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = workflows.curate(doc, {"text": "no_such_rule"}, ["text"], ["doc_id"], redact_fields=[])
    hits = [F.col("text").rlike(pf.java_pattern(n)) for n, _ in pf.PII_PATTERNS]
    assert out.where(F.greatest(*[h.cast("int") for h in hits]) == 1).count() == 0
