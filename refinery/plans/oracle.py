"""Independent DuckDB SQL for every registered query (the correctness oracle).

The derived inputs are restated here in SQL from their written rules (see
``refinery.plans.derived``); the operators' semantics are restated as SQL
expressions, not generated from the Spark code.
"""

from __future__ import annotations

WS = r"'^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {WS}, '', 'g')"


def _api_key(x: str) -> str:
    return f"('ak_' || lpad(CAST({x} AS VARCHAR), 6, '0') || '_key')"


def _money(x: str) -> str:
    cents = f"CAST(round(abs({x}) * 100) AS BIGINT)"
    whole = f"({cents} // 100)"
    frac = f"lpad(CAST({cents} % 100 AS VARCHAR), 2, '0')"
    return (f"(CASE WHEN {whole} >= 1000000 THEN CAST({whole} // 1000000 AS VARCHAR) || ',' || "
            f"lpad(CAST(({whole} // 1000) % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST({whole} % 1000 AS VARCHAR), 3, '0') "
            f"WHEN {whole} >= 1000 THEN CAST({whole} // 1000 AS VARCHAR) || ',' || lpad(CAST({whole} % 1000 AS VARCHAR), 3, '0') "
            f"ELSE CAST({whole} AS VARCHAR) END || '.' || {frac})")


def _render_date(d: str, sel: str) -> str:
    fmts = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y", "%B %d, %Y", "%b %d, %Y"]
    return "(CASE " + " ".join(f"WHEN {sel} = {i} THEN strftime({d}, '{f}')" for i, f in enumerate(fmts)) + " END)"


_PARSE_FMTS = "['%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%Y/%m/%d', '%d-%m-%Y', '%m-%d-%Y', '%B %d, %Y', '%b %d, %Y']"


def _date_rule(x: str) -> str:
    s = _strip(x)
    return f"coalesce(strftime(try_strptime({s}, {_PARSE_FMTS}), '%Y-%m-%d'), {s})"


def _phone_rule(x: str) -> str:
    s = _strip(x)
    return f"(CASE WHEN regexp_replace({s}, '[^0-9+]', '', 'g') = '' THEN {s} ELSE regexp_replace({s}, '[^0-9+]', '', 'g') END)"


_FLOAT = r"[+-]?([0-9](_?[0-9])*(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?"


def _currency_rule(x: str) -> str:
    t = _strip(f"regexp_replace({_strip(x)}, '[,$€£]', '', 'g')")
    return (f"coalesce(round(CASE WHEN regexp_full_match({t}, '{_FLOAT}') THEN TRY_CAST(replace({t}, '_', '') AS DOUBLE) "
            f"WHEN regexp_full_match(lower({t}), '[+-]?(inf|infinity|nan)') THEN TRY_CAST(lower({t}) AS DOUBLE) END, 2), 0.0)")


def _currency_same(x: str) -> str:
    return (f"(regexp_full_match({x}, '-?(0|[1-9][0-9]*)\\.([0-9]*[1-9]|0)') AND TRY_CAST({x} AS DOUBLE) = {_currency_rule(x)} "
            f"AND length(regexp_extract({x}, '\\.([0-9]*)$', 1)) <= 2)")


def _empty(x: str) -> str:
    return f"({x} IS NULL OR {x} = '')"


# ---------------------------------------------------------------------------
# derived inputs as CTE bodies
# ---------------------------------------------------------------------------
DATED_ORDERS = f"""dated_orders AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 5 = 0 THEN '  ' || {_render_date('o_orderdate', 'o_orderkey % 8')} || ' '
              ELSE {_render_date('o_orderdate', 'o_orderkey % 8')} END AS raw_date
  FROM orders)"""

PRICED_LINEITEM = f"""priced_lineitem AS (
  SELECT l_orderkey, l_linenumber,
         CASE (l_orderkey + l_linenumber) % 6
              WHEN 0 THEN '$' || {_money('l_extendedprice')}
              WHEN 1 THEN '€' || {_money('l_extendedprice')}
              WHEN 2 THEN '£ ' || {_money('l_extendedprice')}
              WHEN 3 THEN 'n/a'
              WHEN 4 THEN ''
              ELSE replace({_money('l_extendedprice')}, ',', '') END AS raw_amount
  FROM lineitem)"""

_K = "c_custkey"
_D7 = f"lpad(CAST(({_K} * 7919) % 10000000 AS VARCHAR), 7, '0')"
DIRTY_CUSTOMER = f"""dirty_customer AS (
  SELECT c_custkey, c_name,
         CASE WHEN {_K} % 17 = 0 THEN NULL WHEN {_K} % 19 = 0 THEN ''
              ELSE (CASE {_K} % 4 WHEN 0 THEN '  ' WHEN 1 THEN chr(9) WHEN 2 THEN '' ELSE ' ' END)
                   || (CASE {_K} % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name ELSE lower(c_name) END)
                   || '@Example.COM' || (CASE WHEN {_K} % 5 = 0 THEN ' ' || chr(10) ELSE '' END) END AS contact_email,
         CASE WHEN {_K} % 23 = 0 THEN NULL ELSE
           CASE {_K} % 6
             WHEN 0 THEN '+1 (555) ' || substr({_D7}, 1, 3) || '-' || substr({_D7}, 4, 4)
             WHEN 1 THEN '555.' || substr({_D7}, 1, 3) || '.' || substr({_D7}, 4, 4)
             WHEN 2 THEN ' 555 ' || substr({_D7}, 1, 3) || ' ' || substr({_D7}, 4, 4) || ' '
             WHEN 3 THEN 'n/a'
             WHEN 4 THEN '+44-20-' || {_D7}
             ELSE '' END END AS contact_phone,
         CASE WHEN {_K} % 9 = 0
              THEN ' ' || {_render_date(f"(DATE '2020-01-01' + CAST(({_K} * 37) % 1500 AS INTEGER))", f'{_K} % 8')} || '  '
              ELSE {_render_date(f"(DATE '2020-01-01' + CAST(({_K} * 37) % 1500 AS INTEGER))", f'{_K} % 8')} END AS signup_date,
         CASE {_K} % 7
           WHEN 0 THEN (CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END) || '$' || {_money('c_acctbal')}
           WHEN 1 THEN (CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END) || '€' || {_money('c_acctbal')}
           WHEN 2 THEN (CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END) || '£' || {_money('c_acctbal')}
           WHEN 3 THEN 'call us'
           WHEN 4 THEN ''
           WHEN 5 THEN (CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END) || replace({_money('c_acctbal')}, ',', '')
           ELSE (CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END) || CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR) END
           AS balance_amount,
         CASE WHEN {_K} % 11 = 0 THEN NULL WHEN {_K} % 13 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment
  FROM customer)"""

# Fixed values (must match the reference): tool costs, credit packs.
_TOOLS = ", ".join(f"({i}, '{t}', {c})" for i, (t, c) in enumerate([
    ("sources.connect", 1), ("sources.list", 0), ("sources.test", 0), ("data.query", 2), ("data.fetch", 1),
    ("data.search", 2), ("pipeline.clean", 2), ("pipeline.deduplicate", 1), ("pipeline.redact_pii", 1),
    ("context.build", 3), ("context.summarize", 2), ("credits.check_balance", 0)]))
PACKS = "credit_packs(credits, price_cents) AS (VALUES (100, 800), (500, 3000), (1000, 5000), (5000, 20000), (10000, 40000))"

USAGE = f"""tools(tool_idx, tool, cost) AS (VALUES {_TOOLS}),
usage AS (
  SELECT e.event_id, e.ts, {_api_key('e.user_id')} AS api_key, e.event_type,
         CASE WHEN e.event_type = 'purchase' THEN 'purchase' WHEN e.event_type = 'error' THEN 'failed_call' ELSE 'call' END AS kind,
         CASE WHEN e.event_type = 'purchase' THEN NULL ELSE t.tool END AS tool,
         CAST(CASE WHEN e.event_type = 'purchase' THEN 0 ELSE t.cost END AS INTEGER) AS cost,
         CAST(CASE WHEN e.event_type <> 'purchase' THEN 0 WHEN e.event_id % 40 = 0 THEN 100
                   ELSE CAST(floor(e.value) AS BIGINT) % 10 END AS INTEGER) AS credits
  FROM events e JOIN tools t ON e.event_id % 12 = t.tool_idx)"""

LEDGER = USAGE + """,
ledger AS (
  SELECT -(min(event_id) * 2) - 1 AS id, api_key, 25 AS delta, 'free_tier_signup' AS reason,
         min(ts) - INTERVAL 1 SECOND AS created_at FROM usage GROUP BY api_key
  UNION ALL SELECT event_id * 2, api_key, -cost, 'tool_call', ts FROM usage WHERE kind <> 'purchase' AND cost > 0
  UNION ALL SELECT event_id * 2 + 1, api_key, cost, 'refund_failed_operation', ts FROM usage WHERE kind = 'failed_call' AND cost > 0
  UNION ALL SELECT event_id * 2, api_key, credits, 'credit_purchase', ts FROM usage WHERE kind = 'purchase')"""

AGENTS = f"""agents AS (
  SELECT {_api_key('c_custkey')} AS api_key,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'pro' WHEN 'MACHINERY' THEN 'basic' ELSE 'free' END AS plan
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE'))"""

SUBSCRIPTIONS = f"""subscriptions AS (
  SELECT {_api_key('c_custkey')} AS api_key, 'https://hooks.example.test/' || CAST(c_custkey AS VARCHAR) AS url,
         CASE c_custkey % 3 WHEN 0 THEN '["low_balance"]' WHEN 1 THEN '["payment_received", "low_balance"]'
              ELSE '["payment_received"]' END AS events_json
  FROM customer)"""

PAYMENTS = f"""payment_events AS (
  SELECT l.l_orderkey AS payment_id, {_api_key('o.o_custkey')} AS api_key,
         CASE l.l_orderkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 500 WHEN 2 THEN 1000 WHEN 3 THEN 5000 ELSE 10000 END AS credits,
         CASE (l.l_orderkey + l.l_linenumber) % 5 WHEN 0 THEN 'waiting' WHEN 1 THEN 'confirming' WHEN 2 THEN 'confirmed'
              WHEN 3 THEN 'sending' ELSE 'finished' END AS status,
         l.l_linenumber AS seq, l.l_shipdate + l.l_linenumber * INTERVAL 1 MINUTE AS event_ts
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

_PREFIXES = ["", "select ", "SELECT ", "with ", "drop ", "DELETE ", "update ", "insert ", "create ", "alter ",
             "truncate ", "grant ", "revoke ", "   Select' || chr(9) || '"]
QUERY_LOG = """query_log AS (
  SELECT conv_id, turn, (CASE (conv_id + turn) % 14 """ + " ".join(
    f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PREFIXES)) + """ END) || text AS query
  FROM conversations),
routed AS (
  SELECT conv_id, turn, regexp_extract(query, '^[\\s\\x1c-\\x1f]*([^\\s\\x1c-\\x1f]+)', 1) AS first_word FROM query_log)"""

SOURCE_LOG = f"""source_log AS (
  SELECT doc_id, source AS source_id,
         {_api_key('CAST(substr(source, 4, 10) AS INTEGER) % 3')} AS api_key,
         CASE CAST(substr(source, 4, 10) AS INTEGER) % 4 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'mock_crm'
              WHEN 2 THEN 'csv' ELSE 'json' END AS source_type,
         'Source ' || source AS name,
         CASE doc_id % 5 WHEN 0 THEN 'connected' WHEN 1 THEN 'connected' WHEN 2 THEN 'error'
              WHEN 3 THEN 'disconnected' ELSE 'deleted' END AS status,
         TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS event_time
  FROM documents),
source_state AS (
  SELECT * FROM (
    SELECT source_id, api_key, source_type, name, status, event_time AS updated_at,
           min(event_time) OVER (PARTITION BY source_id) AS created_at,
           count(*) OVER (PARTITION BY source_id) AS n_events,
           row_number() OVER (PARTITION BY source_id ORDER BY event_time DESC, doc_id DESC) AS rn
    FROM source_log) WHERE rn = 1 AND status <> 'deleted')"""

# Fixed values (must match the reference): PII patterns in RE2 syntax (same text as the Java ones, without the (?U) flag)
_PII = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
]


def _redact_first(x: str, repl: str = "[REDACTED]") -> str:
    return "(CASE " + " ".join(
        f"WHEN regexp_matches({x}, '{p}') THEN regexp_replace({x}, '{p}', '{repl}', 'g')" for _, p in _PII) \
        + f" ELSE {x} END)"


def _redact_all(x: str, repl: str = "[REDACTED]") -> str:
    by_name = dict(_PII)
    for n in ("email", "credit_card", "ssn", "ip_address", "phone"):
        x = f"regexp_replace({x}, '{by_name[n]}', '{repl}', 'g')"
    return x


def _pii_type(x: str) -> str:
    return "(CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for n, p in _PII) + " END)"


def _any_pii(x: str) -> str:
    return "(" + " OR ".join(f"coalesce(regexp_matches({x}, '{p}'), false)" for _, p in _PII) + ")"


_TYPE_MAP = ("CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' "
             "WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP_NS' THEN 'timestamp_ntz' "
             "WHEN 'TIMESTAMP_US' THEN 'timestamp_ntz' WHEN 'TIMESTAMP_MS' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' "
             "ELSE lower(data_type) END")
_TABLE_LIST = ", ".join(f"'{t}'" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                                            "events", "documents", "embeddings", "pages", "benchmark", "labels",
                                            "conversations"))
COLUMNS = f"""cols AS (
  SELECT DISTINCT table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name, {_TYPE_MAP} AS data_type
  FROM information_schema.columns WHERE table_name IN ({_TABLE_LIST}))"""

# Fixed values (must match the reference): field-name families.
_FIELD_FAMILIES = [
    ("email", ("email", "mail", "e_mail")),
    ("phone", ("phone", "tel", "mobile", "fax")),
    ("name", ("name", "first_name", "last_name", "full_name", "contact_name")),
    ("address", ("address", "street", "city", "zip", "postal")),
    ("ssn", ("ssn", "social_security", "tax_id", "national_id")),
]


def _field_type(x: str) -> str:
    return "(CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower({x}), '{w}')" for w in ws) + f" THEN '{t}'"
        for t, ws in _FIELD_FAMILIES) + " END)"


# ---------------------------------------------------------------------------
# per-query SQL
# ---------------------------------------------------------------------------
def _profile_sql() -> str:
    spec = {
        "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                     ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                     ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                     ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
        "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                     ("c_acctbal", "double"), ("c_mktsegment", "string")],
    }
    return _profiled(spec)


def _profiled(spec: dict[str, list[tuple[str, str]]], named: str | None = None) -> str:
    parts = []
    for t, cols in spec.items():
        for c, ty in cols:
            num = ty in ("bigint", "int", "double")
            if num:
                mm = (f"CAST(MIN({c}) AS DOUBLE) AS min_num, CAST(MAX({c}) AS DOUBLE) AS max_num, "
                      f"ROUND(AVG({c}), 4) AS mean_num, NULL::VARCHAR AS min_str, NULL::VARCHAR AS max_str")
            elif ty == "timestamp_ntz":
                mm = (f"NULL::DOUBLE AS min_num, NULL::DOUBLE AS max_num, NULL::DOUBLE AS mean_num, "
                      f"strftime(MIN({c}), '%Y-%m-%d %H:%M:%S') AS min_str, strftime(MAX({c}), '%Y-%m-%d %H:%M:%S') AS max_str")
            else:
                mm = (f"NULL::DOUBLE AS min_num, NULL::DOUBLE AS max_num, NULL::DOUBLE AS mean_num, "
                      f"MIN({c}) AS min_str, MAX({c}) AS max_str")
            parts.append(f"SELECT '{named or t}' AS table_name, '{c}' AS column_name, '{ty}' AS data_type, COUNT(*) AS n_rows, "
                         f"COUNT(*) - COUNT({c}) AS n_nulls, COUNT(DISTINCT {c}) AS n_distinct, {mm} FROM {t}")
    return "\nUNION ALL\n".join(parts)


def _top_values_sql() -> str:
    parts = []
    for t, cols in (("lineitem", ("l_returnflag", "l_linestatus", "l_quantity")),
                    ("customer", ("c_mktsegment", "c_nationkey"))):
        for c in cols:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {t}")
    return f"""WITH v AS ({' UNION ALL '.join(parts)}),
cnt AS (SELECT table_name, column_name, value, COUNT(*) AS n FROM v GROUP BY ALL),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY table_name, column_name ORDER BY n DESC, value ASC NULLS FIRST) AS INTEGER) AS rank FROM cnt)
SELECT table_name, column_name, value, n, rank FROM rk WHERE rank <= 5"""


_CHUNKS = """chunk_rows AS (
  SELECT source, lang, doc_id,
         to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'source': source, 'n_chars': n_chars}) AS line,
         row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn
  FROM documents),
chunk_groups AS (
  SELECT source, lang, string_agg(line || chr(10), '' ORDER BY rn) AS body, CAST(count(*) AS INTEGER) AS n_rows
  FROM chunk_rows WHERE rn <= 10 GROUP BY source, lang),
chunks AS (
  SELECT source, lang AS table_name, CAST(row_number() OVER (PARTITION BY source ORDER BY lang) AS INTEGER) AS table_pos,
         n_rows,
         'Table: ' || lang || chr(10) || 'Schema: doc_id (bigint), text (string), lang (string), source (string), n_chars (bigint)'
         || chr(10) || 'Columns: doc_id, text, lang, source, n_chars' || chr(10) || body AS content,
         CAST(1.0 AS DOUBLE) AS relevance_score
  FROM chunk_groups QUALIFY table_pos <= 5),
packed AS (
  SELECT source AS context_id, table_pos, table_name, content AS full_content,
         CAST(length(content) // 4 AS BIGINT) AS tok,
         CAST(coalesce(sum(length(content) // 4) OVER (PARTITION BY source ORDER BY table_pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM chunks),
packed2 AS (
  SELECT context_id, table_pos, table_name,
         CAST(CASE WHEN before + tok > 4000 THEN 4000 - before ELSE tok END AS BIGINT) AS tokens,
         before + tok > 4000 AS truncated,
         CASE WHEN before + tok > 4000 THEN substring(full_content, 1, CAST((4000 - before) * 4 AS INTEGER)) ELSE full_content END AS content
  FROM packed WHERE before < 4000)"""


def _tfidf(items: str, queries: str) -> str:
    """CTEs up to scores(query_id, item_id, score)."""
    words = "unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))"
    return f"""items AS ({items}), queries AS ({queries}),
itf AS (SELECT id, term, COUNT(*) AS tf FROM (SELECT id, {words} AS term FROM items) GROUP BY ALL),
qtf AS (SELECT id, term, COUNT(*) AS tf FROM (SELECT id, {words} AS term FROM queries) GROUP BY ALL),
total AS (SELECT COUNT(*) AS n FROM items),
idf AS (SELECT term, ln((n + 1.0) / (COUNT(*) + 1)) AS idf FROM itf, total GROUP BY term, n),
iw AS (SELECT id, term, tf * idf AS x FROM itf JOIN idf USING (term)),
qw AS (SELECT id, term, tf * coalesce(idf, ln(n + 1.0)) AS x FROM qtf LEFT JOIN idf USING (term), total),
il AS (SELECT id, sqrt(SUM(x * x)) AS len FROM iw GROUP BY id HAVING SUM(x * x) > 0),
ql AS (SELECT id, sqrt(SUM(x * x)) AS len FROM qw GROUP BY id HAVING SUM(x * x) > 0),
scores AS (SELECT qw.id AS query_id, iw.id AS item_id, round(SUM((iw.x / il.len) * (qw.x / ql.len)), 4) AS score
           FROM iw JOIN qw USING (term) JOIN il ON il.id = iw.id JOIN ql ON ql.id = qw.id GROUP BY ALL)"""


_INDEX = """loads AS (
  SELECT md5(source || ':documents:' || to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'source': source, 'n_chars': n_chars})) AS doc_id,
         source AS source_id, 'documents' AS table_name, text AS content,
         unnest(CASE WHEN lang IN ('fr', 'de') THEN [1, 2] ELSE [1] END) AS load_seq FROM documents),
idx AS (SELECT * FROM loads QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY load_seq DESC) = 1)"""


def _multi_chunks_sql() -> str:
    tables = {
        "customer": ("c_custkey", (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_mktsegment", "string"))),
        "nation": ("n_nationkey", (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"))),
        "orders": ("o_orderkey", (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                                  ("o_orderpriority", "string"))),
        "part": ("p_partkey", (("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
                               ("p_size", "int"))),
    }
    parts = []
    for pos, (t, (key, cols)) in enumerate(tables.items(), 1):
        line = "to_json({" + ", ".join(f"'{c}': {c}" for c, _ in cols) + "})"
        head = (f"Table: {t}\\nSchema: " + ", ".join(f"{c} ({k})" for c, k in cols) + "\\nColumns: "
                + ", ".join(c for c, _ in cols) + "\\n")
        head = "'" + head.replace("\\n", "' || chr(10) || '") + "'"
        parts.append(f"SELECT {pos} AS table_pos, '{t}' AS table_name, CAST(COUNT(*) AS INTEGER) AS n_rows, "
                     f"{head} || string_agg(line || chr(10), '' ORDER BY k) AS content "
                     f"FROM (SELECT {key} AS k, {line} AS line FROM {t} ORDER BY {key} LIMIT 10)")
    return f"""WITH chunks AS ({' UNION ALL '.join(parts)}),
b AS (SELECT *, length(content) // 4 AS tok, coalesce(sum(length(content) // 4) OVER (ORDER BY table_pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunks)
SELECT 'warehouse' AS context_id, table_pos, table_name, n_rows,
       CAST(CASE WHEN before + tok > 1000 THEN 1000 - before ELSE tok END AS BIGINT) AS tokens, before + tok > 1000 AS truncated,
       CASE WHEN before + tok > 1000 THEN substring(content, 1, CAST((1000 - before) * 4 AS INTEGER)) ELSE content END AS content
FROM b WHERE before < 1000"""


_ADMITTED = USAGE + """,
e AS (SELECT api_key, list({'id': event_id, 'k': kind, 'c': cost, 'cr': credits, 'ts': ts, 'b': 25::BIGINT, 'a': true}
             ORDER BY ts, event_id) AS evs FROM usage GROUP BY api_key),
f AS (SELECT api_key, list_reduce(evs, lambda acc, x: list_append(acc, {
          'id': x.id, 'k': x.k, 'c': x.c, 'cr': x.cr, 'ts': x.ts,
          'b': (CASE WHEN x.k = 'purchase' THEN acc[len(acc)].b + x.cr
                     WHEN acc[len(acc)].b >= x.c AND x.k = 'call' THEN acc[len(acc)].b - x.c ELSE acc[len(acc)].b END)::BIGINT,
          'a': x.k = 'purchase' OR acc[len(acc)].b >= x.c}),
        [{'id': -1::BIGINT, 'k': '', 'c': 0, 'cr': 0, 'ts': NULL::TIMESTAMP, 'b': 25::BIGINT, 'a': true}]) AS s FROM e),
admitted AS (SELECT api_key, unnest(s[2:]) AS r FROM f)"""

_METERED = _ADMITTED + """,
ledger AS (
  SELECT -(min(event_id) * 2) - 1 AS id, api_key, 25 AS delta, 'free_tier_signup' AS reason,
         min(ts) - INTERVAL 1 SECOND AS created_at FROM usage GROUP BY api_key
  UNION ALL SELECT r.id * 2, api_key, -r.c, 'tool_call', r.ts FROM admitted WHERE r.a AND r.k <> 'purchase' AND r.c > 0
  UNION ALL SELECT r.id * 2 + 1, api_key, r.c, 'refund_failed_operation', r.ts FROM admitted WHERE r.a AND r.k = 'failed_call' AND r.c > 0
  UNION ALL SELECT r.id * 2, api_key, r.cr, 'credit_purchase', r.ts FROM admitted WHERE r.k = 'purchase')"""


def _ledger_q(body: str) -> str:
    return f"WITH {LEDGER}\n{body}"


ORACLE: dict[str, str] = {
    "query_topk": """
WITH best AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)
SELECT c_custkey, c_name, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS n_name, c_acctbal FROM best""",
    "query_default_limit": """
SELECT o_orderkey, o_custkey, o_totalprice FROM (
  SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 100""",
    "sql_join_agg": """
WITH home AS (SELECT c_custkey, n_name, r_name FROM customer, nation, region
              WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey)
SELECT h.n_name, h.r_name, COUNT(*) AS n_lines, SUM(l_quantity)::DOUBLE AS sum_qty,
       ROUND(SUM(l_extendedprice - l_extendedprice * l_discount), 2) AS revenue
FROM home h, orders, lineitem WHERE o_custkey = h.c_custkey AND l_orderkey = o_orderkey
GROUP BY ALL""",
    "sql_rollup": "\nUNION ALL\n".join(
        f"SELECT {a} AS l_returnflag, {b} AS l_linestatus, {g}::INTEGER AS grouping_level, COUNT(*) AS n_lines, "
        f"SUM(l_quantity)::DOUBLE AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_price, ROUND(SUM(l_discount), 2) AS sum_disc "
        f"FROM lineitem {by}" for a, b, g, by in (
            ("l_returnflag", "l_linestatus", 0, "GROUP BY l_returnflag, l_linestatus"),
            ("l_returnflag", "NULL", 2, "GROUP BY l_returnflag"), ("NULL", "NULL", 3, ""))),
    "sql_cube_having": "SELECT * FROM (" + "\nUNION ALL\n".join(
        f"SELECT {a}::VARCHAR AS l_returnflag, {b}::VARCHAR AS l_linestatus, {g}::INTEGER AS grouping_level, COUNT(*) AS n_lines, "
        f"COUNT(DISTINCT l_orderkey) AS n_orders, quantile_cont(l_quantity, 0.5) AS median_qty FROM lineitem {by}"
        for a, b, g, by in (
            ("l_returnflag", "l_linestatus", 0, "GROUP BY l_returnflag, l_linestatus"),
            ("l_returnflag", "NULL", 2, "GROUP BY l_returnflag"), ("NULL", "l_linestatus", 1, "GROUP BY l_linestatus"),
            ("NULL", "NULL", 3, ""))) + ") WHERE n_lines > 100",
    "sql_projection": """
SELECT o_orderkey, o_custkey, o_orderstatus, NOT (o_totalprice <= 100000) AS is_large,
       date_part('year', o_orderdate)::INTEGER AS order_year, ucase(o_orderpriority) AS priority FROM orders""",
    "count_star": "SELECT SUM(1)::BIGINT AS count FROM lineitem",
    "where_conjunction": """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag FROM lineitem
WHERE NOT (l_quantity < 10 OR l_quantity >= 40 OR l_discount > 0.05 OR l_returnflag = 'N' OR l_tax <= 0.02)""",
    "crm_orders_by_nation": """
SELECT n_name, o_orderstatus, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS order_value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name, o_orderstatus""",
    "sql_set_ops": """
SELECT 'union' AS op, COUNT(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL
SELECT 'intersect', COUNT(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL
SELECT 'except', COUNT(*) FROM (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' EXCEPT SELECT o_custkey FROM orders)""",
    "fetch_filtered": "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7 ORDER BY c_custkey LIMIT 10000",
    "fetch_deep_page": """SELECT l_extendedprice, l_orderkey, l_linenumber, l_shipdate FROM lineitem
ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 50 OFFSET 5000""",
    "fetch_page": "SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 100",
    "fetch_total_available": "SELECT COUNT(*) AS total_available FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "table_counts": "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in _TABLE_LIST.replace("'", "").split(", ")),
    "source_tables": f"""WITH {COLUMNS}, counts AS ({' UNION ALL '.join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in _TABLE_LIST.replace("'", "").split(", "))})
SELECT c.table_name, c.row_count, CAST(n.n_columns AS INTEGER) AS n_columns
FROM counts c JOIN (SELECT table_name, COUNT(*) AS n_columns FROM cols GROUP BY table_name) n USING (table_name)
ORDER BY c.table_name""",
    "json_safe_rows": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       regexp_replace(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f'), '[.]0+$', '') AS o_orderdate, o_orderpriority FROM orders""",
    "source_current_state": f"WITH {SOURCE_LOG} SELECT source_id, api_key, status, created_at, updated_at, n_events FROM source_state",
    "source_catalog": f"""WITH {SOURCE_LOG}
SELECT api_key, source_id, source_type, name, status, created_at,
       CAST(row_number() OVER (PARTITION BY api_key ORDER BY created_at DESC, source_id) AS INTEGER) AS pos
FROM source_state""",
    "query_router": f"""WITH {QUERY_LOG}
SELECT conv_id, turn, first_word,
       lower(first_word) NOT IN ('select', 'insert', 'update', 'delete', 'create', 'drop', 'alter', 'with') AS is_natural_language
FROM routed""",
    "query_guard_audit": f"""WITH {QUERY_LOG},
g AS (SELECT conv_id, turn, CASE WHEN upper(first_word) IN ('DROP', 'DELETE', 'UPDATE', 'INSERT', 'ALTER', 'TRUNCATE', 'GRANT', 'REVOKE')
                                 THEN upper(first_word) END AS forbidden_keyword FROM routed)
SELECT conv_id, turn, forbidden_keyword, CASE WHEN forbidden_keyword IS NOT NULL THEN 'rejected' ELSE 'allowed' END AS verdict FROM g""",
    "clean_date": f"""WITH {DATED_ORDERS}
SELECT o_orderkey, raw_date, CASE WHEN {_empty('raw_date')} THEN '' ELSE {_date_rule('raw_date')} END AS clean_date FROM dated_orders""",
    "clean_phone": f"""WITH {DIRTY_CUSTOMER}
SELECT c_custkey, contact_phone, CASE WHEN {_empty('contact_phone')} THEN '' ELSE {_phone_rule('contact_phone')} END AS phone
FROM dirty_customer""",
    "clean_email": f"""WITH {DIRTY_CUSTOMER}
SELECT c_custkey, contact_email, CASE WHEN {_empty('contact_email')} THEN '' ELSE lower({_strip('contact_email')}) END AS email
FROM dirty_customer""",
    "clean_text_case": f"""
SELECT p_partkey, lower({_strip("' ' || p_name || chr(9)")}) AS name_lower, upper({_strip("'  ' || p_type")}) AS type_upper
FROM part""",
    "clean_nulls": f"""WITH {DIRTY_CUSTOMER}
SELECT c_custkey,
       CASE WHEN {_empty('c_mktsegment')} THEN '' ELSE upper({_strip('c_mktsegment')}) END AS c_mktsegment,
       CASE WHEN {_empty('balance_amount')} THEN 0.0 ELSE {_currency_rule('balance_amount')} END AS balance_amount
FROM dirty_customer""",
    "clean_auto_detect": f"""WITH {DIRTY_CUSTOMER}
SELECT c_custkey, c_name,
       CASE WHEN {_empty('contact_email')} THEN '' ELSE lower({_strip('contact_email')}) END AS contact_email,
       CASE WHEN {_empty('contact_phone')} THEN '' ELSE {_phone_rule('contact_phone')} END AS contact_phone,
       CASE WHEN {_empty('signup_date')} THEN '' ELSE {_date_rule('signup_date')} END AS signup_date,
       CASE WHEN {_empty('balance_amount')} THEN 0.0 ELSE {_currency_rule('balance_amount')} END AS balance_amount,
       c_mktsegment
FROM dirty_customer""",
    "clean_currency": f"""WITH {PRICED_LINEITEM}
SELECT l_orderkey, l_linenumber, raw_amount,
       CASE WHEN {_empty('raw_amount')} THEN 0.0 ELSE {_currency_rule('raw_amount')} END AS amount
FROM priced_lineitem""",
    "clean_stats": f"""WITH {DIRTY_CUSTOMER}
SELECT COUNT(*) AS records_in, COUNT(*) AS records_out,
       CAST(SUM(CAST({_empty('contact_email')} AS INT) + CAST({_empty('contact_phone')} AS INT)
                + CAST({_empty('signup_date')} AS INT) + CAST({_empty('balance_amount')} AS INT)) AS BIGINT) AS nulls_filled,
       CAST(SUM(CAST(NOT {_empty('contact_email')} AND lower({_strip('contact_email')}) <> contact_email AS INT)
              + CAST(NOT {_empty('contact_phone')} AND {_phone_rule('contact_phone')} <> contact_phone AS INT)
              + CAST(NOT {_empty('signup_date')} AND {_date_rule('signup_date')} <> signup_date AS INT)
              + CAST(NOT {_empty('balance_amount')} AND NOT {_currency_same('balance_amount')} AS INT)) AS BIGINT)
         AS formats_standardized
FROM dirty_customer""",
    "pii_redact_text": f"SELECT doc_id, {_redact_first('text')} AS text, {_pii_type('text')} AS pii_type FROM documents",
    "pii_stats": f"""
SELECT COUNT(*) AS records_in,
       CAST(SUM(CAST({_any_pii('text')} AS INT) + CAST({_any_pii('lang')} AS INT) + CAST({_any_pii('source')} AS INT)) AS BIGINT)
         AS fields_redacted,
       coalesce((SELECT string_agg(DISTINCT t, ',' ORDER BY t) FROM (
           SELECT {_pii_type('text')} AS t FROM documents UNION ALL SELECT {_pii_type('lang')} FROM documents
           UNION ALL SELECT {_pii_type('source')} FROM documents) WHERE t IS NOT NULL), '') AS pii_types_found
FROM documents""",
    "pii_redact_fields": f"""WITH {DIRTY_CUSTOMER}
SELECT c_custkey,
       CASE WHEN c_name IS NOT NULL THEN '[REDACTED]' END AS c_name,
       CASE WHEN contact_email IS NOT NULL THEN '[REDACTED]' END AS contact_email,
       CASE WHEN contact_phone IS NOT NULL THEN '[REDACTED]' END AS contact_phone,
       {_redact_first('c_mktsegment')} AS c_mktsegment,
       CAST(coalesce(c_name <> '[REDACTED]', false) AS INT) + CAST(coalesce(contact_email <> '[REDACTED]', false) AS INT)
       + CAST(coalesce(contact_phone <> '[REDACTED]', false) AS INT) + CAST({_any_pii('c_mktsegment')} AS INT) AS fields_redacted
FROM dirty_customer""",
    "pii_field_audit": "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {_field_type(f"'{c}'")}::VARCHAR AS name_type, "
        f"COUNT({c}) AS n_values, " + ", ".join(f"COUNT(*) FILTER (regexp_matches({c}, '{p}')) AS n_{n}" for n, p in _PII)
        + f" FROM {t}" for t, cols in (
            ("customer", ("c_name", "c_mktsegment")), ("supplier", ("s_name",)), ("part", ("p_name", "p_brand", "p_type")),
            ("documents", ("text", "lang", "source")), ("conversations", ("role", "text")), ("pages", ("url",)))
        for c in cols),
    "pii_redact_all": f"""
SELECT doc_id, {_redact_all('text')} AS text, {_redact_all('source')} AS source,
       CAST({_redact_all('text')} <> text AS INTEGER) + CAST({_redact_all('source')} <> source AS INTEGER) AS fields_redacted
FROM documents""",
    "dedup_full": "SELECT MIN(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang",
    "dedup_keys": """
SELECT user_id, event_type, ts, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
    "dedup_stats": """
SELECT CAST(COUNT(*) AS BIGINT) AS records_in, (SELECT COUNT(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS records_out,
       CAST(COUNT(*) AS BIGINT) - (SELECT COUNT(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicates_removed
FROM documents""",
    "index_upsert": f"""WITH {_INDEX}
SELECT doc_id, source_id, table_name, CAST(length(content) AS INTEGER) AS content_chars, load_seq FROM idx""",
    "index_delete_source": f"""WITH {_INDEX}
SELECT CAST(SUM(CASE WHEN source_id = 'src3' THEN 1 ELSE 0 END) AS BIGINT) AS deleted,
       CAST(SUM(CASE WHEN source_id = 'src3' THEN 0 ELSE 1 END) AS BIGINT) AS remaining FROM idx""",
    "search_topk": """
WITH q AS (SELECT arg_min(embedding, vec_id) AS qv FROM embeddings WHERE label = 0)
SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 4) AS score
FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""",
    "search_topk_filtered": """
WITH q AS (SELECT arg_min(embedding, vec_id) AS qv FROM embeddings WHERE label = 0)
SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 4) AS score
FROM embeddings, q WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10""",
    "search_topk_batch": """
WITH q AS (SELECT label AS query_label, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY label),
s AS (SELECT q.query_label, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.qv::DOUBLE[]), 4) AS score
      FROM q CROSS JOIN embeddings e)
SELECT query_label, vec_id, label, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "search_text_tfidf": f"""WITH {_tfidf("SELECT doc_id AS id, text FROM documents", "SELECT item_id AS id, text FROM benchmark")}
SELECT query_id, item_id AS doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 5""",
    "search_index_text": f"""WITH {_INDEX}, mine AS (SELECT * FROM idx WHERE source_id = 'src1'),
{_tfidf("SELECT doc_id AS id, content AS text FROM mine", "SELECT item_id AS id, text FROM benchmark")}
SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id AS doc_id, source_id, score,
       CAST(length(content) AS INTEGER) AS content_chars, table_name
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scores WHERE score > 0) s
JOIN mine ON mine.doc_id = s.item_id WHERE rank <= 3""",
    "search_ann_recall": """
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id,
                  round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score
           FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0),
x AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10)
SELECT query_id, COUNT(*) AS n_neighbours, MIN(score) AS kth_score, TRUE AS recall_reached FROM x GROUP BY query_id""",
    "context_pack_ranked": f"""WITH {_CHUNKS}, keyed AS (SELECT *, source || chr(0) || table_name AS cid FROM chunks),
{_tfidf("SELECT cid AS id, content AS text FROM keyed", "SELECT item_id AS id, text FROM benchmark")},
r AS (SELECT query_id, source, table_pos, table_name, score, CAST(length(content) // 4 AS BIGINT) AS tok,
             CAST(coalesce(sum(length(content) // 4) OVER (PARTITION BY query_id, source ORDER BY score DESC, table_pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM scores JOIN keyed ON keyed.cid = scores.item_id WHERE score > 0)
SELECT query_id AS item_id, source AS context_id, table_pos, table_name, score AS relevance_score,
       CAST(CASE WHEN before + tok > 4000 THEN 4000 - before ELSE tok END AS BIGINT) AS tokens, before + tok > 4000 AS truncated
FROM r WHERE before < 4000""",
    "context_chunks_multi": _multi_chunks_sql(),
    "context_chunks": f"WITH {_CHUNKS} SELECT source, table_name, table_pos, n_rows, content, relevance_score FROM chunks",
    "context_pack": f"WITH {_CHUNKS} SELECT context_id, table_pos, table_name, tokens, truncated, content FROM packed2",
    "context_totals": f"""WITH {_CHUNKS},
b AS (SELECT source AS context_id, COUNT(*) AS n_chunks, CAST(SUM(length(content)) AS BIGINT) AS total_chars FROM chunks GROUP BY source),
a AS (SELECT context_id, COUNT(*) AS n_packed, CAST(SUM(tokens) AS BIGINT) AS packed_tokens FROM packed2 GROUP BY context_id)
SELECT b.context_id, n_chunks, total_chars, CAST(total_chars // 4 AS BIGINT) AS tokens_estimate, n_packed, packed_tokens
FROM b LEFT JOIN a USING (context_id)""",
    "dataset_profile": _profile_sql(),
    "dataset_top_values": _top_values_sql(),
    "explore_source": f"""WITH picked AS (
  SELECT c_mktsegment, c_nationkey, o_orderstatus, o_orderpriority, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000)
SELECT 'crm' AS source, true AS connected,
       'Connected. 2 tables, ' || ((SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM orders)) || ' records total.' AS message, p.*
FROM ({_profiled({"picked": [("c_mktsegment", "string"), ("c_nationkey", "int"), ("o_orderstatus", "string"),
                             ("o_orderpriority", "string"), ("o_totalprice", "double")]}, "crm")}) p""",
    "credit_balance": _ledger_q("SELECT api_key, CAST(COALESCE(SUM(delta), 0) AS BIGINT) AS balance FROM ledger GROUP BY api_key"),
    "credit_balance_plan": f"""WITH {LEDGER}, {AGENTS},
b AS (SELECT api_key, CAST(COALESCE(SUM(delta), 0) AS BIGINT) AS balance FROM ledger GROUP BY api_key)
SELECT b.api_key, b.balance, COALESCE(a.plan, 'free') AS plan FROM b LEFT JOIN agents a USING (api_key)""",
    "credit_running_balance": _ledger_q("""
SELECT id, api_key, delta, created_at,
       CAST(SUM(delta) OVER (PARTITION BY api_key ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_after
FROM ledger"""),
    "credit_history_topn": _ledger_q("""
SELECT api_key, pos, id, delta, reason, created_at FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY api_key ORDER BY created_at DESC, id DESC) AS INTEGER) AS pos FROM ledger)
WHERE pos <= 50"""),
    "credit_check_balance": f"""WITH {LEDGER}, {AGENTS},
b AS (SELECT api_key, CAST(COALESCE(SUM(delta), 0) AS BIGINT) AS balance FROM ledger GROUP BY api_key),
h AS (SELECT api_key, string_agg(CASE WHEN delta >= 0 THEN '+' ELSE '-' END || CAST(abs(delta) AS VARCHAR) || ' ' || reason,
                                 '; ' ORDER BY pos) AS recent_history
      FROM (SELECT *, row_number() OVER (PARTITION BY api_key ORDER BY created_at DESC, id DESC) AS pos FROM ledger)
      WHERE pos <= 10 GROUP BY api_key)
SELECT b.api_key, b.balance, COALESCE(a.plan, 'free') AS plan, h.recent_history
FROM b LEFT JOIN agents a USING (api_key) LEFT JOIN h USING (api_key)""",
    "low_balance_alerts": f"""WITH {LEDGER}, {SUBSCRIPTIONS},
b AS (SELECT api_key, CAST(COALESCE(SUM(delta), 0) AS BIGINT) AS balance FROM ledger GROUP BY api_key)
SELECT substr(b.api_key, 1, 8) || '...' AS api_key_masked, b.balance, s.url, 'low_balance' AS event
FROM b JOIN subscriptions s USING (api_key)
WHERE b.balance <= 5 AND list_contains(from_json(s.events_json, '["VARCHAR"]'), 'low_balance')""",
    "usage_cost_rollup": f"""WITH {USAGE}
SELECT api_key, tool, COUNT(*) AS calls, CAST(SUM(CASE WHEN kind = 'failed_call' THEN 1 ELSE 0 END) AS BIGINT) AS failed_calls,
       CAST(SUM(cost) AS BIGINT) AS credits_charged
FROM usage WHERE kind <> 'purchase' GROUP BY api_key, tool""",
    "credit_reason_rollup": _ledger_q("""
SELECT api_key, reason, CAST(SUM(delta) AS BIGINT) AS credits, COUNT(*) AS n_rows FROM ledger GROUP BY api_key, reason"""),
    "credit_refunds": f"""WITH {USAGE}
SELECT api_key, COUNT(*) AS n_refunds, CAST(SUM(cost) AS BIGINT) AS credits_refunded
FROM usage WHERE kind = 'failed_call' AND cost > 0 GROUP BY api_key""",
    "credit_pricing": f"""WITH {USAGE}, {PACKS}
SELECT u.event_id, u.api_key, u.credits,
       CAST(COALESCE(p.price_cents / 100.0, round(u.credits * 0.08, 2)) AS DOUBLE) AS price_usd
FROM usage u LEFT JOIN credit_packs p ON u.credits = p.credits WHERE u.kind = 'purchase'""",
    "credit_admission": f"""WITH {USAGE},
e AS (SELECT api_key, list({{'k': kind, 'c': cost, 'cr': credits}} ORDER BY ts, event_id) AS evs FROM usage GROUP BY api_key),
f AS (SELECT api_key, list_reduce(evs, lambda acc, x:
        CASE WHEN x.k = 'purchase' THEN {{'b': acc.b + x.cr, 'a': acc.a, 'r': acc.r}}
             WHEN acc.b >= x.c THEN {{'b': acc.b - CASE WHEN x.k = 'call' THEN x.c ELSE 0 END, 'a': acc.a + 1, 'r': acc.r}}
             ELSE {{'b': acc.b, 'a': acc.a, 'r': acc.r + 1}} END,
        {{'b': 25, 'a': 0, 'r': 0}}) AS s FROM e)
SELECT api_key, CAST(s.b AS BIGINT) AS final_balance, CAST(s.a AS BIGINT) AS n_admitted, CAST(s.r AS BIGINT) AS n_refused FROM f""",
    "credit_admission_events": f"""WITH {_ADMITTED}
SELECT api_key, r.id AS event_id, r.k AS kind, r.a AS admitted, r.b AS balance_after FROM admitted""",
    "metered_ledger": f"WITH {_METERED} SELECT id, api_key, CAST(delta AS INTEGER) AS delta, reason, created_at FROM ledger",
    "metered_balance": f"WITH {_METERED} SELECT api_key, CAST(SUM(delta) AS BIGINT) AS balance FROM ledger GROUP BY api_key",
    "payment_settlement": f"""WITH {PAYMENTS}, {PACKS},
s AS (SELECT * FROM payment_events WHERE status IN ('finished', 'confirmed')
      QUALIFY row_number() OVER (PARTITION BY payment_id ORDER BY event_ts, seq) = 1)
SELECT s.payment_id, s.api_key, s.credits,
       CAST(COALESCE(p.price_cents / 100.0, round(s.credits * 0.08, 2)) AS DOUBLE) AS price_usd,
       s.status AS settled_status, s.event_ts AS settled_at
FROM s LEFT JOIN credit_packs p ON s.credits = p.credits""",
    "curate_records": f"""
WITH c AS (SELECT doc_id, text, upper({_strip('lang')}) AS lang, lower({_strip('source')}) AS source FROM documents),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)
SELECT doc_id, {_redact_all('text')} AS text, {_redact_all('lang')} AS lang, {_redact_all('source')} AS source FROM s""",
    "curate_records_first": f"""
WITH c AS (SELECT doc_id, text, upper({_strip('lang')}) AS lang, lower({_strip('source')}) AS source FROM documents),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)
SELECT doc_id, {_redact_first('text')} AS text, {_redact_first('lang')} AS lang, {_redact_first('source')} AS source FROM s""",
    "curate_report": f"""
WITH c AS (SELECT doc_id, text, lang AS lang0, source AS source0, upper({_strip('lang')}) AS lang, lower({_strip('source')}) AS source
           FROM documents),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
st AS (SELECT COUNT(*) AS records_in,
              CAST(SUM(CAST({_empty('lang0')} AS INT) + CAST({_empty('source0')} AS INT)) AS BIGINT) AS nulls_filled,
              CAST(SUM(CAST(NOT {_empty('lang0')} AND lang <> lang0 AS INT) + CAST(NOT {_empty('source0')} AND source <> source0 AS INT)) AS BIGINT)
                AS formats_standardized FROM c),
rd AS (SELECT COUNT(*) AS records_out,
              CAST(SUM(CAST({_any_pii('text')} AS INT) + CAST({_any_pii('lang')} AS INT) + CAST({_any_pii('source')} AS INT)) AS BIGINT)
                AS fields_redacted,
              coalesce(string_agg(DISTINCT {_pii_type('text')}, ',' ORDER BY {_pii_type('text')}), '') AS pii_types_found FROM s)
SELECT st.records_in, rd.records_out, st.nulls_filled, st.formats_standardized, rd.fields_redacted, rd.pii_types_found,
       st.records_in - rd.records_out AS duplicates_removed
FROM st, rd""",
}
