"""Streaming variants agree with the batch operators on the same data."""

import os

from pyspark.sql import functions as F

from refinery import streaming as st
from refinery.operators import clean, ledger
from refinery.plans import derived

from conftest import SF_SMALL


def _to_files(df, path, order_col, parts=3):
    """Write ``df`` as ``parts`` files, one per time slice, in time order (the
    file source replays them in modification-time order, one per micro-batch)."""
    lo, hi = df.agg(F.min(order_col), F.max(order_col)).first()
    step = (hi - lo) / parts
    for i in range(parts):
        cond = F.col(order_col) >= lo + step * i
        if i < parts - 1:
            cond = cond & (F.col(order_col) < lo + step * (i + 1))
        df.where(cond).coalesce(1).write.parquet(os.path.join(path, f"part{i}"))


def _run(stream_df, name, mode="append"):
    q = stream_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path + "/part*/*.parquet")


def test_clean_stream_equals_batch(spark, scratch):
    dc = derived.dirty_customer(spark, SF_SMALL)
    dc.coalesce(1).write.parquet(scratch + "/dc/part0")
    _run(st.clean_stream(_stream(spark, scratch + "/dc", dc.schema)), "clean_out")
    got = spark.table("clean_out")
    want = clean.clean(dc)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _admit(spark, path, schema, name, **options):
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        _run(st.admission_stream(_stream(spark, path, schema), **options), name)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    return spark.table(name)


def test_admission_stream_equals_batch_on_shuffled_arrival(spark, scratch):
    """Rows arrive in any order within a day, in four micro-batches; a last event of another key, far
    later, lets the watermark pass all of them."""
    usage = derived.usage_events(spark, SF_SMALL).select("api_key", "event_id", "ts", "kind", "cost", "credits")
    end = usage.agg(F.max("ts").alias("ts")).select(
        F.lit("clock").alias("api_key"), F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"),
        F.lit("purchase").alias("kind"), F.lit(0).alias("cost"), F.lit(0).alias("credits"))
    jitter = F.col("ts") + F.make_dt_interval(F.lit(0), F.pmod(F.hash("event_id"), F.lit(20)))
    lo, hi = usage.agg(F.min(jitter), F.max(jitter)).first()
    for i in range(4):
        mine = usage.where(F.least(F.floor((jitter - lo).cast("long") * 4 / F.lit((hi - lo).total_seconds())), F.lit(3)) == i)
        mine.orderBy(F.hash("event_id", "api_key")).coalesce(1).write.parquet(f"{scratch}/u/part{i}")
    end.coalesce(1).write.parquet(f"{scratch}/u/part9")
    got = _admit(spark, scratch + "/u", usage.schema, "adm_out", delay="1 day").where("api_key <> 'clock'")
    want = ledger.admission(usage)
    assert got.where("late").count() == 0 and got.count() == want.count() > 0
    columns = ["api_key", "event_id", "admitted", "balance_after"]
    assert got.select(*columns).exceptAll(want.select(*columns)).count() == 0


def test_late_events_come_out_undecided(spark, scratch):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    schema = "api_key string, event_id long, ts timestamp_ntz, kind string, cost int, credits int"
    batches = [
        [("a", 1, t0, "call", 5, 0), ("b", 2, t0 + dt.timedelta(minutes=30), "call", 20, 0)],
        [("a", 3, t0 + dt.timedelta(minutes=25), "call", 20, 0), ("a", 4, t0 + dt.timedelta(minutes=24), "call", 1, 0)],
        [("a", 5, t0 + dt.timedelta(minutes=5), "call", 1, 0), ("b", 6, t0 + dt.timedelta(hours=5), "purchase", 0, 3)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{scratch}/l/part{i}")
    rows = _admit(spark, scratch + "/l", spark.createDataFrame([], schema).schema, "late_out",
                  delay="10 minutes", late_for="2 hours").collect()
    got = {r.event_id: (r.admitted, r.balance_after, r.late) for r in rows}
    # 6 still waits; 5 came when 20 minutes had passed; 4 goes before 3, which then is refused
    assert got == {1: (True, 20, False), 2: (True, 5, False), 4: (True, 19, False), 3: (False, 19, False), 5: (None, None, True)}


def test_dedup_stream_keeps_one_row_per_key(spark, scratch):
    ev = spark.read.parquet(SF_SMALL + "/events.parquet")
    _to_files(ev, scratch + "/e", "ts")
    s = st.dedup_stream(_stream(spark, scratch + "/e", ev.schema), ["user_id", "event_type"], "ts", "40 days")
    _run(s, "dedup_out")
    got = spark.table("dedup_out")
    assert got.count() == got.select("user_id", "event_type").distinct().count() \
        == ev.select("user_id", "event_type").distinct().count()


def test_usage_windows_match_batch(spark, scratch):
    usage = derived.usage_events(spark, SF_SMALL)
    _to_files(usage, scratch + "/w", "ts")
    _run(st.usage_cost_windows(_stream(spark, scratch + "/w", usage.schema), "1 day", "1 hour"), "win_out")
    got = spark.table("win_out")
    calls = usage.where(F.col("kind") != "purchase").withColumn("ts", F.col("ts").cast("timestamp"))
    want = calls.groupBy(F.window("ts", "1 day").alias("w"), "tool").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("cost").cast("bigint").alias("credits")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tool", "calls", "credits")
    # windows are emitted once the watermark passes their end
    assert got.count() > 0
    assert got.exceptAll(want).count() == 0


def test_low_balance_alerts_via_foreach_batch(spark, scratch):
    led = derived.ledger(spark, SF_SMALL)
    _to_files(led, scratch + "/l", "created_at")
    handler = st.low_balance_sink(derived.subscriptions(spark, SF_SMALL), scratch + "/alerts")
    q = st.balances_stream(_stream(spark, scratch + "/l", led.schema)).writeStream.outputMode("update") \
        .foreachBatch(handler).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ledger.low_balance_alerts(led, derived.subscriptions(spark, SF_SMALL))
    final = {r.url for r in batch.collect()}
    if os.path.exists(scratch + "/alerts"):
        seen = {r.url for r in spark.read.parquet(scratch + "/alerts").collect()}
    else:
        seen = set()
    assert final <= seen


def test_redact_stream_equals_batch(spark, scratch):
    from refinery.operators import redact
    doc = spark.read.parquet(SF_SMALL + "/documents.parquet").select("doc_id", "text", "source")
    doc.coalesce(1).write.parquet(scratch + "/docs/part0")
    _run(st.redact_stream(_stream(spark, scratch + "/docs", doc.schema), fields=[]), "redact_out")
    got = spark.table("redact_out")
    want = redact.redact(doc, fields=[], mode="all")
    assert got.count() == doc.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
