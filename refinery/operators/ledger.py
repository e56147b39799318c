"""Credit ledger: balances, running balances, history, admission, refunds,
pricing, settlement and low-balance alerts.

The ledger is append-only (id, api_key, delta, reason, created_at); balances
are always derived, never stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refinery.constants import FREE_CREDITS, PER_CREDIT_USD
from refinery.session import saved, ship_package

LOW_BALANCE = 5


def balances(ledger: DataFrame) -> DataFrame:
    """COALESCE(SUM(delta), 0) per api_key — partial + final hash aggregate."""
    return ledger.groupBy("api_key").agg(F.coalesce(F.sum("delta"), F.lit(0)).cast("bigint").alias("balance"))


def balances_with_plan(ledger: DataFrame, agents: DataFrame) -> DataFrame:
    """Balance plus plan; keys with no agent row get plan 'free'. The agent side
    is a dimension; AQE turns the join into a broadcast when it is small."""
    return balances(ledger).join(agents.select("api_key", "plan"), "api_key", "left") \
        .select("api_key", "balance", F.coalesce("plan", F.lit("free")).alias("plan"))


def dealt_rows(ledger: DataFrame) -> DataFrame:
    """Ledger rows with the number of the range of (key, time, id) they were dealt to."""
    return ledger.select("id", "api_key", "delta", "reason", "created_at") \
        .repartitionByRange(int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions")), "api_key", "created_at", "id") \
        .withColumn("_part", F.spark_partition_id())


def running_balance(ledger: DataFrame) -> DataFrame:
    """Balance after every ledger row, ordered by (created_at, id) per key.

    A distributed prefix sum: rows are range-partitioned by sampled bounds of (key, time,
    id), so neither a hot key nor one instant that holds most of its rows stays in one
    task; each part adds up its own rows, and a key's parts (as many as there are
    partitions at most) give the offsets to add. The dealt rows are written to the shared
    folder, since both steps have to see the same parts.
    """
    dealt = saved(dealt_rows(ledger), "ledger-parts")
    totals = dealt.groupBy("api_key", "_part").agg(F.sum("delta").alias("_t"))
    before = Window.partitionBy("api_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("api_key", "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy("api_key", "_part").orderBy("created_at", "id") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("_local", F.sum("delta").over(within)).join(offsets, ["api_key", "_part"]).select(
        "id", "api_key", "delta", "reason", "created_at",
        (F.col("_off") + F.col("_local")).cast("bigint").alias("balance_after"))


def history(ledger: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` rows per key (created_at desc, id desc). Spark plans the
    rank filter as WindowGroupLimit, so each map task keeps only its top ``n``
    per key before the shuffle — a hot key ships n rows per task, not all."""
    w = Window.partitionBy("api_key").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return ledger.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n) \
        .select("api_key", "pos", "id", "delta", "reason", "created_at")


def check_balance(ledger: DataFrame, agents: DataFrame, n: int = 10) -> DataFrame:
    """credits.check_balance for every key at once: balance, plan and the newest
    ``n`` ledger rows as text ("delta reason" entries, newest first). The list
    is built from the WindowGroupLimit top-n, so it holds at most n rows per key."""
    recent = history(ledger, n)
    entry = F.struct(F.col("pos"), F.format_string("%+d %s", "delta", "reason").alias("e"))
    hist = recent.groupBy("api_key").agg(F.sort_array(F.collect_list(entry)).alias("_h")) \
        .select("api_key", F.concat_ws("; ", F.transform("_h", lambda x: x["e"])).alias("recent_history"))
    return balances_with_plan(ledger, agents).join(hist, "api_key", "left")


def low_balance_alerts(ledger: DataFrame, subscriptions: DataFrame, threshold: int = LOW_BALANCE) -> DataFrame:
    """Keys whose balance is <= threshold joined to their subscriptions that ask
    for 'low_balance'; the key is masked to its first 8 characters."""
    low = balances(ledger).where(F.col("balance") <= threshold)
    subs = subscriptions.where(F.array_contains(F.from_json("events_json", "array<string>"), "low_balance"))
    return low.join(subs.select("api_key", "url"), "api_key").select(
        F.concat(F.substring("api_key", 1, 8), F.lit("...")).alias("api_key_masked"),
        "balance", "url", F.lit("low_balance").alias("event"))


def usage_rollup(ledger: DataFrame) -> DataFrame:
    """Credits and row counts per (api_key, reason)."""
    return ledger.groupBy("api_key", "reason").agg(
        F.sum("delta").cast("bigint").alias("credits"), F.count(F.lit(1)).alias("n_rows"))


def tool_cost_rollup(usage: DataFrame) -> DataFrame:
    """Calls and credits charged per (api_key, tool), failed calls separated."""
    calls = usage.where(F.col("kind") != "purchase")
    return calls.groupBy("api_key", "tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.when(F.col("kind") == "failed_call", 1).otherwise(0)).cast("bigint").alias("failed_calls"),
        F.sum("cost").cast("bigint").alias("credits_charged"))


def refunds(usage: DataFrame) -> DataFrame:
    """Compensating +cost ledger rows for failed (charged) calls, per key."""
    failed = usage.where((F.col("kind") == "failed_call") & (F.col("cost") > 0))
    return failed.groupBy("api_key").agg(F.count(F.lit(1)).alias("n_refunds"),
                                         F.sum("cost").cast("bigint").alias("credits_refunded"))


def pricing(purchases: DataFrame, packs: DataFrame) -> DataFrame:
    """Pack price when the credit amount is a pack, else credits * $0.08 (rounded).
    ``packs`` is a fixed 5-row dimension, so broadcasting it is bounded."""
    p = purchases.join(F.broadcast(packs), "credits", "left")
    return p.select("event_id", "api_key", "credits",
                    F.coalesce(F.col("price_cents") / 100.0,
                               F.round(F.col("credits") * PER_CREDIT_USD, 2)).alias("price_usd"))


def settlements(payment_events: DataFrame) -> DataFrame:
    """Credit each payment exactly once, on its first move into finished/confirmed.

    ``min(struct(ts, seq, ...))`` per payment is a partial aggregate, so even a
    payment with a huge event history is reduced map-side.
    """
    settled = payment_events.where(F.col("status").isin("finished", "confirmed"))
    first = settled.groupBy("payment_id").agg(
        F.min(F.struct("event_ts", "seq", "status", "api_key", "credits")).alias("f"))
    return first.select("payment_id", "f.api_key", "f.credits", F.col("f.status").alias("settled_status"),
                        F.col("f.event_ts").alias("settled_at"))


# ---------------------------------------------------------------------------
# admission
# ---------------------------------------------------------------------------
ADMISSION_SCHEMA = "api_key string, event_id long, ts timestamp_ntz, kind string, cost int, credits int, admitted boolean, balance_after long"

SEGMENT = 1024  # events folded together, and segments (then groups of them) composed together
_ALWAYS = -(2 ** 62)  # requirement of a purchase: always admitted
_WINDOW = 2048       # events per optimistic vectorised step
_USAGE_COLS = ["api_key", "event_id", "ts", "kind", "cost", "credits"]


def _moves(kinds: np.ndarray, costs: np.ndarray, credits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Change of the balance if admitted, and balance required, of each event."""
    is_buy = kinds == "purchase"
    delta = np.where(is_buy, credits, np.where(kinds == "call", -costs, 0)).astype(np.int64)
    return delta, np.where(is_buy, _ALWAYS, costs).astype(np.int64)


def fold_admission(kinds: np.ndarray, costs: np.ndarray, credits: np.ndarray, balance: int):
    """Fold one key's events (already in order) from ``balance``.

    Returns (admitted flags, balance after each event, final balance).
    Per window of events: optimistically assume every call is admitted and get
    all balances from one cumsum; if no event would then be short of credits
    the window is done vectorised, otherwise it is folded with a plain loop.
    """
    delta, need = _moves(kinds, costs, credits)
    n = len(kinds)
    ok = np.ones(n, dtype=bool)
    after = np.empty(n, dtype=np.int64)
    bal = int(balance)
    for i in range(0, n, _WINDOW):
        j = min(n, i + _WINDOW)
        pre = bal + np.cumsum(delta[i:j]) - delta[i:j]
        if not (pre < need[i:j]).any():
            after[i:j] = pre + delta[i:j]
            bal = int(after[j - 1])
            continue
        win_ok, win_after = [], []
        for d, r in zip(delta[i:j].tolist(), need[i:j].tolist()):
            if bal >= r:
                bal += d
                win_ok.append(True)
            else:
                win_ok.append(False)
            win_after.append(bal)
        ok[i:j], after[i:j] = win_ok, win_after
    return ok, after, bal


class Transfer:
    """Exit balance as a function of the entry balance over low..high: runs that begin at entry
    ``starts`` with exit ``exits`` and rise by one an entry."""

    def __init__(self, starts: np.ndarray, exits: np.ndarray, high: int):
        self.starts, self.exits, self.high = starts, exits, high

    @classmethod
    def between(cls, low: int, high: int) -> "Transfer":
        return cls(np.array([low], np.int64), np.array([low], np.int64), high)

    def _split(self, at: np.ndarray, inside: np.ndarray) -> None:
        """Cut run ``inside[i]`` after its first ``at[i]`` entries."""
        self.starts = np.concatenate([self.starts, self.starts[inside] + at])
        self.exits = np.concatenate([self.exits, self.exits[inside] + at])
        order = np.argsort(self.starts, kind="stable")
        self.starts, self.exits = self.starts[order], self.exits[order]

    def _lengths(self) -> np.ndarray:
        return np.diff(np.append(self.starts, self.high + 1))

    def _join(self) -> None:
        """Neighbouring runs that go on in one line become one."""
        new = np.ones(len(self.starts), bool)
        new[1:] = np.diff(self.exits) != np.diff(self.starts)
        self.starts, self.exits = self.starts[new], self.exits[new]

    def event(self, delta: int, need: int) -> None:
        if delta == 0:
            return
        lengths = self._lengths()
        inside = np.flatnonzero((self.exits < need) & (need < self.exits + lengths))
        if len(inside):
            self._split(need - self.exits[inside], inside)
        self.exits = self.exits + np.where(self.exits >= need, delta, 0)
        if len(self.starts) > 64:
            self._join()

    def then(self, other: "Transfer") -> "Transfer":
        """First this, then ``other`` (whose domain holds all exits of this)."""
        edges = other.starts[1:]
        lengths = self._lengths()
        first = np.searchsorted(edges, self.exits, "right")
        last = np.searchsorted(edges, self.exits + lengths - 1, "right")
        runs = np.repeat(np.arange(len(lengths)), last - first + 1)
        k = np.arange(len(runs)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
        piece = first[runs] + k
        enter = np.maximum(self.exits[runs], other.starts[piece])
        out = Transfer(self.starts[runs] + enter - self.exits[runs], other.exits[piece] + enter - other.starts[piece], self.high)
        out._join()
        return out

    def at(self, entry: int) -> int:
        i = int(np.searchsorted(self.starts, entry, "right")) - 1
        return int(self.exits[i] + entry - self.starts[i])


_MARK = "api_key string, event_id long, ts timestamp_ntz, kind string, cost int, credits int, _seg long, _pos int, _d long, _need long, _p long"


def _segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (api_key, ts, event_id), numbered by segment of at most ``size`` events of one
    key, with change, requirement and the segment's change before the row."""
    from pyspark import TaskContext

    number, key, ran, total = (TaskContext.get().partitionId() << 32) - 1, None, None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        kinds, costs, credits = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "cost", "credits"))
        delta, need = _moves(kinds, costs, credits)
        keys = batch.column("api_key").fill_null("\0null").to_numpy(zero_copy_only=False)
        other = np.ones(n, bool)
        other[1:] = keys[1:] != keys[:-1]
        other[0] = ran is None or keys[0] != key
        # Place of each row among its key's rows of this part; a segment begins at each multiple of size.
        head = np.maximum.accumulate(np.where(other, np.arange(n), -1))
        place = np.arange(n) - np.maximum(head, 0) + np.where(head < 0, ran or 0, 0)
        begins = place % size == 0
        seg = number + np.cumsum(begins)
        sums = np.cumsum(delta) - delta
        first = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
        before = sums - np.where(first < 0, -total, sums[np.maximum(first, 0)])
        number, key, ran, total = int(seg[-1]), keys[-1], int(place[-1]) + 1, int(before[-1] + delta[-1])
        columns = [*batch.columns, pa.array(seg), pa.array((place % size).astype(np.int32)), pa.array(delta), pa.array(need),
                   pa.array(before)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_seg", "_pos", "_d", "_need", "_p"])


_TRANSFER = "api_key string, _grp long, _seg long, _low long, _high long, starts binary, exits binary"


def _transfer_row(key, group: int, seg: int, low: int, t: Transfer) -> pa.Table:
    return pa.table({"api_key": pa.array([key], pa.string()), "_grp": pa.array([group], pa.int64()),
                     "_seg": pa.array([seg], pa.int64()), "_low": pa.array([low], pa.int64()),
                     "_high": pa.array([t.high], pa.int64()), "starts": pa.array([t.starts.tobytes()], pa.binary()),
                     "exits": pa.array([t.exits.tobytes()], pa.binary())})


def _transfers(table: pa.Table) -> list[tuple[dict, Transfer]]:
    return [(r, Transfer(np.frombuffer(r["starts"], np.int64), np.frombuffer(r["exits"], np.int64), r["_high"]))
            for r in table.sort_by("_seg").to_pylist()]


def _of_segment(table: pa.Table) -> pa.Table:
    """One segment's events as a transfer over the entries it can have."""
    table = table.sort_by("_pos")
    first = table.slice(0, 1).to_pylist()[0]
    t = Transfer.between(first["_low"], first["_high"])
    for d, need in zip(table.column("_d").to_pylist(), table.column("_need").to_pylist()):
        t.event(d, need)
    t._join()
    return _transfer_row(first["api_key"], first["_grp"], first["_seg"], first["_low"], t)


def _of_group(table: pa.Table) -> pa.Table:
    """Consecutive segments (or groups) as one transfer, named by the first."""
    rows = _transfers(table)
    head, t = rows[0]
    for _, other in rows[1:]:
        t = t.then(other)
    return _transfer_row(head["api_key"], head["_grp"], head["_seg"], head["_low"], t)


def _entries(table: pa.Table) -> pa.Table:
    """Entry of each of a group's members, from the entry of the first (column ``_entry``)."""
    rows = _transfers(table)
    entry, out = rows[0][0]["_entry"], []
    for r, t in rows:
        out.append((r["_seg"], entry))
        entry = t.at(entry)
    return pa.table({"_seg": pa.array([s for s, _ in out], pa.int64()), "_exact": pa.array([e for _, e in out], pa.int64())})


def _fold_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (_seg, _pos), each with its segment's entry: the balance is carried across batches."""
    seg, bal = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        segs = batch.column("_seg").to_numpy()
        kinds, costs, credits = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "cost", "credits"))
        entries = batch.column("_entry").to_numpy()
        admitted, after = np.ones(len(segs), bool), np.empty(len(segs), np.int64)
        starts = np.flatnonzero(np.r_[True, segs[1:] != segs[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(segs)]):
            if segs[a] != seg:
                seg, bal = segs[a], int(entries[a])
            admitted[a:b], after[a:b], bal = fold_admission(kinds[a:b], costs[a:b], credits[a:b], bal)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _USAGE_COLS), pa.array(admitted), pa.array(after)],
                                         names=[*_USAGE_COLS, "admitted", "balance_after"])


def _composed(rows: DataFrame, tail: DataFrame, size: int) -> DataFrame:
    """(_seg, _exact): entry balances of ``tail`` segments (api_key, _seg, _low, _high, _first, _entry, _rank).

    Transfers of ``size`` consecutive segments are composed to one, ``size`` of those again,
    and so on until a key has one group; then entries are handed down level by level.
    """
    levels = [saved(
        rows.join(tail.select("_seg", "_low", "_high", F.expr(f"_rank div {size}").alias("_grp")), "_seg")
        .select("api_key", "_grp", "_seg", "_pos", "_d", "_need", "_low", "_high")
        .groupBy("_seg").applyInArrow(_of_segment, _TRANSFER), "transfers")]
    while levels[-1].agg(F.max("_grp")).first()[0]:
        groups = levels[-1].groupBy("api_key", "_grp").applyInArrow(_of_group, _TRANSFER) \
            .withColumn("_grp", F.expr(f"_grp div {size}"))
        levels.append(saved(groups, "transfers"))
    known = tail.where("_rank = 0").select("_seg", F.col("_entry").alias("_exact"))
    for level in reversed(levels):  # of each group, the first member's entry is known
        heads = known.withColumnRenamed("_exact", "_entry")
        known = level.join(heads, "_seg", "left").groupBy("api_key", "_grp").applyInArrow(_entries, "_seg long, _exact long")
    return known


def admission(usage: DataFrame, opening: int = FREE_CREDITS, size: int = SEGMENT) -> DataFrame:
    """Sequential admission: a call is admitted iff the balance covers its cost; a refused call
    costs nothing, so this is a fold, not a running sum. It is done in parallel by segments:

    1. Rows are range-partitioned by sampled bounds of (key, time, event) and each part is cut
       into segments of at most ``size`` events of one key, written to the shared folder.
    2. Sums over segments give each one's entry balance if all calls are admitted, which is
       exact up to a key's first segment that may refuse, and an upper bound of the entry
       of every later one: after a refusal the balance was below the refused cost.
    3. From a key's first such segment on, a segment becomes a function from entry balance
       (from 0 to its bound) to exit balance; functions are composed in groups of ``size``,
       level by level, and the entries are handed down again.
    4. All segments are folded in parallel from their exact entries.

    No task folds more than a segment of a key at a time or holds more than ``size`` functions.
    ``opening``, costs and credits must not be negative; null counts as 0. Events that share key, time and
    id come in no defined order.
    """
    spark = usage.sparkSession
    ship_package(spark)
    order = ["api_key", "ts", "event_id"]
    clean = usage.select("api_key", "event_id", "ts", "kind", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("cost", "credits")])
    rows = saved(clean.repartitionByRange(*order).sortWithinPartitions(*order)
                 .mapInArrow(lambda it: _segments(it, size), _MARK), "usage-segments")
    after = F.col("_p") + F.col("_d")
    segs = rows.groupBy("api_key", "_seg").agg(
        F.sum("_d").alias("_net"), F.max(F.col("_need") - F.col("_p")).alias("_t"),
        F.max(F.when(F.col("_need") > 0, F.col("_need") - 1 - after)).alias("_r"))  # exit after a refusal, less _net
    before = Window.partitionBy("api_key").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    key = Window.partitionBy("api_key")
    segs = segs.withColumn("_sum", F.coalesce(F.sum("_net").over(before), F.lit(0)).cast("long"))
    segs = segs.withColumn("_entry", F.lit(opening) + F.col("_sum"))
    segs = segs.withColumn("_bad", F.min(F.when(F.col("_entry") < F.col("_t"), F.col("_seg"))).over(key))
    # Highest balance any earlier refusal can have led to, carried on as if all is admitted since.
    led = F.max(F.col("_r") - F.col("_sum")).over(before) + F.col("_sum")
    segs = segs.withColumn("_high", F.greatest("_entry", F.coalesce(led, F.col("_entry")), F.lit(0)))
    segs = saved(segs.select("api_key", "_seg", "_entry", "_bad", "_high"), "segments")
    tail = segs.where("_seg >= _bad").withColumn(
        "_rank", F.row_number().over(Window.partitionBy("api_key").orderBy("_seg")).cast("long") - 1) \
        .withColumn("_low", F.when(F.col("_rank") == 0, F.col("_entry")).otherwise(F.lit(0))) \
        .withColumn("_high", F.when(F.col("_rank") == 0, F.col("_entry")).otherwise(F.col("_high")))
    entries = segs.select("_seg", "_entry", "_bad")
    if not segs.where("_seg > _bad").isEmpty():
        many = segs.where("_seg > _bad").select(F.col("api_key").alias("_key")).distinct()
        several = tail.join(many, F.col("api_key").eqNullSafe(F.col("_key")), "left_semi")
        exact = _composed(rows, several, size)
        entries = entries.join(exact, "_seg", "left").withColumn("_entry", F.coalesce("_exact", "_entry"))
    folded = rows.join(entries.select("_seg", "_entry"), "_seg") \
        .select(*_USAGE_COLS, "_seg", "_pos", "_entry").repartition("_seg").sortWithinPartitions("_seg", "_pos")
    return folded.mapInArrow(_fold_segments, ADMISSION_SCHEMA)


def metered(admitted: DataFrame, opening: int = FREE_CREDITS) -> DataFrame:
    """Ledger rows (id, api_key, delta, reason, created_at) of admitted usage: one
    grant a key, purchases, charges of admitted calls, refunds of those that failed."""
    charged = F.col("admitted") & (F.col("kind") != "purchase") & (F.col("cost") > 0)

    def row(id_, delta, reason):
        return F.struct(id_.cast("long").alias("id"), delta.cast("int").alias("delta"), F.lit(reason).alias("reason"))

    even, odd = F.col("event_id") * 2, F.col("event_id") * 2 + 1
    rows = F.array(
        F.when(charged, row(even, -F.col("cost"), "tool_call")),
        F.when(charged & (F.col("kind") == "failed_call"), row(odd, F.col("cost"), "refund_failed_operation")),
        F.when(F.col("kind") == "purchase", row(even, F.col("credits"), "credit_purchase")))
    moves = admitted.select("api_key", F.col("ts").alias("created_at"),
                            F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")) \
        .select("r.id", "api_key", "r.delta", "r.reason", "created_at")
    grants = admitted.groupBy("api_key").agg(F.min("ts").alias("ts"), F.min("event_id").alias("e")).select(
        (-(F.col("e") * 2) - 1).alias("id"), "api_key", F.lit(opening).alias("delta"),
        F.lit("free_tier_signup").alias("reason"), (F.col("ts") - F.expr("INTERVAL 1 SECOND")).alias("created_at"))
    return grants.unionByName(moves)


def admission_summary(admitted: DataFrame) -> DataFrame:
    """Per key: final balance, calls admitted and refused."""
    return admitted.groupBy("api_key").agg(
        F.max_by("balance_after", F.struct("ts", "event_id")).cast("bigint").alias("final_balance"),
        F.sum(F.when((F.col("kind") != "purchase") & F.col("admitted"), 1).otherwise(0)).cast("bigint").alias("n_admitted"),
        F.sum(F.when(~F.col("admitted"), 1).otherwise(0)).cast("bigint").alias("n_refused"))
