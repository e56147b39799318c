"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles gets a signature of ``POSITIONS`` minhashes of
``BITS`` bits. Two sets of similarity s differ in each position with probability
1 - s (or less, as b-bit values may agree by chance), so with ``allowed_distance``
all but ``MISS`` of the pairs at the similarity itself, and nearly all above it,
are within the signature distance. Signatures are split into chunks whose
allowances of errors add up, with one each, to distance + 1: by pigeonhole a pair
within the distance agrees in some chunk up to that chunk's allowance. Each allowed
choice of differing positions gives one key, the chunk with those positions left
out, so every such pair shares a key: none is lost. A longer signature of bytes
(``CHECKS`` positions) then tells near pairs from accidental ones.

Buckets are never expanded into all pairs. Members near their bucket's smallest id
are joined into loose clusters. A member left outside its bucket's cluster is then
compared by signature with that cluster, once however many buckets they share, and
with the bucket's other outsiders, all in blocks. After that every near pair lies
inside one cluster. Links are confirmed inside clusters on the full shingle sets, starting
from the document nearest to the cluster's commonest signature and skipping pairs
that are joined already. A large cluster is cut into blocks; the blocks' central
documents are treated likewise, level by level, and at last every document outside
the largest component of its cluster is compared with all blocks. So no link that
matters for a component is dropped, and a group of copies costs about its size.
Equal sets are one vertex from the start.

Nulls and ties: a null or wordless text has an empty set, links with nothing and
is kept. Rows sharing a doc_id are one vertex: the links of all their texts
count. A null doc_id never represents a group; if a class has null ids only, its
component_id is null and kept is false. Empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinery.llm.store import components, in_tasks, saved
from refinery.llm.textbatch import Words, inner, mix, ngrams, pieces, powers

POSITIONS, BITS, CHECKS = 64, 16, 256
MISS = 1e-5
BLOCK = 512
_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(1, 1 << 31, CHECKS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(1, 1 << 31, CHECKS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def allowed_distance(similarity: float, positions: int = POSITIONS, miss: float = MISS) -> int:
    """Smallest d such that a pair of this similarity differs in more than d
    positions with a probability of at most ``miss``."""
    p, tail = 1.0 - similarity, 1.0
    for d in range(positions + 1):
        tail -= math.comb(positions, d) * p ** d * (1 - p) ** (positions - d)
        if tail <= miss:
            return d
    return positions


def chunk_plan(distance: int) -> list[tuple[int, tuple[int, ...]]]:
    """(chunk, positions compared) of every key: for a chunk that may hold e
    errors, all choices of its positions less e. The fewest chunks are taken that may
    hold one error at most: longer chunks tell more, more errors cost more keys."""
    chunks = min(POSITIONS, -(-(distance + 1) // 2))
    spare = distance + 1 - chunks
    plan = []
    for c, at in enumerate(np.array_split(np.arange(POSITIONS), chunks)):
        errors = min(spare // chunks + (c < spare % chunks), len(at) - 1)
        plan += [(c, own) for own in itertools.combinations(at.tolist(), len(at) - errors)]
    return plan


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each shingle, in order; the words of a document with
    fewer than ``size`` make one."""
    h = words.hashes()
    at = inner(words.bounds, size)
    out, doc = [ngrams(h, size)[at] if len(at) else np.zeros(0, np.uint64)], [words.doc[at]]
    counts = np.diff(words.bounds)
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            v = sum(h[words.bounds[short] + j] * p for j, p in enumerate(powers(n)))
            out.append(mix(v + np.uint64(n)))
            doc.append(short)
    out, doc = np.concatenate(out), np.concatenate(doc)
    order = np.argsort(doc, kind="stable")
    return out[order], doc[order]


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, doc = shingle_hashes(Words(batch.column("text"), lower=True), size)
    ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    for i in range(batch.num_rows):
        own = np.sort(h[ends[i]:ends[i + 1]])
        yield own[np.append(True, own[1:] != own[:-1])] if len(own) else own


def signature(members: np.ndarray) -> tuple[bytes, bytes]:
    """(POSITIONS values of BITS bits, CHECKS bytes)"""
    low = (members & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (members >> np.uint64(32)).astype(np.uint32)
    least = np.full(CHECKS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        v = low[None, at:at + 2048] * _A[:, None]
        v += high[None, at:at + 2048] * _B[:, None]
        np.minimum(least, v.min(axis=1), out=least)
    return least[:POSITIONS].astype(np.uint16).tobytes(), least.astype(np.uint8).tobytes()


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            count, digest, sig, check = [], [], [], []
            for members in _sets(batch, size):
                count.append(len(members))
                some = len(members) > 0
                digest.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest() if some else None)
                own = signature(members) if some else (None, None)
                sig.append(own[0])
                check.append(own[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(sig, pa.binary()), pa.array(check, pa.binary())],
                names=["doc_id", "n_shingles", "set_hash", "sig", "check"])
    return run


def _matrix(column: pa.Array, kind=np.uint8, width: int = CHECKS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _keys(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                sig = _matrix(batch.column("sig"), np.uint16, POSITIONS).astype(np.uint64)
                keys = np.empty((len(plan), len(sig)), np.uint64)
                for k, (_, own) in enumerate(plan):
                    v = np.full(len(sig), k, np.uint64)
                    for p in own:
                        v = v * np.uint64(0x9E3779B97F4A7C15) + sig[:, p]
                    keys[k] = mix(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(batch.column("id").to_numpy(), len(plan)))],
                    names=["key", "id"])
    return run


def _close(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_matrix(batch.column("sa")) != _matrix(batch.column("sb"))).sum(axis=1) <= distance \
                if batch.num_rows else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(near))
    return run


def _shingle_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = [s.tobytes() for s in _sets(batch, size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["id", "set"])
    return run


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    together = np.sort(np.concatenate([x, y]))
    both = int((together[1:] == together[:-1]).sum())
    return den * both >= num * (len(x) + len(y) - both)


def _far(check: np.ndarray, x: int, among: np.ndarray) -> np.ndarray:
    return (check[among] != check[x]).sum(axis=1)


def _central_order(check: np.ndarray) -> np.ndarray:
    """Positions by distance from the commonest value of each signature position."""
    ordered = np.sort(check, axis=0)
    n = len(check)
    best, run = np.zeros(check.shape[1], np.int64), np.zeros(check.shape[1], np.int64)
    common = ordered[0].copy()
    for i in range(n):
        run = np.where(ordered[i] == ordered[i - 1], run + 1, 1) if i else np.ones_like(run)
        better = run > best
        common[better] = ordered[i][better]
        best = np.maximum(best, run)
    return np.argsort((check != common).sum(axis=1), kind="stable")


def _join(ids, check, sets, group, seekers, partner, distance: int, num: int, den: int) -> list[tuple[int, int]]:
    """Confirmed links that join ``group`` (a component number each, changed in place).
    ``seekers``: positions to be compared with those that ``partner`` marks, which a
    seeker leaves once it has been compared."""
    edges = []
    for x in seekers:
        partner[x] = False
        other = np.flatnonzero(partner & (group != group[x]))
        other = other[_far(check, x, other) <= distance]
        for y in other:
            if group[y] != group[x] and _linked(sets[x], sets[y], num, den):
                edges.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                group[group == group[y]] = group[x]
    return edges


def _confirm(distance: int, num: int, den: int):
    """Rows sorted by (cluster, block): links that join a block's documents, and its
    central document as a row with b null."""
    def links(t: pa.Table) -> pa.RecordBatch:
        ids = t.column("id").to_pylist()
        check = _matrix(t.column("check"))
        sets = [np.frombuffer(v, np.uint64) for v in t.column("set").to_pylist()]
        order = _central_order(check)
        group = np.unique(ids, return_inverse=True)[1]
        edges = _join(ids, check, sets, group, order, np.ones(len(ids), bool), distance, num, den)
        a, b = [ids[order[0]], *(x for x, _ in edges)], [None, *(y for _, y in edges)]
        return pa.RecordBatch.from_arrays(
            [pa.array([t.column("cluster")[0].as_py()] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
            names=["cluster", "a", "b"])

    return lambda batches: (links(pa.Table.from_batches(g)) for g in _groups(batches, ("cluster", "block")))


def _confirm_rest(distance: int, num: int, den: int):
    """Rows sorted by (cluster, block): ``seeks`` marks documents that came to be
    compared with the block's own."""
    def links(t: pa.Table) -> pa.RecordBatch:
        ids = t.column("id").to_pylist()
        seeks = t.column("seeks").to_numpy(zero_copy_only=False)
        group = np.unique(t.column("root").to_numpy(), return_inverse=True)[1]
        sets = [np.frombuffer(v, np.uint64) for v in t.column("set").to_pylist()]
        edges = _join(ids, _matrix(t.column("check")), sets, group, np.flatnonzero(seeks), ~seeks, distance, num, den)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())],
                                          names=["a", "b"])

    return lambda batches: (links(pa.Table.from_batches(g)) for g in _groups(batches, ("cluster", "block")))


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[list[pa.RecordBatch]]:
    """Sorted rows as one list of slices per group."""
    held, last = [], None
    for batch in batches:
        k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in by])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            now = tuple(k[:, lo])
            if held and now != last:
                yield held
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
    if held:
        yield held


def _blocks(distance: int):
    """Rows (key, i, j, own, id, root, check) sorted by (key, i, j): an edge for each
    pair of block i with block j that is near and would join two roots."""
    def pairs(t: pa.Table) -> pa.RecordBatch:
        own, ids, root = (t.column(c).to_numpy() for c in ("own", "id", "root"))
        group = np.unique(root, return_inverse=True)[1]
        check = _matrix(t.column("check"))
        right = own == t.column("j")[0].as_py()
        a, b = [], []
        for x in np.flatnonzero(own == t.column("i")[0].as_py()):
            y = np.flatnonzero(right & (group != group[x]))
            for z in y[_far(check, x, y) <= distance]:
                if group[z] != group[x]:
                    a.append(min(ids[x], ids[z]))
                    b.append(max(ids[x], ids[z]))
                    group[group == group[z]] = group[x]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lambda batches: (pairs(pa.Table.from_batches(g)) for g in _groups(batches, ("key", "i", "j")))


def _loose_clusters(reps: DataFrame, allowed: int, distance: int) -> DataFrame:
    """(v, root) of all documents with a near one: near pairs share a root."""
    keys = in_tasks(reps.select("id", "sig"), _keys(chunk_plan(allowed)), "key long, id long")
    heads = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("key", "a")
    star = keys.join(heads, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    by_id = reps.select("id", "check")
    near = saved(in_tasks(
        star.join(by_id.toDF("a", "sa"), "a").join(by_id.toDF("b", "sb"), "b").select("a", "b", "sa", "sb"),
        _close(distance), "a long, b long"), "near")
    roots = components(near)
    # Members outside their bucket head's cluster may be near other members: of that
    # cluster (a), or outside like themselves (b).
    main = heads.join(roots.select(F.col("v").alias("a"), F.col("root").alias("main")), "a", "left") \
        .select("key", F.coalesce("main", "a").alias("main"))
    outside = saved(
        keys.join(roots.select(F.col("v").alias("id"), "root"), "id", "left").join(main, "key")
        .select("key", "id", F.coalesce("root", "id").alias("root"), "main").where("root <> main"), "outside")
    columns = ["key", "i", "j", "own", "id", "root"]
    wanted = outside.select(F.col("main").alias("key"), "id", "root").distinct()
    inside = roots.select(F.col("root").alias("key"), F.col("v").alias("id"), "root").join(
        wanted.select("key").distinct(), "key", "left_semi")
    size = inside.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"))
    block = F.pmod(F.xxhash64("id"), F.col("g").cast("long")).cast("int")
    seekers = F.lit(-1)  # the block of those that are compared with all blocks of a cluster
    rows_a = inside.join(size, "key").select("key", block.alias("i"), seekers.alias("j"), block.alias("own"), "id", "root").union(
        wanted.join(size, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("i"),
                                        seekers.alias("j"), seekers.alias("own"), "id", "root"))
    open_keys = outside.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")) \
        .where("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("g"))
    rows_b = outside.join(open_keys, "key").withColumn("own", block) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))) \
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root")
    spread = rows_a.union(rows_b).join(by_id, "id").select(*columns, "check")
    more = saved(in_tasks(spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"),
                          _blocks(distance), "a long, b long").distinct(), "near")
    return roots if more.isEmpty() else components(near.union(more))


def _confirmed(docs: DataFrame, reps: DataFrame, clusters: DataFrame, shingle: int, distance: int,
               num: int, den: int) -> DataFrame:
    """Links (a, b) whose components are those of all links."""
    clusters = clusters.select(F.col("v").alias("id"), F.col("root").alias("cluster"))
    sets = in_tasks(docs.join(clusters.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"),
                    _shingle_sets(shingle), "id long, set binary")
    sets = clusters.join(reps.select("id", "check"), "id").join(sets, "id")
    size = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("g"))
    whole = saved(sets.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("g"))), "clusters")
    columns = ["cluster", "block", "id", "check", "set"]

    def level(rows: DataFrame) -> DataFrame:
        return saved(in_tasks(rows.select(*columns).repartition("cluster", "block").sortWithinPartitions("cluster", "block"),
                              _confirm(distance, num, den), "cluster long, a long, b long"), "links")

    found = level(whole)
    links = found.where("b is not null").select("a", "b")
    large = whole.where("g > 1")
    if large.isEmpty():
        return links
    while True:  # central documents of the blocks of large clusters, till one block holds them
        central = found.where("b is null").select("cluster", F.col("a").alias("id")).distinct()
        size = central.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1") \
            .select("cluster", F.ceil(F.col("n") / BLOCK).cast("long").alias("g"))
        if size.isEmpty():
            break
        rows = large.drop("g", "block").join(central.join(size, "cluster"), ["cluster", "id"]) \
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("g")))
        found = level(rows)
        links = links.union(found.where("b is not null").select("a", "b"))
    roots = components(links).select(F.col("v").alias("id"), "root")
    held = saved(large.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "large")
    main = held.groupBy("cluster", "root").count().groupBy("cluster").agg(
        F.max_by("root", F.struct("count", "root")).alias("main"))
    outside = held.join(main, "cluster").where("root <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = held.select(*columns, "root", F.lit(False).alias("seeks")) \
        .union(outside.select(*columns, "root", F.lit(True).alias("seeks")))
    rest = in_tasks(rows.repartition("cluster", "block").sortWithinPartitions("cluster", "block"),
                    _confirm_rest(distance, num, den), "a long, b long")
    return links.union(saved(rest, "links"))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, num: int = 4, den: int = 5,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. Documents are linked if
    ``den * |A and B| >= num * |A or B|`` for their sets of ``shingle`` words."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    distance = allowed_distance(num / den, CHECKS)
    sigs = saved(in_tasks(docs, _signatures(shingle),
                          "doc_id long, n_shingles long, set_hash binary, sig binary, check binary"), "signatures")
    reps = saved(sigs.where("set_hash is not null and doc_id is not null").groupBy("set_hash", "sig", "check")
                 .agg(F.min("doc_id").alias("id")), "classes")
    clusters = _loose_clusters(reps, allowed_distance(num / den), distance)
    roots = components(_confirmed(docs, reps, clusters, shingle, distance, num, den))
    label = reps.join(roots.select(F.col("v").alias("id"), "root"), "id", "left") \
        .select("set_hash", F.coalesce("root", "id").alias("root"))
    # The smallest id of a component is that of a class, and classes go by their smallest id.
    out = sigs.select("doc_id", "n_shingles", "set_hash").join(label, "set_hash", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("root")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component stays, that of smallest id (a null one last). Every
    row is a vertex of its own, so rows without an id or with one id are told apart.
    Rows without words link with nothing and stay."""
    vertex = "vertex"
    while vertex in docs.columns:
        vertex += "_"
    # Written once: the numbers must not change when the rows are read again.
    rows = saved(docs.withColumn(vertex, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, id_col=vertex, text_col=text_col, **options) \
        .select(F.col("doc_id").alias(vertex), "component_id")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(vertex))
    stay = rows.select(vertex, order.alias("order")).join(found, vertex).groupBy("component_id") \
        .agg(F.min("order").getField(vertex).alias(vertex)).select(vertex)
    return rows.join(stay, vertex, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
