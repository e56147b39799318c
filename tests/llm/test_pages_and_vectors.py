"""WARC archives and embeddings against brute force."""

import base64
import gzip
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from refinery.llm import multi_index, warc
from refinery.llm.store import components

PAGES = [(1, "http://a.example/x", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b/ü \r\nX: y", None), (4, "", ""),
         (5, "u", "é" * 70_000), (6, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08 text"), (6, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08 text"),
         (None, "u", "<p>one</p>"), (None, "u", "alone"), (None, "u", "alone")]


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string") \
        .withColumn("sha", F.lit("clash")).withColumn("value", F.lit(1)).withColumn("payload", F.lit(2))


def by_force(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and f != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                    "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", ["3000", "128m"])
def test_warc_round_trip_over_byte_ranges(spark, scratch, split):
    """Ranges far smaller than records, with payloads that do not compress (so that
    false magics and long members cross ranges)."""
    rng = random.Random(8)
    rows = PAGES + [(100 + i, f"http://h/{i}", "".join(chr(rng.randrange(32, 0x2000)) for _ in range(rng.randrange(4000))))
                    for i in range(40)]
    path = os.path.join(scratch, "archive")
    warc.write_archives(pages_frame(spark, rows).repartition(3), path)
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        out = warc.read_archives(spark, path)
        got = sorted((tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                   "refers_to").collect()), key=repr)
        urls = {r.page_id: r.url for r in out.collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    assert got == by_force(rows)
    assert urls[1] == "http://a.example/x" and urls[2] is None and "\r" not in urls[3]


def test_warc_files_are_plain_gzip_members(spark, scratch):
    path = os.path.join(scratch, "archive")
    warc.write_archives(pages_frame(spark, PAGES).coalesce(1), path)
    raw = b"".join(open(os.path.join(path, f), "rb").read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    text = gzip.decompress(raw)
    assert text.count(b"WARC-Type: ") == len(PAGES) and text.endswith(b"\r\n\r\n")


def test_warc_member_with_false_magic_across_ranges():
    data = warc.member(warc.record(7, "u", b"\x1f\x8b\x08" * 30, None, "2024-01-01T00:00:00Z"), 0)  # stored, not packed
    pieces = data.split(warc.MAGIC)[1:]
    assert len(pieces) > 10
    stream, found = warc.Stream(), []
    for p in pieces:
        _, text = stream.feed(p)
        if text is not None:
            found.append(warc.parse(text))
    assert [f["payload"] for f in found] == [b"\x1f\x8b\x08" * 30]
    assert warc.Stream().feed(pieces[3]) == (False, None)


def test_warc_least_bytes_and_empty(spark, scratch):
    path = os.path.join(scratch, "a")
    warc.write_archives(pages_frame(spark, PAGES), path, least_bytes=11)
    kinds = {(r.page_id, r.record_type) for r in warc.read_archives(spark, path).collect()}
    assert (2, "response") in kinds
    path = os.path.join(scratch, "b")
    warc.write_archives(pages_frame(spark, []), path)
    assert warc.read_archives(spark, path).count() == 0


def links_by_force(rows, threshold):
    units = []
    for _, v in rows:
        ok = v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        x = np.array(v, float) / max(map(abs, v)) if ok else None
        units.append(x / np.linalg.norm(x) if ok else None)
    n = len(rows)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for a in range(n):
        for b in range(a):
            x, y = units[a], units[b]
            if x is not None and y is not None and len(x) == len(y) and x @ y >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(rows[a][0]), find(rows[b][0])))
                parent[q] = p
    return sorted((i, k, find(i), find(i) == i) for (i, _), k in zip(rows, links))


@pytest.mark.parametrize("block", [7, 256])
def test_embeddings_links_and_components(spark, block):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(150)]
    hub = rng.normal(size=16)
    rows += [(1000 + i, (hub + rng.normal(size=16) * 0.12).tolist()) for i in range(80)]
    rows += [(2000 + i, hub.tolist()) for i in range(30)] + [(3000, (hub * 1e200).tolist()), (3001, (hub * 1e-200).tolist())]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [1.0, None] * 8), (4004, [float("nan")] * 16),
             (4005, [float("inf")] * 16), (4006, [1.0, 2.0]), (4007, [1.0, 2.1]), (4008, [-2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")) \
        .withColumn("vec", F.lit(0)).withColumn("cell", F.lit(0))
    out = multi_index.near_duplicates(df, block=block)
    got = sorted(tuple(r) for r in out.select("vec_id", "n_links", "component_id", "kept").collect())
    want = links_by_force(rows, 0.95)
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    exact = {w[0]: w for w in want}
    assert all(g == exact[g[0]] for g in got if g[0] >= 2000)


def test_embeddings_null_ids_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert multi_index.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [0.0, 1.0]), (6, None)]
    got = {tuple(r) for r in multi_index.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert (5, 1, 5, True) in got and (6, 0, 6, True) in got and (None, 1, None, False) in got


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 200), (200, 250), (250, 300)]
    rng.shuffle(edges)
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 200: 200, 250: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
