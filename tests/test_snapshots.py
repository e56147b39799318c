"""The versioned index: loads, pinned readers, crashes, overtaken loads, and explore."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from refinery.operators import explore, search, snapshots, textsearch

COLS = "source string, text string, n int"


def load(spark, rows, seq):
    return search.index_records(spark.createDataFrame(rows, COLS), F.col("source"), "t", "text", seq)


def rows(index):
    return sorted(((r.source_id, r.content, r.load_seq) for r in index.collect()), key=str)


def files(path):
    return {os.path.join(at, f): os.path.getmtime(os.path.join(at, f)) for at, _, found in os.walk(path) for f in found}


@pytest.fixture()
def index(spark, scratch):
    path = scratch + "/index"
    assert snapshots.upsert(spark, path, load(spark, [("a", "one", 1), ("a", "two", 2), ("b", "one", 1), (None, "none", 0)], 1)) == 1
    return path


def test_upsert_and_delete_rewrite_their_buckets_only(spark, index):
    before = files(index + "/data")
    assert len({snapshots.bucket_of(s) for s in ("a", "b", "c", None)}) == 4
    assert snapshots.upsert(spark, index, load(spark, [("a", "two", 2), ("a", "two", 3), ("c", "new", 1)], 2)) == 2
    want = [("a", "one", 1), ("a", "two", 2), ("a", "two", 2), ("b", "one", 1), ("c", "new", 2), (None, "none", 1)]
    assert rows(snapshots.read(spark, index)) == sorted(want, key=str)
    added = set(files(index + "/data")) - set(before)
    assert {f: t for f, t in files(index + "/data").items() if f in before} == before
    assert not any(f"_bucket={snapshots.bucket_of('b')}/" in f for f in added)
    assert snapshots.delete_source(spark, index, "a") == 3
    assert snapshots.delete_source(spark, index, "a") == 0
    assert snapshots.delete_source(spark, index, "nobody") == 0
    assert rows(snapshots.read(spark, index)) == sorted(want[3:], key=str)
    queries = spark.createDataFrame([(1, "something new"), (2, "nothing else")], "item_id int, text string")
    found = textsearch.search_index(snapshots.read(spark, index), queries).collect()
    assert [(r.query_id, r.content, r.metadata["table"]) for r in found] == [(1, "new", "t")]


def test_sources_read_their_bucket_only(spark, index):
    some = snapshots.read(spark, index, sources=["b"])
    assert rows(some) == [("b", "one", 1)]
    assert all(f"_bucket={snapshots.bucket_of('b')}/" in f for f in some.inputFiles())
    assert rows(snapshots.read(spark, index, sources=["nobody"])) == []


def test_readers_keep_their_version(spark, index):
    pinned, first = snapshots.read(spark, index), rows(snapshots.read(spark, index))
    snapshots.upsert(spark, index, load(spark, [("a", "three", 3)], 2))
    snapshots.delete_source(spark, index, "b")
    assert rows(pinned) == first == rows(snapshots.read(spark, index, version=1))
    assert snapshots.versions(spark, index) == [1, 2, 3]
    assert rows(snapshots.read(spark, index)) != first


def test_a_load_that_dies_before_its_version_leaves_the_one_before(spark, index, monkeypatch):
    first = rows(snapshots.read(spark, index))

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(snapshots, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            snapshots.upsert(spark, index, load(spark, [("a", "three", 3)], 2))
        with pytest.raises(KeyboardInterrupt):
            snapshots.delete_source(spark, index, "a")
    assert snapshots.versions(spark, index) == [1] and rows(snapshots.read(spark, index)) == first
    assert snapshots.upsert(spark, index, load(spark, [("a", "three", 3)], 2)) == 2
    assert len(rows(snapshots.read(spark, index))) == len(first) + 1
    assert snapshots.expire(spark, index, keep=1) == [1]
    assert len(os.listdir(index + "/data")) == 2  # version 2 still reads b and the null source from the first load
    assert len(rows(snapshots.read(spark, index))) == len(first) + 1


def test_an_overtaken_load_starts_again(spark, index, monkeypatch):
    publish, other = snapshots._publish, []

    def late(session, path, manifest):
        if not other:  # another load is published between reading the version and renaming
            other.append(True)
            snapshots.upsert(spark, path, load(spark, [("a", "theirs", 7)], 2))
        return publish(session, path, manifest)

    monkeypatch.setattr(snapshots, "_publish", late)
    assert snapshots.upsert(spark, index, load(spark, [("a", "ours", 8)], 3)) == 3
    contents = {r[1] for r in rows(snapshots.read(spark, index))}
    assert {"theirs", "ours", "one", "two"} <= contents
    base = snapshots._manifest(spark, index, 2)
    with pytest.raises(snapshots.Overtaken):
        publish(spark, index, base | {"version": 3})
    assert not [f for f in os.listdir(index + "/versions") if f.startswith(".") and not f.endswith(".crc")]


def test_empty_loads_and_missing_index(spark, scratch):
    path = scratch + "/new"
    with pytest.raises(ValueError):
        snapshots.read(spark, path)
    assert snapshots.delete_source(spark, path, "a") == 0
    assert snapshots.upsert(spark, path, load(spark, [], 1)) == 1
    assert rows(snapshots.read(spark, path)) == []
    with pytest.raises(ValueError):
        snapshots.expire(spark, path, keep=0)


def test_whole_table_round_trip(spark, scratch):
    docs = spark.read.parquet(SF_SMALL + "/documents.parquet")
    of = search.index_records(docs, F.col("source"), "documents", "text", 1)
    path = scratch + "/documents"
    snapshots.upsert(spark, path, of)
    want = search.upsert(of)
    got = snapshots.read(spark, path)
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).isEmpty()
    n = want.where("source_id = 'src1'").count()
    assert n and snapshots.delete_source(spark, path, "src1") == n


def test_explore(spark):
    tables = {t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("nation", "region")}
    got = explore.explore(spark, tables, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "world").collect()
    assert [(r.source, r.connected, r.column_name, r.n_rows) for r in sorted(got, key=lambda r: r.column_name)] == \
        [("world", True, "n_name", 25), ("world", True, "r_name", 25)]
    assert got[0].message == "Connected. 2 tables, 30 records total."
    with pytest.raises(ValueError):
        explore.explore(spark, tables, "SELECT * FROM text.`/etc/hostname`")


def test_explore_of_a_source_that_cannot_be_opened(spark, scratch):
    folder = scratch + "/gone"
    spark.range(3).write.parquet(folder)
    broken = spark.read.parquet(folder)
    for f in os.listdir(folder):
        os.truncate(os.path.join(folder, f), 0)
    got = explore.explore(spark, {"t": broken}, "SELECT * FROM t", "bad").collect()
    assert len(got) == 1 and not got[0].connected and got[0].message and got[0].column_name is None
