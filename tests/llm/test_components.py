"""Connected components on top of the shared folder."""

import random

import pytest

from refinery.llm import store


def reachable(edges):
    least = {}

    def root(v):
        while least[v] != v:
            v = least[v]
        return v

    for a, b in edges:
        if a == b:
            continue
        for v in (a, b):
            least.setdefault(v, v)
        a, b = sorted((root(a), root(b)))
        least[b] = a
    return {v: root(v) for v in least}


def found(spark, edges):
    rows = store.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({r.v for r in rows})
    return {r.v: r.root for r in rows}


@pytest.fixture()
def tables(monkeypatch):
    """Names of the tables written to the shared folder."""
    names, saved = [], store.saved

    def noted(df, name):
        names.append(name)
        return saved(df, name)

    monkeypatch.setattr(store, "saved", noted)
    return names


def test_a_long_sorted_path_takes_few_rounds(spark, tables):
    got = found(spark, [(v, v + 1) for v in range(5000)])
    assert got == dict.fromkeys(range(5001), 0)
    assert tables.count("pointers") <= 14 and tables.count("nearest") == 1 and len(tables) <= 20


def test_random_graphs_stars_and_shuffled_paths(spark, tables):
    draw = random.Random(5)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(300)]       # with self-loops
    edges += edges[:40] + [(b, a) for a, b in edges[40:60]]                        # repeated edges
    edges += [(1999, v) for v in range(1000, 1100)]                                # a hub with the largest number
    path = list(range(3000, 3300))
    draw.shuffle(path)
    edges += list(zip(path, path[1:]))
    edges += [(-5, 2 ** 62), (2 ** 62, -(2 ** 62))]
    assert found(spark, edges) == reachable(edges)
    assert tables.count("nearest") <= 9  # log2 of the longest part's vertices


def test_no_edges(spark):
    assert found(spark, []) == {} == found(spark, [(3, 3)])


def test_small_graphs_are_written_by_few_tasks(spark, monkeypatch):
    """Each table by one task here, however many shuffle partitions there are; each by as many as its rows are worth."""
    parts, saved = [], store.saved
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in conf}

    def noted(df, name):
        out = saved(df, name)
        parts.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(store, "saved", noted)
    edges = [(v, v + 1) for v in range(0, 2000) if v % 10]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = found(spark, edges)
        assert got == reachable(edges) and max(parts) == 1
        assert store.few(spark.range(9).repartition(50), 3 * store.TASK_ROWS).rdd.getNumPartitions() == 3
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def graphs():
    draw = random.Random(8)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)]       # with self-loops
    edges += edges[:30] + [(b, a) for a, b in edges[30:50]]                        # repeated edges
    edges += [(1999, v) for v in range(1000, 1060)]                                # a hub with the largest number
    path = list(range(3000, 3200))
    draw.shuffle(path)
    edges += list(zip(path, path[1:]))
    return edges + [(-5, 2 ** 62), (2 ** 62, -(2 ** 62))]


@pytest.mark.parametrize("rows", [0, 60, 1 << 18])
def test_rounds_of_joins_and_the_one_task_agree(spark, monkeypatch, rows):
    """No, some or all rounds by the one task that takes what is left."""
    monkeypatch.setattr(store, "few", lambda df, n: df)
    monkeypatch.setattr(store, "TASK_ROWS", rows)
    edges = graphs()
    assert found(spark, edges) == reachable(edges)


def test_edges_worth_one_task_take_few_jobs(spark):
    """Rounds of joins took the driver dozens of jobs, plans and broadcasts for a few hundred edges."""
    edges = spark.createDataFrame(graphs(), "a long, b long")
    spark.sparkContext.setJobGroup("few-jobs", "")
    try:
        store.components(edges)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) <= 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
