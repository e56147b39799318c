"""Byte-string dedup by suffixes against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from refinery.llm import suffixes

ODD = [
    (1, None), (2, ""), (None, "null id " * 30), (None, "null id " * 30), (None, None), (4, "é" * 99), (5, "same row " * 20),
    (5, "same row " * 20), (6, "same row " * 20), (7, "x" * 5000), (8, "x" * 5000 + "y"), (9, "\x00" * 300 + "a" + "\x00" * 150),
    (10, "other text of one id, " * 9), (10, "yet " + "other text of one id, " * 9), (11, "你好世界" * 60), (12, "世界" + "你好世界" * 60),
    (13, "a" * 100), (14, "a" * 99), (15, "b" + "a" * 100),
]


def corpus(n=150, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "été", "and", "stone", "\n", "house,"] + ["".join(rng.choices("abcdeéñ", k=rng.randrange(1, 9))) for _ in range(300)]
    passages = [" ".join(rng.choices(words, k=rng.randrange(5, 80))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randrange(150)))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text) + 1)
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text = text[:at] + (passages[0] if rng.random() < .4 else p[a:]) + text[at:]
        rows.append((rng.randrange(10 ** 6), text))
    rows += [(10 ** 6 + i, rows[i][1]) for i in range(0, n, 5)] + [(2 * 10 ** 6 + i, "tail " + rows[3][1]) for i in range(30)]
    return rows


def check(spark, rows, partitions=6, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    for clash in ("part", "lo", "th", "key", "kept", "my col", "rest"):
        df = df.withColumn(clash, F.lit("clash"))
    out = suffixes.remove_repeats(df, **options).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256), "rest.my col")
    got = sorted((tuple(r)[:5] for r in out.collect()), key=repr)
    want = sorted(suffixes.brute_force(rows, options.get("length", suffixes.LENGTH)), key=repr)
    assert got == want
    return want


def test_odd_rows(spark):
    assert sum(r[2] for r in check(spark, ODD)) > 5000


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 3000}, {"length": 30, "gram": 5, "bucket_bytes": 2000}, {"length": 24, "gram": 8}])
def test_repeats_match_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 20_000)
    want = check(spark, corpus(), **options)
    assert sum(r[2] > 0 for r in want) > 50 and sum(r[3] > 1 for r in want) > 5


def test_windows_across_splitters_and_parts(spark, monkeypatch):
    """Few sampled ranks, so ranges begin inside groups of like suffixes, and parts by hash."""
    monkeypatch.setattr(suffixes, "MAX_SPLITTERS", 40)
    monkeypatch.setattr(suffixes, "HOT_SHARE", 2.0)
    common = "a passage that stands everywhere, in front of what differs and after it, so long that many windows fit. "
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("ab", k=rng.randrange(60))) + common + "".join(rng.choices("ab", k=rng.randrange(60))))
            for i in range(300)]
    check(spark, rows, bucket_bytes=500)


def test_no_window_across_a_splitter(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefghijklmnop", k=400)) for _ in range(50)]
    want = check(spark, list(enumerate(texts)) + [(100 + i, t[150:]) for i, t in enumerate(texts)], bucket_bytes=10_000)
    assert [r[2] for r in want].count(250) == 50


def test_hot_passage_ranks_last(spark):
    """Windows that hold some bytes of their own are not sorted under a passage of all documents."""
    rng = random.Random(2)
    common = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
    texts = ["".join(rng.choices("klmnop ", k=200)) + common + "".join(rng.choices("qrstuv ", k=200)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams, _, _, _ = suffixes._model(df, 100, 16, 1 << 20)
    data = "".join(texts).encode()
    edge = np.arange(401) * len(texts[0])
    seeds = suffixes.Seeds(np.frombuffer(data, np.uint8), edge, grams, 100, 16)
    within = seeds.at - edge[seeds.row]
    inside = (within >= 200) & (within <= 200 + len(common) - 16)
    assert inside.any()
    own = 4  # seven letters to the fourth: rare
    assert (within - seeds.dhi >= 200 - own)[inside].all()
    assert (within - seeds.dlo + 100 <= 200 + len(common) + own)[inside].all()


def test_empty(spark):
    assert suffixes.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_multikey_order():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 500):
        for high in (1, 2, 50, 2 ** 63):
            words = rng.integers(0, high, (n, 4)).astype(np.uint64)
            want = sorted(range(n), key=lambda i: tuple(words[i]))
            assert suffixes.multikey_order(words).tolist() == want
