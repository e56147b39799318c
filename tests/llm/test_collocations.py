"""Collocations against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from refinery.llm import collocations

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def corpus():
    rng = random.Random(13)
    words = ["a", "b", "c", "d", "The", "été", "x" * 40, "new", "york", "City", "\x1cz", "你好"] + [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        out = []
        for _ in range(rng.randrange(60)):
            out.append(rng.choice(words[:12] if rng.random() < .6 else words))
            if rng.random() < .1:
                out.append("New york  CITY hall"[:rng.choice([8, 14, 19])])
            out[-1] += rng.choice(["", "", "", ".", ",", "?!", "\n", "\t", " \r\n"])
        rows.append((i, " ".join(out), rng.choice(["en", "en", "en", "fr", None, "und"])))
    rows += [(900, None, "en"), (901, "", "en"), (902, " \t.,;\n", "de"), (903, "same row", "en"), (903, "same row", "en"),
             (None, "a b c d " * 3000, "en"), (904, "tie one. tie one. tie two. tie two. " * 20, "xx"), (905, "alone", "")]
    return rows


@pytest.mark.parametrize("least,slots", [(30, None), (3, 1 << 16), (3, 8), (1, None)])
def test_collocations_match_brute_force(spark, least, slots):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for clash in ("w1", "n", "words", "part", "phrase", "my col"):
        df = df.withColumn(clash, F.lit("clash"))
    got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(df, least=least, top=50, slots=slots).collect())
    want = collocations.brute_force([(lang, t) for _, t, lang in rows], least=least, top=50)
    assert got == want and (least > 3 or len(want) > 100)


def test_collocations_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(df).collect() == []
    df = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    assert collocations.collocations(df).collect() == []


def test_scores_pass_64_bits(spark):
    big = 9_000_000_000_000_000
    freq = spark.createDataFrame([("en", ["a", "b"], big), ("en", ["a"], big), ("en", ["b"], big + 3), ("en", [], 4 * big)],
                                 "lang string, words array<string>, n long")
    row = collocations.ranked(freq).first()
    assert row.score == 2000000 * big // (2 * big + 3) and row.n == 4 * big
