"""Operators on documents against brute force, round trips and held-out labels."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refinery.llm import bpe, decontam, langid, license, minhash, rules, substring, toxicity

SF = "/root/testdata/sf0.001"

#: Nulls, empty and odd texts, repeated rows and ids, a very long text.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (None, "one two three"), (None, None), (4, "Éa été où 你好 мир !!"),
    (5, "same words here"), (5, "same words here"), (6, "same words here"), (7, "x" * 50_000),
    (8, "the words of a very long text " * 4_000), (9, "…—"), (9, "other text of the same id"),
    (10, "a\x1cb c　d  e\r\n\r\n f "), (11, "12345 ١٢٣ don't 'll we've"),
]


def frame(spark, rows, schema="doc_id long, text string"):
    """``rows`` with columns whose names clash with those the operators use."""
    df = spark.createDataFrame(rows, schema)
    for extra in ("id", "key", "root", "block", "part", "score", "label", "n", "words", "th", "kind", "cluster"):
        if extra not in df.columns:
            df = df.withColumn(extra, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).persist()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- byte-level BPE ---------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path),
                              special_tokens={})
    return path, public_tokenizers.PATTERN, whole


@pytest.mark.parametrize("block", [7, 1 << 24])
def test_bpe_ids_and_round_trip(spark, odd, docs, tokenizer, block):
    path, pattern, whole = tokenizer
    texts = odd.select("doc_id", "text").union(docs.select("doc_id", "text").limit(40 if block == 7 else 1000))
    want = []
    for i, t in texts.collect():
        ids = whole.encode_ordinary(t or "")
        want.append((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), (t or "").encode()))
    out = bpe.decode(bpe.encode(texts, path, pattern, block_bytes=block), path)
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_bpe_long_words_take_the_heap(tokenizer):
    path, _, whole = tokenizer
    ranks = bpe.read_ranks(path)
    rng = random.Random(5)
    for size in (150, 201, 900):
        word = "".join(rng.choice("aeithou") for _ in range(size)).encode()
        assert bpe.merge_word(word, ranks) == whole.encode_ordinary(word.decode())


def test_bpe_empty_table(spark, tokenizer):
    empty = frame(spark, [])
    assert bpe.encode(empty, *tokenizer[:2]).collect() == []


# --- substring dedup --------------------------------------------------------------

def test_substring_matches_brute_force(spark, docs):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(9)]
    shared = [rng.choice(vocab) for _ in range(60)]
    rows = [(i, " ".join([rng.choice(vocab) for _ in range(rng.randrange(40))] + shared[rng.randrange(30):]
                         + [rng.choice(vocab) for _ in range(rng.randrange(40))])) for i in range(60)]
    rows += [(100, "a " * 300), (101, "a " * 300), (102, None), (103, ""), (104, " ".join(shared))]
    rows += [(r.doc_id + 1000, r.text) for r in docs.collect()]
    df = frame(spark, rows)
    got = rows_of(substring.digests(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(substring.brute_force(rows), key=repr)


def test_substring_odd_rows_and_strip(spark, odd):
    out = {(r.doc_id, r.n_words): r.n_removed for r in substring.digests(odd).collect()}
    assert out[(1, 0)] == out[(2, 0)] == out[(3, 0)] == 0
    assert out[(8, 28_000)] > 27_000  # its own repeats
    assert out[(5, 3)] == 0  # rows of one id and text do not repeat each other
    kept = substring.strip_repeats(odd.withColumn("n_chars", F.length("text").cast("long")))
    assert kept.columns == [*odd.columns, "n_chars"]
    assert kept.where("doc_id is null").count() == 2
    assert substring.digests(frame(spark, [])).collect() == []


def test_substring_hot_anchor_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(substring, "SLICE_BYTES", 200)
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(i, f"own{i} {text} end{i}") for i in range(40)]
    got = rows_of(substring.digests(spark.createDataFrame(rows, "doc_id long, text string")),
                  "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(substring.brute_force(rows), key=repr)


# --- MinHash ----------------------------------------------------------------------

def components_by_force(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).split()
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if rows[a][0] is not None and rows[b][0] is not None and x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(rows[a][0]), find(rows[b][0])))
                parent[q] = p
    out = []
    for (i, _), x in zip(rows, sets):
        if i is not None:
            c = find(i)
        else:
            same = [j for (j, _), y in zip(rows, sets) if x and y == x and j is not None]
            c = find(min(same)) if same else None
        out.append((i, len(x), c, i is not None and i == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size,num,den,block", [(3, 85, 100, 512), (5, 4, 5, 8)])
def test_minhash_matches_brute_force(spark, monkeypatch, size, num, den, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(3)
    rows = []
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    for i in range(60):  # a large group of near copies, cut into blocks of 8
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(60)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i * 3 + 1, " ".join(w)))
    for g in range(12):
        b = [f"q{g}_{k}" for k in range(40)]
        for j in range(rng.randrange(1, 5)):
            w = list(b)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(40)] = f"y{rng.randrange(10 ** 6)}"
            rows.append((1000 + g * 10 + j, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "a"), (5003, "A"), (5004, "a b"), (5005, " a  b "), (None, "a b"),
             (None, "zz top q r s t"), (5006, " ".join(base)), (5006, " ".join(base))]
    out = minhash.near_duplicates(frame(spark, rows), shingle=size, num=num, den=den)
    assert rows_of(out, "doc_id", "n_shingles", "component_id", "kept") == components_by_force(rows, size, num, den)


def test_minhash_empty_and_deduplicate(spark, odd):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []
    kept = minhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 in ids and 6 not in ids and 1 in ids and 2 in ids


def test_keys_hold_every_pair_within_the_distance():
    allowed = minhash.allowed_distance(0.85)
    plan = minhash.chunk_plan(allowed)
    rng = np.random.default_rng(1)
    for _ in range(300):
        differ = set(rng.choice(minhash.POSITIONS, allowed, replace=False).tolist())
        assert any(not differ & set(own) for _, own in plan)


# --- licences ---------------------------------------------------------------------

def test_license_base_places_and_templates(spark, odd):
    import re

    base = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    texts = ["Released under the MIT License.", "x Apache-License, VERSION 2 under the mit license cc BY-NC cc by nc y",
             "under the mit licence", "licensed under the GNU General Public License, version 3",
             "cc by\n\nnc", "under the under the mit license", "the the of license mit the", "",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
             " associated documents files (the Software) to deal in the Software without restriction, including the"
             " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"]
    rows = [*enumerate(texts, 100), *ODD]
    got = {(r.doc_id, r.n_words): r for r in license.labels(frame(spark, rows)).collect()}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in base.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        r = got[(i, len(w))]
        assert r.n_base == len(places)
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({b for _, b in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert got[(103, 9)].labels == "gpl-3" and got[(103, 9)].score == 1.0
    assert [r.labels for (i, _), r in got.items() if i == 108] == ["mit"]
    assert license.labels(frame(spark, [])).collect() == []


def test_automaton_statistics():
    a = license.Automaton([("x", "a b c a b d"), ("y", "b c a")], [("b c", "p")])
    number = {w: int(a.tokens(license._words(w)[1])[0]) for w in "abcd"}
    base, _ = a.walk([number[c] for c in "abcabcabd"])
    assert base == [(0, 1), (0, 4)]
    text = "abcabdbcad"
    for i in range(len(text)):  # longest suffix that occurs in a template
        want = max((k for k in range(i + 2) if any(text[i + 1 - k:i + 1] in t for t in ("abcabd", "bca"))), default=0)
        state = size = 0
        for c in text[:i + 1]:
            while state and number[c] not in a.next[state]:
                state = a.link[state]
                size = a.length[state]
            if number[c] in a.next[state]:
                state, size = a.next[state][number[c]], size + 1
        assert size == want


# --- language ---------------------------------------------------------------------

def viterbi_by_hand(e, switch):
    v, back = e[0].astype(float), []
    for row in e[1:]:
        best = v.argmax()
        move = v[best] - switch
        back.append([i if v[i] >= move else best for i in range(len(v))])
        v = np.maximum(v, move) + row
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return v.max(), path[::-1]


@pytest.mark.parametrize("states", [2, 3, 300])
def test_viterbi_over_segments_is_exact(states):
    rng = np.random.default_rng(2)
    counts = [0, 1, 5, 33, 200, 0, 64]
    bounds = np.concatenate([[0], np.cumsum(counts)])
    e = rng.normal(size=(bounds[-1], states)).astype(np.float32)
    got = langid.viterbi(e, bounds, 1.5, segment=16)
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            best, _ = viterbi_by_hand(e[a:b], 1.5)
            path = got[a:b]
            score = e[np.arange(a, b), path].sum() - 1.5 * (path[1:] != path[:-1]).sum()
            assert abs(score - best) < 1e-3


def test_language_held_out_and_mixed(spark, odd):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predictions(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.98
    model = langid.train(table)
    en = table.where("lang = 'en'").first().text[:1500]
    de = table.where("lang = 'de'").first().text[:1500]
    mixed = langid.identify(frame(spark, [(1, en + " " + de)]), model).first()
    assert [s.lang for s in mixed.spans] == ["en", "de"]
    assert abs(mixed.spans[1].first_byte - len(en.encode())) < 40
    got = {(r.doc_id, r.lang) for r in langid.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (9, "und"), (None, "und")} <= got
    assert langid.identify(frame(spark, []), model).collect() == []
    assert {r.lang for r in langid.identify(odd, langid.train(table.limit(0))).collect()} == {"und"}


# --- classifiers ------------------------------------------------------------------

def auc(rows):
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    a, b = s[y == 1], s[y == 0]
    return (a[:, None] > b).mean() + (a[:, None] == b).mean() / 2


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = rules.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    held = out.where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    assert auc(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.collect())


def test_toxicity_dictionaries_hold_every_mark():
    rng = random.Random(8)
    letters = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхц", "αβγδεζηθικλμνξοπρστυ", "áéíóúñçãõüöä"]
    marks = sorted({"".join(rng.choices(abc, k=n)) for abc in letters for n in (2, 3, 3, 5, 8) for _ in range(60)})
    other = [f"{w}{n}" for w in ("plain", "usual", "every") for n in "bcdfghjklm"]
    words = ["the", "and", "with"]
    mark, plain = ([w.encode() for w in ws] for ws in (marks, other))
    held = toxicity.Dictionaries.of([w.encode() for w in words], mark, plain)
    rows = [(n, f"the {w} and with") for n, w in enumerate(marks)] + [(-1, "the and with the and")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])],
                                       names=["doc_id", "text"])
    got = [d for b in toxicity._distances(held)([batch]) for d in b.column("first").to_pylist()]
    assert len(marks) > 900 and [w for w, d in zip(marks, got) if d < 2] == [] and got[-1] <= 0


def test_toxicity_of_a_three_letter_mark(spark):
    rng = random.Random(2)
    plain = [f"w{rng.randrange(10 ** 5)}x" for _ in range(2_000)]
    rows = []
    for n in range(1_500):
        w = rng.choices(plain, k=20)
        if n % 2:
            w[rng.randrange(20)] = "kys"
        rows.append((n, " ".join(w)))
    labels = spark.createDataFrame([(n, n % 2) for n in range(1_200)], "doc_id long, label int")
    got = toxicity.scored(frame(spark, rows), labels).where("doc_id >= 1200").collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.98


def test_toxicity_of_a_stem_with_many_endings(spark):
    """No single form is frequent; in each language its own stem marks toxic texts."""
    rng = random.Random(12)
    stems = {"aa": "grolb", "bb": "tíxun", "cc": "мерзк"}
    plain = ["".join(rng.choices("abdeilmnoprstu", k=rng.randrange(2, 9))) for _ in range(800)]
    rows, labels = [], []
    for i in range(3000):
        lang = rng.choice(list(stems))
        words = rng.choices(plain, k=40)
        toxic = int(rng.random() < 0.3)
        if toxic:
            for at in rng.sample(range(40), 3):
                words[at] = stems[lang] + "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(1, 4)))
        rows.append((i, " ".join(words), lang))
        labels.append((i, toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, label int")
    out = toxicity.scored(df, marks.where("doc_id < 2000")).join(marks, "doc_id").join(df, "doc_id").where("doc_id >= 2000")
    for lang in stems:
        mine = out.where(F.col("lang") == lang).groupBy("label").agg(F.avg("predicted").alias("p")).collect()
        share = {r.label: r.p for r in mine}
        assert share[1] > 0.9 and share[0] < 0.02, (lang, share)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'")
    out = toxicity.toxicity_scores(table, labels)
    held = out.where("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    assert auc(held) > 0.85
    flagged = out.where("predicted = 1 and held_out").join(labels, "doc_id").agg(F.avg("toxic")).first()[0]
    assert flagged > 0.9


@pytest.mark.parametrize("scored", [rules.scored, toxicity.scored])
def test_classifiers_odd_rows(spark, odd, scored):
    labels = spark.createDataFrame([(5, 1), (5, 0), (8, 1), (7, 0), (7, None), (77, 1), (2, 1), (4, 0)], "doc_id long, label int")
    out = scored(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    none = scored(odd, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert min(r.score for r in scored(odd, labels.where("label = 1")).collect()) > 0.99
    assert scored(frame(spark, []), labels).collect() == []


def test_rules_compile_to_the_conjunction(spark):
    rule = (("n_words", 2.0, 10.0), ("share_upper", -np.inf, 0.5))
    df = spark.createDataFrame([(3.0, 0.1), (2.0, 0.1), (11.0, 0.1), (5.0, 0.6)], "n_words double, share_upper double")
    assert [r[0] for r in df.select(rules.condition(rule)).collect()] == [True, False, False, False]
    model = rules.RuleModel(-1.0, ((rule, 3.0),))
    got = [r[0] for r in df.select(model.score()).collect()]
    assert np.allclose(got, [1 / (1 + np.exp(-2))] + [1 / (1 + np.exp(1))] * 3)


# --- decontamination --------------------------------------------------------------

def test_lcs():
    rng = random.Random(4)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.lcs(a, b) == table[-1][-1]


def test_decontamination_finds_verbatim_and_paraphrases(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 15)  # several blocks of items
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(300)
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    rng = random.Random(9)
    planted = []
    for n, (i, t) in enumerate(sorted(items.items())[:20]):
        w = t.split()
        if n % 2:  # every fifth word replaced
            w = [x if k % 5 else f"new{k}" for k, x in enumerate(w)]
        pad = [f"pad{rng.randrange(10 ** 6)}" for _ in range(100)]
        planted.append((10_000 + n, " ".join(pad[:50] + w + pad[50:]), i))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [(i, t) for i, t in texts.items()] + [(i, t) for i, t, _ in planted] + ODD
    got = decontam.leaks(frame(spark, rows), bench.union(spark.createDataFrame([(900, None), (901, ""), (902, "!?")], bench.schema)))
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    assert {(i, j) for i, _, j in planted} <= pairs
    assert {(i, j) for i, t in texts.items() for j, b in items.items() if b in t} <= pairs
    wrong = [p for p in pairs if p[0] is not None and p[0] < 10_000 and p[0] > 11
             and decontam.lcs(*(decontam.words_of(x).tolist() for x in (items[p[1]], texts[p[0]])))
             < 0.4 * len(decontam.words_of(items[p[1]]))]
    assert wrong == []


def test_decontamination_without_the_rarest_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(300)
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    uses = Counter(w for t in texts.values() for w in (t or "").lower().split())
    rng = random.Random(5)
    rows, planted = list(texts.items()), set()
    for n, r in enumerate(bench.where("text is not null").orderBy("item_id").limit(60).collect()):
        w = r.text.split()
        rare = set(sorted(range(len(w)), key=lambda k: uses[w[k].lower()])[:int(len(w) * 0.35)])
        w = [f"new{rng.randrange(10 ** 7)}" if k in rare else x for k, x in enumerate(w)]
        if decontam.lcs(*(decontam.words_of(x).tolist() for x in (r.text, " ".join(w)))) \
                >= 0.6 * len(decontam.words_of(r.text)):
            host = rng.choice([t for t in texts.values() if t]).split()[:200]
            rows.append((10_000 + n, " ".join(host[:100] + w + host[100:])))
            planted.add((10_000 + n, r.item_id))
            if n == 0:  # an item copied into most documents, at any place
                rows += [(20_000 + k, " ".join(host[:k % 90] + [r.text] + host[k % 90:])) for k in range(1_000)]
                planted |= {(20_000 + k, r.item_id) for k in range(1_000)}
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, rows), bench).collect()}
    assert len(planted) > 1_030
    assert planted - got == set()


def test_places_of_a_copied_item_count_once():
    item = decontam.words_of("alpha beta gamma")
    block = decontam.Block([1], [item], [item])
    texts = pa.array(["x " * k + "one alpha beta gamma two" for k in range(50)]
                     + [f"p{k} beta q{k}" for k in range(3_000)])
    words = decontam.Words(texts, keep=decontam.ALNUM, lower=True)
    h = words.hashes()
    at, term = block.terms(h)
    registers = np.zeros((3, decontam.REGISTERS), np.uint8)
    decontam._register(registers, term, decontam._places(words, h, at))
    n = decontam._distinct_places(registers)[np.searchsorted(block.vocab, item)]
    assert abs(n[0] - 1) < 0.1 and abs(n[2] - 1) < 0.1 and 2_000 < n[1] < 4_000


def test_decontamination_with_a_small_fit(spark, docs, monkeypatch):
    """The same leaks whether the singular vectors are fitted on all passages or on a few."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = rows_of(decontam.leaks(docs, bench), "doc_id", "item_id")
    monkeypatch.setattr(decontam, "SKETCH", 300)
    assert rows_of(decontam.leaks(docs, bench), "doc_id", "item_id") == whole and whole


def test_singular_vectors_are_fitted_on_all_passages(spark, monkeypatch):
    """Z = A'A.Omega over the passages of all texts and items, however few are added at a time."""
    rng = random.Random(8)
    words = [f"w{n}" for n in range(40)]
    items = [(n, " ".join(rng.sample(words, 20))) for n in range(4)]
    texts = [(n, " ".join(rng.choices(words + ["x", "y"], k=20))) for n in range(300)]
    seen, fit = [], decontam.right_vectors
    monkeypatch.setattr(decontam, "right_vectors", lambda z, omega: seen.append((z, omega)) or fit(z, omega))
    monkeypatch.setattr(decontam, "_distinct_places", lambda registers: np.ones(len(registers)))  # all words weigh the same
    monkeypatch.setattr(decontam, "SKETCH", 7)
    decontam.leaks(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    (z, omega), = seen
    vocab = np.unique(np.concatenate([decontam.words_of(t) for _, t in items]))
    a = np.array([np.isin(vocab, decontam.words_of(t)) for _, t in texts + items], float)
    a /= np.maximum(np.sqrt(a.sum(axis=1, keepdims=True)), 1)
    assert np.allclose(z, a.T @ (a @ omega), rtol=1e-3, atol=1e-2)


def test_fit_by_pairs_of_terms_equals_the_fit_by_rows(monkeypatch):
    """A'A.Omega from the pairs of each passage's terms, without a row of Omega for each entry;
    from rows of Omega for vocabularies whose A'A would not fit."""
    rng = random.Random(9)
    words = [f"w{n}" for n in range(700)]
    block = decontam._block([{"item_id": n, "text": " ".join(words[7 * n:7 * n + 7])} for n in range(100)])
    texts = [None, "", "x y"] + [" ".join(rng.choices(words[:20], k=30) + rng.choices(words, k=rng.randrange(90))) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    omega = np.random.default_rng(1).standard_normal((len(block.vocab), 5)).astype(np.float32)
    weight = np.random.default_rng(2).uniform(0.5, 3, len(block.vocab))
    p = decontam.Passages(batch, block)
    a = np.zeros((p.passage.max() + 1, len(block.vocab)))
    a[p.passage, p.term] = weight[p.term]
    a /= np.maximum(np.sqrt((a * a).sum(axis=1, keepdims=True)), 1e-12)

    def fitted():
        z = np.zeros(omega.shape, np.float32)
        held = type("Held", (), {"value": (block, weight, omega)})
        for b in decontam._sketches(held)(iter([batch, batch])):
            for at, blob in zip(*(c.to_pylist() for c in b.columns)):
                part = np.frombuffer(blob, np.float32).reshape(-1, omega.shape[1])
                z[at:at + len(part)] += part
        return z

    by_rows = decontam._sketch
    monkeypatch.setattr(decontam, "_sketch", lambda *_: pytest.fail("a row of Omega for each entry"))
    want = 2 * a.T @ (a @ omega)
    assert np.allclose(fitted(), want, rtol=1e-3, atol=1e-3)
    monkeypatch.setattr(decontam, "_sketch", by_rows)
    monkeypatch.setattr(decontam, "GRAM", 0)
    assert np.allclose(fitted(), want, rtol=1e-3, atol=1e-3)


@pytest.mark.parametrize("often", [0, 3, 64, 10**9])
def test_projection_with_frequent_terms_as_a_matrix_product(monkeypatch, often):
    monkeypatch.setattr(decontam, "OFTEN", often)
    rng = np.random.default_rng(3)
    basis = rng.standard_normal((50, 6)).astype(np.float32)
    rows = [np.sort(rng.choice(50, n, replace=False, p=np.arange(1, 51) / 1275)) for n in rng.integers(1, 20, 600)]
    head = np.cumsum([0] + [len(r) for r in rows[:-1]])
    term = np.concatenate(rows)
    v = rng.uniform(0, 1, len(term)).astype(np.float32)
    a = np.zeros((len(rows), 50))
    a[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), term] = v
    assert np.allclose(decontam._projected(v, term, head, basis), a @ basis, atol=1e-4)
    assert decontam._projected(v[:0], term[:0], head[:0], basis).shape == (0, 6)


def test_lcs_of_many_windows_equals_one_by_one():
    rng = random.Random(4)
    sequences = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 5, 40, 63, 64, 65, 130)] + [[-1, 3, -1]]
    text = np.array([rng.randrange(9) for _ in range(300)])
    which = np.array([rng.randrange(len(sequences)) for _ in range(500)])
    left = np.array([rng.randrange(300) for _ in which])
    right = np.array([rng.randrange(a, 301) for a in left])
    got = decontam.Sequences(sequences, 9).lcs(which, text, left, right)
    assert got.tolist() == [decontam.lcs(sequences[n], text[a:b].tolist()) for n, a, b in zip(which, left, right)]


def test_decontamination_empty_sides(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "other text of the same id")], "item_id long, text string")
    assert decontam.leaks(odd, none).collect() == []
    assert decontam.leaks(frame(spark, []), some).collect() == []
    assert [r.doc_id for r in decontam.leaks(odd, some).collect()] == [9]
    kept = decontam.decontaminate(odd, some)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1  # not the other text of id 9
    more = frame(spark, [(None, "so other text of the same id stands"), (9, "clean"), (None, "clean")])
    assert sorted(r.text for r in decontam.decontaminate(more, some).collect()) == ["clean", "clean"]


def test_held_out_marks(spark, docs):
    for r in rules.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_digest_columns(spark, docs, tokenizer):
    r = bpe.digests(docs.orderBy("doc_id").limit(1), *tokenizer[:2]).first()
    text = docs.where(F.col("doc_id") == r.doc_id).first().text
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_packed_numbers_come_back_and_are_small():
    for v in ([], [0], [127, 128], [2 ** 32 - 1, 0, 2 ** 14, 2 ** 21 - 1, 2 ** 28]):
        assert bpe._unpack_numbers(bpe._pack_numbers(np.array(v, np.uint32))).tolist() == v
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(9_000)]
    text = " ".join(rng.choices(words, [1 / (n + 1) for n in range(len(words))], k=100_000))
    block = bpe._Block()
    block.add(pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]}))
    import public_tokenizers
    import regex
    rows = list(block.rows(0, regex.compile(public_tokenizers.PATTERN), 4))
    assert sum(len(x) for r in rows for x in (r[4], r[6])) < 0.224 * len(text)  # 0.229 with all of a number's bytes in a row
