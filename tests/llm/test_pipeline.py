"""The pipeline against its stages by hand, at a small scale."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from refinery.llm import bpe, minhash, substring

SF = "/root/testdata/sf0.01"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").persist()
    columns = docs.columns
    rng = random.Random(3)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()
    clean = docs.where("lang = 'en'").orderBy("doc_id").first().text
    words = clean.split()
    passage = " ".join(f"q{rng.randrange(10 ** 6)}" for _ in range(60))
    own = [" ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(120)) for _ in range(4)]
    junk = " ".join(w.upper() + "!!" for w in words) * 3
    planted = [(90_001, own[0] + ". " + passage), (90_002, own[1] + ". " + passage), (90_003, own[2] + " " + bench.text),
               (90_004, own[3]), (90_005, own[3] + " end"), (90_006, junk)]
    rows = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in planted], docs.schema)
    out, kept = docs.union(rows), {}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, out, SF)
        assert out.columns == columns
        kept[name] = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
    assert 90_004 in kept["minhash_near_dedup"] and 90_005 not in kept["minhash_near_dedup"]
    assert kept["substring_dedup"][90_001] == planted[0][1]
    assert kept["substring_dedup"][90_002] == " ".join((own[1] + ".").split())
    assert 90_003 not in kept["decontamination"] and 90_004 in kept["decontamination"]
    first = corpus_pipeline.STAGES[0][1](spark, docs.union(rows), SF)
    ids = {r.doc_id for r in first.select("doc_id").collect()}
    assert 90_006 not in ids and first.columns == columns
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good & ids) / len(good) > 0.97


def test_null_and_repeated_ids_through_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    rng = random.Random(6)
    own = [" ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(80)) for _ in range(6)]
    planted = [(None, own[0]), (None, own[1]), (None, own[1] + " end"),  # without ids
               (80_001, own[2]), (80_001, own[2]),  # a repeated row
               (80_002, own[3]), (80_003, own[4]), (80_003, own[3] + " end"),  # two texts of one id
               (None, own[5]), (80_004, own[5])]
    rows = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in planted], docs.schema)
    out = docs.union(rows)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, out, SF)
    got = [(r.doc_id, r.text) for r in out.collect() if r.doc_id is None or r.doc_id > 80_000]
    alone = [t for i, t in got if i is None]
    assert own[0] in alone and len(alone) == 2 and len({own[1], own[1] + " end"} & set(alone)) == 1
    assert sorted(x for x in got if x[0]) == [(80_001, own[2]), (80_002, own[3]), (80_003, own[4]), (80_004, own[5])]


def test_rows_are_judged_by_their_own_texts(spark):
    """Junk and leaks go with a null id or an id shared with clean texts, which stay; column names with
    spaces and dots pass every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()
    rng = random.Random(8)
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    clean = [r.text for r in docs.join(good, "doc_id").where("lang = 'en' and n_chars between 800 and 3000").orderBy("doc_id").limit(4).collect()]
    junk = " ".join(w.upper() + "!!" for w in clean[0].split()) * 3
    own = " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(120))
    leak = f"{own} {bench.text}"
    planted = [(None, junk), (70_001, junk + " x"), (70_001, clean[1]), (None, leak), (70_002, leak), (70_002, clean[2]), (None, clean[3])]
    rows = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in planted], docs.schema)
    out = docs.where("doc_id % 3 = 0").union(rows).withColumn("my col", F.lit(1)).withColumn("a.b", F.lit(2))
    columns = out.columns
    poor = corpus_pipeline.quality_stage(spark, out, SF)
    texts = {r.text for r in poor.collect()}
    assert poor.columns == columns and not {junk, junk + " x"} & texts and set(clean[1:]) <= texts
    left = corpus_pipeline.decontam_stage(spark, out, SF)
    texts = {r.text for r in left.collect()}
    assert left.columns == columns and leak not in texts and {clean[1], clean[2], clean[3]} <= texts
    for stage in (corpus_pipeline.near_dup_stage, corpus_pipeline.substring_stage):
        done = stage(spark, out, SF)
        assert done.columns == columns and done.count() > 0


def test_run_is_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert sorted(map(tuple, out)) == sorted(map(tuple, docs.collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "substring_dedup",
                                                     "decontamination", "byte_bpe"]


def test_last_stages_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    from tests.llm.test_text_operators import components_by_force

    want = {r[0] for r in components_by_force(rows, 5, 4, 5) if r[3]}
    assert {r.doc_id for r in minhash.deduplicate(docs).collect()} == want
    gone = {r[0]: (r[1], r[2]) for r in substring.brute_force(rows)}
    kept = {r.doc_id for r in substring.strip_repeats(docs).collect()}
    assert kept == {i for i, (n, k) in gone.items() if k == 0 or k < n}
    out = corpus_pipeline.bpe_stage(spark, docs, "").collect()
    texts = dict(rows)
    assert all(r.text == texts[r.doc_id] for r in out) and len(out) == len(rows)
    assert bpe.tokenizer(spark)[0].endswith(".tiktoken")
