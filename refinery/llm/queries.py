"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from refinery.llm import (
    bpe, collocations, decontam, langid, license, minhash, multi_index, rules, substring, suffixes, toxicity, warc, whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, with spans of mixed-language text."""
    return langid.predictions(_table(spark, sf_dir, "documents"))


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair that leaks."""
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by 20-word windows that occur earlier, removed from every document."""
    return substring.digests(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by compression distance."""
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a sparse rule ensemble."""
    return rules.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and their decoding for every document, as digests."""
    return bpe.digests(_table(spark, sf_dir, "documents"), *bpe.tokenizer(spark))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return multi_index.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents (3-word shingles, Jaccard 0.85)."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of every document."""
    return license.labels(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 leading components of all embeddings, whitened."""
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 100-byte strings that occur earlier, removed from every document."""
    return suffixes.digests(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two to four words of each language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_decontam": op2_decontam,
    "op3_substring": op3_substring,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_warc": op7_warc,
    "op8_embeddings": op8_embeddings,
    "op9_minhash": op9_minhash,
    "op10_license": op10_license,
    "op11_whitening": op11_whitening,
    "op12_suffixes": op12_suffixes,
    "op13_collocations": op13_collocations,
}

#: SQL cannot say the other methods' results (models, signatures, archives, eigenvectors) or not over
#: whole tables in time; tests hold them against brute force, round trips or held-out labels.
ORACLE: dict[str, str] = {"op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
orders AS (SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS m FROM spots),
freq AS (
  SELECT lang, phrase, m, count(*) AS a FROM (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM orders)
  GROUP BY lang, phrase, m),
often AS MATERIALIZED (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS p FROM freq WHERE a >= 30),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM freq WHERE m = 1 GROUP BY lang),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(p[1:k], ' ') AS head, array_to_string(p[k + 1:m], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM often WHERE m >= 2)),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, ((c.a::HUGEINT * 2000000) // (l.a + r.a))::BIGINT AS score
  FROM cuts c JOIN often l ON l.lang = c.lang AND l.phrase = c.head JOIN often r ON r.lang = c.lang AND r.phrase = c.tail
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
sizes AS (SELECT lang, p, m, a, unnest(range(2, m)) AS size FROM often WHERE m > 2),
places AS (SELECT lang, p, a, size, unnest(range(1, m - size + 2)) AS i FROM sizes),
held AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(p[i:i + size - 1], ' ') AS phrase, a FROM places)
  GROUP BY lang, phrase),
kept AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase
  WHERE h.longer IS NULL OR 100 * h.longer::HUGEINT < 80 * s.a::HUGEINT)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM kept k JOIN total t ON t.lang = k.lang WHERE rank <= 2000
"""}
