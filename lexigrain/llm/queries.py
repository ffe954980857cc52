"""Queries of the training data operators over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise
from . import encoding, leakage, mixture, pii, setjoin, terms, tokens, vectors


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_pairs(_read(spark, sf_dir, "ticket_vectors"))


def p1_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked lists, with ``col1`` left to a join on ``row_id``."""
    return vectors.similar_vectors(_read(spark, sf_dir, "ticket_vectors"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_terms(spark, sf_dir).where("mark IS NOT NULL").select("term")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_dictionary(spark, sf_dir).drop("term_id")


def p3_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the identifiers, which follow the partitioning."""
    return terms.term_counts(_read(spark, sf_dir, "clust2_csv"), ["col1", "col2"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_repaired(spark, sf_dir).select("row_id", "field")


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled(_read(spark, sf_dir, "clust2_csv"), ["col1", "col3"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.similar_row_clusters(_read(spark, sf_dir, "clust2_csv")).select(F.col("first_id").alias("first_row_id"), F.col("id").alias("row_id"))


def p5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and density of every row, by the Gaussian mixture."""
    return mixture.mixture_clusters(_read(spark, sf_dir, "clust2_csv"))


def p5_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical rows of the mixture's clusters."""
    return mixture.describe(materialise(p5_mixture(spark, sf_dir)))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(_read(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids."""
    return tokens.decode_corpus(p6_ids(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_matches(spark, sf_dir).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.without_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_replacements(spark, sf_dir).select("doc_id", "kind").distinct()


def p8_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replacements(_read(spark, sf_dir, "documents"))


def p8_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.masked(_read(spark, sf_dir, "documents"))


SECRET = "of the test tables, not for use"


def p8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    ranks, syllables = pii.clashes(docs, SECRET)
    return pii.masked(docs, secret=SECRET, ranks=ranks, syllables=syllables)


def p8_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogates that stand for several entities after clashes are resolved: none."""
    docs = _read(spark, sf_dir, "documents")
    ranks, syllables = pii.clashes(docs, SECRET)
    return pii.collisions(pii.replacements(docs, secret=SECRET, ranks=ranks, syllables=syllables))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_TERMS = r"""
WITH words AS (
  SELECT row_id, 1 AS c, unnest(regexp_extract_all(lower(col1), '[а-яёa-z0-9]+')) AS term FROM clust2_csv
  UNION ALL
  SELECT row_id, 2 AS c, unnest(regexp_extract_all(lower(col2), '[а-яёa-z0-9]+')) AS term FROM clust2_csv
), counts AS (
  SELECT term, count(*) FILTER (c = 1) AS n_col1, count(*) FILTER (c = 2) AS n_col2, count(*) AS n_total, count(DISTINCT row_id) AS n_rows
  FROM words WHERE length(term) >= 2 AND NOT regexp_full_match(term, '[0-9]+') GROUP BY term
), marked AS (
  SELECT *, CASE WHEN n_rows < 3 THEN 'rare' WHEN n_rows > 0.25 * (SELECT count(*) FROM clust2_csv) THEN 'common' END AS mark FROM counts
)
"""

_CLUSTERS = r"""
WITH RECURSIVE words AS (
  SELECT row_id, list_distinct(list_filter(regexp_extract_all(lower(col1), '[а-яёa-z0-9]+'), lambda x: length(x) >= 4 AND NOT regexp_full_match(x, '[0-9]+'))) AS w FROM clust2_csv
), kept AS (SELECT row_id, list_sort(w) AS w FROM words WHERE len(w) >= 8),
classes AS (SELECT w, min(row_id) AS cid, len(w) AS n FROM kept GROUP BY w),
flat AS (SELECT cid, n, unnest(w) AS x FROM classes),
shared AS (SELECT a.cid AS a, b.cid AS b, a.n AS na, b.n AS nb, count(*) AS k FROM flat a JOIN flat b ON a.x = b.x AND a.cid < b.cid GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE k * 10 >= 7 * (na + nb - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT cid, cid FROM classes UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
roots AS (SELECT a AS cid, min(b) AS root FROM reach GROUP BY a),
members AS (SELECT k.row_id, r.root FROM kept k JOIN classes c ON k.w = c.w JOIN roots r ON r.cid = c.cid),
sizes AS (SELECT root, count(*) AS n, min(row_id) AS first_row_id FROM members GROUP BY root HAVING count(*) >= 3)
SELECT s.first_row_id, m.row_id FROM members m JOIN sizes s ON m.root = s.root WHERE m.row_id <> s.first_row_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _TERMS + "SELECT term FROM marked WHERE mark IS NOT NULL",
        "p3_terms": _TERMS + "SELECT term, n_col1, n_col2, n_total, n_rows, mark FROM marked",
        "p5_found": _CLUSTERS,
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
