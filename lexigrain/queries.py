"""Queries of the core operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering_sql as C
from .functions import ngrams as N
from .functions import text as X
from .operators import agglomerative, classify, graph, leader, metrics, minibatch, packed, records, report, similarity, spherical, tfidf
from .plans import pipelines
from .scratch import materialise, new_path, sorted_merge
from .sources import corpora, csvfiles
from .streaming.classify import predict_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- records that fail to parse -----------------------------------------------
_RECORD = r"""
WITH parsed AS (
  SELECT rec_id, raw, regexp_extract(raw, '(?s)^("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*)$', ['a', 'b', 'c']) AS f,
    coalesce(raw <> '' AND regexp_full_match(raw, '(?s)("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*)'), false) AS clean
  FROM csv3_raw
), fields AS (
  SELECT rec_id, raw, clean,
    CASE WHEN f.a LIKE '"%' THEN replace(f.a[2:length(f.a) - 1], '""', '"') ELSE f.a END AS col1,
    CASE WHEN f.b LIKE '"%' THEN replace(f.b[2:length(f.b) - 1], '""', '"') ELSE f.b END AS col2,
    CASE WHEN f.c LIKE '"%' THEN replace(f.c[2:length(f.c) - 1], '""', '"') ELSE f.c END AS col3
  FROM parsed
), judged AS (
  SELECT *, clean AND regexp_matches(col1, '(?s)\[обращение [0-9]+\][ \t\r\n]*$') AND NOT regexp_matches(raw, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]') AS good FROM fields
)
"""


@query("p2_found", _RECORD + "SELECT rec_id FROM judged WHERE NOT good")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_rejects(spark, sf_dir).select("rec_id")


@query("p2_rejects")
def p2_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.rejected(read(spark, sf_dir, "csv3_raw"))


@query("p2_loaded", _RECORD + "SELECT rec_id, col1, col2, col3 FROM judged WHERE good")
def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.loaded(read(spark, sf_dir, "csv3_raw"))


# --- text expressions ---------------------------------------------------------
def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(set(words))) + "]"


def _sql_text(table: str = "topics12") -> str:
    return f"t AS (SELECT doc_id, coalesce(text, '') AS text FROM {table} WHERE doc_id IS NOT NULL)"


_LETTER = r"\p{L}\p{Nl}\p{No}"
_SQL_TICKET = "regexp_extract_all(replace(lower(text), 'ё', 'е'), '[а-яёa-z0-9]+')"
_SQL_CLEAN = f"list_filter({_SQL_TICKET}, lambda x: length(x) >= 2 AND NOT list_contains({_list([*X.STOP_BASE, *X.STOP_DOMAIN])}, x) AND NOT regexp_full_match(x, '[0-9]+'))"
_SQL_LETTERS = rf"trim(regexp_replace(regexp_replace(lower(text), '[^{_LETTER}]+', ' ', 'g'), '\s+', ' ', 'g'))"
_SQL_LITERAL = rf"trim(regexp_replace(regexp_replace(lower(text), '[{_LETTER}]+', ' ', 'g'), '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"
_WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SQL_NORMAL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), 'ё', 'е'), "
    rf"'https?://[^{_WS}]+|www\.[^{_WS}]+', ' ', 'g'), '[^а-яa-z{_WS}-]', ' ', 'g'), '-+', ' ', 'g'), '[{_WS}]+', ' ', 'g'))"
)
_SQL_STEM = f"CASE WHEN length(x) > 3 AND length(regexp_replace(x, '({X.ENDINGS})$', '')) >= 3 THEN regexp_replace(x, '({X.ENDINGS})$', '') ELSE x END"
_SQL_STEMS = f"list_transform(list_filter(regexp_extract_all(lower(text), '[а-яёa-z0-9]+'), lambda x: NOT list_contains({_list(X.STOP_CSV)}, x) AND length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+')), lambda x: {_SQL_STEM})"
_SQL_CLASSIFIER = f"list_filter(string_split({_SQL_NORMAL}, ' '), lambda x: length(x) > 1 AND NOT list_contains({_list(X.STOP_CLASSIFIER)}, x))"
_ROW_TEXT = "t AS (SELECT row_id AS doc_id, coalesce(col1, '') || ' ' || coalesce(col2, '') || ' ' || coalesce(col3, '') AS text FROM clust2_csv)"


def _joined(name: str, table: str, make: Callable[[], object], sql: str) -> None:
    """A query of one array expression over a table of texts, shown as one string with a bar between items."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, table).where("doc_id IS NOT NULL").select("doc_id", F.size(make()).alias("n"), F.array_join(make(), "|").alias("items"))

    query(name, f"WITH {_sql_text(table)}, g AS (SELECT doc_id, {sql} AS g FROM t) SELECT doc_id, len(g)::INT AS n, array_to_string(g, '|') AS items FROM g")(run)


_joined("tokens_words", "documents", lambda: X.word_tokens("text"), r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')")
_joined("tokens_ticket", "documents", lambda: X.ticket_tokens("text"), _SQL_TICKET)
_joined("tokens_clean", "documents", lambda: X.clean_tokens("text"), _SQL_CLEAN)
_joined("tokens_letters", "documents", lambda: X.letter_tokens("text"), rf"regexp_extract_all({_SQL_LETTERS}, '[{_LETTER}]+')")
_joined("tokens_classifier", "documents", lambda: X.classifier_tokens(X.normalised("text")), _SQL_CLASSIFIER)


def _scalar(name: str, make: Callable[[], object], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", make().alias("cleaned"))

    query(name, f"WITH {_sql_text('documents')} SELECT doc_id, {sql} AS cleaned FROM t")(run)


_scalar("text_letters_only", lambda: X.letters_only("text"), _SQL_LETTERS)
_scalar("text_letters_literal", lambda: X.letters_only("text", literal=True), _SQL_LITERAL)
_scalar("text_normalised", lambda: X.normalised("text"), _SQL_NORMAL)


@query("tokens_stemmed", f"WITH {_ROW_TEXT} SELECT doc_id AS row_id, array_to_string({_SQL_STEMS}, '|') AS items FROM t")
def tokens_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = csvfiles.joined_text("col1", "col2", "col3")
    return read(spark, sf_dir, "clust2_csv").select("row_id", F.array_join(X.stemmed_tokens(text), "|").alias("items"))


# --- n-grams ------------------------------------------------------------------
def _sql_words(list_sql: str, n: int, sep: str, prefix: str = "") -> str:
    if n == 0:
        return f"list_transform(range(0, len({list_sql}) + 1), lambda i: '')"
    return f"list_transform(range(1, greatest(len({list_sql}) - {n - 1}, 0) + 1), lambda i: '{prefix}' || array_to_string({list_sql}[i:i + {n - 1}], '{sep}'))"


def _sql_chars(text_sql: str, n: int, prefix: str = "") -> str:
    return f"list_transform(range(1, greatest(length({text_sql}) - {n - 1}, 0) + 1), lambda i: '{prefix}' || substring({text_sql}, i, {n}))"


def _sql_concat(parts: list[str]) -> str:
    return "flatten([" + ", ".join(parts) + "])"


def _sql_words_range(list_sql: str, a: int, b: int, sep: str, prefix: str = "") -> str:
    return _sql_concat([_sql_words(list_sql, n, sep, prefix) for n in range(a, b + 1)])


def _sql_chars_range(text_sql: str, a: int, b: int, prefix: str = "") -> str:
    return _sql_concat([_sql_chars(text_sql, n, prefix) for n in range(a, b + 1)])


def _sql_token_chars(list_sql: str, a: int, b: int, prefix: str = "") -> str:
    return f"flatten(list_transform({list_sql}, lambda w: {_sql_chars_range('w', a, b, prefix)}))"


def _sql_padded(clean: str, a: int = 3, b: int = 5) -> str:
    return f"list_transform(list_filter({_sql_chars_range(clean, a, b)}, lambda g: regexp_matches(g, '[а-я]')), lambda g: 'c:' || g)"


def _ngrams(name: str, prepare: dict[str, tuple[Callable[[], object], str]], make: Callable[[], object], sql: str) -> None:
    """A query of grams over topics12: ``prepare`` names columns the grams are made of."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, "topics12").where("doc_id IS NOT NULL").select("doc_id", *[f().alias(k) for k, (f, _) in prepare.items()])
        return df.select("doc_id", F.size(make()).alias("n"), F.array_join(make(), "|").alias("items"))

    columns = ", ".join(f"{s} AS {k}" for k, (_, s) in prepare.items())
    query(name, f"WITH {_sql_text()}, p AS (SELECT doc_id, {columns} FROM t), g AS (SELECT doc_id, {sql} AS g FROM p) SELECT doc_id, len(g)::INT AS n, array_to_string(g, '|') AS items FROM g")(run)


_TOK = {"tok": (lambda: X.word_tokens("text"), r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')")}
_LET = {"cl": (lambda: X.letters_only("text"), _SQL_LETTERS), "tok": (lambda: X.letter_tokens("text"), rf"regexp_extract_all({_SQL_LETTERS}, '[{_LETTER}]+')")}
_CLEANED = {"tok": (lambda: X.clean_tokens("text"), _SQL_CLEAN)}
_STEMMED = {"tok": (lambda: X.stemmed_tokens("text"), _SQL_STEMS)}
_NORMAL = {"cl": (lambda: X.normalised("text"), _SQL_NORMAL), "tok": (lambda: X.classifier_tokens(X.normalised("text")), _SQL_CLASSIFIER)}
_C = F.col
_ngrams("ngrams_word", _CLEANED, lambda: N.word_ngrams(_C("tok"), 1, 2), _sql_words_range("tok", 1, 2, " "))
_ngrams("ngrams_word_zero", _TOK, lambda: N.word_ngrams(_C("tok"), 0, 1), _sql_words_range("tok", 0, 1, " "))
_ngrams("ngrams_word_prefixed", _NORMAL, lambda: N.word_ngrams(_C("tok"), 1, 2, "_", "w:"), _sql_words_range("tok", 1, 2, "_", "w:"))
_ngrams("ngrams_char", _CLEANED, lambda: N.char_ngrams(F.array_join("tok", " "), 3, 5), _sql_chars_range("array_to_string(tok, ' ')", 3, 5))
_ngrams("ngrams_char_spaceless", _LET, lambda: N.spaceless_char_ngrams(_C("cl"), 2, 5), _sql_chars_range("replace(cl, ' ', '')", 2, 5))
_ngrams("ngrams_char_in_tokens", _LET, lambda: N.token_char_ngrams(_C("tok"), 2, 5), _sql_token_chars("tok", 2, 5))
_ngrams("ngrams_ticket", _STEMMED, lambda: N.ticket_ngrams(_C("tok")), _sql_concat([_sql_words_range("tok", 1, 2, "_", "w:"), _sql_token_chars("tok", 3, 3, "c:")]))
_ngrams("ngrams_char_padded", _NORMAL, lambda: N.padded_char_ngrams(_C("cl")), _sql_padded("' ' || cl || ' '"))
_ngrams("features_mixed_spaceless", _LET, lambda: N.mixed_ngrams(N.spaceless_char_ngrams(_C("cl")), _C("tok")), _sql_concat([_sql_chars_range("replace(cl, ' ', '')", 2, 5), _sql_words_range("tok", 1, 2, " ")]))
_ngrams("features_mixed_in_tokens", _LET, lambda: N.mixed_ngrams(N.token_char_ngrams(_C("tok")), _C("tok")), _sql_concat([_sql_token_chars("tok", 2, 5), _sql_words_range("tok", 1, 2, " ")]))


# --- bags, frequencies, TF-IDF ------------------------------------------------
def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "topics12").where("doc_id IS NOT NULL").select("doc_id", "text", "label")


def _clean(df: DataFrame) -> DataFrame:
    return df.select("doc_id", X.clean_tokens("text").alias("tok"))


_SQL_P = f"WITH {_sql_text()}, p AS (SELECT doc_id, {_SQL_CLEAN} AS tok FROM t), n AS (SELECT count(*) AS n FROM t)"
_SQL_BAG = _SQL_P + f", bag AS (SELECT doc_id, feature, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest({_sql_words_range('tok', 1, 2, ' ')}) AS feature FROM p) GROUP BY ALL), df AS (SELECT feature, count(*) AS df FROM bag GROUP BY feature)"
_SQL_WEIGHTED = (
    _SQL_P + f", parts AS (SELECT doc_id, unnest({_sql_words_range('tok', 1, 2, ' ', 'W:')}) AS feature, 1.0::DOUBLE AS x FROM p UNION ALL "
    f"SELECT doc_id, unnest({_sql_chars_range(chr(97) + 'rray_to_string(tok, ' + chr(39) + ' ' + chr(39) + ')', 3, 5, 'C:')}) AS feature, 1.2::DOUBLE AS x FROM p), "
    "bag AS (SELECT doc_id, feature, sum(x) AS tf FROM parts GROUP BY ALL), df AS (SELECT feature, count(*) AS df FROM bag GROUP BY feature)"
)
_IDF = "ln((n.n + 1.0) / (df.df + 1.0)) + 1.0"


def _word_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.bag(_clean(_topics(spark, sf_dir)), "doc_id", N.word_ngrams(_C("tok"), 1, 2))


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [(N.word_ngrams(_C("tok"), 1, 2, " ", "W:"), 1.0), (N.char_ngrams(F.array_join("tok", " "), 3, 5, "C:"), 1.2)]
    return tfidf.weighted_bag(_clean(_topics(spark, sf_dir)), "doc_id", parts)


@query("bag_words", _SQL_BAG + " SELECT doc_id, feature, tf FROM bag")
def bag_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_bag(spark, sf_dir)


@query("bag_totals", _SQL_BAG + " SELECT doc_id, sum(tf) AS total FROM bag GROUP BY doc_id")
def bag_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_bag(spark, sf_dir).groupBy("doc_id").agg(F.sum("tf").alias("total"))


@query("bag_weighted", _SQL_WEIGHTED + " SELECT doc_id, feature, round(tf, 6) AS tf FROM bag")
def bag_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir).withColumn("tf", F.round("tf", 6))


@query("bag_classifier", f"WITH {_sql_text()}, p AS (SELECT doc_id, {_SQL_NORMAL} AS cl, {_SQL_CLASSIFIER} AS tok FROM t) SELECT doc_id, feature, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest({_sql_concat([_sql_words_range('tok', 1, 2, '_', 'w:'), _sql_padded(chr(39) + ' ' + chr(39) + ' || cl || ' + chr(39) + ' ' + chr(39))])}) AS feature FROM p) GROUP BY ALL")
def bag_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.features(_topics(spark, sf_dir), "doc_id", "text")


@query("document_frequency", _SQL_BAG + " SELECT feature, df FROM df")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.document_frequency(_word_bag(spark, sf_dir))


@query("corpus_size", "SELECT count(*) AS n_docs FROM topics12 WHERE doc_id IS NOT NULL")
def corpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topics(spark, sf_dir).agg(F.count("*").alias("n_docs"))


@query("tfidf_share", _SQL_BAG + f" SELECT doc_id, bag.feature, round(tf / sum(tf) OVER (PARTITION BY doc_id) * ({_IDF}), 6) AS w FROM bag JOIN df USING (feature), n")
def tfidf_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags, n = _word_bag(spark, sf_dir), _topics(spark, sf_dir).count()
    return tfidf.tfidf(bags, tfidf.vocabulary(bags, n), "doc_id").select("doc_id", "feature", F.round("w", 6).alias("w"))


@query("tfidf_weighted", _SQL_WEIGHTED + f", v AS (SELECT doc_id, bag.feature, tf * ({_IDF}) AS w FROM bag JOIN df USING (feature), n) SELECT doc_id, feature, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS w FROM v")
def tfidf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags, n = _weighted(spark, sf_dir), _topics(spark, sf_dir).count()
    return tfidf.tfidf(bags, tfidf.vocabulary(bags, n), "doc_id", "raw", normalise=True).select("doc_id", "feature", F.round("w", 6).alias("w"))


_SQL_TICKETS = (
    f"WITH {_ROW_TEXT}, p AS (SELECT doc_id, {_SQL_STEMS} AS tok FROM t), n AS (SELECT count(*) AS n FROM t), "
    f"bag AS (SELECT doc_id, feature, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest({_sql_concat([_sql_words_range('tok', 1, 2, '_', 'w:'), _sql_token_chars('tok', 3, 3, 'c:')])}) AS feature FROM p) GROUP BY ALL), "
    "df AS (SELECT feature, count(*) AS df FROM bag GROUP BY feature HAVING count(*) >= 3), "
    "top AS (SELECT feature, df, row_number() OVER (ORDER BY df DESC, feature) - 1 AS feature_id FROM df QUALIFY feature_id < 5000)"
)


@query("vocabulary_pruned", _SQL_TICKETS + " SELECT feature, top.df, feature_id::INT AS feature_id, round(ln((n.n + 1.0) / (top.df + 1.0)) + 1.0, 6) AS idf FROM top, n")
def vocabulary_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, v = pipelines.ticket_vectors(read(spark, sf_dir, "clust2_csv"), "row_id")
    return v.select("feature", "df", "feature_id", F.round("idf", 6).alias("idf"))


@query("tfidf_pruned", _SQL_TICKETS + ", shares AS (SELECT doc_id, feature, tf / sum(tf) OVER (PARTITION BY doc_id) AS share FROM bag), v AS (SELECT doc_id, s.feature, feature_id, share * (ln((n.n + 1.0) / (top.df + 1.0)) + 1.0) AS w FROM shares s JOIN top USING (feature), n) SELECT doc_id AS row_id, feature, feature_id::INT AS feature_id, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS w FROM v")
def tfidf_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = pipelines.ticket_vectors(read(spark, sf_dir, "clust2_csv"), "row_id")
    return v.select("row_id", "feature", "feature_id", F.round("w", 6).alias("w"))


@query("common_words", f"WITH {_sql_text('documents')}, p AS (SELECT doc_id, unnest({_SQL_CLEAN}) AS w FROM t), d AS (SELECT w, count(DISTINCT doc_id) AS df FROM p GROUP BY w) SELECT w AS feature, df FROM d WHERE df / (SELECT count(*) FROM t) > 0.3")
def common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    return tfidf.frequent_words(tfidf.bag(_clean(d), "doc_id", _C("tok")), d.count(), 0.3)


@query("without_common_words", f"WITH {_sql_text('documents')}, p AS (SELECT doc_id, {_SQL_CLEAN} AS tok FROM t), u AS (SELECT doc_id, unnest(tok) AS w FROM p), c AS (SELECT list(w) AS common FROM (SELECT w FROM u GROUP BY w HAVING count(DISTINCT doc_id) / (SELECT count(*) FROM t) > 0.3)) SELECT doc_id, array_to_string(list_filter(tok, lambda x: NOT list_contains(coalesce(common, []), x)), '|') AS tokens FROM p, c")
def without_common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens in their order, without those in more than 0.3 of the texts."""
    d = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    kept = pipelines.without_words(_clean(d).withColumnRenamed("tok", "tokens"), common_words(spark, sf_dir).select(_C("feature").alias("word")))
    return kept.select("doc_id", F.array_join("tokens", "|").alias("tokens"))


@query("tfidf_mixed", f"WITH {_sql_text()}, p AS (SELECT doc_id, {_SQL_LETTERS} AS cl FROM t), q AS (SELECT doc_id, regexp_extract_all(cl, '[{_LETTER}]+') AS tok FROM p), n AS (SELECT count(*) AS n FROM t), bag AS (SELECT doc_id, feature, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest({_sql_concat([_sql_token_chars('tok', 2, 5), _sql_words_range('tok', 1, 2, ' ')])}) AS feature FROM q) GROUP BY ALL), df AS (SELECT feature, count(*) AS df FROM bag GROUP BY feature), v AS (SELECT doc_id, bag.feature, tf * ({_IDF}) AS w FROM bag JOIN df USING (feature), n), x AS (SELECT doc_id, feature, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS w FROM v) SELECT t.doc_id, feature, w FROM t LEFT JOIN x USING (doc_id)")
def tfidf_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character and word grams over the whole vocabulary; a text without features has one row of nulls."""
    t = _topics(spark, sf_dir)
    bags = tfidf.bag(t.select("doc_id", X.letter_tokens("text").alias("tok")), "doc_id", N.mixed_ngrams(N.token_char_ngrams(_C("tok")), _C("tok")))
    v = tfidf.tfidf(bags, tfidf.vocabulary(bags, t.count()), "doc_id", "raw", normalise=True)
    return t.select("doc_id").join(sorted_merge(v.select("doc_id", "feature", F.round("w", 6).alias("w"))), "doc_id", "left")


@query("labels_distinct", "SELECT DISTINCT label FROM topics12 WHERE label IS NOT NULL")
def labels_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topics(spark, sf_dir).where("label IS NOT NULL").select("label").distinct()


# --- vectors ------------------------------------------------------------------
@query("cosine_dense", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the one of the next id."""
    e = read(spark, sf_dir, "embeddings")
    nxt = e.select((_C("vec_id") - 1).alias("vec_id"), _C("embedding").alias("b"))
    c = similarity.cosine(_C("embedding"), _C("b"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(c, 6).alias("similarity"), F.round(similarity.cosine_distance(_C("embedding"), _C("b")), 6).alias("distance"))


@query("normalised_dense", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS total FROM embeddings")
def normalised_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.aggregate(similarity.normalised(_C("embedding")), F.lit(0.0), lambda s, x: s + x)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(unit, 6).alias("total"))


@query("norms_sparse", _SQL_BAG + " SELECT doc_id, round(sqrt(sum(tf * tf)), 6) AS norm FROM bag GROUP BY doc_id")
def norms_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.sparse_norms(_word_bag(spark, sf_dir), "doc_id", "tf").withColumn("norm", F.round("norm", 6))


# --- neighbours and graphs ----------------------------------------------------
_SQL_UNIT = _SQL_BAG + f", v AS (SELECT doc_id, bag.feature, tf * ({_IDF}) AS w FROM bag JOIN df USING (feature), n), u AS (SELECT doc_id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM v)"
_SQL_PAIRS = _SQL_UNIT + ", pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.w * b.w), 6) AS similarity FROM u a JOIN u b ON a.feature = b.feature AND a.doc_id < b.doc_id GROUP BY ALL HAVING round(sum(a.w * b.w), 12) >= 0.18)"
_SQL_NEIGHBORS = _SQL_PAIRS + ", both_ways AS (SELECT a AS doc_id, b AS neighbor_id, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs), nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, neighbor_id DESC)::INT AS rank FROM both_ways QUALIFY rank <= 4)"
_SQL_GRAPH = _SQL_NEIGHBORS.replace("WITH ", "WITH RECURSIVE ", 1) + ", edges AS (SELECT doc_id AS src, neighbor_id AS dst FROM nb UNION SELECT neighbor_id, doc_id FROM nb), nodes AS (SELECT DISTINCT doc_id FROM t)"
_SQL_COMPONENTS = _SQL_GRAPH + ", reach(a, b) AS (SELECT doc_id, doc_id FROM nodes UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON r.b = e.src), roots AS (SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY a), cl AS (SELECT doc_id, (dense_rank() OVER (ORDER BY root) - 1)::INT AS cluster_id FROM roots)"


def _unit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags, n = _word_bag(spark, sf_dir), _topics(spark, sf_dir).count()
    return tfidf.tfidf(bags, tfidf.vocabulary(bags, n), "doc_id", "raw", normalise=True)


def _pairs(spark: SparkSession, sf_dir: str, least: float = 0.18) -> DataFrame:
    return similarity.sparse_pairs(materialise(_unit_words(spark, sf_dir)), min_similarity=least)


@query("neighbors_top4", _SQL_NEIGHBORS + " SELECT doc_id, neighbor_id, similarity, rank FROM nb")
def neighbors_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.nearest_texts(materialise(_unit_words(spark, sf_dir)))


@query("knn_graph", _SQL_GRAPH + " SELECT src, dst FROM edges")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symmetric_edges(neighbors_top4(spark, sf_dir))


@query("graph_components", _SQL_COMPONENTS + " SELECT doc_id, cluster_id FROM cl")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(knn_graph(spark, sf_dir), _topics(spark, sf_dir))


@query("graph_degrees", _SQL_GRAPH + " SELECT doc_id, count(dst) AS degree FROM nodes LEFT JOIN edges ON src = doc_id GROUP BY doc_id")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(knn_graph(spark, sf_dir), _topics(spark, sf_dir))


@query("similarity_histogram", _SQL_NEIGHBORS + ", e AS (SELECT min(similarity) AS a, max(similarity) AS b FROM nb), placed AS (SELECT least(floor((similarity - a) * 20 / (b - a)), 19)::INT AS bin, count(*) AS n FROM nb, e GROUP BY ALL) SELECT g.bin::INT AS bin, round(a + g.bin * ((b - a) / 20), 6) AS lower, round(a + (g.bin + 1) * ((b - a) / 20), 6) AS upper, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 20)) AS bin) g CROSS JOIN e LEFT JOIN placed ON placed.bin = g.bin")
def similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.similarity_histogram(materialise(neighbors_top4(spark, sf_dir)))


@query("cluster_sizes", _SQL_COMPONENTS + " SELECT cluster_id, count(*) AS size FROM cl GROUP BY cluster_id")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cluster_sizes(graph_components(spark, sf_dir))


@query("cluster_size_histogram", _SQL_COMPONENTS + ", s AS (SELECT count(*) AS size FROM cl GROUP BY cluster_id) SELECT size, count(*) AS n_clusters FROM s GROUP BY size")
def cluster_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.size_histogram(graph_components(spark, sf_dir))


@query("cluster_top_features", _SQL_COMPONENTS + ", s AS (SELECT cluster_id, feature, round(sum(w), 6) AS score FROM u JOIN cl USING (doc_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, feature)::INT AS rank FROM s QUALIFY rank <= 10) SELECT cluster_id, rank, feature, feature[1:2] AS kind, feature[3:] AS value, score FROM r")
def cluster_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_features(_unit_words(spark, sf_dir), materialise(graph_components(spark, sf_dir)))


@query("cluster_listing", _SQL_COMPONENTS + ", s AS (SELECT cluster_id, count(*) AS size FROM cl GROUP BY cluster_id) SELECT cluster_id, size, cl.doc_id, topics12.text FROM cl JOIN s USING (cluster_id) JOIN topics12 ON topics12.doc_id = cl.doc_id")
def cluster_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cluster_listing(_topics(spark, sf_dir), materialise(graph_components(spark, sf_dir)))


@query("neighbor_listing", _SQL_NEIGHBORS + " SELECT d.doc_id, d.text, nb.rank, printf('%.3f', nb.similarity) AS similarity, nb.neighbor_id, x.text AS neighbor_text FROM topics12 d LEFT JOIN nb ON nb.doc_id = d.doc_id LEFT JOIN topics12 x ON x.doc_id = nb.neighbor_id WHERE d.doc_id IS NOT NULL")
def neighbor_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.neighbor_listing(_topics(spark, sf_dir), neighbors_top4(spark, sf_dir))


@query("cleaned_listing", f"WITH {_sql_text()} SELECT topics12.doc_id, topics12.text, array_to_string(c.tok, ' ') AS cleaned FROM topics12 JOIN (SELECT doc_id, {_SQL_CLEAN} AS tok FROM t) c USING (doc_id)")
def cleaned_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cleaned_texts(_topics(spark, sf_dir), X.clean_tokens("text"))


@query("stop_word_listing", f"SELECT array_to_string({_list([*X.STOP_BASE, *X.STOP_DOMAIN])}, ', ') AS words")
def stop_word_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in X.STOP_BASE], "word string").union(spark.createDataFrame([(w,) for w in X.STOP_DOMAIN], "word string"))
    return report.word_listing(words, "word")


_HEX = "(('0x' || md5('42{a}:' || feature)[1:12])::BIGINT / 281474976710656.0 * 2 - 1)"


@query("random_projection", _SQL_UNIT + f", xy AS (SELECT doc_id, round(sum(w * {_HEX.format(a='x')}), 6) AS x, round(sum(w * {_HEX.format(a='y')}), 6) AS y FROM u GROUP BY doc_id) SELECT t.doc_id, coalesce(x, 0.0) AS x, coalesce(y, 0.0) AS y FROM t LEFT JOIN xy USING (doc_id)")
def random_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.random_projection(_unit_words(spark, sf_dir), _topics(spark, sf_dir))


def _sql_pipeline(texts: str) -> str:
    """The graph clustering with its production options over ``texts``, which selects doc_id and text."""
    grams = f"SELECT doc_id, unnest({_sql_words_range('tok', 1, 2, ' ', 'W:')}) AS feature, 1.0::DOUBLE AS x FROM p UNION ALL SELECT doc_id, unnest({_sql_chars_range('joined', 3, 5, 'C:')}) AS feature, 1.2::DOUBLE AS x FROM p"
    unit = (
        f"WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM ({texts}) WHERE doc_id IS NOT NULL), n AS (SELECT count(*) AS n FROM t), p0 AS (SELECT doc_id, {_SQL_CLEAN} AS tok FROM t), "
        "c AS (SELECT list(w) AS common FROM (SELECT w FROM (SELECT doc_id, unnest(tok) AS w FROM p0) GROUP BY w HAVING count(DISTINCT doc_id) / (SELECT count(*) FROM t) > 0.85)), "
        "p AS (SELECT doc_id, tok, array_to_string(tok, ' ') AS joined FROM (SELECT doc_id, list_filter(tok, lambda x: NOT list_contains(coalesce(common, []), x)) AS tok FROM p0, c)), "
        f"bag AS (SELECT doc_id, feature, sum(x) AS tf FROM ({grams}) GROUP BY ALL), df AS (SELECT feature, count(*) AS df FROM bag GROUP BY feature), "
        f"v AS (SELECT doc_id, bag.feature, tf * ({_IDF}) AS w FROM bag JOIN df USING (feature), n), u AS (SELECT doc_id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM v)"
    )
    return unit + _SQL_COMPONENTS[len(_SQL_UNIT.replace("WITH ", "WITH RECURSIVE ", 1)) :] + " SELECT doc_id, cluster_id FROM cl"


def _values(texts: tuple[str, ...]) -> str:
    return "SELECT doc_id::BIGINT AS doc_id, text FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts)) + ") v(doc_id, text)"


@query("graph_pipeline", _sql_pipeline(_values(corpora.TICKETS)))
def graph_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph clustering with word and character grams, over the ticket texts in memory."""
    return pipelines.graph_clustering(corpora.tickets(spark)).clusters


@query("graph_pipeline_topics", _sql_pipeline("SELECT doc_id, text FROM topics12"))
def graph_pipeline_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with its production options over a table that grows."""
    return pipelines.graph_clustering(_topics(spark, sf_dir)).clusters


# --- clustering ---------------------------------------------------------------
_K = 10


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.pack_dense(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _first_ids(spark: SparkSession, sf_dir: str) -> list[int]:
    return [r["id"] for r in _embedded(spark, sf_dir).select("id").orderBy("id").limit(_K).collect()]


_SQL_EMB = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings), c0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS cluster_id, v AS c FROM e QUALIFY cluster_id < 10)"


def _sql_assign(i: int) -> str:
    return (
        f"s{i} AS (SELECT id, cluster_id, round(list_dot_product(v, c), 12) AS s FROM e, c{i}), a{i} AS (SELECT id, cluster_id, s FROM s{i} QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, cluster_id) = 1), "
        f"m{i} AS (SELECT cluster_id, d, avg(x) AS x FROM (SELECT a.cluster_id, unnest(range(1, 65)) AS d, unnest(e.v) AS x FROM a{i} a JOIN e USING (id)) GROUP BY ALL), "
        f"c{i + 1} AS (SELECT cluster_id, list(x / nn ORDER BY d) AS c FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY cluster_id)) AS nn FROM m{i}) GROUP BY cluster_id)"
    )


_SQL_KM = "WITH " + ", ".join([_SQL_EMB, _sql_assign(0), _sql_assign(1)])


@query("kmeans_assign", _SQL_KM + " SELECT id, cluster_id, round(s, 6) AS similarity FROM a0")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of ten given centroids."""
    p = _embedded(spark, sf_dir)
    return packed.assign(p, packed.rows_of(p, _first_ids(spark, sf_dir), packed.width(p)))


@query("kmeans_centroids", _SQL_KM + " SELECT cluster_id, (d - 1)::INT AS feature_id, round(x / sqrt(sum(x * x) OVER (PARTITION BY cluster_id)), 6) AS w FROM m0")
def kmeans_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the clusters of :func:`kmeans_assign`, brought to length 1."""
    p = _embedded(spark, sf_dir)
    unit = p.select("id", F.explode(F.arrays_zip("idx", similarity.normalised(_C("val")).alias("w"))).alias("z")).select("id", _C("z.idx").alias("feature_id"), _C("z.w").alias("w"))
    return spherical.centroids_of(unit, kmeans_assign(spark, sf_dir), "id").withColumn("w", F.round("w", 6))


@query("kmeans_score", _SQL_KM + " SELECT round(sum(round(list_dot_product(v, c), 6)), 4) AS score FROM a0 JOIN e USING (id) JOIN c1 USING (cluster_id)")
def kmeans_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of cosines of the rows and the centroids after one round."""
    c = spherical.spherical_kmeans(_embedded(spark, sf_dir), _K, max_iterations=1, init="given", first_ids=_first_ids(spark, sf_dir), repair=False)
    return c.assignments.agg(F.round(F.sum("similarity"), 4).alias("score"))


@query("kmeans_two_rounds", _SQL_KM + " SELECT id, cluster_id, round(list_dot_product(v, c), 6) AS similarity FROM a1 JOIN e USING (id) JOIN c2 USING (cluster_id)")
def kmeans_two_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spherical.spherical_kmeans(_embedded(spark, sf_dir), _K, max_iterations=2, init="given", first_ids=_first_ids(spark, sf_dir), repair=False)
    return c.assignments


_SQL_POINTS = "SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings"


@query("kmeans_random", C.kmeans(_SQL_POINTS, _K, 10, False, "SELECT id, cluster_id, similarity FROM best"))
def kmeans_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.spherical_kmeans(_embedded(spark, sf_dir), _K, init="random", repair=False).assignments


@query("kmeans_farthest", C.kmeans(_SQL_POINTS, _K, 20, True, "SELECT id, cluster_id, similarity FROM best"))
def kmeans_farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.spherical_kmeans(_embedded(spark, sf_dir), _K, n_init=20).assignments


@query("kmeans_topics")
def kmeans_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spherical k-means of character and word grams."""
    t = _topics(spark, sf_dir).select("doc_id", X.letters_only("text").alias("cl"), X.letter_tokens("text").alias("tok"))
    bags = tfidf.bag(t, "doc_id", N.mixed_ngrams(N.token_char_ngrams(_C("tok")), _C("tok")))
    v, _ = tfidf.pruned_tfidf(bags, t.count(), "doc_id", 2, 20_000)
    return spherical.spherical_kmeans(materialise(packed.pack(v, t)), 12, n_init=20).assignments


@query("kmeans_clusters", C.kmeans(_SQL_POINTS, _K, 20, True, "SELECT cluster_id, count(*) OVER (PARTITION BY cluster_id) AS size, id FROM best"))
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.make_clusters(spark, kmeans_farthest(spark, sf_dir), _K)


@query("kmeans_summary", C.kmeans(_SQL_POINTS, _K, 20, True, "SELECT count(*) AS clusters, sum(size)::BIGINT AS rows, min(size) AS smallest, max(size) AS largest, round(any_value(score), 4) AS score FROM (SELECT cluster_id, count(*) AS size, any_value(score) AS score FROM best GROUP BY cluster_id)"))
def kmeans_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spherical.spherical_kmeans(_embedded(spark, sf_dir), _K, n_init=20)
    return report.clustering_summary(c.assignments, c.score)


def _ticket_packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "clust2_csv").where("row_id IS NOT NULL")
    v, vocab = pipelines.ticket_vectors(rows, "row_id")
    return materialise(packed.pack(v, rows, "row_id")), vocab


@query("minibatch_tickets")
def minibatch_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minibatch.minibatch_kmeans(_ticket_packed(spark, sf_dir)[0], 10)[0]


@query("minibatch_features")
def minibatch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, vocab = _ticket_packed(spark, sf_dir)
    return report.centroid_features(minibatch.minibatch_kmeans(p, 10)[1], vocab, 6)


@query("leader_topics", C.leaders(_SQL_PAIRS.replace(">= 0.18", ">= 0.35"), "SELECT doc_id, (dense_rank() OVER (ORDER BY leader) - 1)::INT AS cluster_id, leader, similarity FROM led"))
def leader_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leader.leader_clustering(_pairs(spark, sf_dir, 0.35), _topics(spark, sf_dir))


def _eval_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = read(spark, sf_dir, "eval_items").select(_C("item_id").alias("doc_id"), "text")
    bags = tfidf.bag(d.select("doc_id", X.word_tokens("text").alias("tok")), "doc_id", N.word_ngrams(_C("tok"), 1, 2))
    return d, tfidf.tfidf(bags, tfidf.vocabulary(bags, d.count()), "doc_id", normalise=True)


def _sql_positive(texts: str, first: int, last: int) -> str:
    """All pairs of a positive cosine of word grams over ``texts``."""
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
    return (
        f"WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM ({texts})), p AS (SELECT doc_id, {words} AS tok FROM t), n AS (SELECT count(*) AS n FROM t), "
        f"bag AS (SELECT doc_id, feature, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest({_sql_words_range('tok', first, last, ' ')}) AS feature FROM p) GROUP BY ALL), df AS (SELECT feature, count(*) AS df FROM bag GROUP BY feature), "
        f"v AS (SELECT doc_id, bag.feature, tf * ({_IDF}) AS w FROM bag JOIN df USING (feature), n), u AS (SELECT doc_id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM v), "
        "pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS similarity FROM u a JOIN u b ON a.feature = b.feature AND a.doc_id < b.doc_id GROUP BY ALL)"
    )


@query("agglomerative_news", C.linkage(_sql_positive(_values(corpora.NEWS), 0, 1), 0.5))
def agglomerative_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpora.news(spark)
    bags = tfidf.bag(d.select("doc_id", X.word_tokens("text").alias("tok")), "doc_id", N.word_ngrams(_C("tok"), 0, 1))
    v = tfidf.tfidf(bags, tfidf.vocabulary(bags, d.count()), "doc_id", normalise=True)
    return agglomerative.agglomerative_clusters(similarity.sparse_pairs(v, min_similarity=1e-9), d, 0.5)


@query("agglomerative_items", C.linkage(_sql_positive("SELECT item_id AS doc_id, text FROM eval_items", 1, 2), 0.65))
def agglomerative_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, v = _eval_vectors(spark, sf_dir)
    return agglomerative.agglomerative_clusters(similarity.sparse_pairs(v, min_similarity=1e-9), d, 0.65)


@query("agglomerative_topics")
def agglomerative_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average linkage over a table that grows."""
    return agglomerative.average_linkage(materialise(_unit_words(spark, sf_dir)), _topics(spark, sf_dir), 0.65)


# --- classification -----------------------------------------------------------
_SQL_SPLIT = (
    "h AS (SELECT doc_id, text, label, md5('42:' || doc_id) AS h FROM topics12 WHERE label IS NOT NULL AND doc_id IS NOT NULL), "
    "split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY h, doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY label) * 0.2)) THEN 'test' ELSE 'train' END AS split FROM h)"
)


def _sql_features(name: str, source: str) -> str:
    grams = _sql_concat([_sql_words_range("tok", 1, 2, "_", "w:"), _sql_padded("' ' || cl || ' '")])
    return f"{name}_t AS (SELECT doc_id, coalesce(text, '') AS text FROM {source}), {name}_p AS (SELECT doc_id, {_SQL_NORMAL} AS cl, {_SQL_CLASSIFIER} AS tok FROM {name}_t), {name} AS (SELECT doc_id, feature, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest({grams}) AS feature FROM {name}_p) GROUP BY ALL)"


def _sql_unit(name: str, bag: str) -> str:
    return f"{name}_w AS (SELECT doc_id, feature, feature_id, (1 + ln(tf)) * idf AS w FROM {bag} JOIN vocab USING (feature)), {name} AS (SELECT doc_id, feature, feature_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM {name}_w)"


_SQL_FIT = "WITH " + ", ".join([
    _SQL_SPLIT, "train AS (SELECT doc_id, text, label FROM split WHERE split = 'train')", _sql_features("bag", "train"),
    "n AS (SELECT count(*) AS n FROM train)",
    "vocab AS (SELECT feature, df, ln((n + 1.0) / (df + 1.0)) + 1.0 AS idf, (row_number() OVER (ORDER BY df DESC, feature) - 1)::INT AS feature_id FROM (SELECT feature, count(*) AS df FROM bag GROUP BY feature HAVING count(*) >= 2), n QUALIFY feature_id < 60000)",
    _sql_unit("vec", "bag"), "classes AS (SELECT label, count(*) AS n, (row_number() OVER (ORDER BY label) - 1)::INT AS label_id FROM train GROUP BY label)",
    "means AS (SELECT label_id, feature_id, sum(w) / any_value(classes.n) AS w FROM vec JOIN train USING (doc_id) JOIN classes USING (label) GROUP BY label_id, feature_id)",
    "cent AS (SELECT label_id, feature_id, w / sqrt(sum(w * w) OVER (PARTITION BY label_id)) AS w FROM means)",
])
_SQL_PREDICT = _SQL_FIT + ", " + ", ".join([
    "test AS (SELECT doc_id, text, label FROM split WHERE split = 'test')", _sql_features("tbag", "test"), _sql_unit("tvec", "tbag"),
    "scores AS (SELECT doc_id, label_id, round(sum(tvec.w * cent.w), 12) AS score FROM tvec JOIN cent USING (feature_id) GROUP BY ALL)",
    "best AS (SELECT doc_id, label_id, score FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label_id) = 1)",
    "pred AS (SELECT test.doc_id, test.label, classes.label AS prediction, round(coalesce(best.score, 0.0), 6) AS score FROM test LEFT JOIN best USING (doc_id) JOIN classes ON classes.label_id = coalesce(best.label_id, 0))",
])


def _evaluation(spark: SparkSession, sf_dir: str) -> pipelines.Evaluation:
    return pipelines.train_and_evaluate(_topics(spark, sf_dir))


@query("stratified_split", f"WITH {_SQL_SPLIT} SELECT doc_id, label, split FROM split")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stratified_split(_topics(spark, sf_dir).where("label IS NOT NULL")).select("doc_id", "label", "split")


@query("classifier_vocabulary", _SQL_FIT + " SELECT feature, df, feature_id, round(idf, 6) AS idf FROM vocab")
def classifier_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).model.vocabulary.select("feature", "df", "feature_id", F.round("idf", 6).alias("idf"))


@query("classifier_centroids", _SQL_FIT + " SELECT label_id, feature_id, round(w, 6) AS w FROM cent")
def classifier_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).model.centroids.withColumn("w", F.round("w", 6))


@query("classifier_classes", _SQL_FIT + " SELECT label_id, label, n, round(coalesce(norm, 0.0), 6) AS norm FROM classes LEFT JOIN (SELECT label_id, sqrt(sum(w * w)) AS norm FROM means GROUP BY label_id) USING (label_id)")
def classifier_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).model.classes.withColumn("norm", F.round("norm", 6))


@query("classifier_predict", _SQL_PREDICT + " SELECT doc_id, label, prediction, score FROM pred")
def classifier_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).predictions.select("doc_id", "label", "prediction", "score")


@query("classifier_transform", _SQL_PREDICT + " SELECT doc_id, feature, feature_id, round(w, 6) AS w FROM tvec")
def classifier_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = metrics.stratified_split(_topics(spark, sf_dir).where("label IS NOT NULL"))
    model = classify.fit(split.where("split = 'train'"))
    return model.transform(split.where("split = 'test'")).select("doc_id", "feature", "feature_id", F.round("w", 6).alias("w"))


@query("classifier_typical", _SQL_FIT + " SELECT label, rank, feature, round(w, 6) AS w FROM (SELECT label, feature, cent.w, row_number() OVER (PARTITION BY label ORDER BY round(cent.w, 9) DESC, feature)::INT AS rank FROM cent JOIN classes USING (label_id) JOIN vocab USING (feature_id) QUALIFY rank <= 20)")
def classifier_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).model.typical()


_SQL_PROJECTION = _SQL_FIT + ", " + ", ".join([
    "pts AS (SELECT doc_id, text, label FROM topics12 WHERE doc_id IS NOT NULL ORDER BY doc_id LIMIT 1500)", _sql_features("pbag", "pts"), _sql_unit("pvec", "pbag"),
    "xy AS (SELECT doc_id, round(sum(CASE WHEN label_id = 0 THEN pvec.w * cent.w ELSE 0 END), 6) AS x, round(sum(CASE WHEN label_id = 1 THEN pvec.w * cent.w ELSE 0 END), 6) AS y FROM pvec JOIN cent USING (feature_id) WHERE label_id < 2 GROUP BY doc_id)",
])


@query("classifier_projection", _SQL_PROJECTION + " SELECT pts.doc_id, classes.label_id, coalesce(x, 0.0) AS x, coalesce(y, 0.0) AS y FROM pts LEFT JOIN xy USING (doc_id) LEFT JOIN classes USING (label)")
def classifier_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the plot with the number of their label (null for labels the model does not know)."""
    t, model = _topics(spark, sf_dir), _evaluation(spark, sf_dir).model
    return model.projection(t).join(t.join(model.classes, "label").select("doc_id", "label_id"), "doc_id", "left").select("doc_id", "label_id", "x", "y")


@query("classifier_stream", _SQL_PREDICT + " SELECT doc_id, prediction FROM pred")
def classifier_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test texts classified as a stream of files."""
    split = metrics.stratified_split(_topics(spark, sf_dir).where("label IS NOT NULL"))
    model = classify.fit(split.where("split = 'train'"))
    source, out, state = new_path(spark), new_path(spark), new_path(spark)
    split.where("split = 'test'").select("doc_id", "text").write.parquet(source)
    got = predict_stream(model, spark.readStream.schema("doc_id bigint, text string").parquet(source))
    got.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id bigint, prediction string").parquet(out)


@query("confusion_matrix", _SQL_PREDICT + " SELECT label AS actual, prediction AS predicted, count(*) AS n FROM pred GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_evaluation(spark, sf_dir).predictions)


_SQL_REPORT = (
    _SQL_PREDICT + ", names AS (SELECT label FROM pred UNION SELECT prediction FROM pred), k AS (SELECT names.label, count(*) FILTER (pred.label = names.label) AS support, count(*) FILTER (prediction = names.label) AS claimed, count(*) FILTER (pred.label = names.label AND prediction = names.label) AS tp FROM names, pred GROUP BY names.label), "
    "pr AS (SELECT label, support, CASE WHEN claimed > 0 THEN tp / claimed ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM k), "
    "rep AS (SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f, support FROM pr)"
)


@query("classification_report", _SQL_REPORT + " SELECT label, precision, recall, round(f, 6) AS f1, support FROM rep")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).by_label


@query("classification_summary", _SQL_REPORT + " SELECT round((SELECT avg((label = prediction)::INT) FROM pred), 6) AS accuracy, round(avg(f), 6) AS macro_f1, (SELECT count(*) FROM pred) AS n FROM rep")
def classification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).totals


# --- sources and sinks --------------------------------------------------------
def _sql_trim(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '^[{_WS}]+|[{_WS}]+$', '', 'g')"



@query("csv_round_trip", "SELECT " + ", ".join(f"replace({_sql_trim(c)}, chr(65533), '') AS {c}" for c in ("col1", "col2", "col3")) + ", -1 AS cluster_id FROM clust2_csv")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticket rows written as CSV with a cluster and loaded again; the cluster column is the fourth and not read."""
    rows = read(spark, sf_dir, "clust2_csv").select("row_id", "col1", "col2", "col3")
    path = new_path(spark)
    csvfiles.save_clustered(rows, rows.select("row_id", F.lit(-1).alias("cluster_id")), path)
    return csvfiles.load_csv(spark, path).select("col1", "col2", "col3", F.lit(-1).alias("cluster_id"))


@query("lines_round_trip", "SELECT count(*) AS n, count(label) AS n_labels, (count(*) * (count(*) - 1) // 2)::BIGINT AS numbers, sum(length(text))::BIGINT AS chars, min(text) AS least, max(text) AS most FROM (SELECT regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS text, regexp_replace(coalesce(label, '?'), '[\\r\\n]+', ' ', 'g') AS label FROM topics12 WHERE text IS NOT NULL AND doc_id IS NOT NULL)")
def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and labels written as files of lines and loaded again, joined by line number; in totals, as the numbers follow the files."""
    flat = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    t = _topics(spark, sf_dir).where("text IS NOT NULL").select(flat("text").alias("text"), flat(F.coalesce("label", F.lit("?"))).alias("label"))
    t = materialise(t.coalesce(1))
    paths = new_path(spark), new_path(spark)
    for path, column in zip(paths, ("text", "label")):
        t.select(column).coalesce(1).write.text(path)
    d = csvfiles.load_lines(spark, *paths)
    return d.agg(F.count("*").alias("n"), F.count("label").alias("n_labels"), F.sum("doc_id").alias("numbers"), F.sum(F.length("text")).alias("chars"), F.min("text").alias("least"), F.max("text").alias("most"))


def _template_sql() -> str:
    values = ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in row) + ")" for i, row in enumerate(corpora.TEMPLATES))
    return f"SELECT i AS row_id, c1 || ' [ID обращение ' || i || ']' AS col1, c2 AS col2, c3 AS col3 FROM (SELECT unnest(range(0, 100000)) AS i) r JOIN (VALUES {values}) v(k, c1, c2, c3) ON v.k = r.i % 5"


@query("template_tickets", _template_sql())
def template_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.template_tickets(spark)


def _labelled_sql(per_class: int = 500, seed: int = 42) -> str:
    pick = lambda *salt: "(('0x' || md5(" + " || ':' || ".join([f"'{seed}'", "id", *salt]) + ")[1:12])::BIGINT)"
    lists = "[" + ", ".join(_quoted(w.split()) for w in corpora.TOPICS.values()) + "]"
    at = lambda a, x: f"{a}[({x} % len({a})) + 1]"
    own, names, everyday = f"({lists})[topic + 1]", _quoted(corpora.TOPICS), _quoted(corpora.COMMON.split())
    return (
        f"WITH d AS (SELECT range AS id, range % {len(corpora.TOPICS)} AS topic FROM range({per_class * len(corpora.TOPICS)})), "
        f"w AS (SELECT *, list_transform(range(1, {pick(repr('n'))} % 8 + 6), lambda i: {at(own, pick(repr('w'), 'i'))}) AS chosen FROM d), "
        f"e AS (SELECT *, list_concat([CASE WHEN {pick(repr('s'))} % 100 < 45 THEN chosen[1] || {at(_quoted(corpora.SUFFIXES), pick(repr('e')))} ELSE chosen[1] END], list_concat(chosen[2:], list_transform(range(1, {pick(repr('m'))} % 4 + 2), lambda i: {at(everyday, pick(repr('c'), 'i'))}))) AS every FROM w), "
        f"o AS (SELECT id, topic, list_transform(list_sort(list_transform(every, lambda x, i: {{'k': {pick(repr('o'), '(i - 1)')}, 'x': x}})), lambda s: s.x) AS mixed FROM e) "
        f"SELECT id AS doc_id, array_to_string(mixed, ' ') || {_quoted(('', '.', '!', '?', '...'))}[({pick(repr('p'))} % 5) + 1] AS text, ({names})[topic + 1] AS label FROM o"
    )


def _quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("labelled_topics", _labelled_sql())
def labelled_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.labelled_topics(spark)


query("corpus_news", _values(corpora.NEWS))(lambda spark, sf_dir: corpora.news(spark))
query("corpus_tickets", _values(corpora.TICKETS))(lambda spark, sf_dir: corpora.tickets(spark))
query("joined_columns", f"WITH {_ROW_TEXT} SELECT doc_id AS row_id, text FROM t")(lambda spark, sf_dir: read(spark, sf_dir, "clust2_csv").select("row_id", csvfiles.joined_text("col1", "col2", "col3").alias("text")))
