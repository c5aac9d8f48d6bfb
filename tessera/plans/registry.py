"""The registered queries of the retrieval engine with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, evaluation, graph, ingest, retrieval, routing
from tessera.sources.tables import held, passages, questions, scan, seeded_sample, table_counts

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Pieces of SQL that several oracles share.
TOK = r"regexp_extract_all({0}, '\S+')"
SEARCH = r"list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9\-]+'), lambda w: lower(w))"
SENT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
DOC = "coalesce(text, '')"
BIG = r"list_transform(list_zip(SEARCH({0})[:-2], SEARCH({0})[2:]), lambda p: p[1] || ' ' || p[2])"
#: Sentinels of missing text, as in the functions.
MISSING = "('', 'nan', 'none', 'null', 'n/a', 'na')"


def _pieces(sql: str) -> str:
    for name, value in (("BIG", BIG), ("TOK", TOK), ("SEARCH", SEARCH), ("SENT", SENT)):
        while f"{name}(" in sql:
            at = sql.index(f"{name}(")
            depth, end = 0, at + len(name)
            while True:
                depth += (sql[end] == "(") - (sql[end] == ")")
                end += 1
                if not depth:
                    break
            sql = sql[:at] + value.replace("{0}", sql[at + len(name) + 1 : end - 1]) + sql[end:]
    return sql


# --- ingestion ---------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, (text IS NULL OR lower(trim(text)) IN {MISSING}) AS is_empty FROM documents")
def sentinel_empty(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, sf, "documents").select("doc_id", T.is_empty_text(F.col("text")).alias("is_empty"))


@query(f"SELECT 'DOC-' || doc_id AS canonical_id, sha256({DOC}) AS raw_sha256, sha256(trim(regexp_replace({DOC}, '\\s+', ' ', 'g'))) AS normalized_sha256, NOT (text IS NULL OR lower(trim(text)) IN {MISSING}) AS is_usable FROM documents")
def canonical_passages(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.canonical(scan(spark, sf, "documents"))


@query(f"SELECT doc_id, min(doc_id) OVER w AS group_first_id, count(*) OVER w > 1 AS is_duplicate FROM documents WINDOW w AS (PARTITION BY {DOC})")
def exact_dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.exact_duplicate_groups(scan(spark, sf, "documents"))


@query(f"SELECT sha256({DOC}) AS sha, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.duplicate_summary(scan(spark, sf, "documents"))


@query(_pieces(rf"""SELECT doc_id, length(t) AS n_characters, len(TOK(t)) AS n_words, len(SENT(t)) AS n_sentences, len(string_split(t, chr(10))) AS n_lines,
 CASE WHEN length(t) > 0 THEN len(regexp_extract_all(t, '[0-9]')) / length(t) ELSE 0.0 END AS digit_share,
 CASE WHEN length(t) > 0 THEN len(regexp_extract_all(t, '[A-Z]')) / length(t) ELSE 0.0 END AS upper_share,
 len(regexp_extract_all(t, 'https?://')) AS n_urls, len(regexp_extract_all(t, '\(')) AS n_parens FROM (SELECT doc_id, {DOC} AS t FROM documents)"""))
def structural_features(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.structural_features(scan(spark, sf, "documents"))


@query(_pieces(rf"""SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]{{2,}}[.,;:]?$'))) / greatest(len(w), 1) AS acronym_density,
 len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z]+-[A-Za-z]+'))) / greatest(len(w), 1) AS hyphen_density,
 len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) / greatest(len(w), 1) AS digit_density, len(w) / greatest(s, 1) AS words_per_sentence
 FROM (SELECT doc_id, TOK({DOC}) AS w, len(SENT({DOC})) AS s FROM documents)"""))
def doc_profile(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.document_profile(scan(spark, sf, "documents"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_unique FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")))
def schema_report(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.schema_report(scan(spark, sf, "documents"))


@query(f"SELECT *, n_rows = 0 OR n_ids < n_rows AS hard_error, n_texts < n_rows AS warn_duplicates FROM (SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, count(*) FILTER (WHERE text IS NULL OR lower(trim(text)) IN {MISSING}) AS n_empty, count(DISTINCT {DOC}) AS n_texts FROM documents)")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.quality_gate(scan(spark, sf, "documents"))


@query(_pieces(f"SELECT lang, count(*) AS n, avg(k) AS mean_words, quantile_cont(k, 0.5) AS median_words, quantile_cont(k, 0.95) AS p95_words FROM (SELECT lang, len(TOK({DOC})) AS k FROM documents) GROUP BY lang"))
def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.length_statistics(scan(spark, sf, "documents"), "lang")


GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id AS unit_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.gold_by_containment(scan(spark, sf, "documents"), scan(spark, sf, "benchmark"))


@query(f"WITH {GOLD} SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY unit_id) AS gold_rank FROM gold")
def gold_explode(spark: SparkSession, sf: str) -> DataFrame:
    return _gold(spark, sf)


@query(f"WITH {GOLD}, c AS (SELECT unit_id, count(*) AS n FROM gold GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, unit_id) AS p, sum(n) OVER () AS links, count(*) OVER () AS units FROM c) SELECT sum(n)::BIGINT AS top_links, max(links)::BIGINT AS links, max(units) AS units FROM r WHERE p <= ceil(units * 0.1)")
def gold_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.frequency_concentration(_gold(spark, sf))


@query(f"WITH {GOLD} SELECT b.item_id AS query_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.query_id = b.item_id)")
def gold_missing(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("query_id").join(_gold(spark, sf), "query_id", "left_anti")


@query(f"SELECT 'benchmark' AS table_name, count(*) AS n_rows FROM benchmark UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table_counts({n: scan(spark, sf, n) for n in ("documents", "benchmark", "embeddings")})


@query("SELECT item_id FROM benchmark ORDER BY md5('7|' || item_id), item_id LIMIT 20")
def sample_questions(spark: SparkSession, sf: str) -> DataFrame:
    return seeded_sample(scan(spark, sf, "benchmark", "item_id"), "item_id", 20, 7)


@query("SELECT l.quality, l.toxic, d.doc_id, row_number() OVER w AS place FROM documents d JOIN labels l USING (doc_id) WINDOW w AS (PARTITION BY l.quality, l.toxic ORDER BY md5('7|' || d.doc_id), d.doc_id) QUALIFY place <= 20")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    joined = scan(spark, sf, "documents", "doc_id").join(scan(spark, sf, "labels"), "doc_id")
    return evaluation.stratified_sample(joined, ["quality", "toxic"], "doc_id", 20)


# --- chunking ----------------------------------------------------------------------------------------------------


def _windows_sql(size: int, overlap: int, strategy: str) -> str:
    return _pieces(rf"""WITH d AS (SELECT doc_id AS unit_id, TOK({DOC}) AS w FROM documents),
 s AS (SELECT unit_id, w, unnest(range(0, greatest(0, len(w) - {overlap} - 1) + 1, {size - overlap})) AS start_token FROM d WHERE len(w) > 0),
 c AS (SELECT unit_id, '{strategy}' AS strategy, (start_token // {size - overlap})::INT AS chunk_index, array_to_string(w[start_token + 1 : start_token + {size}], ' ') AS text, (least(start_token + {size}, len(w)) - start_token)::INT AS n_tokens, start_token::INT AS start_token, least(start_token + {size}, len(w))::INT AS end_token FROM s)
 """)


FIXED_SQL = _windows_sql(256, 32, "fixed")


@query(FIXED_SQL + "SELECT *, 'CHK-' || substr(sha256(concat_ws('|', unit_id, strategy, chunk_index, text)), 1, 20) AS chunk_id FROM c")
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.fixed_chunks(passages(spark, sf))


@query(_windows_sql(96, 16, "parent_child") + "SELECT *, 'CHK-' || substr(sha256(concat_ws('|', unit_id, strategy, chunk_index, text)), 1, 20) AS chunk_id FROM c")
def chunk_parent_child(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.parent_child_chunks(passages(spark, sf))


@query()
def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.packed_chunks(passages(spark, sf), "recursive")


@query()
def chunk_biomedical(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.packed_chunks(passages(spark, sf), "biomedical")


@query()
def chunk_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.packed_chunks(passages(spark, sf), "semantic")


@query(_pieces(rf"""WITH cp AS (SELECT doc_id AS unit_id, list_filter(list_transform(flatten(list_transform(SENT({DOC}), lambda s: regexp_split_to_array(s, '(?i)\s+(?:and|but|while|whereas|although|because|therefore|however)\s+'))), lambda x: regexp_replace(x, '^[ ,;:]+|[ ,;:]+$', '', 'g')), lambda x: x <> '') AS parts FROM documents),
 cw AS (SELECT unit_id, flatten(list_transform(parts, lambda x: list_transform(range(0, greatest(len(TOK(x)), 1), 96), lambda i: TOK(x)[i + 1 : i + 96]))) AS cuts FROM cp), cx AS (SELECT unit_id, unnest(cuts) AS w, generate_subscripts(cuts, 1) - 1 AS chunk_index FROM cw)
 SELECT unit_id, 'proposition' AS strategy, chunk_index, array_to_string(w, ' ') AS text, len(w) AS n_tokens FROM cx"""))
def chunk_proposition(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.proposition_chunks(passages(spark, sf))


def _density(pattern: str) -> str:
    return f"round(len(list_filter(w, lambda x: regexp_matches(x, '{pattern}'))) / greatest(len(w), 1), 9)"


@query(_pieces(rf"""WITH rd AS (SELECT doc_id AS unit_id, TOK({DOC}) AS w, list_transform(SENT({DOC}), lambda x: list_distinct(SEARCH(x))) AS s FROM documents),
 rs AS (SELECT unit_id, w, len(s) AS n_sentences, list_transform(range(1, len(s)), lambda i: 1 - CASE WHEN len(s[i] || s[i + 1]) > 0 THEN len(list_intersect(s[i], s[i + 1])) / len(list_distinct(s[i] || s[i + 1])) ELSE 0.0 END) AS shifts FROM rd),
 rp AS (SELECT unit_id, len(w) AS n_tokens, n_sentences, {_density('(?i)' + chunking.RELATION)} AS relation_density, {_density('(?i)' + chunking.NEGATION)} AS negation_density, {_density(chunking.ENTITY)} AS entity_density, round(CASE WHEN n_sentences > 1 THEN list_sum(shifts) / (n_sentences - 1) ELSE 0.0 END, 6) AS topic_shift FROM rs)
 SELECT *, CASE WHEN n_tokens <= 180 THEN 'recursive' WHEN relation_density >= 0.015 AND negation_density > 0 THEN 'biomedical' WHEN entity_density >= 0.012 THEN 'biomedical' WHEN topic_shift >= 0.65 THEN 'semantic' WHEN n_tokens >= 700 THEN 'parent_child' ELSE 'recursive' END AS route FROM rp"""))
def chunk_profile_route(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.routing_profile(passages(spark, sf))


@query()
def chunk_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.adaptive_chunks(passages(spark, sf))


@query(FIXED_SQL + r"SELECT strategy, count(*) AS n_chunks, count(DISTINCT unit_id) AS n_parents, quantile_cont(n_tokens, 0.5) AS median_tokens, quantile_cont(n_tokens, 0.95) AS p95_tokens, 1 - count(DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) / count(*) AS duplicate_share FROM c GROUP BY strategy")
def chunk_economics(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.economics(chunking.fixed_chunks(passages(spark, sf)))


@query(FIXED_SQL + r"SELECT strategy, count(*) FILTER (WHERE regexp_matches(text, '^[a-z]')) AS mid_start, count(*) FILTER (WHERE NOT regexp_matches(text, '[.!?]$')) AS mid_end, count(*) FILTER (WHERE len(regexp_extract_all(text, '\(')) <> len(regexp_extract_all(text, '\)'))) AS unbalanced FROM c GROUP BY strategy")
def boundary_flags(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.boundary_flags(chunking.fixed_chunks(passages(spark, sf)))


@query(FIXED_SQL + _pieces(rf""", a AS (SELECT unit_id, t, count(*) AS n FROM (SELECT doc_id AS unit_id, unnest(TOK(lower({DOC}))) AS t FROM documents) GROUP BY 1, 2),
 b AS (SELECT unit_id, t, count(*) AS m FROM (SELECT unit_id, unnest(TOK(lower(text))) AS t FROM c) GROUP BY 1, 2)
 SELECT unit_id, sum(least(n, coalesce(m, 0))) / sum(n) AS coverage FROM a LEFT JOIN b USING (unit_id, t) GROUP BY unit_id"""))
def token_coverage(spark: SparkSession, sf: str) -> DataFrame:
    p = passages(spark, sf)
    return chunking.token_coverage(p, chunking.fixed_chunks(p))


# --- retrieval ---------------------------------------------------------------------------------------------------

BM25_SQL = _pieces(rf"""WITH d AS (SELECT doc_id AS unit_id, SEARCH({DOC}) AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
 p AS (SELECT unit_id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT unit_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY 1, 2),
 f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), i AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM f, s),
 idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i) ELSE raw END AS idf FROM i),
 q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(SEARCH({DOC})) AS term FROM benchmark) GROUP BY 1, 2),
 z AS (SELECT query_id, unit_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN q USING (term) JOIN idf USING (term), s GROUP BY 1, 2),
 bm AS (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank, score FROM z QUALIFY rank <= 40 AND score > 0)
 """)
CAND_SQL = BM25_SQL + f", cand AS (SELECT query_id, unit_id, rank, score, b.text AS question, coalesce(x.text, '') AS text FROM bm JOIN benchmark b ON b.item_id = query_id JOIN documents x ON x.doc_id = unit_id)"


def _bm25(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return retrieval.bm25_search(passages(spark, sf), questions(spark, sf), k)


#: Units a question that channels give and rerankers see; results are cut to ten at the end.
POOL = 40


#: Rows of a result that go to the scan of the texts; a larger one is joined with them by shuffle.
SENT_ROWS = 1_000_000


def _with_texts(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows found (query_id, unit_id, ...) with their texts, which are not shuffled for few rows; held."""
    found = held(found)
    return held(texts.join(F.broadcast(found) if found.count() <= SENT_ROWS else found, "unit_id"))


def _candidates(spark: SparkSession, sf: str, k: int = POOL, found: DataFrame | None = None) -> DataFrame:
    """(query_id, unit_id, rank, score, question, text) of the k best."""
    found = _bm25(spark, sf, k) if found is None else found
    return _with_texts(found, passages(spark, sf)).join(questions(spark, sf), "query_id")


@query(BM25_SQL + "SELECT * FROM bm WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf)


@query(BM25_SQL + "SELECT term, df, round(idf, 9) AS idf FROM idf")
def bm25_idf(spark: SparkSession, sf: str) -> DataFrame:
    p = passages(spark, sf)
    out = retrieval.bm25_idf(retrieval.postings(p), p.agg(F.count(F.lit(1)).alias("n")))
    return out.select("term", "df", F.round("idf", 9).alias("idf"))


def _dense_sql(score: str) -> str:
    return f"WITH z AS (SELECT a.vec_id AS query_id, b.vec_id AS unit_id, round({score}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank, score FROM z QUALIFY rank <= 10"


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = scan(spark, sf, "embeddings").select(F.col("vec_id").alias("unit_id"), "embedding")
    return v, v.where("unit_id % 20 = 0").withColumnRenamed("unit_id", "query_id")


@query(_dense_sql("list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"))
def dense_ip_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.dense_search(*_vectors(spark, sf))


@query(_dense_sql("list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"))
def dense_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.dense_search(*_vectors(spark, sf), cosine=True)


def _ivf(spark: SparkSession, sf: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf)
    return retrieval.IvfIndex(vectors).search(asked)


@query()
def ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.recall_at_k(_ivf(spark, sf), retrieval.dense_search(*_vectors(spark, sf)))


@query()
def ivf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ivf(spark, sf)


OVERLAP = r"len(list_intersect(list_distinct(SEARCH(question)), list_distinct(SEARCH(text)))) / (len(list_distinct(SEARCH(question))) + 1e-9)"
JACC = r"len(list_intersect(list_distinct(SEARCH(question)), list_distinct(SEARCH(text)))) / len(list_distinct(SEARCH(question) || SEARCH(text)))"


def _rerank_sql(score: str) -> str:
    return CAND_SQL + _pieces(f", y AS (SELECT query_id, unit_id, round({score}, 6) AS score FROM cand) SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank, score FROM y QUALIFY rank <= 10")


@query(_rerank_sql(OVERLAP))
def lexical_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rerank(_candidates(spark, sf), "lexical_overlap")


@query(_rerank_sql(JACC))
def jaccard_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rerank(_candidates(spark, sf), "jaccard")


PROXY = r"""0.55 * (len(list_intersect(list_distinct(SEARCH(question)), list_distinct(SEARCH(text)))) / greatest(len(list_distinct(SEARCH(question))), 1))
 + 0.35 * (len(list_intersect(list_distinct(BIG(question)), list_distinct(BIG(text)))) / greatest(len(list_distinct(BIG(question))), 1)) + 0.10 * contains(lower(text), lower(trim(question)))::INT"""


@query(_rerank_sql(PROXY))
def proxy_ce_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rerank(_candidates(spark, sf, POOL), "cross_encoder_proxy")


@query()
def maxsim_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.maxsim_rerank(_candidates(spark, sf, 10))


@query()
def mmr_select(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.mmr(_candidates(spark, sf, 10))


@query(CAND_SQL + _pieces(", r AS (SELECT query_id, unit_id, rank, len(TOK(text)) AS n_tokens FROM cand WHERE rank <= 10) SELECT query_id, unit_id, rank, n_tokens, (sum(n_tokens) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS used FROM r QUALIFY used <= 1200"))
def context_pack(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.pack_context(_candidates(spark, sf, 10))


@query(CAND_SQL + _pieces(r""", e AS (SELECT query_id, unit_id, rank, list_distinct(SEARCH(question)) AS q, SENT(text) AS ss FROM cand WHERE rank <= 3),
 x AS (SELECT query_id, unit_id, rank, q, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS pos FROM e),
 y AS (SELECT *, len(list_intersect(q, list_distinct(SEARCH(sentence)))) AS shared FROM x),
 b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY query_id, unit_id ORDER BY shared DESC, pos) = 1)
 SELECT query_id, string_agg(sentence, ' ' ORDER BY rank) AS answer, sum(shared)::BIGINT AS shared_words FROM b WHERE rank <= 2 GROUP BY 1"""))
def extractive_answer(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.extractive_answer(_candidates(spark, sf, 10))


METRIC_SQL = f""", gold AS (SELECT b.item_id AS query_id, d.doc_id AS unit_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
 g AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
 h AS (SELECT query_id, count(*) AS n_hit, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM bm JOIN gold USING (query_id, unit_id) WHERE rank <= 10 GROUP BY 1),
 m AS (SELECT query_id, n_gold, CASE WHEN coalesce(n_hit, 0) > 0 THEN 1.0 ELSE 0.0 END AS hit, round(coalesce(n_hit / n_gold, 0), 9) AS recall, round(coalesce(1 / first, 0), 9) AS mrr,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda r: 1 / log2(r + 1))), 9) AS ndcg FROM g LEFT JOIN h USING (query_id))"""


@query(BM25_SQL + METRIC_SQL + " SELECT query_id, n_gold, hit::DOUBLE AS hit, recall, mrr, ndcg FROM m")
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.ranking_metrics(_bm25(spark, sf), _gold(spark, sf).select("query_id", "unit_id"))


def _resampled(values: str, v: str) -> str:
    """Means of 1000 resamples of a table (query_id, v): rows by a hash of the numbers of resample and draw."""
    return f""", rv AS (SELECT row_number() OVER (ORDER BY query_id) - 1 AS place, {v} AS v FROM {values}), rn AS (SELECT count(*) AS n FROM rv),
 rd AS (SELECT b, ('0x' || substr(md5('0|' || b || '|' || i), 1, 8))::BIGINT % n AS place FROM rn, range(1000) x(b), LATERAL (SELECT unnest(range(0, n)) AS i)),
 rm AS (SELECT b, avg(v) AS m FROM rd JOIN rv USING (place) GROUP BY 1), ci AS (SELECT round(quantile_cont(m, 0.025), 4) AS ci_low, round(quantile_cont(m, 0.975), 4) AS ci_high FROM rm)"""


@query(BM25_SQL + METRIC_SQL + _resampled("m", "ndcg") + " SELECT round(avg(ndcg), 4) AS value, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high FROM m, ci")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.bootstrap(retrieval_metrics(spark, sf), "ndcg")


def _runs(spark: SparkSession, sf: str, found: DataFrame | None = None, again: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The metrics of BM25 and of its reranking; found and again: their results, if made before."""
    gold = held(_gold(spark, sf).select("query_id", "unit_id"))
    found = _bm25(spark, sf, POOL) if found is None else found
    again = retrieval.rerank(_candidates(spark, sf, POOL, found), "jaccard") if again is None else again
    return retrieval.ranking_metrics(found, gold), retrieval.ranking_metrics(again, gold)


def _metric_sql(run: str, name: str) -> str:
    """The metrics of a run as the table of that name; the gold tables come before."""
    at = METRIC_SQL.index(" h AS (")
    return METRIC_SQL[at:].replace(" h AS", f" h_{name} AS").replace(" m AS", f" {name} AS").replace("JOIN h ", f"JOIN h_{name} ").replace("FROM bm JOIN", f"FROM {run} JOIN")


PAIR_SQL = CAND_SQL + _pieces(f", jy AS (SELECT query_id, unit_id, round({JACC}, 6) AS score FROM cand), jac AS (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM jy)") + METRIC_SQL[: METRIC_SQL.index(" h AS (")] + _metric_sql("bm", "ma") + "," + _metric_sql("jac", "mb")
DELTA_SQL = PAIR_SQL + ", dd AS (SELECT query_id, ma.ndcg AS x, mb.ndcg AS y, mb.ndcg - ma.ndcg AS d FROM ma JOIN mb USING (query_id))"
WINS = "count(*) FILTER (WHERE d > 1e-9) AS wins, count(*) FILTER (WHERE d < -1e-9) AS losses, count(*) FILTER (WHERE abs(d) <= 1e-9) AS ties"


@query(DELTA_SQL + f" SELECT {WINS}, count(*) AS n, avg(d) AS mean_difference FROM dd")
def run_compare(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.paired_compare(*_runs(spark, sf), "ndcg")


@query(DELTA_SQL + _resampled("dd", "d") + f" SELECT round(avg(x), 4) AS a, round(avg(y), 4) AS b, {WINS}, round(avg(d), 4) AS delta, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high, any_value(ci_low > 0 OR ci_high < 0) AS significant FROM dd, ci")
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.paired_bootstrap(*_runs(spark, sf), "ndcg")


@query(DELTA_SQL + ", e AS (SELECT query_id, round(d, 6) AS delta, CASE WHEN d > 0 THEN 'gain' ELSE 'loss' END AS side FROM dd WHERE abs(round(d, 6)) > 1e-9) SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(delta) DESC, query_id) AS place FROM e QUALIFY place <= 5")
def gains_and_losses(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.gains_and_losses(*_runs(spark, sf), "ndcg")


@query(BM25_SQL + METRIC_SQL + " SELECT query_id, n_gold, row_number() OVER (ORDER BY n_gold DESC, query_id) AS place FROM m WHERE hit = 0 QUALIFY place <= 25")
def missed_questions(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    m = retrieval_metrics(spark, sf).where("hit = 0").select("query_id", "n_gold").orderBy(F.desc("n_gold"), "query_id").limit(25)
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_gold"), "query_id")))


# --- graph, topics, abbreviations ----------------------------------------------------------------------------------

def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NO_ENTITY = "[" + ", ".join(map(_q, graph.NO_ENTITY)) + "]"


def _found(text: str) -> str:
    """The surfaces of a text as the graph finds them."""
    return rf"""list_filter(list_transform(list_concat(list_filter(regexp_extract_all({text}, {_q(graph.TOKEN)}), lambda w: regexp_matches(w, {_q(graph.ENTITY)})), regexp_extract_all({ASCII_LOWER.format(text)}, {_q(graph.PHRASE)})),
 lambda w: {{'key': regexp_replace(lower(w), '[\s\-]+', '', 'g'), 'surface': w}}), lambda e: length(e.key) > 2 AND NOT list_contains({NO_ENTITY}, e.key) AND regexp_matches(e.key, '[^0-9]'))"""


PREDICATE = "CASE " + " ".join(f"WHEN regexp_matches({ASCII_LOWER.format('sentence')}, {_q(graph.relation_pattern(w))}) THEN '{n}'" for w, n in graph.PREDICATES) + " ELSE 'CO_OCCURS' END"
ENT_SQL = _pieces(rf"""WITH RECURSIVE s AS (SELECT row_number() OVER () AS r, * FROM (SELECT doc_id AS unit_id, unnest(SENT({DOC})) AS sentence FROM documents)),
 f AS (SELECT r, unit_id, sentence, {_found('sentence')} AS found FROM s),
 k AS (SELECT r, unit_id, sentence, found, list_sort(list_distinct(list_transform(found, lambda e: e.key))) AS keys FROM f WHERE len(found) > 0),
 m AS (SELECT entity, unit_id, count(*) AS n FROM (SELECT unit_id, unnest(keys) AS entity FROM k) GROUP BY 1, 2),
 u AS (SELECT entity, count(*) AS df, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM m GROUP BY 1 HAVING count(*) <= 0.03 * (SELECT count(*) FROM documents)),
 sf AS (SELECT entity, surface, n FROM (SELECT e.key AS entity, e.surface AS surface, count(*) AS n FROM (SELECT unnest(found) AS e FROM k) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, surface) = 1),
 kp AS (SELECT r, unit_id, {PREDICATE} AS predicate, unnest(keys[1:12]) AS e FROM k),
 te AS (SELECT a.e AS src, b.e AS dst, a.predicate, a.unit_id, count(*) AS n FROM kp a JOIN kp b ON a.r = b.r AND a.e < b.e WHERE a.e IN (SELECT entity FROM u) AND b.e IN (SELECT entity FROM u) GROUP BY ALL)
 """)
SEED_SQL = ENT_SQL + rf""", qw AS (SELECT item_id AS query_id, {DOC} AS question, regexp_extract_all({DOC}, {_q(graph.WORD_PAIR)}) AS w FROM benchmark),
 qg AS (SELECT DISTINCT query_id, regexp_replace(lower(g), '[\s\-]+', '', 'g') AS entity FROM (SELECT query_id, unnest(list_concat(w, list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || p[2]))) AS g FROM qw)),
 qr AS (SELECT DISTINCT query_id, e.key AS entity FROM (SELECT query_id, unnest({_found('question')}) AS e FROM qw)),
 seed AS (SELECT query_id, entity, idf FROM (SELECT * FROM qr UNION SELECT query_id, entity FROM qg JOIN sf USING (entity) WHERE length(entity) > 2 AND NOT list_contains({NO_ENTITY}, entity) AND (regexp_matches(entity, '[0-9]') OR surface <> upper(surface))) JOIN u USING (entity))
 """
WEIGHT = "CASE WHEN predicate <> 'CO_OCCURS' THEN 1.5 ELSE 1.0 END"
GRAPH_SQL = SEED_SQL + f""", pairs AS (SELECT a.query_id, unit_id, 0.5 * (a.idf + b.idf) / 2 * {WEIGHT} AS w FROM te JOIN seed a ON a.entity = src JOIN seed b ON b.entity = dst AND b.query_id = a.query_id),
 ends AS (SELECT query_id, src AS seed, dst AS entity, {WEIGHT} AS w FROM te JOIN seed ON entity = src UNION ALL SELECT query_id, dst, src, {WEIGHT} FROM te JOIN seed ON entity = dst),
 nb AS (SELECT query_id, entity, idf, round(sum(w) * any_value(idf) * CASE WHEN count(DISTINCT seed) > 1 THEN 2.0 ELSE 1.0 END, 6) AS strength FROM ends o JOIN u USING (entity) WHERE NOT EXISTS (SELECT 1 FROM seed x WHERE x.query_id = o.query_id AND x.entity = o.entity) GROUP BY query_id, entity, idf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, entity) <= 8),
 gz AS (SELECT query_id, unit_id, idf AS w FROM m JOIN seed USING (entity) UNION ALL SELECT * FROM pairs UNION ALL SELECT query_id, unit_id, 0.5 * idf FROM m JOIN nb USING (entity)),
 gs AS (SELECT query_id, unit_id, round(sum(w), 6) AS score, count(*) AS n_reasons FROM gz GROUP BY 1, 2),
 gr AS (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank, score, n_reasons FROM gs QUALIFY rank <= 40)
 """


@query(ENT_SQL + "SELECT * FROM m")
def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return graph.mentions(passages(spark, sf))


@query(ENT_SQL + "SELECT entity, surface, n FROM sf")
def entity_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    return graph.entity_surfaces(passages(spark, sf))


@query(ENT_SQL + "SELECT entity, df, round(idf, 9) AS idf FROM u")
def entity_idf(spark: SparkSession, sf: str) -> DataFrame:
    p = passages(spark, sf)
    return graph.usable_entities(p, graph.mentions(p)).select("entity", "df", F.round("idf", 9).alias("idf"))


@query(ENT_SQL + "SELECT src, dst, sum(n)::BIGINT AS n, count(DISTINCT unit_id) AS n_units, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates FROM te GROUP BY 1, 2")
def entity_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges(passages(spark, sf))


@query(SEED_SQL + "SELECT query_id, entity, round(idf, 9) AS idf FROM seed")
def question_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return _seeds(spark, sf).select("query_id", "entity", F.round("idf", 9).alias("idf"))


def _seeds(spark: SparkSession, sf: str, facts: DataFrame | None = None) -> DataFrame:
    p = passages(spark, sf)
    facts = graph.entity_facts(p) if facts is None else facts
    return graph.question_seeds(questions(spark, sf), graph.usable_entities(p, graph.mentions(facts)), graph.entity_surfaces(facts))


@query(GRAPH_SQL + "SELECT * FROM gr WHERE rank <= 10")
def graph_traverse(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_scores(passages(spark, sf), questions(spark, sf))


KHOP_SQL = SEED_SQL + """, both_ways AS (SELECT DISTINCT src, dst FROM te UNION SELECT DISTINCT dst, src FROM te), s0 AS (SELECT DISTINCT entity FROM seed),
 h1 AS (SELECT DISTINCT dst AS entity FROM both_ways JOIN s0 ON src = entity WHERE dst NOT IN (SELECT entity FROM s0)),
 h2 AS (SELECT DISTINCT dst AS entity FROM both_ways JOIN h1 ON src = entity WHERE dst NOT IN (SELECT entity FROM s0) AND dst NOT IN (SELECT entity FROM h1))
 SELECT entity, 0 AS hop FROM s0 UNION ALL SELECT entity, 1 FROM h1 UNION ALL SELECT entity, 2 FROM h2"""


@query(KHOP_SQL)
def graph_khop(spark: SparkSession, sf: str) -> DataFrame:
    p = passages(spark, sf)
    facts = graph.entity_facts(p)
    return graph.neighbours(graph.edges(p, facts), _seeds(spark, sf, facts).select("entity").distinct())


# BM25 and the graph search all passages each on its own; their ranks are fused and the pool is reranked.
HYBRID_SQL = GRAPH_SQL.replace(" m AS (", " em AS (").replace("FROM m ", "FROM em ").replace(" f AS (", " ef AS (").replace("FROM f ", "FROM ef ").replace(" s AS (", " es AS (").replace("FROM s)", "FROM es)").replace(" u AS (", " eu AS (").replace("FROM u)", "FROM eu)").replace("JOIN u ", "JOIN eu ") + ", " + BM25_SQL.removeprefix("WITH ") + """, ch AS (SELECT query_id, unit_id, rank, 'bm25' AS channel FROM bm UNION ALL SELECT query_id, unit_id, rank, 'graph' FROM gr),
 fu AS (SELECT query_id, unit_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, count(*) AS n_channels FROM ch GROUP BY 1, 2),
 rr AS (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank, score, n_channels FROM fu)
 """


def _channels(spark: SparkSession, sf: str, found: DataFrame | None = None) -> DataFrame:
    found = _bm25(spark, sf, POOL) if found is None else found
    lexical = found.select("query_id", "unit_id", F.lit("bm25").alias("channel"), "rank")
    linked = graph.graph_scores(passages(spark, sf), questions(spark, sf), POOL).select("query_id", "unit_id", F.lit("graph").alias("channel"), "rank")
    return lexical.unionByName(linked)


@query(HYBRID_SQL + "SELECT query_id, unit_id, rank, score, n_channels FROM rr WHERE rank <= 10")
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rrf(_channels(spark, sf))


@query(HYBRID_SQL + _pieces(f", hc AS (SELECT query_id, unit_id, round({JACC}, 6) AS score FROM (SELECT query_id, unit_id, b.text AS question, coalesce(x.text, '') AS text FROM rr JOIN benchmark b ON b.item_id = query_id JOIN documents x ON x.doc_id = unit_id WHERE rank <= 40)) SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank, score FROM hc QUALIFY rank <= 10"))
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    pool = retrieval.rrf(_channels(spark, sf), top=POOL).select("query_id", "unit_id")
    return retrieval.rerank(_with_texts(pool, passages(spark, sf)).join(questions(spark, sf), "query_id"), "jaccard")


@query(HYBRID_SQL + " SELECT query_id, count(*) FILTER (WHERE k = 2) AS shared, count(*) AS seen FROM (SELECT query_id, unit_id, count(*) AS k FROM ch WHERE rank <= 10 GROUP BY 1, 2) GROUP BY 1")
def retriever_agreement(spark: SparkSession, sf: str) -> DataFrame:
    both = _channels(spark, sf).where("rank <= 10").groupBy("query_id", "unit_id").agg(F.count(F.lit(1)).alias("k"))
    return both.groupBy("query_id").agg(F.count_if(F.col("k") == 2).alias("shared"), F.count(F.lit(1)).alias("seen"))


ROUTE_SQL = SEED_SQL + f""", rt AS (SELECT query_id, question, {ASCII_LOWER.format('question')} AS low FROM qw), rq AS (SELECT query_id, CASE WHEN regexp_matches(low, {_q(routing.LIST)}) THEN 'list' WHEN regexp_matches(low, {_q(routing.SUMMARY)}) THEN 'summary' WHEN regexp_matches(low, {_q(routing.YES_NO)}) THEN 'yes/no' ELSE 'factoid' END AS type,
 (SELECT count(*) FROM seed WHERE seed.query_id = rt.query_id) AS n_entities, regexp_matches(low, {_q(routing.RELATION)}) AS relation_word FROM rt),
 rp AS (SELECT *, 0::BIGINT AS n_added, n_entities >= 2 OR (n_entities = 1 AND relation_word) AS use_graph, false AS use_synonyms, type IN ('list', 'summary') AND n_entities = 0 AS use_tree FROM rq)
 """


@query(ROUTE_SQL + "SELECT *, coalesce(nullif(concat_ws(',', CASE WHEN use_graph THEN 'R1' END, CASE WHEN use_tree THEN 'R3' END), ''), 'R0') AS rules FROM rp")
def route_plan(spark: SparkSession, sf: str) -> DataFrame:
    return routing.route_plan(questions(spark, sf), _seeds(spark, sf))


KEY_TERMS = f"list_filter(SEARCH(question), lambda w: length(w) > 2 AND NOT list_contains([{', '.join(map(_q, routing.STOP))}], w))"


def _coverage_sql(run: str, name: str) -> str:
    return _pieces(f""", {name}_t AS (SELECT item_id AS query_id, list_distinct({KEY_TERMS}) AS terms FROM (SELECT item_id, {DOC} AS question FROM benchmark)),
 {name}_h AS (SELECT query_id, term, coalesce(bool_or(contains(lower({DOC}), substr(term, 1, 6))), false) AS held FROM (SELECT query_id, unnest(terms) AS term FROM {name}_t) LEFT JOIN {run} USING (query_id) LEFT JOIN documents ON doc_id = unit_id GROUP BY 1, 2),
 {name} AS (SELECT query_id, len(terms)::BIGINT AS n_terms, CASE WHEN len(terms) = 0 THEN 1.0 ELSE round(count(term) FILTER (WHERE held) / len(terms), 3) END AS coverage, coalesce(string_agg(term, ' ' ORDER BY term) FILTER (WHERE NOT held), '') AS missing FROM {name}_t LEFT JOIN {name}_h USING (query_id) GROUP BY query_id, terms)""")


@query(BM25_SQL + ", b3 AS (SELECT query_id, unit_id FROM bm WHERE rank <= 3)" + _coverage_sql("b3", "cv") + " SELECT * FROM cv")
def term_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return routing.term_coverage(questions(spark, sf), _with_texts(_bm25(spark, sf, 3), passages(spark, sf)))


@query(HYBRID_SQL + ", b3 AS (SELECT query_id, unit_id FROM bm WHERE rank <= 3), w3 AS (SELECT query_id, unit_id FROM rr WHERE rank <= 3)" + _coverage_sql("b3", "cv") + _coverage_sql("w3", "cw") + " SELECT query_id, cv.coverage, CASE WHEN cv.coverage < 0.6 THEN cw.coverage END AS wide_coverage, CASE WHEN cv.coverage < 0.6 AND cw.coverage > cv.coverage THEN 2 ELSE 1 END AS round FROM cv JOIN cw USING (query_id)")
def two_rounds(spark: SparkSession, sf: str) -> DataFrame:
    lexical = _bm25(spark, sf, POOL)
    wide = held(retrieval.rrf(_channels(spark, sf, lexical), top=3).select("query_id", "unit_id"))
    first = lexical.where("rank <= 3").select("query_id", "unit_id")
    texts = _with_texts(first.unionByName(wide).select("unit_id").distinct(), passages(spark, sf))
    return routing.retry(questions(spark, sf), first, wide, texts)


@query()
def expanded_questions(spark: SparkSession, sf: str) -> DataFrame:
    return graph.expand_questions(questions(spark, sf), graph.abbreviation_dictionary(graph.abbreviations(passages(spark, sf))))


COV_SQL = _pieces(rf"""WITH d AS (SELECT doc_id AS unit_id, lang AS topic, unnest(list_distinct(SEARCH({DOC}))) AS term FROM documents), z AS (SELECT lang AS topic, count(*) AS size FROM documents GROUP BY 1),
 bt AS (SELECT topic, term, count(*) AS k FROM d GROUP BY 1, 2), f AS (SELECT term, sum(k) AS df FROM bt GROUP BY 1 HAVING sum(k) >= 2),
 c AS (SELECT topic, term, k / size AS coverage, ln((SELECT count(*) FROM documents) / df) AS idf FROM bt JOIN f USING (term) JOIN z USING (topic))
 """)


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("topic"), "text")


@query(COV_SQL + "SELECT topic, term, round(coverage, 9) AS coverage, round(idf, 9) AS idf FROM c")
def tree_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return graph.coverage(_topics(spark, sf)).select("topic", "term", F.round("coverage", 9).alias("coverage"), F.round("idf", 9).alias("idf"))


@query(COV_SQL + "SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS place, term, weight FROM (SELECT topic, term, round(coverage * idf, 6) AS weight FROM c WHERE coverage >= 0.1) QUALIFY place <= 4")
def tree_labels(spark: SparkSession, sf: str) -> DataFrame:
    return graph.topic_labels(_topics(spark, sf))


@query(COV_SQL + _pieces(f", q AS (SELECT item_id AS query_id, unnest(list_distinct(SEARCH({DOC}))) AS term FROM benchmark), s AS (SELECT query_id, topic, round(sum(idf * pow(coverage, 0.25)), 6) AS score FROM q JOIN c USING (term) GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, topic) AS rank FROM s"))
def tree_navigate(spark: SparkSession, sf: str) -> DataFrame:
    return graph.topic_scores(_topics(spark, sf), questions(spark, sf))


TREE = "SELECT doc_id, text, coalesce(lang, '-') || ' > ' || coalesce(source, '-') AS lang FROM documents"
NAV = ", {0}q AS (SELECT item_id AS query_id, unnest(list_distinct(SEARCH({1}))) AS term FROM benchmark), {0}s AS (SELECT query_id, topic, round(sum(idf * pow(coverage, 0.25)), 6) AS score FROM {0}q JOIN {2} USING (term) GROUP BY 1, 2), {0}r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, topic) AS rank FROM {0}s)"
LEAF_SQL = COV_SQL.removeprefix("WITH d AS").replace("FROM documents", f"FROM ({TREE})").replace(" z AS", " lz AS").replace("JOIN z ", "JOIN lz ").replace(" bt AS", " lbt AS").replace("FROM bt ", "FROM lbt ").replace(" f AS", " lf AS").replace("JOIN f ", "JOIN lf ").replace(" c AS", " lc AS").replace("FROM d ", "FROM ld ")


@query(COV_SQL + _pieces(NAV.format("t", DOC, "c")) + ", ld AS" + LEAF_SQL + _pieces(NAV.format("l", DOC, "lc")) + f", n AS (SELECT lang AS path, split_part(lang, ' > ', 1) AS top, count(*) AS n_units FROM ({TREE}) GROUP BY 1), w AS (SELECT l.query_id, path, l.score, n_units FROM ls l JOIN n ON path = l.topic JOIN tr ON tr.query_id = l.query_id AND coalesce(tr.topic, '-') = top AND tr.rank <= 5) SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank, score, n_units FROM w QUALIFY rank <= 6")
def tree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    tree = scan(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("topic"), F.col("source").alias("leaf"), "text")
    return graph.navigate(tree, questions(spark, sf))


@query()
def abbrev_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return graph.abbreviation_dictionary(graph.abbreviations(passages(spark, sf)))


# --- answers, slices, service levels -------------------------------------------------------------------------------

WORDS = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"


@query(f"""WITH p AS (SELECT conv_id * 1000 + turn AS pair_id, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference, turn FROM conversations),
 w AS (SELECT pair_id, {WORDS.format('answer')} AS a, {WORDS.format('reference')} AS r FROM p WHERE reference IS NOT NULL),
 x AS (SELECT pair_id, w, count(*) AS x FROM (SELECT pair_id, unnest(a) AS w FROM w) GROUP BY 1, 2), y AS (SELECT pair_id, w, count(*) AS y FROM (SELECT pair_id, unnest(r) AS w FROM w) GROUP BY 1, 2),
 s AS (SELECT pair_id, sum(least(x, y)) AS same FROM x JOIN y USING (pair_id, w) GROUP BY 1)
 SELECT pair_id, CASE WHEN len(a) + len(r) > 0 THEN 2 * coalesce(same, 0) / (len(a) + len(r)) ELSE 0.0 END AS f1 FROM w LEFT JOIN s USING (pair_id)""")
def token_f1(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    c = scan(spark, sf, "conversations").withColumn("reference", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return evaluation.token_f1(c.where("reference is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("answer"), "reference"))


@query("SELECT dimension, value, count(*) AS n, avg(n_chars) AS mean FROM (SELECT n_chars, unnest([{'dimension': 'lang', 'value': lang}, {'dimension': 'source', 'value': source}], recursive := true) FROM documents) GROUP BY 1, 2")
def run_slices(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.slices(scan(spark, sf, "documents", "lang", "source", "n_chars"), ("lang", "source"), "n_chars")


LATENCY = "SELECT event_type, count(*) AS n, avg(value) AS mean_value, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1"


@query(LATENCY)
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.latency_summary(scan(spark, sf, "events"))


@query(f"SELECT event_type, p95, p99, p95 <= 100 AS p95_ok, p99 <= 200 AS p99_ok FROM ({LATENCY})")
def slo_eval(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.slo(scan(spark, sf, "events"), 100.0, 200.0)


EARLY = "ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"


@query(f"WITH d AS (SELECT {EARLY} AS early, unnest([{{'metric': 'value', 'v': value, 'lim': 0.5}}, {{'metric': 'is_error', 'v': (event_type = 'error')::INT::DOUBLE, 'lim': 0.05}}], recursive := true) FROM events), a AS (SELECT metric, lim, round(avg(v) FILTER (WHERE early), 6) AS reference, round(avg(v) FILTER (WHERE NOT early), 6) AS current FROM d GROUP BY 1, 2) SELECT metric, reference, current, round(current - reference, 6) AS delta, abs(round(current - reference, 6)) >= lim AS drifted FROM a")
def drift_check(spark: SparkSession, sf: str) -> DataFrame:
    e = scan(spark, sf, "events").withColumn("is_error", (F.col("event_type") == "error").cast("int"))
    middle = e.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("middle"))
    return evaluation.drift(e.crossJoin(F.broadcast(middle)), {"value": 0.5, "is_error": 0.05}, F.col("ts") < F.col("middle"))


@query("SELECT user_id, b AS bucket, CASE WHEN b < 1000 THEN 'B' ELSE 'A' END AS arm FROM (SELECT user_id, list_reduce(list_transform(range(8), lambda k: ('0x' || substr(sha256('42:' || user_id), k * 8 + 1, 8))::BIGINT), lambda a, w: (a % 10000 * 7296 + w) % 10000) AS b0, b0 % 10000 AS b FROM (SELECT DISTINCT user_id FROM events))")
def ab_assign(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.ab_assign(scan(spark, sf, "events"))


REQUESTS = "SELECT event_type, user_id, event_type <> 'error' AS ok, value > 40 AS timed_out, value AS latency, value * 0.001 AS cost FROM events"
SLO_SQL = f"WITH r AS ({REQUESTS}), s AS (SELECT event_type, count(*) AS n, round(avg(ok::INT), 6) AS availability, round(avg(timed_out::INT), 6) AS timeout_rate, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, round(quantile_cont(latency, 0.99), 6) AS p99, round(avg(cost), 6) AS cost FROM r GROUP BY 1)"


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, sf, "events").select("event_type", "user_id", (F.col("event_type") != "error").alias("ok"), (F.col("value") > 40).alias("timed_out"), F.col("value").alias("latency"), (F.col("value") * 0.001).alias("cost"))


@query(SLO_SQL + ", v AS (SELECT *, concat_ws(',', CASE WHEN availability < 0.995 THEN 'availability' END, CASE WHEN cost > 0.08 THEN 'cost' END, CASE WHEN p95 > 30 THEN 'p95' END, CASE WHEN timeout_rate > 0.01 THEN 'timeout_rate' END) AS violations FROM s) SELECT *, violations = '' AS compliant FROM v")
def slo_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.slo_report(_requests(spark, sf), {"availability": 0.995, "timeout_rate": 0.01, "p95": 30.0, "cost": 0.08}, "event_type")


@query(SLO_SQL + """, g AS (SELECT event_type, 1 - CASE WHEN max(p95) OVER () = min(p95) OVER () THEN 1.0 ELSE (p95 - min(p95) OVER ()) / (max(p95) OVER () - min(p95) OVER ()) END AS speed,
 (CASE WHEN max(availability) OVER () = min(availability) OVER () THEN 1.0 ELSE (availability - min(availability) OVER ()) / (max(availability) OVER () - min(availability) OVER ()) END + 1 - CASE WHEN max(cost) OVER () = min(cost) OVER () THEN 1.0 ELSE (cost - min(cost) OVER ()) / (max(cost) OVER () - min(cost) OVER ()) END) / 2 AS operations FROM s)
 SELECT event_type, round(speed, 6) AS speed, round(operations, 6) AS operations, round((round(speed, 6) * 0.3 + round(operations, 6) * 0.1) / 0.4, 6) AS composite FROM g""")
def system_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluation.slo_report(_requests(spark, sf), {}, "event_type")
    groups = {"speed": ("p95",), "operations": ("availability", "cost")}
    return evaluation.leaderboard(s, groups, {"speed": 0.3, "operations": 0.1}, ("p95", "cost")).select("event_type", "speed", "operations", "composite")


@query(SLO_SQL + " SELECT event_type, p95, availability FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.p95 <= a.p95 AND b.n >= a.n AND (b.p95 < a.p95 OR b.n > a.n))")
def pareto_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.pareto(evaluation.slo_report(_requests(spark, sf), {}, "event_type"), "n", "p95").select("event_type", "p95", "availability")


# --- claims and answers -------------------------------------------------------------------------------------------

CLAIM_SQL = CAND_SQL + _pieces(r""", e AS (SELECT query_id, unit_id, rank, text, list_distinct(SEARCH(question)) AS q, SENT(text) AS ss FROM cand WHERE rank <= 3),
 x AS (SELECT query_id, unit_id, rank, q, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS pos FROM e),
 cl AS (SELECT query_id, unit_id, rank AS claim_no, sentence AS claim FROM x QUALIFY row_number() OVER (PARTITION BY query_id, unit_id ORDER BY len(list_intersect(q, list_distinct(SEARCH(sentence)))) DESC, pos) = 1),
 ev AS (SELECT query_id, unit_id, text FROM e WHERE rank <= 2)""")
CONTENT = "list_distinct(list_filter(SEARCH({0}), lambda w: NOT list_contains([{1}], w)))"
CLAIM_WORDS, ANSWER_WORDS = ", ".join(map(_q, evaluation.CLAIM_STOP)), ", ".join(map(_q, evaluation.ANSWER_STOP))
SUPPORT_SQL = CLAIM_SQL + _pieces(f""", ct AS (SELECT query_id, claim_no, unit_id, {CONTENT.format('claim', CLAIM_WORDS)} AS c, {CONTENT.format('text', CLAIM_WORDS)} AS t, text IS NOT NULL AS valid FROM cl LEFT JOIN ev USING (query_id, unit_id)),
 sp AS (SELECT query_id, claim_no, 1::BIGINT AS n_citations, valid::INT::BIGINT AS n_valid, round(CASE WHEN valid AND len(c) > 0 THEN len(list_intersect(c, t)) / len(c) ELSE 0.0 END, 9) AS best FROM ct),
 lb AS (SELECT *, CASE WHEN best >= 0.5 THEN 'SUPPORTED' WHEN best >= 0.2 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS label FROM sp)""")


def _claims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = _candidates(spark, sf, 3)
    return evaluation.extractive_answer(c), evaluation.claims_of(c), c.where("rank <= 2").select("query_id", "unit_id", "text")


@query(SUPPORT_SQL + " SELECT * FROM lb")
def claim_support(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.claim_support(*_claims(spark, sf)[1:])


@query(SUPPORT_SQL + " SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM lb GROUP BY 1")
def support_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.label_histogram(evaluation.claim_support(*_claims(spark, sf)[1:]))


@query(SUPPORT_SQL + _pieces(f""", an AS (SELECT query_id, string_agg(claim, ' ' ORDER BY claim_no) AS answer FROM cl WHERE claim_no <= 2 GROUP BY 1), aw AS (SELECT query_id, unnest({CONTENT.format('answer', ANSWER_WORDS)}) AS w FROM an), ew AS (SELECT DISTINCT query_id, unnest({CONTENT.format('text', ANSWER_WORDS)}) AS w FROM ev),
 gg AS (SELECT aw.query_id, round(avg((ew.w IS NOT NULL)::INT), 4) AS grounding FROM aw LEFT JOIN ew ON ew.query_id = aw.query_id AND ew.w = aw.w GROUP BY 1),
 co AS (SELECT query_id, round(avg((unit_id IN (SELECT unit_id FROM cl WHERE cl.query_id = ev.query_id))::INT), 4) AS coverage FROM ev GROUP BY 1), fa AS (SELECT query_id, round(avg((label = 'SUPPORTED')::INT), 4) AS faithfulness FROM lb GROUP BY 1),
 am AS (SELECT query_id, coalesce(grounding, 0.0) AS grounding, coalesce(coverage, 0.0) AS coverage, coalesce(faithfulness, 0.0) AS faithfulness FROM an LEFT JOIN gg USING (query_id) LEFT JOIN co USING (query_id) LEFT JOIN fa USING (query_id))
 SELECT *, CASE WHEN grounding >= 0.6 AND coverage >= 0.4 THEN 'sufficient' WHEN grounding >= 0.3 THEN 'weak' ELSE 'insufficient' END AS status FROM am"""))
def answer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.answer_metrics(*_claims(spark, sf))


# --- shares, strata, chunk planning ----------------------------------------------------------------------------------


@query("SELECT lang AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY 1")
def value_shares(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.value_shares(scan(spark, sf, "documents", "lang"), "lang")


@query("SELECT doc_id, n_chars, ['low_overlap', 'medium_low', 'medium_high', 'high_overlap'][ntile(4) OVER (ORDER BY n_chars NULLS FIRST, doc_id)] AS stratum FROM documents")
def length_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.quartiles(scan(spark, sf, "documents", "doc_id", "n_chars"), "doc_id", "n_chars")


@query(_pieces(f"WITH n AS (SELECT len(TOK({DOC})) AS n FROM documents), g AS (SELECT unnest([{{'size': 128, 'overlap': 16}}, {{'size': 256, 'overlap': 32}}, {{'size': 384, 'overlap': 48}}, {{'size': 512, 'overlap': 64}}], recursive := true)), k AS (SELECT size, overlap, n, greatest(n - overlap - 1, 0) // (size - overlap) + 1 AS k FROM n, g WHERE n > 0) SELECT size, overlap, sum(k)::BIGINT AS n_chunks, sum(n + (k - 1) * overlap)::BIGINT AS n_tokens, (sum(k) * 6144)::BIGINT AS bytes FROM k GROUP BY 1, 2"))
def chunk_size_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.size_sweep(passages(spark, sf))


@query(_windows_sql(96, 16, "parent_child") + "SELECT count(*) AS n_parents, sum(k)::BIGINT AS n_children, min(k) AS least, round(avg(k), 6) AS mean, max(k) AS most, 0::BIGINT AS orphans FROM (SELECT unit_id, count(*) AS k FROM c GROUP BY 1)")
def parent_child_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = passages(spark, sf)
    return chunking.parent_summary(chunking.parent_child_chunks(p), p)


@query(FIXED_SQL + _pieces(f""", {GOLD}, a AS (SELECT query_id, unit_id, t, count(*) AS n FROM (SELECT g.query_id, g.unit_id, unnest(SEARCH(b.text)) AS t FROM gold g JOIN benchmark b ON b.item_id = g.query_id) GROUP BY ALL), b AS (SELECT unit_id, chunk_index, t, count(*) AS m FROM (SELECT unit_id, chunk_index, unnest(SEARCH(text)) AS t FROM c) GROUP BY ALL),
 sm AS (SELECT query_id, max(same) AS same FROM (SELECT query_id, unit_id, chunk_index, sum(least(n, m)) AS same FROM a JOIN b USING (unit_id, t) GROUP BY ALL) GROUP BY 1), tt AS (SELECT query_id, max(n) AS n FROM (SELECT query_id, unit_id, sum(n) AS n FROM a GROUP BY 1, 2) GROUP BY 1)
 SELECT query_id, round(coalesce(same, 0) / n, 9) AS recall FROM tt LEFT JOIN sm USING (query_id)"""))
def chunk_answer_recall(spark: SparkSession, sf: str) -> DataFrame:
    answers = held(_gold(spark, sf).join(questions(spark, sf), "query_id").select("query_id", "unit_id", F.col("question").alias("answer")))
    named = _with_texts(answers.select("unit_id").distinct(), passages(spark, sf))
    return chunking.best_answer_recall(chunking.fixed_chunks(named), answers)


@query(_pieces(f"WITH s AS (SELECT doc_id, generate_subscripts(ss, 1) AS pos, list_distinct(SEARCH(unnest(ss))) AS w FROM (SELECT doc_id, SENT({DOC}) AS ss FROM documents)), p AS (SELECT w, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS v FROM s) SELECT count(*) AS n_pairs, round(quantile_cont(CASE WHEN len(w || v) > 0 THEN len(list_intersect(w, v)) / len(list_distinct(w || v)) ELSE 0.0 END, 0.2), 9) AS threshold FROM p WHERE v IS NOT NULL"))
def semantic_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.semantic_threshold(passages(spark, sf))


# --- more of ingestion, evaluation and service levels ------------------------------------------------------------------


@query(f"WITH g AS (SELECT count(*) AS n, min(doc_id) AS first, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY sha256({DOC}) HAVING count(*) > 1) SELECT row_number() OVER (ORDER BY first) AS group_no, n, ids FROM g")
def duplicate_members(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.duplicate_members(scan(spark, sf, "documents"))


@query("SELECT lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS question, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")
def duplicate_questions(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, sf, "conversations").groupBy(T.question_key(F.col("text")).alias("question")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


SIGNAL_SQL = _pieces(rf"""WITH sw AS (SELECT doc_id, {DOC} AS t, list_transform(TOK({DOC}), lambda w: regexp_replace(w, '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g')) AS w FROM documents),
 sc AS (SELECT doc_id, greatest(len(w), 1) AS n, len(list_filter(w, lambda x: regexp_matches(x, {_q('^' + ingest.ACRONYM + '$')}))) AS acronyms, len(list_filter(w, lambda x: regexp_matches(x, {_q('^' + ingest.HYPHENATED)}))) AS hyphenated, len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) AS digit_tokens, length(t) - length(translate(t, '{ingest.GREEK}', '')) AS greek FROM sw),
 sg AS (SELECT doc_id, acronyms, hyphenated, digit_tokens, greek, round(acronyms / n, 9) AS acronyms_density, round(hyphenated / n, 9) AS hyphenated_density, round(digit_tokens / n, 9) AS digit_tokens_density FROM sc)
 """)


@query(SIGNAL_SQL + "SELECT * FROM sg")
def signal_features(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.signal_features(scan(spark, sf, "documents"))


@query(SIGNAL_SQL + """, o AS (SELECT count(*)::DOUBLE AS "rows", avg(acronyms_density) AS mean_acronyms_density, avg(hyphenated_density) AS mean_hyphenated_density, avg(digit_tokens_density) AS mean_digit_tokens_density, 100 * avg((acronyms > 0)::INT) AS any_acronym_pct, 100 * avg((greek > 0)::INT) AS any_greek_pct FROM sg) SELECT metric, round(value, 6) AS value FROM (UNPIVOT o ON COLUMNS(*) INTO NAME metric VALUE value)""")
def corpus_profile(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.corpus_profile(ingest.signal_features(scan(spark, sf, "documents")))


@query(f"WITH {GOLD} SELECT query_id, count(*) AS n_gold, count(*) FILTER (WHERE unit_id % 3 <> 0) AS n_known, count(*) = count(*) FILTER (WHERE unit_id % 3 <> 0) AS usable FROM gold GROUP BY 1")
def gold_all_known(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.all_known(_gold(spark, sf), passages(spark, sf).select("unit_id").where("unit_id % 3 <> 0"))


@query(f"WITH {GOLD}, n AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1) SELECT query_id, n_gold, CASE WHEN n_gold <= 1 THEN 'single-passage' WHEN n_gold = 2 THEN 'two-passage' WHEN n_gold <= 5 THEN 'multi-passage-3-to-5' ELSE 'multi-passage-6-plus' END AS complexity FROM n")
def evidence_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.evidence_complexity(_gold(spark, sf).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold")))


@query("SELECT event_id, list_sum(list_distinct(list_transform(regexp_extract_all(coalesce(props, '') || ',' || user_id, '[0-9]+'), lambda x: x::BIGINT)))::BIGINT AS total, len(list_distinct(regexp_extract_all(coalesce(props, '') || ',' || user_id, '[0-9]+')))::BIGINT AS n_ids FROM events")
def parse_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = ingest.parse_ids(F.concat(F.coalesce("props", F.lit("")), F.lit(","), F.col("user_id").cast("string")))
    return scan(spark, sf, "events").select("event_id", ids.alias("ids")).select("event_id", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("ids").cast("long").alias("n_ids"))


@query("SELECT lang, avg(n_chars) FILTER (WHERE quality = 1) AS good, avg(n_chars) FILTER (WHERE quality = 0) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def quality_pivot(spark: SparkSession, sf: str) -> DataFrame:
    joined = scan(spark, sf, "documents", "doc_id", "lang", "n_chars").join(scan(spark, sf, "labels"), "doc_id")
    return joined.groupBy("lang").pivot("quality", [1, 0]).agg(F.avg("n_chars")).select("lang", F.col("1").alias("good"), F.col("0").alias("bad"))


EM_WORDS = "list_filter(SEARCH({0}), lambda w: w NOT IN ('a', 'an', 'the'))"


@query(_pieces(f"""WITH p AS (SELECT conv_id * 1000 + turn AS pair_id, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference FROM conversations),
 w AS (SELECT pair_id, {EM_WORDS.format("coalesce(answer, '')")} AS a, {EM_WORDS.format("coalesce(reference, '')")} AS r FROM p WHERE reference IS NOT NULL),
 s AS (SELECT pair_id, a = r AS em, len(list_intersect(a, r)) AS same, len(list_distinct(a)) AS na, len(list_distinct(r)) AS nr FROM w),
 f AS (SELECT pair_id, em::INT::DOUBLE AS em, same, CASE WHEN na > 0 THEN same / na ELSE 0.0 END AS p, CASE WHEN nr > 0 THEN same / nr ELSE 0.0 END AS q FROM s)
 SELECT pair_id, em, round(p, 9) AS precision, round(q, 9) AS recall, round(CASE WHEN same > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 9) AS f1 FROM f"""))
def exact_match(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    c = scan(spark, sf, "conversations").withColumn("reference", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return evaluation.exact_match(c.where("reference is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("answer"), "reference"))


@query(BM25_SQL + f", {GOLD}, ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1), hk AS (SELECT query_id, k, n_gold, (SELECT count(*) FROM bm JOIN gold g USING (query_id, unit_id) WHERE bm.query_id = ng.query_id AND rank <= k) AS found FROM ng, (SELECT unnest([1, 3, 5, 10]) AS k)) SELECT k, round(avg(found / n_gold), 4) AS recall, round(avg((found > 0)::INT), 4) AS hit, count(*) AS n FROM hk GROUP BY 1")
def metrics_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.rank_metrics_at(_bm25(spark, sf), _gold(spark, sf).select("query_id", "unit_id"))


@query(CAND_SQL + _pieces(f", {GOLD}, se AS (SELECT query_id, unit_id, len(TOK(text)) AS n_tokens FROM cand WHERE rank <= 4), sj AS (SELECT se.query_id, count(*) AS n, count(g.unit_id) AS hit, sum(CASE WHEN g.unit_id IS NULL THEN n_tokens ELSE 0 END) AS off FROM se LEFT JOIN gold g ON g.query_id = se.query_id AND g.unit_id = se.unit_id GROUP BY 1) SELECT query_id, round(hit / n, 9) AS precision, round(hit / n_gold, 9) AS recall, round(off / 1200, 9) AS waste FROM sj JOIN (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1) USING (query_id)"))
def evidence_metrics(spark: SparkSession, sf: str) -> DataFrame:
    chosen = _candidates(spark, sf, 4).select("query_id", "unit_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))
    return evaluation.evidence_metrics(chosen, _gold(spark, sf).select("query_id", "unit_id"), evaluation.CONTEXT_TOKENS)


CHUNK_BM25 = BM25_SQL.replace(f"SELECT doc_id AS unit_id, {SEARCH.replace('{0}', DOC)} AS w FROM documents", f"SELECT unit_id * 1000 + chunk_index AS unit_id, {SEARCH.replace('{0}', 'text')} AS w FROM pc")


@query(_windows_sql(96, 16, "parent_child").replace("WITH d AS", "WITH pd AS").replace("FROM d WHERE", "FROM pd WHERE").replace(" s AS", " ps AS").replace("FROM s)", "FROM ps)").replace(" c AS (", " pc AS (") + ", " + CHUNK_BM25.removeprefix("WITH ") + ", pt AS (SELECT query_id, unit_id // 1000 AS unit_id, min(rank) AS best, count(*) AS n_chunks FROM bm GROUP BY 1, 2) SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY best, unit_id) AS rank, n_chunks FROM pt QUALIFY rank <= 10")
def parent_expansion(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.parent_child_chunks(passages(spark, sf)).select((F.col("unit_id") * 1000 + F.col("chunk_index")).alias("unit_id"), "text")
    found = retrieval.bm25_search(c, questions(spark, sf), POOL)
    return retrieval.to_parents(found.withColumn("parent_id", F.floor(F.col("unit_id") / 1000)))


@query(HYBRID_SQL + f", {GOLD}, ks AS (SELECT unnest([1, 10, 60, 200]) AS k), fk AS (SELECT k, query_id, unit_id, round(sum(1.0::DOUBLE / (k + rank)), 6) AS score FROM ch, ks GROUP BY ALL), ck AS (SELECT * FROM fk QUALIFY row_number() OVER (PARTITION BY k, query_id ORDER BY score DESC, unit_id) <= 10), hk AS (SELECT k, query_id, count(*) AS hit FROM ck JOIN gold USING (query_id, unit_id) GROUP BY 1, 2), ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1) SELECT ks.k, round(avg(coalesce(hit, 0) / n_gold), 6) AS recall FROM ng CROSS JOIN ks LEFT JOIN hk ON hk.k = ks.k AND hk.query_id = ng.query_id GROUP BY 1")
def rrf_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rrf_sensitivity(_channels(spark, sf).select("query_id", "unit_id", "rank"), _gold(spark, sf).select("query_id", "unit_id"))


@query(SUPPORT_SQL + ", e2 AS (SELECT query_id, unit_id FROM ev)" + _coverage_sql("e2", "cv") + ", su AS (SELECT query_id, round(avg(best), 6) AS support, round(avg((label = 'SUPPORTED')::INT), 6) AS agreement FROM lb GROUP BY 1), ss AS (SELECT query_id, coverage, support, agreement, round(0.55 * coverage + 0.30 * support + 0.15 * agreement, 6) AS score FROM cv JOIN su USING (query_id)) SELECT *, CASE WHEN score >= 0.75 THEN 'SUFFICIENT' WHEN score >= 0.5 THEN 'WEAK' ELSE 'INSUFFICIENT' END AS label FROM ss")
def evidence_sufficiency(spark: SparkSession, sf: str) -> DataFrame:
    _, claims, evidence = _claims(spark, sf)
    s = evaluation.claim_support(claims, evidence).groupBy("query_id").agg(F.round(F.avg("best"), 6).alias("support"), F.round(F.avg((F.col("label") == "SUPPORTED").cast("int")), 6).alias("agreement"))
    return evaluation.sufficiency(routing.term_coverage(questions(spark, sf), evidence).select("query_id", "coverage").join(s, "query_id"))


@query("SELECT event_id, round(value * 0.001 * (CASE WHEN event_type = 'error' THEN 2 ELSE 1 END) + user_id * 0.0001, 9) AS cost FROM events")
def request_cost(spark: SparkSession, sf: str) -> DataFrame:
    e = scan(spark, sf, "events").select("event_id", F.col("user_id").alias("embed"), F.col("value").alias("gen_in"), (F.col("event_type") == "error").alias("repair"))
    return evaluation.request_cost(e, {"embed": 0.0001, "gen_in": 0.001}).select("event_id", "cost")


@query("SELECT DISTINCT user_id AS attempt, least(2.0, 0.2 * pow(2, user_id)) AS wait FROM events WHERE user_id < 12")
def retry_backoff(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.backoff(scan(spark, sf, "events").where("user_id < 12").select(F.col("user_id").alias("attempt")).distinct())


@query(SLO_SQL + ", b AS (SELECT p95 AS base_latency, availability AS base_quality, cost AS base_cost FROM s WHERE event_type = 'click'), c AS (SELECT event_type, concat_ws(',', CASE WHEN availability < base_quality THEN 'quality' END, CASE WHEN availability < availability - 0.03 THEN 'grounding' END, CASE WHEN p95 > base_latency * 1.15 THEN 'latency' END, CASE WHEN cost > base_cost * 1.15 THEN 'cost' END) AS failed FROM s, b) SELECT event_type, failed, failed = '' AS promote FROM c")
def rollout_gate(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluation.slo_report(_requests(spark, sf), {}, "event_type").select("event_type", "availability", "p95", "cost")
    base = s.where("event_type = 'click'").select(F.col("availability").alias("base_quality"), F.col("p95").alias("base_latency"), F.col("cost").alias("base_cost"))
    own = [F.col("availability").alias("cand_quality"), *[F.col("availability").alias(f"{side}_{m}") for side in ("base", "cand") for m in ("grounding", "citation")], F.col("p95").alias("cand_latency"), F.col("cost").alias("cand_cost")]
    return evaluation.rollout(s.crossJoin(F.broadcast(base)).select("event_type", "base_quality", "base_latency", "base_cost", *own)).select("event_type", "failed", "promote")


@query(_pieces(f"SELECT conv_id, turn, CASE WHEN regexp_matches(low, {_q(routing.LIST)}) THEN 'list' WHEN regexp_matches(low, {_q(routing.SUMMARY)}) THEN 'summary' WHEN regexp_matches(low, {_q(routing.YES_NO)}) THEN 'yes/no' ELSE 'factoid' END AS type, array_to_string(list_filter({KEY_TERMS}, lambda w, i: list_position({KEY_TERMS}, w) = i), ' ') AS terms FROM (SELECT conv_id, turn, {DOC} AS question, {ASCII_LOWER.format(DOC)} AS low FROM conversations)"))
def question_types(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, sf, "conversations").select("conv_id", "turn", routing.question_type(F.col("text")).alias("type"), F.array_join(routing.key_terms(F.col("text")), " ").alias("terms"))


@query(_pieces(rf"""WITH tn AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({DOC}, '\r\n?', chr(10), 'g'), '\t', ' ', 'g'), ' +', ' ', 'g') AS t FROM documents)
 SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(t, ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS sha FROM tn"""))
def normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, sf, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("sha"))


@query(SUPPORT_SQL + """, vc AS (SELECT query_id, sum(n_citations)::BIGINT AS n_citations, count(*) FILTER (WHERE n_valid = 0) AS n_phantom, count(*) FILTER (WHERE n_valid = 1 AND best >= 0.2) AS n_good, sum(n_valid)::BIGINT AS n_used,
 count(*) FILTER (WHERE label = 'SUPPORTED') AS n_strong, count(*) FILTER (WHERE label = 'PARTIALLY_SUPPORTED') AS n_weak, count(*) FILTER (WHERE label = 'UNSUPPORTED') AS n_unsupported FROM lb GROUP BY 1)
 SELECT *, n_good / n_citations AS precision, coalesce(n_used / n_evidence, 0.0) AS recall FROM vc LEFT JOIN (SELECT query_id, count(DISTINCT unit_id) AS n_evidence FROM ev GROUP BY 1) USING (query_id)""")
def citation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.validate_citations(*_claims(spark, sf)[1:])


from tessera.plans import reports  # noqa: E402, F401  (registers its queries)
