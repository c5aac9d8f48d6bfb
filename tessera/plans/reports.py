"""Registered queries of chunk quality and of the reports, with their DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, evaluation, graph, ingest, passage_scores, quality, reports, retrieval
from tessera.plans.registry import (
    BM25_SQL, CAND_SQL, DELTA_SQL, DOC, GOLD, JACC, MISSING, PAIR_SQL, POOL, SEED_SQL, SUPPORT_SQL, _bm25, _candidates, _claims, _gold, _pieces, _q, _requests, _runs, _seeds, oracle_sql, query,
)
from tessera.sources.tables import held, passages, questions, scan

# --- chunk quality -------------------------------------------------------------------------------------------------

STRATEGIES = ("fixed", "parent_child", "proposition")
UNITS_SQL = "WITH units AS (" + " UNION ALL ".join(f"SELECT unit_id, strategy, chunk_index::INT AS chunk_index, text, n_tokens::INT AS n_tokens FROM ({oracle_sql()['chunk_' + s]})" for s in STRATEGIES) + ")"


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return _units_of(passages(spark, sf))


def _units_of(p: DataFrame) -> DataFrame:
    made = (chunking.fixed_chunks(p), chunking.parent_child_chunks(p), chunking.proposition_chunks(p))
    return reduce(DataFrame.unionByName, [m.select("unit_id", "strategy", F.col("chunk_index").cast("int").alias("chunk_index"), "text", F.col("n_tokens").cast("int").alias("n_tokens")) for m in made])


def _by_repeat(p: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Passages whose ids occur once (or are null), which are scored where they lie, and the others, if there are any."""
    repeated = held(p.where("unit_id is not null").groupBy("unit_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("unit_id"))
    return (p.join(repeated, "unit_id", "left_anti"), p.join(repeated, "unit_id", "left_semi")) if repeated.take(1) else (p, None)


@query(UNITS_SQL + f", {GOLD}, gu AS (SELECT DISTINCT unit_id FROM gold) SELECT strategy, (SELECT count(*) FROM gu) AS n_gold, count(gu.unit_id) AS represented, round(100 * count(gu.unit_id) / greatest((SELECT count(*) FROM gu), 1), 6) AS coverage_pct FROM (SELECT DISTINCT strategy, unit_id FROM units) LEFT JOIN gu USING (unit_id) GROUP BY 1")
def gold_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    return quality.gold_compatibility(_units(spark, sf), _gold(spark, sf))


@query(UNITS_SQL + ", iq AS (SELECT strategy, count(*) AS n_chunks, sum(n_tokens)::BIGINT AS n_tokens, quantile_cont(n_tokens, 0.5)::DOUBLE AS median_tokens FROM units GROUP BY 1) SELECT *, round(n_chunks / (SELECT count(*) FROM documents), 3) AS per_passage, round(n_tokens * 0.0001::DOUBLE / 1000, 4) AS usd, n_chunks * 6144 AS bytes, round(n_chunks / (SELECT n_chunks FROM iq WHERE strategy = 'fixed'), 2) AS explosion FROM iq")
def index_cost(spark: SparkSession, sf: str) -> DataFrame:
    return quality.index_cost(_units(spark, sf), scan(spark, sf, "documents", "doc_id").agg(F.count(F.lit(1)).alias("n_passages")), "fixed")


def _edges(text: str) -> str:
    return f"regexp_replace({text}, {_q(T.BEYOND_ASCII)}, '_', 'g')"


def _has(pattern: str, text: str = "text") -> str:
    return f"regexp_matches({_edges(text)}, {_q(pattern)})"


INTRINSIC_SQL = UNITS_SQL + _pieces(f""", ic AS (SELECT unit_id, strategy, count(*) AS n_chunks, avg(regexp_matches(text, {_q(quality.CLOSED)})::INT) AS closed, avg((n_tokens <= 384)::INT) AS small,
 least(1.0, sum(2 * {_has(quality.ENTITY)}::INT + {_has(quality.RELATION)}::INT + {_has(quality.NEGATION)}::INT) / (4 * count(*))) AS signal, 1 - count(DISTINCT text) / count(*) AS repeats, sum(n_tokens) AS n_tokens FROM units GROUP BY 1, 2),
 im AS (SELECT unit_id, strategy, n_chunks, round(closed, 6) AS boundary_quality, round(small, 6) AS size_compliance, round(signal, 6) AS biomedical_signal, round(repeats, 6) AS redundancy, round(n_tokens / n_source, 6) AS token_expansion,
 round(0.30::DOUBLE * closed + 0.25::DOUBLE * small + 0.25::DOUBLE * signal + 0.20::DOUBLE * (1 - repeats), 6) AS score FROM ic JOIN (SELECT doc_id AS unit_id, greatest(len(TOK({DOC})), 1) AS n_source FROM documents) USING (unit_id))""")


@query(INTRINSIC_SQL + " SELECT * FROM im")
def chunk_intrinsic(spark: SparkSession, sf: str) -> DataFrame:
    return _intrinsic(passages(spark, sf))


def _intrinsic(p: DataFrame) -> DataFrame:
    one, many = _by_repeat(p)
    rows = passage_scores.intrinsic(one, STRATEGIES)
    return rows if many is None else rows.unionByName(quality.intrinsic_metrics(many, _units_of(many)))


COHESION_WORDS = f"list_distinct(regexp_extract_all(lower({{0}}), {_q(quality.COHESION_TOKEN)}))"


@query(UNITS_SQL + _pieces(f""", cs AS (SELECT strategy, unit_id, chunk_index, text, list_transform(SENT(text), lambda x: {COHESION_WORDS.format('x')}) AS s FROM units),
 co AS (SELECT strategy, unit_id, chunk_index, (NOT {_has(quality.BACK_REFERENCE, 'trim(text)')})::INT AS rc, CASE WHEN len(s) < 2 THEN 1.0 ELSE list_avg(list_transform(range(1, len(s)), lambda i: CASE WHEN len(s[i] || s[i + 1]) > 0 THEN len(list_intersect(s[i], s[i + 1])) / len(list_distinct(s[i] || s[i + 1])) ELSE 0.0 END)) END AS icc FROM cs),
 cw AS (SELECT strategy, unit_id, chunk_index, unnest({COHESION_WORDS.format('text')}) AS w FROM units), dw AS (SELECT doc_id AS unit_id, unnest({COHESION_WORDS.format(DOC)}) AS w, 1 AS known FROM documents),
 cd AS (SELECT strategy, unit_id, chunk_index, count(known) / count(*) AS dcc FROM cw LEFT JOIN dw USING (unit_id, w) GROUP BY 1, 2, 3)
 SELECT strategy, round(avg(icc), 6) AS icc, round(avg(coalesce(dcc, 0.0)), 6) AS dcc, round(avg(rc), 6) AS rc FROM co LEFT JOIN cd USING (strategy, unit_id, chunk_index) GROUP BY 1"""))
def chunk_cohesion(spark: SparkSession, sf: str) -> DataFrame:
    one, many = _by_repeat(passages(spark, sf))
    sums = passage_scores.cohesion_sums(one, STRATEGIES)
    return passage_scores.cohesion_means(sums if many is None else sums.unionByName(passage_scores.cohesion_sums_of(many, _units_of(many))))


KEYED = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"


def _all(pattern: str) -> str:
    return f"list_transform(regexp_extract_all({_edges(DOC)}, {_q(pattern)}), lambda x: lower(x))"


@query(UNITS_SQL + _pieces(f""", sg AS (SELECT doc_id AS unit_id, {_all(quality.ENTITY)} AS e, {_all(quality.NEGATION)} AS g, list_transform(list_filter(SENT({DOC}), lambda x: {_has(quality.RELATION, 'x')}), lambda x: {KEYED.format('x')}) AS r FROM documents),
 sl AS (SELECT unit_id, kind, signal, count(*) AS n FROM (SELECT unit_id, 'entity' AS kind, unnest(e) AS signal FROM sg UNION ALL SELECT unit_id, 'negation', unnest(g) FROM sg UNION ALL SELECT unit_id, 'relation', unnest(r) FROM sg) GROUP BY 1, 2, 3),
 sw AS (SELECT strategy, unit_id, kind, signal, any_value(n) AS n, bool_or(contains({KEYED.format('text')}, signal)) AS whole FROM units JOIN sl USING (unit_id) GROUP BY 1, 2, 3, 4)
 SELECT strategy, kind, sum(n)::BIGINT AS n_checked, round(sum(CASE WHEN whole THEN n ELSE 0 END) / sum(n), 6) AS intact FROM sw GROUP BY 1, 2"""))
def chunk_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return quality.integrity(passages(spark, sf), _units(spark, sf))


CONFIDENT = "CASE WHEN n_tokens <= 180 THEN 0.90 WHEN route = 'biomedical' THEN CASE WHEN relation_density >= 0.015 AND negation_density > 0 THEN 0.82 ELSE 0.78 END WHEN route = 'semantic' THEN 0.76 WHEN route = 'parent_child' THEN 0.73 ELSE 0.65 END::DOUBLE"
PROFILE_SQL = f", pf AS (SELECT *, {CONFIDENT} AS confidence FROM ({oracle_sql()['chunk_profile_route']}))"


@query(UNITS_SQL + PROFILE_SQL + """, kc AS (SELECT unit_id, k, count(*) AS votes FROM (SELECT unit_id, strategy, count(*) AS k FROM units GROUP BY 1, 2) GROUP BY 1, 2), da AS (SELECT unit_id, round(1 - max(votes) / sum(votes), 6) AS disagreement FROM kc GROUP BY 1),
 tr AS (SELECT unit_id, confidence, coalesce(disagreement, 0.0) AS disagreement, CASE WHEN confidence < 0.70 THEN 'low_router_confidence' WHEN topic_shift > 0.75 THEN 'high_topic_shift' WHEN relation_density > 0.02 AND n_sentences > 5 THEN 'high_relation_density' WHEN coalesce(disagreement, 0) > 0.25 THEN 'candidate_disagreement' ELSE 'normal_route' END AS reason FROM pf LEFT JOIN da USING (unit_id))
 SELECT *, reason <> 'normal_route' AS triggered FROM tr""")
def chunk_trigger(spark: SparkSession, sf: str) -> DataFrame:
    return quality.trigger(chunking.routing_profile(passages(spark, sf)), quality.disagreement(_units(spark, sf)))


@query(INTRINSIC_SQL + PROFILE_SQL + """, bo AS (SELECT unit_id, max(score) AS top FROM im GROUP BY 1), oc AS (SELECT unit_id, any_value(top) AS top, min(strategy) FILTER (WHERE score = top) AS oracle FROM im JOIN bo USING (unit_id) GROUP BY 1),
 ch AS (SELECT unit_id, top, oracle, confidence >= 0.70 AS sure, CASE WHEN confidence >= 0.70 THEN CASE WHEN EXISTS (SELECT 1 FROM im WHERE im.unit_id = oc.unit_id AND im.strategy = pf.route) THEN route ELSE 'fixed' END ELSE oracle END AS choice FROM oc JOIN pf USING (unit_id))
 SELECT ch.unit_id, choice, CASE WHEN sure THEN 'rule' ELSE 'score' END AS stopped_by, oracle, choice = oracle AS accurate, round(top - coalesce(im.score, 0.0), 6) AS regret FROM ch LEFT JOIN im ON im.unit_id = ch.unit_id AND im.strategy = choice""")
def chunk_selection(spark: SparkSession, sf: str) -> DataFrame:
    p = passages(spark, sf)
    return quality.selection(_intrinsic(p), chunking.routing_profile(p), "fixed")


# --- ingestion -----------------------------------------------------------------------------------------------------

LISTS = "CASE WHEN doc_id % 3 = 0 THEN '[\"' || coalesce(lang, '') || '\", \"' || coalesce(source, '') || '\"]' WHEN doc_id % 3 = 1 THEN lang || ' ;' || coalesce(source, '') || '|' END"


@query(f"WITH x AS (SELECT doc_id, {LISTS} AS v FROM documents) SELECT doc_id, array_to_string(list_filter(list_transform(CASE WHEN v IS NULL THEN []::VARCHAR[] WHEN v LIKE '[%' THEN from_json(v, '[\"VARCHAR\"]') ELSE regexp_split_to_array(v, '[;,|]') END, lambda m: trim(m)), lambda m: m <> ''), '/') AS members FROM x")
def parse_lists(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, sf, "documents", "doc_id", "lang", "source").select("doc_id", F.array_join(reports.parse_list(F.expr(LISTS)), "/").alias("members"))


@query(f"WITH {GOLD}, e AS (SELECT doc_id AS unit_id, (text IS NULL OR lower(trim(text)) IN {MISSING}) AS empty FROM documents) SELECT query_id, count(*) AS n_gold, count(*) FILTER (WHERE empty) AS n_empty, count(*) FILTER (WHERE NOT empty) AS n_usable, count(*) FILTER (WHERE NOT empty) > 0 AS has_usable FROM gold JOIN e USING (unit_id) GROUP BY 1")
def usable_gold(spark: SparkSession, sf: str) -> DataFrame:
    return reports.usable_gold(_gold(spark, sf).select("query_id", "unit_id"), scan(spark, sf, "documents", "doc_id", "text"))


@query(_pieces(rf"""WITH {GOLD}, d AS (SELECT (text IS NULL OR lower(trim(text)) IN {MISSING}) AS empty, trim(regexp_replace({DOC}, '\s+', ' ', 'g')) AS t, len(TOK({DOC})) AS w FROM documents), u AS (SELECT count(*) AS n FROM d GROUP BY t),
 o AS (SELECT (SELECT count(*) FROM d)::DOUBLE AS passages, (SELECT count(*) FROM d WHERE empty)::DOUBLE AS empty_passages, (SELECT quantile_cont(w, 0.5) FROM d WHERE NOT empty)::DOUBLE AS median_words, (SELECT quantile_cont(w, 0.95) FROM d WHERE NOT empty)::DOUBLE AS p95_words,
 (SELECT count(*) FROM u)::DOUBLE AS unique_texts, (SELECT coalesce(sum(n), 0) FROM u WHERE n > 1)::DOUBLE AS duplicate_rows, (SELECT count(*) FROM benchmark)::DOUBLE AS questions, (SELECT quantile_cont(len(TOK({DOC})), 0.5) FROM benchmark)::DOUBLE AS median_question_words,
 (SELECT count(*) FROM gold)::DOUBLE AS gold_relations, (SELECT count(DISTINCT query_id) FROM gold)::DOUBLE AS questions_with_gold) SELECT metric, round(value, 6) AS value FROM (UNPIVOT o ON COLUMNS(*) INTO NAME metric VALUE value)"""))
def canonical_stats(spark: SparkSession, sf: str) -> DataFrame:
    return reports.canonical_stats(scan(spark, sf, "documents", "doc_id", "text"), questions(spark, sf), _gold(spark, sf))


@query("SELECT doc_id, to_json({'lang': lang, 'n_chars': n_chars, 'source': source})::VARCHAR AS metadata FROM documents")
def metadata_json(spark: SparkSession, sf: str) -> DataFrame:
    return reports.metadata_json(scan(spark, sf, "documents", "doc_id", "lang", "n_chars", "source"), "doc_id")


TERMS = f"list_distinct(list_filter(regexp_extract_all(lower({{0}}), {_q(reports.TERM)}), lambda w: length(w) > 2 AND NOT list_contains([{', '.join(map(_q, reports.TERM_STOP))}], w)))"


@query(f"WITH {GOLD}, q AS (SELECT item_id AS query_id, {TERMS.format(DOC)} AS q FROM benchmark), qw AS (SELECT query_id, unnest(q) AS w FROM q), h AS (SELECT DISTINCT query_id, unnest({TERMS.format(DOC)}) AS w FROM gold JOIN documents ON doc_id = unit_id), n AS (SELECT qw.query_id, round(count(h.w) / count(*), 9) AS share FROM qw LEFT JOIN h ON h.query_id = qw.query_id AND h.w = qw.w GROUP BY 1) SELECT query_id, len(q) AS n_terms, coalesce(share, 0.0) AS coverage FROM q LEFT JOIN n USING (query_id)")
def gold_term_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return reports.gold_term_coverage(questions(spark, sf), _gold(spark, sf).select("query_id", "unit_id"), passages(spark, sf))


@query(f"WITH {GOLD} SELECT query_id, 'DOC-' || unit_id AS canonical_id, sha256({DOC}) AS raw_sha256 FROM gold JOIN documents ON doc_id = unit_id")
def lineage(spark: SparkSession, sf: str) -> DataFrame:
    return reports.lineage(_gold(spark, sf).select("query_id", "unit_id"), ingest.canonical(scan(spark, sf, "documents")))


# --- questions -----------------------------------------------------------------------------------------------------


def _any_of(words: tuple[str, ...], test: str) -> str:
    return f"len(list_filter([{', '.join(map(_q, words))}], lambda p: {test})) > 0"


@query(f"SELECT conv_id, turn, CASE WHEN {_any_of(reports.YES_NO, 'starts_with(q, p)')} THEN 'yes_no_candidate' WHEN {_any_of(reports.LISTED, 'starts_with(q, p)')} THEN 'list_or_factoid_candidate' WHEN {_any_of(reports.FACTOID, 'starts_with(q, p)')} THEN 'factoid_candidate' WHEN {_any_of(reports.SUMMARY, 'contains(q, p)')} THEN 'summary_or_mechanism_candidate' ELSE 'other' END AS kind FROM (SELECT conv_id, turn, lower(trim({DOC})) AS q FROM conversations)")
def inferred_types(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, sf, "conversations").select("conv_id", "turn", reports.inferred_type(F.coalesce("text", F.lit(""))).alias("kind"))


KIND = "CASE " + " ".join(f"WHEN {_any_of(words, 'contains(low, p)')} THEN '{name}'" for name, words in reports.KINDS) + " ELSE 'factoid' END"


@query(_pieces(f"""WITH a AS (SELECT conv_id * 1000 + turn AS query_id, {DOC} AS question, lower({DOC}) AS low FROM conversations),
 b AS (SELECT query_id, {KIND} AS kind, len(regexp_extract_all({_edges('question')}, {_q(reports.NAMED)})) AS n_entities, {_any_of(reports.RELATIONS, 'contains(low, p)')} AS relation_signal, {_any_of(reports.HOPS, 'contains(low, p)')} AS hop, len(TOK(low)) AS n FROM a),
 c AS (SELECT *, relation_signal AND (n_entities >= 2 OR hop) AS multi_hop, kind IN ('comparison', 'mechanism') AS hard FROM b), d AS (SELECT *, CASE WHEN multi_hop OR n > 28 OR hard THEN 'high' WHEN n > 16 THEN 'medium' ELSE 'low' END AS complexity FROM c)
 SELECT query_id, kind, n_entities, relation_signal, multi_hop, complexity, CASE WHEN multi_hop THEN 'hybrid,graph' ELSE 'hybrid' END AS primary_tools, concat_ws(',', CASE WHEN hard OR complexity = 'high' THEN 'decompose,pageindex' END, CASE WHEN kind IN ('factoid', 'association', 'effect') AND complexity <> 'high' THEN 'query2doc,hyde' END) AS recovery_tools FROM d"""))
def query_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return reports.query_analysis(scan(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.coalesce("text", F.lit("")).alias("question")))


@query(f"WITH {GOLD}, n AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1) SELECT item_id AS query_id, coalesce(n_gold, 0) AS n_gold, CASE WHEN coalesce(n_gold, 0) <= 1 THEN 'single-passage' WHEN n_gold = 2 THEN 'two-passage' ELSE 'multi-passage' END AS bucket, " + _pieces(f"len(TOK({DOC}))") + " AS n_words FROM benchmark LEFT JOIN n ON query_id = item_id")
def complexity_features(spark: SparkSession, sf: str) -> DataFrame:
    return reports.complexity_features(questions(spark, sf), _gold(spark, sf))


# --- runs ----------------------------------------------------------------------------------------------------------


@query(BM25_SQL + f", {GOLD}, ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1), gh AS (SELECT query_id, count(*) FILTER (WHERE rank <= 10) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 10) AS dcg FROM bm JOIN gold USING (query_id, unit_id) GROUP BY 1), gm AS (SELECT item_id AS query_id, n_gold, coalesce(hits, 0) AS hits, first, dcg FROM benchmark LEFT JOIN ng ON ng.query_id = item_id LEFT JOIN gh ON gh.query_id = item_id)" + """
 SELECT query_id, CASE WHEN n_gold IS NOT NULL THEN (hits > 0)::INT::DOUBLE END AS hit, CASE WHEN n_gold IS NOT NULL THEN round(hits / n_gold, 9) END AS recall, CASE WHEN n_gold IS NOT NULL THEN round(CASE WHEN hits > 0 THEN dcg / list_sum(list_transform(range(1, hits + 1), lambda r: 1 / log2(r + 1))) ELSE 0.0 END, 9) END AS ndcg, round(coalesce(1 / first, 0.0), 9) AS mrr FROM gm""")
def graded_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return reports.graded_metrics(questions(spark, sf), _bm25(spark, sf, 40), _gold(spark, sf).select("query_id", "unit_id"))


def _pair(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _runs(spark, sf)
    return a.select("query_id", "hit", "recall", F.col("ndcg").alias("x")).join(b.select("query_id", F.col("ndcg").alias("y")), "query_id")


def _both(spark: SparkSession, sf: str, found: DataFrame | None = None, again: DataFrame | None = None) -> DataFrame:
    a, b = _runs(spark, sf, found, again)
    return a.withColumn("config", F.lit("bm25")).unionByName(b.withColumn("config", F.lit("jaccard")))


BOTH_SQL = PAIR_SQL + ", rn AS (SELECT *, 'bm25' AS config FROM ma UNION ALL BY NAME SELECT *, 'jaccard' AS config FROM mb)"


@query(DELTA_SQL + " SELECT CASE WHEN d > 1e-9 THEN 'HELPED' WHEN d < -1e-9 THEN 'HURT' ELSE 'NEUTRAL' END AS effect, count(*) AS n, round(avg(d), 6) AS mean_gain, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM dd GROUP BY 1")
def rerank_effects(spark: SparkSession, sf: str) -> DataFrame:
    return reports.effects(_pair(spark, sf))


@query(DELTA_SQL + " SELECT count(*) AS n_attempts, round(avg((round(d, 9) >= 0.02)::INT), 6) AS success FROM dd WHERE x < 1")
def recovery_success(spark: SparkSession, sf: str) -> DataFrame:
    return reports.recovery(_pair(spark, sf), F.col("x") < 1)


@query(BOTH_SQL + " SELECT query_id, max(ndcg) AS oracle, max(ndcg) FILTER (WHERE config = 'bm25') AS chosen, round(max(ndcg) - max(ndcg) FILTER (WHERE config = 'bm25'), 9) AS regret FROM rn GROUP BY 1")
def routing_regret(spark: SparkSession, sf: str) -> DataFrame:
    return reports.chosen_regret(_both(spark, sf).withColumnRenamed("ndcg", "utility"), "bm25")


@query(BOTH_SQL + ", rl AS (SELECT config, count(*) AS n, round(avg(hit), 4) AS hit, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM rn GROUP BY 1) SELECT *, round(ndcg - (SELECT ndcg FROM rl WHERE config = 'bm25'), 4) AS delta, row_number() OVER (ORDER BY ndcg DESC, config)::INT AS place FROM rl")
def recipe_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return reports.recipe_leaderboard(_both(spark, sf), "bm25")


JUDGED_SQL = _pieces(f"""jd AS (SELECT 'bm25' AS config, query_id, round(avg({JACC}), 6) AS judged FROM cand WHERE rank <= 3 GROUP BY 2 UNION ALL SELECT 'jaccard', c.query_id, round(avg({JACC}), 6) FROM cand c JOIN jac j ON j.query_id = c.query_id AND j.unit_id = c.unit_id AND j.rank <= 3 GROUP BY 2)""")


def _judged(c: DataFrame, again: DataFrame) -> DataFrame:
    """(query_id, judged, config) of candidates by BM25 and of their reranking."""
    again = again.where("rank <= 3").select("query_id", "unit_id")
    liked = lambda rows, name: rows.groupBy("query_id").agg(F.round(F.avg(retrieval.jaccard_score(F.col("question"), F.col("text"))), 6).alias("judged")).withColumn("config", F.lit(name))
    return liked(c.where("rank <= 3"), "bm25").unionByName(liked(c.join(again, ["query_id", "unit_id"]), "jaccard"))


@query(BOTH_SQL + f""", {JUDGED_SQL},
 js AS (SELECT query_id, config, judged, ndcg AS utility FROM rn JOIN jd USING (query_id, config)), jp AS (SELECT query_id, max(utility) AS best, max(utility) FILTER (WHERE config = 'bm25') AS usual, any_value(p) AS picked FROM js JOIN (SELECT query_id, utility AS p FROM js QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY judged DESC, config) = 1) USING (query_id) GROUP BY 1)
 SELECT count(*) AS n, round(avg((best - picked <= 1e-9)::INT), 6) AS oracle_share, round(avg(best - picked), 6) AS regret, round(avg(picked), 6) AS picked, round(avg(usual), 6) AS "default", round(avg(best), 6) AS oracle FROM jp""")
def judge_calibration(spark: SparkSession, sf: str) -> DataFrame:
    found = _bm25(spark, sf, POOL)
    c = _candidates(spark, sf, POOL, found)
    again = held(retrieval.rerank(c, "jaccard"))
    return reports.calibration(_both(spark, sf, found, again).withColumnRenamed("ndcg", "utility").join(_judged(c, again), ["query_id", "config"]), "bm25")


@query(PAIR_SQL + f", {JUDGED_SQL} SELECT query_id, min(config) FILTER (WHERE judged = m) AS best, any_value(m) AS evidence_score, round(any_value(m) - min(judged), 6) AS margin FROM jd JOIN (SELECT query_id, max(judged) AS m FROM jd GROUP BY 1) USING (query_id) GROUP BY 1")
def compare_configs(spark: SparkSession, sf: str) -> DataFrame:
    c = _candidates(spark, sf)
    return reports.best_config(_judged(c, held(retrieval.rerank(c, "jaccard"))))


TAGS_SQL = DELTA_SQL + ", tg AS (SELECT unnest(list_filter([CASE WHEN hit = 0 THEN 'F04' END, CASE WHEN d < -1e-9 THEN 'F08' END, CASE WHEN recall < 1 THEN 'F13' END], lambda t: t IS NOT NULL)) AS failure_code FROM dd JOIN ma USING (query_id))"


@query(TAGS_SQL + f" SELECT failure_code, CASE failure_code {' '.join(f'WHEN {_q(k)} THEN {_q(v)}' for k, v in reports.FAILURES.items())} ELSE failure_code END AS failure_name, count(*) AS n FROM tg GROUP BY 1")
def failure_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.failure_counts(reports.failure_tags(_pair(spark, sf).withColumn("delta", F.col("y") - F.col("x"))))


@query(CAND_SQL + _pieces(f", {GOLD}, ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1), ck AS (SELECT unnest([1, 2, 4, 8]) AS k), cx AS (SELECT c.query_id, k, n_gold, sum(len(TOK(text))) AS tokens, count(*) AS m, count(g.unit_id) AS good FROM cand c JOIN ng USING (query_id) JOIN ck ON rank <= k LEFT JOIN gold g ON g.query_id = c.query_id AND g.unit_id = c.unit_id GROUP BY 1, 2, 3) SELECT k, round(avg(tokens), 4) AS tokens, round(avg(good / m), 6) AS precision, round(avg(good / n_gold), 6) AS recall, count(*) AS n FROM cx GROUP BY 1"))
def context_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return reports.context_sweep(_candidates(spark, sf, 10).withColumn("n_tokens", F.size(T.tokens(F.col("text")))), _gold(spark, sf).select("query_id", "unit_id"))


@query()
def utility_select(spark: SparkSession, sf: str) -> DataFrame:
    return reports.utility_select(_candidates(spark, sf, 10))


@query(SEED_SQL + ", ps AS (SELECT DISTINCT query_id, unit_id, src, dst, predicate FROM te JOIN seed ON entity = src OR entity = dst), pc AS (SELECT query_id, unit_id, count(*) AS support FROM ps GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, unit_id)::INT AS place FROM pc QUALIFY place <= 20")
def provenance_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = passages(spark, sf)
    facts = graph.entity_facts(p)
    usable = held(graph.usable_entities(p, graph.mentions(facts)))
    return reports.provenance_scores(graph.typed_edges(facts, usable), graph.question_seeds(questions(spark, sf), usable, graph.entity_surfaces(facts)))


# --- service -------------------------------------------------------------------------------------------------------


@query("WITH e AS (SELECT event_type, (event_type <> 'error')::INT AS u, greatest(value, 0) + 0.001::DOUBLE * greatest(user_id, 0) + greatest(value * 0.001::DOUBLE, 0) AS s FROM events) SELECT event_type, round(avg(u), 6) AS utility, round(avg(CASE WHEN s > 0 THEN u / s END), 6) AS efficiency FROM e GROUP BY 1")
def agent_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    return reports.efficiency(_requests(spark, sf).withColumn("utility", F.col("ok").cast("int")).withColumn("tokens", F.col("user_id")), "event_type")


@query("WITH s AS (SELECT event_id, 1500 - value * 20 AS r, user_id % 8 AS slots, value * 0.001::DOUBLE AS money, event_type FROM events) SELECT event_id, event_type = 'click' AND r >= 1200 AND slots > 2 AS graph, r >= 800 AND slots > 2 AS reranker, r >= 800 AND money >= 0.01 AS repair, CASE WHEN r < 800 THEN 4 WHEN r < 1200 THEN 6 ELSE 10 END AS top_k FROM s")
def budget_policy(spark: SparkSession, sf: str) -> DataFrame:
    e = scan(spark, sf, "events").select("event_id", (1500 - F.col("value") * 20).alias("remaining_ms"), (F.col("user_id") % 8).alias("slots"), (F.col("value") * 0.001).alias("money"), F.when(F.col("event_type") == "click", "complex").otherwise("simple").alias("complexity"))
    return reports.policy(e).select("event_id", "graph", "reranker", "repair", "top_k")


@query("SELECT doc_id, sha256('{\"lang\": ' || to_json(coalesce(lang, '')) || ', \"source\": ' || to_json(coalesce(source, '')) || '}') AS fingerprint FROM documents")
def version_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return reports.fingerprint(scan(spark, sf, "documents", "doc_id", "lang", "source"), "doc_id", ("lang", "source"))


@query(SUPPORT_SQL + """, rc AS (SELECT query_id, claim_no, best >= 0.35 AS good, claim || ' [' || unit_id || ']' AS cited FROM lb JOIN cl USING (query_id, claim_no)),
 ra AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE good) AS n_kept, coalesce(string_agg(cited, ' ' ORDER BY claim_no) FILTER (WHERE good), '') AS answer FROM rc GROUP BY 1) SELECT query_id, CASE WHEN n_kept = n THEN 'ANSWER' WHEN n_kept > 0 THEN 'REPAIRED' ELSE 'ABSTAIN' END AS decision, n_kept, answer FROM ra""")
def repaired_answers(spark: SparkSession, sf: str) -> DataFrame:
    _, claims, evidence = _claims(spark, sf)
    return reports.repair_or_abstain(claims.join(evaluation.claim_support(claims, evidence).select("query_id", "claim_no", "best"), ["query_id", "claim_no"]))


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1")
def commonest_language(spark: SparkSession, sf: str) -> DataFrame:
    return reports.commonest(scan(spark, sf, "documents", "source", "lang"), "source", "lang")


LOADS = tuple(round(0.1 * i, 1) for i in range(1, 13))


def _u(purpose: str) -> str:
    return f"('0x' || substr(md5('42|' || step || '|' || i || '|{purpose}'), 1, 8))::BIGINT / 4294967296"


LOAD_SQL = f"""WITH r AS (SELECT step, i, ([{', '.join(map(str, LOADS))}]::DOUBLE[])[step + 1] AS load FROM range(12) a(step), range(400) b(i)),
 l AS (SELECT *, {_u('cache')} < 0.20 AS cached, round(CASE WHEN {_u('cache')} < 0.20 THEN 70 + 40 * {_u('hit')} ELSE CASE WHEN {_u('recovery')} < 0.25 THEN 650 ELSE 0 END + 700 * CASE WHEN {_u('kind')} < 0.5 THEN 1.0::DOUBLE ELSE 1.55::DOUBLE END + greatest(0, 180 * load * load + 70 * (2 * {_u('queue')} - 1)) + 120 * {_u('noise')} END, 6) AS latency FROM r),
 q AS (SELECT load, cached OR (latency <= 5000 AND {_u('fail')} >= 0.02 * load) AS ok, latency > 5000 AS timed_out, latency, CASE WHEN cached THEN 0.004 ELSE 0.02 END::DOUBLE AS cost FROM l),
 s AS (SELECT load, count(*) AS n, round(avg(ok::INT), 6) AS availability, round(avg(timed_out::INT), 6) AS timeout_rate, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, round(quantile_cont(latency, 0.99), 6) AS p99, round(avg(cost), 6) AS cost FROM q GROUP BY 1),
 v AS (SELECT *, concat_ws(',', CASE WHEN availability < 0.995 THEN 'availability' END, CASE WHEN cost > 0.08 THEN 'cost' END, CASE WHEN p95 > 2500 THEN 'p95' END, CASE WHEN timeout_rate > 0.01 THEN 'timeout_rate' END) AS violations FROM s)"""


def _loads(spark: SparkSession) -> DataFrame:
    return evaluation.slo_report(reports.simulated_requests(spark, LOADS), {"availability": 0.995, "timeout_rate": 0.01, "p95": 2500.0, "cost": 0.08}, "load")


@query(LOAD_SQL + " SELECT *, violations = '' AS compliant FROM v")
def load_report(spark: SparkSession, sf: str) -> DataFrame:
    return _loads(spark)


@query(LOAD_SQL + " SELECT max(load) AS capacity, count(*) AS n_loads FROM v WHERE load < coalesce((SELECT min(load) FROM v WHERE violations <> ''), 1e9)")
def capacity(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.capacity_curve(_loads(spark), "load")
