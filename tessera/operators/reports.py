"""Reports on questions, runs and service: coverage, effects, regret, calibration, failures, policies, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Words left out of a question's terms, prefixes and words of the question types, tools, failure names,
# weights of evidence selection, gain of a recovery, limits of the policy.
TERM = r"[a-z0-9][a-z0-9\-α-ωβγδ]+"
TERM_STOP = ("a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "be", "been", "what", "which", "who", "where", "when", "does", "do", "did", "has", "have", "how", "why", "from", "that", "this", "these", "those", "can", "could", "may", "might", "as", "by", "at", "it", "its")
YES_NO = ("is ", "are ", "was ", "were ", "does ", "do ", "did ", "has ", "have ", "can ", "could ", "should ")
LISTED = ("list ", "name ", "what are ", "which are ", "what genes ", "what proteins ", "what factors ", "what classes ")
FACTOID = ("what is ", "what was ", "where is ", "who is ", "when did ", "which gene ", "which protein ", "which disease ")
SUMMARY = ("mechanism", "effects", "impact", "outcomes", "describe", "explain", "role of", "association between")
KINDS = (
    ("mechanism", ("why", "mechanism", "how does")), ("comparison", ("compare", "versus", "difference between")), ("association", ("risk", "association", "associated")),
    ("list", ("multiple", "which drugs", "what treatments", "list")), ("effect", ("effect", "affect", "impact")),
)
RELATIONS = ("treats", "causes", "associated_with", "increases_risk", "decreases_risk", "interacts_with", "expressed_in", "measured_by", "prevents", "relationship", "link", "pathway", "gene", "protein", "mutation")
HOPS = ("through", "between", "pathway", "leads to")
NAMED = r"\b[A-Z][A-Za-z0-9-]{2,}\b"
FAILURES = {
    "F01": "ingestion", "F02": "chunking", "F03": "entity extraction", "F04": "lexical miss", "F05": "dense miss", "F06": "ANN recall loss", "F07": "fusion",
    "F08": "reranker", "F09": "graph linking", "F10": "graph traversal", "F11": "PageIndex", "F12": "query expansion drift", "F13": "evidence incompleteness",
    "F14": "evidence conflict", "F15": "generation error", "F16": "hallucination", "F17": "citation failure", "F18": "should-have-abstained",
    "F19": "unnecessary retrieval", "F20": "latency/cost",
}
OVERLAP_GAIN, DIVERSITY, PROVENANCE, REDUNDANCY, PER_TOKEN = 0.25, 0.20, 0.05, 0.35, 0.001
MIN_GAIN = 0.02
SHORT_MS, TIGHT_MS, FEW_SLOTS, LITTLE_MONEY = 1200, 800, 2, 0.01
EPSILON = 1e-9


def parse_list(value: Column) -> Column:
    """The members of a JSON list, or of a text divided by semicolons, commas or bars, trimmed; empty ones go, null gives
    an empty list."""
    divided = F.split(value, r"[;,|]")
    members = F.transform(F.coalesce(F.from_json(value, "array<string>"), divided), lambda x: F.trim(x))
    return F.coalesce(F.filter(members, lambda x: x != ""), F.array().cast("array<string>"))


def usable_gold(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, n_gold, n_empty, n_usable, has_usable): gold passages with and without text."""
    empty = docs.select(F.col("doc_id").alias("unit_id"), T.is_empty_text(F.col("text")).alias("empty"))
    g = gold.join(empty, "unit_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"), F.count_if("empty").alias("n_empty"))
    usable = F.col("n_gold") - F.col("n_empty")
    return g.select("*", usable.alias("n_usable"), (usable > 0).alias("has_usable"))


def canonical_stats(docs: DataFrame, questions: DataFrame, gold: DataFrame) -> DataFrame:
    """(metric, value): rows, empty and repeated passages, gold relations, lengths in words."""
    t = F.col("text")
    d = docs.select(T.is_empty_text(t).alias("empty"), F.sha2(T.collapse_spaces(F.coalesce(t, F.lit(""))), 256).alias("sha"), F.size(T.tokens(t)).alias("words"))
    usable = F.when(~F.col("empty"), F.col("words"))
    twice = d.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("unique_texts"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_rows"))
    rows = d.agg(F.count(F.lit(1)).alias("passages"), F.count_if("empty").alias("empty_passages"), F.percentile(usable, F.lit(0.5)).alias("median_words"), F.percentile(usable, F.lit(0.95)).alias("p95_words"))
    asked = questions.agg(F.count(F.lit(1)).alias("questions"), F.percentile(F.size(T.tokens(F.col("question"))), F.lit(0.5)).alias("median_question_words"))
    linked = gold.agg(F.count(F.lit(1)).alias("gold_relations"), F.countDistinct("query_id").alias("questions_with_gold"))
    one = rows.join(F.broadcast(twice)).join(F.broadcast(asked)).join(F.broadcast(linked))
    return one.select([F.col(c).cast("double") for c in one.columns]).unpivot([], one.columns, "metric", "value").withColumn("value", F.round("value", 6))


def metadata_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, metadata): the other columns as JSON in the order of their names, nulls kept."""
    return rows.select(key, F.to_json(F.struct(*sorted(c for c in rows.columns if c != key)), {"ignoreNullFields": "false"}).alias("metadata"))


def terms(text: Column) -> Column:
    """The distinct terms of a question or passage."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*TERM_STOP)))


def gold_term_coverage(questions: DataFrame, gold: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, n_terms, coverage): share of a question's terms that its gold passages hold between them."""
    asked = questions.select("query_id", terms(F.col("question")).alias("q"))
    wanted = asked.select("query_id", F.explode("q").alias("w"))
    held = gold.join(units, "unit_id").select("query_id", F.explode(terms(F.col("text"))).alias("w")).distinct()
    n = wanted.join(held.withColumn("held", F.lit(1)), ["query_id", "w"], "left").groupBy("query_id").agg(F.round(F.count("held") / F.count(F.lit(1)), 9).alias("share"))
    return asked.join(n, "query_id", "left").select("query_id", F.size("q").cast("long").alias("n_terms"), F.coalesce("share", F.lit(0.0)).alias("coverage"))


def lineage(gold: DataFrame, canonical: DataFrame, prefix: str = "DOC-") -> DataFrame:
    """(query_id, canonical_id, raw_sha256): from a question by its gold passages to the raw text's digest."""
    return gold.withColumn("canonical_id", F.concat(F.lit(prefix), F.col("unit_id").cast("string"))).join(canonical, "canonical_id").select("query_id", "canonical_id", "raw_sha256")


def inferred_type(question: Column) -> Column:
    """The type of a question by how it begins, else by a word in it."""
    q = F.lower(F.trim(question))
    begins = lambda prefixes: F.exists(F.array(*map(F.lit, prefixes)), lambda p: q.startswith(p))
    named = F.exists(F.array(*map(F.lit, SUMMARY)), lambda p: F.contains(q, p))
    return F.when(begins(YES_NO), "yes_no_candidate").when(begins(LISTED), "list_or_factoid_candidate").when(begins(FACTOID), "factoid_candidate").when(named, "summary_or_mechanism_candidate").otherwise("other")


def query_analysis(questions: DataFrame) -> DataFrame:
    """(query_id, kind, n_entities, relation_signal, multi_hop, complexity, primary_tools, recovery_tools)."""
    low = F.lower("question")
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    kind = F.coalesce(*[F.when(has(words), name) for name, words in KINDS], F.lit("factoid"))
    q = questions.select("query_id", kind.alias("kind"), F.size(F.regexp_extract_all(T.word_edges(F.col("question")), F.lit(NAMED), F.lit(0))).cast("long").alias("n_entities"), has(RELATIONS).alias("relation_signal"), has(HOPS).alias("hop"), F.size(T.tokens(low)).alias("n"))
    q = q.withColumn("multi_hop", F.col("relation_signal") & ((F.col("n_entities") >= 2) | F.col("hop")))
    hard = F.col("kind").isin("comparison", "mechanism")
    q = q.withColumn("complexity", F.when(F.col("multi_hop") | (F.col("n") > 28) | hard, "high").when(F.col("n") > 16, "medium").otherwise("low"))
    high = F.col("complexity") == "high"
    deep, wide = F.when(hard | high, "decompose,pageindex"), F.when(F.col("kind").isin("factoid", "association", "effect") & ~high, "query2doc,hyde")
    tools = [F.when(F.col("multi_hop"), "hybrid,graph").otherwise("hybrid").alias("primary_tools"), F.concat_ws(",", deep, wide).alias("recovery_tools")]
    return q.select("query_id", "kind", "n_entities", "relation_signal", "multi_hop", "complexity", *tools)


def graded_metrics(questions: DataFrame, ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, hit, recall, ndcg, mrr): null for a question without gold but for mrr, which is 0; mrr sees the whole
    list and the ideal of ndcg are the gold passages that were retrieved."""
    r = ranked.join(gold.distinct(), ["query_id", "unit_id"]).select("query_id", "rank", (F.col("rank") <= k).alias("top"))
    f = r.groupBy("query_id").agg(F.count_if("top").alias("hits"), F.min("rank").alias("first"), F.sum(F.when(F.col("top"), 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"))
    m = questions.select("query_id").join(gold.groupBy("query_id").agg(F.countDistinct("unit_id").alias("n_gold")), "query_id", "left").join(f, "query_id", "left")
    hits = F.coalesce("hits", F.lit(0)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(hits, F.lit(1))), F.lit(0.0), lambda a, x: a + 1 / F.log2(x + 1.0))
    known = lambda c: F.when(F.col("n_gold").isNotNull(), c)
    return m.select("query_id", known((hits > 0).cast("double")).alias("hit"), known(F.round(hits / F.col("n_gold"), 9)).alias("recall"), known(F.round(F.when(hits > 0, F.col("dcg") / ideal).otherwise(0.0), 9)).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9).alias("mrr"))


def effects(pairs: DataFrame) -> DataFrame:
    """(effect, n, share, mean_gain): how many questions a step HELPED, HURT or left NEUTRAL: pairs (query_id, x, y)."""
    gain = F.col("y") - F.col("x")
    e = F.when(gain > EPSILON, "HELPED").when(gain < -EPSILON, "HURT").otherwise("NEUTRAL")
    n = pairs.select(e.alias("effect"), gain.alias("gain")).groupBy("effect").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gain"), 6).alias("mean_gain"))
    total = pairs.agg(F.count(F.lit(1)).alias("total"))
    return n.crossJoin(F.broadcast(total)).select("effect", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), "mean_gain")


def recovery(pairs: DataFrame, attempted: Column) -> DataFrame:
    """One row: second attempts and the share of them that gained at least MIN_GAIN, null without any."""
    gained = (F.round(F.col("y") - F.col("x"), 9) >= MIN_GAIN).cast("int")
    return pairs.where(attempted).agg(F.count(F.lit(1)).alias("n_attempts"), F.round(F.avg(gained), 6).alias("success"))


def chosen_regret(scores: DataFrame, chosen: str) -> DataFrame:
    """(query_id, oracle, chosen, regret): scores (query_id, config, utility) against the best configuration's."""
    s = scores.groupBy("query_id").agg(F.max("utility").alias("oracle"), F.max(F.when(F.col("config") == chosen, F.col("utility"))).alias("chosen"))
    return s.withColumn("regret", F.round(F.col("oracle") - F.col("chosen"), 9))


def recipe_leaderboard(runs: DataFrame, base: str) -> DataFrame:
    """(config, n, hit, recall, mrr, ndcg, delta, place): means of each recipe, its ndcg against the base's, best first.

    Recipes are few: they are ranked in one window.
    """
    m = runs.groupBy("config").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("hit", "recall", "mrr", "ndcg")])
    b = m.where(F.col("config") == base).select(F.col("ndcg").alias("of_base"))
    return m.join(F.broadcast(b), how="left").select(*m.columns, F.round(F.col("ndcg") - F.col("of_base"), 4).alias("delta"), F.row_number().over(Window.orderBy(F.desc("ndcg"), "config")).alias("place"))


def calibration(scores: DataFrame, default: str) -> DataFrame:
    """One row: how often the judge's pick is as good as the best, its regret, and the utility of pick, default and best.

    scores: (query_id, config, judged, utility); the judge takes the highest, then the first name.
    """
    s = scores.groupBy("query_id").agg(
        F.max("utility").alias("best"), F.max(F.when(F.col("config") == default, F.col("utility"))).alias("usual"),
        F.min(F.struct((-F.col("judged")).alias("less"), "config", "utility")).alias("pick"),
    )
    lost = F.col("best") - F.col("pick.utility")
    names = {"oracle_share": (lost <= EPSILON).cast("int"), "regret": lost, "picked": F.col("pick.utility"), "default": F.col("usual"), "oracle": F.col("best")}
    return s.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(v), 6).alias(k) for k, v in names.items()])


def failure_tags(outcomes: DataFrame) -> DataFrame:
    """Adds failure_tags of (query_id, hit, recall, delta): nothing found, not all found, a reranker that made it worse."""
    tags = (F.when(F.col("hit") == 0, "F04"), F.when(F.col("delta") < -EPSILON, "F08"), F.when(F.col("recall") < 1, "F13"))
    return outcomes.withColumn("failure_tags", F.array_compact(F.array(*tags)))


def failure_counts(tagged: DataFrame) -> DataFrame:
    """(failure_code, failure_name, n): rows with each tag; a tag without a name is its own."""
    t = tagged.select(F.explode("failure_tags").alias("failure_code")).groupBy("failure_code").agg(F.count(F.lit(1)).alias("n"))
    names = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])
    return t.select("failure_code", F.coalesce(F.element_at(names, F.col("failure_code")), F.col("failure_code")).alias("failure_name"), "n")


def complexity_features(questions: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, n_gold, bucket, n_words): how many passages a question needs and how long it is."""
    n = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    k = F.coalesce("n_gold", F.lit(0))
    bucket = F.when(k <= 1, "single-passage").when(k == 2, "two-passage").otherwise("multi-passage")
    return questions.join(n, "query_id", "left").select("query_id", k.alias("n_gold"), bucket.alias("bucket"), F.size(T.tokens(F.col("question"))).cast("long").alias("n_words"))


def efficiency(requests: DataFrame, key: str) -> DataFrame:
    """(key, utility, efficiency): mean utility, and utility for the weighed cost of time, tokens and money, null if free."""
    spent = F.greatest(F.coalesce("latency", F.lit(0.0)), F.lit(0.0)) + 0.001 * F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)) + F.greatest(F.coalesce("cost", F.lit(0.0)), F.lit(0.0))
    return requests.groupBy(key).agg(F.round(F.avg("utility"), 6).alias("utility"), F.round(F.avg(F.when(spent > 0, F.col("utility") / spent)), 6).alias("efficiency"))


def policy(states: DataFrame) -> DataFrame:
    """Adds graph, reranker, repair and top_k: what a request may still use, from (remaining_ms, slots, money, complexity)."""
    short, tight, full, poor = F.col("remaining_ms") < SHORT_MS, F.col("remaining_ms") < TIGHT_MS, F.col("slots") <= FEW_SLOTS, F.col("money") < LITTLE_MONEY
    flags = {"graph": F.col("complexity").isin("multi-hop", "complex") & ~short & ~full, "reranker": ~tight & ~full, "repair": ~tight & ~poor, "top_k": F.when(tight, 4).when(short, 6).otherwise(10)}
    return states.select("*", *[v.alias(k) for k, v in flags.items()])


def fingerprint(rows: DataFrame, key: str, parts: tuple[str, ...]) -> DataFrame:
    """(key, fingerprint): SHA-256 of the named parts as JSON in the order of their names, spaced as Python writes it."""
    fields = [F.concat(F.lit(f'"{p}": '), F.regexp_replace(F.to_json(F.array(F.coalesce(F.col(p).cast("string"), F.lit("")))), r"^\[|\]$", "")) for p in sorted(parts)]
    return rows.select(key, F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")), 256).alias("fingerprint"))


def context_sweep(ranked: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """(k, tokens, precision, recall, n): mean length and evidence of the first k passages, over questions with gold."""
    r = ranked.join(gold.distinct().withColumn("good", F.lit(1)), ["query_id", "unit_id"], "left").select("query_id", "rank", "n_tokens", "good")
    n = gold.groupBy("query_id").agg(F.countDistinct("unit_id").alias("n_gold")).withColumn("k", F.explode(F.array(*map(F.lit, cuts))))
    kept = r.join(n, "query_id").where(F.col("rank") <= F.col("k")).groupBy("query_id", "k", "n_gold").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("m"), F.count("good").alias("good"))
    return kept.groupBy("k").agg(F.round(F.avg("tokens"), 4).alias("tokens"), F.round(F.avg(F.col("good") / F.col("m")), 6).alias("precision"), F.round(F.avg(F.col("good") / F.col("n_gold")), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


def utility_select(pool: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, unit_id, place): greedy choice by score, likeness to the question, novelty and shortness.

    pool (query_id, unit_id, rank, score, question, text) is bounded by the reranking pool. Ties go to the better rank. A
    query's pool is one array, from which a fold takes the best k times.
    """
    words = lambda c: F.array_distinct(T.search_tokens(F.col(c)))
    w = pool.select("query_id", "unit_id", "rank", words("text").alias("w"), (F.col("score") + OVERLAP_GAIN * T.jaccard(words("question"), words("text")) + DIVERSITY + PROVENANCE - PER_TOKEN * F.size(T.tokens(F.col("text")))).alias("own"))
    items = w.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "unit_id", "w", "own"))).alias("pool"))

    def worth(x: Column, taken: Column) -> Column:
        most = F.aggregate(taken, F.lit(0.0), lambda a, y: F.greatest(a, T.jaccard(x["w"], y["w"])))
        return F.round(x["own"] - (DIVERSITY + REDUNDANCY) * most, 9)

    def take(taken: Column, _: Column) -> Column:
        left = F.filter("pool", lambda x: ~F.exists(taken, lambda y: y["rank"] == x["rank"]))
        best = F.array_min(F.transform(left, lambda x: F.struct((-worth(x, taken)).alias("less"), x["rank"].alias("rank"), x.alias("item"))))
        return F.concat(taken, F.transform(F.array(best), lambda b: b["item"]))

    chosen = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.size("pool"))), F.filter("pool", lambda x: F.lit(False)), take)
    return items.select("query_id", F.posexplode(F.transform(chosen, lambda x: x["unit_id"])).alias("at", "unit_id")).select("query_id", "unit_id", (F.col("at") + 1).alias("place"))


def provenance_scores(edges: DataFrame, seeds: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, unit_id, support, place): passages by how many edges at a question's seeds they state; ids break ties.

    edges: (src, dst, predicate, unit_id), one row each. An edge between two seeds counts once.
    """
    s = seeds.select("query_id", F.col("entity"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("entity"), F.struct("src", "dst", "predicate").alias("edge"), "unit_id")
    e = ends.join(s, "entity").select("query_id", "unit_id", "edge").distinct().groupBy("query_id", "unit_id").agg(F.count(F.lit(1)).alias("support"))
    return e.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("support"), "unit_id"))).where(F.col("place") <= most)


def repair_or_abstain(claims: DataFrame, least: float = 0.35) -> DataFrame:
    """(query_id, decision, n_kept, answer): all claims if each has support of at least `least`, else those that have, else
    none; a kept claim is followed by its citations in order.

    claims: (query_id, claim_no, claim, citations, best), a few to a question.
    """
    cited = F.concat_ws(" ", "claim", F.transform(F.array_sort(F.array_distinct(F.transform("citations", lambda c: c.cast("string")))), lambda c: F.concat(F.lit("["), c, F.lit("]"))))
    good = F.col("best") >= least
    kept = F.array_sort(F.collect_list(F.when(good, F.struct("claim_no", cited.alias("cited")))))
    a = claims.groupBy("query_id").agg(F.count_if(good).alias("n_kept"), F.count(F.lit(1)).alias("n"), kept.alias("kept"))
    decision = F.when(F.col("n_kept") == F.col("n"), "ANSWER").when(F.col("n_kept") > 0, "REPAIRED").otherwise("ABSTAIN")
    return a.select("query_id", decision.alias("decision"), "n_kept", F.array_join(F.transform("kept", lambda x: x["cited"]), " ").alias("answer"))


def commonest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the commonest value of each key, the smallest of several; nulls do not count."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("v"))).alias("m")).select(key, F.col("m.v").alias(value), (-F.col("m.less")).alias("n"))


def best_config(judged: DataFrame) -> DataFrame:
    """(query_id, best, evidence_score, margin): the configuration the judge likes most, the first name of several, and how
    far it is ahead of the one it likes least. judged: (query_id, config, judged)."""
    j = judged.groupBy("query_id").agg(F.min(F.struct((-F.col("judged")).alias("less"), "config")).alias("m"), F.min("judged").alias("least"))
    return j.select("query_id", F.col("m.config").alias("best"), (-F.col("m.less")).alias("evidence_score"), F.round(-F.col("m.less") - F.col("least"), 6).alias("margin"))


def simulated_requests(spark, loads: tuple[float, ...], n: int = 400, seed: int = 42) -> DataFrame:
    """(load, i, ok, timed_out, latency, cost): requests at each load, drawn by hashes of seed, load, request and purpose."""
    key = F.concat_ws("|", F.lit(str(seed)), F.col("step").cast("string"), F.col("i").cast("string"))
    u = lambda purpose: F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + purpose))), 1, 8), 16, 10).cast("long") / 4294967296.0
    step = F.floor(F.col("id") / n).cast("int")
    r = spark.range(len(loads) * n).select(step.alias("step"), (F.col("id") % n).alias("i")).withColumn("load", F.element_at(F.array(*map(F.lit, loads)), F.col("step") + 1))
    queue = F.greatest(F.lit(0.0), 180 * F.col("load") * F.col("load") + 70 * (2 * u("queue") - 1))
    slow = F.when(u("recovery") < 0.25, 650).otherwise(0) + 700 * F.when(u("kind") < 0.5, 1.0).otherwise(1.55)
    cached = u("cache") < 0.20
    latency = F.round(F.when(cached, 70 + 40 * u("hit")).otherwise(slow + queue + 120 * u("noise")), 6)
    late = latency > 5000
    return r.select("load", "i", (cached | (~late & (u("fail") >= 0.02 * F.col("load")))).alias("ok"), late.alias("timed_out"), latency.alias("latency"), F.when(cached, 0.004).otherwise(0.02).alias("cost"))
