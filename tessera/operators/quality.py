"""How well chunkers keep passages whole: cost, intrinsic scores, cohesion, integrity, and the choice among them.

Chunks are (unit_id, strategy, chunk_index, text, n_tokens), of several strategies in one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Patterns of signals and of openings that refer back, weights of the intrinsic score, price and size of a
# vector, confidence of each routing rule, limits from which the costly chunker is asked.
ENTITY = r"(?i)\b(?:BRCA\d*|EGFR|KRAS|BRAF|p53|COX[- ]?2|aspirin|olaparib|breast cancer|ovarian cancer)\b"
RELATION = r"(?i)\b(?:inhibits?|activates?|associated with|increases?|decreases?|causes?|reduces?|induces?|interacts with)\b"
NEGATION = r"(?i)\b(?:no|not|never|without|absence of|did not|does not)\b"
BACK_REFERENCE = r"(?i)^(?:this|that|these|those|it|they|them|such|the former|the latter)\b"
CLOSED = r"[.!?)\]]$"
COHESION_TOKEN = r"[A-Za-z0-9-]+"
BOUNDARY, SIZE, SIGNAL, UNIQUE = 0.30, 0.25, 0.25, 0.20
MAX_TOKENS = 384
USD_PER_1K, VECTOR_BYTES = 0.0001, 1536 * 4
CONFIDENCE = (0.90, 0.82, 0.78, 0.76, 0.73, 0.65)
SURE, SHIFTED, RELATIONAL, SENTENCES, DISAGREED = 0.70, 0.75, 0.02, 5, 0.25


def gold_compatibility(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """(strategy, n_gold, represented, coverage_pct): gold passages of which a strategy holds any chunk."""
    wanted = gold.select("unit_id").distinct()
    held = chunks.select("strategy", "unit_id").distinct().join(wanted.withColumn("gold", F.lit(1)), "unit_id", "left")
    n = wanted.agg(F.count(F.lit(1)).alias("n_gold"))
    by = held.groupBy("strategy").agg(F.count("gold").alias("represented"))
    return by.crossJoin(F.broadcast(n)).select("strategy", "n_gold", "represented", F.round(100 * F.col("represented") / F.greatest("n_gold", F.lit(1)), 6).alias("coverage_pct"))


def index_cost(chunks: DataFrame, n_passages: DataFrame, base: str) -> DataFrame:
    """What each strategy's vectors cost to make and hold, and how many times the chunks of the base strategy it has.

    n_passages: one row (n_passages).
    """
    by = chunks.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), F.expr("percentile(n_tokens, 0.5)").alias("median_tokens"))
    of_base = by.where(F.col("strategy") == base).select(F.col("n_chunks").alias("base"))
    return by.join(F.broadcast(n_passages)).join(F.broadcast(of_base), how="left").select(
        "strategy", "n_chunks", "n_tokens", "median_tokens",
        F.round(F.col("n_chunks") / F.greatest("n_passages", F.lit(1)), 3).alias("per_passage"),
        F.round(F.col("n_tokens") * USD_PER_1K / 1000, 4).alias("usd"),
        (F.col("n_chunks") * VECTOR_BYTES).alias("bytes"),
        F.round(F.col("n_chunks") / F.coalesce("base", F.lit(1)), 2).alias("explosion"),
    )


def intrinsic_metrics(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each passage and strategy: shares of closed and of small chunks, signals, repeats, expansion, score."""
    t = F.col("text")
    has = lambda pattern: T.word_edges(t).rlike(pattern).cast("int")
    n = F.count(F.lit(1))
    c = chunks.groupBy("unit_id", "strategy").agg(
        n.alias("n_chunks"), F.avg(t.rlike(CLOSED).cast("int")).alias("closed"), F.avg((F.col("n_tokens") <= MAX_TOKENS).cast("int")).alias("small"),
        F.least(F.lit(1.0), F.sum(2 * has(ENTITY) + has(RELATION) + has(NEGATION)) / (4 * n)).alias("signal"),
        (1 - F.countDistinct(F.sha2(t, 256)) / n).alias("repeats"), F.sum("n_tokens").alias("n_tokens"),
    )
    source = passages.select("unit_id", F.greatest(F.size(T.tokens(F.col("text"))), F.lit(1)).alias("n_source"))
    return intrinsic_scores(c.join(source, "unit_id"))


def intrinsic_scores(c: DataFrame) -> DataFrame:
    """The rows of intrinsic_metrics from the shares of closed and small chunks, signals and repeats, and both lengths."""
    score = BOUNDARY * F.col("closed") + SIZE * F.col("small") + SIGNAL * F.col("signal") + UNIQUE * (1 - F.col("repeats"))
    cols = {"boundary_quality": F.col("closed"), "size_compliance": F.col("small"), "biomedical_signal": F.col("signal"), "redundancy": F.col("repeats"), "token_expansion": F.col("n_tokens") / F.col("n_source"), "score": score}
    return c.select("unit_id", "strategy", "n_chunks", *[F.round(v, 6).alias(k) for k, v in cols.items()])


def cohesion(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(strategy, icc, dcc, rc): mean likeness of neighbouring sentences within a chunk (1 for a single sentence), share of
    a chunk's vocabulary found in its passage, share of chunks that do not open by referring back.

    Chunks are brought together with the passages of their id and scored there; their words are not shuffled.
    """
    from tessera.operators import passage_scores

    return passage_scores.cohesion_means(passage_scores.cohesion_sums_of(passages, chunks))


def source_signals(passages: DataFrame) -> DataFrame:
    """(unit_id, kind, signal, n): entities and negations as often as they occur, and whole sentences with a relation."""
    t = F.col("text")
    found = lambda pattern: F.transform(F.regexp_extract_all(T.word_edges(t), F.lit(pattern), F.lit(0)), lambda s: F.lower(s))
    told = F.transform(F.filter(T.sentences(t), lambda s: T.word_edges(s).rlike(RELATION)), T.question_key)

    def named(kind: str, signals: Column) -> Column:
        return F.transform(signals, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("signal")))

    every = F.concat(named("entity", found(ENTITY)), named("negation", found(NEGATION)), named("relation", told))
    return passages.select("unit_id", F.explode(every).alias("s")).groupBy("unit_id", "s.kind", "s.signal").agg(F.count(F.lit(1)).alias("n"))


def integrity(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(strategy, kind, n_checked, intact): share of a passage's signals that one of its chunks holds whole.

    Passages of which a strategy has no chunk are left out. A passage costs its distinct signals times its chunks.
    """
    held = chunks.select("strategy", "unit_id", T.question_key(F.col("text")).alias("low"))
    both = held.join(source_signals(passages), "unit_id")
    each = both.groupBy("strategy", "unit_id", "kind", "signal").agg(F.max("n").alias("n"), F.max(F.contains("low", "signal")).alias("whole"))
    return each.groupBy("strategy", "kind").agg(F.sum("n").alias("n_checked"), F.round(F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("intact"))


def rule_confidence(profile: DataFrame) -> DataFrame:
    """Adds confidence: that of the rule which gave a profile its route."""
    short, told, named, shifted, long, rest = map(F.lit, CONFIDENCE)
    by = (
        F.when(F.col("n_tokens") <= 180, short)
        .when(F.col("route") == "biomedical", F.when((F.col("relation_density") >= 0.015) & (F.col("negation_density") > 0), told).otherwise(named))
        .when(F.col("route") == "semantic", shifted)
        .when(F.col("route") == "parent_child", long)
        .otherwise(rest)
    )
    return profile.withColumn("confidence", by)


def disagreement(chunks: DataFrame) -> DataFrame:
    """(unit_id, disagreement): 1 less the share of strategies that give the passage its commonest number of chunks."""
    n = chunks.groupBy("unit_id", "strategy").agg(F.count(F.lit(1)).alias("k")).groupBy("unit_id", "k").agg(F.count(F.lit(1)).alias("votes"))
    return n.groupBy("unit_id").agg(F.round(1 - F.max("votes") / F.sum("votes"), 6).alias("disagreement"))


def trigger(profile: DataFrame, apart: DataFrame) -> DataFrame:
    """(unit_id, confidence, disagreement, reason, triggered): whether a passage is worth the costly chunker, and why."""
    p = rule_confidence(profile).join(apart, "unit_id", "left").withColumn("disagreement", F.coalesce("disagreement", F.lit(0.0)))
    reason = (
        F.when(F.col("confidence") < SURE, "low_router_confidence")
        .when(F.col("topic_shift") > SHIFTED, "high_topic_shift")
        .when((F.col("relation_density") > RELATIONAL) & (F.col("n_sentences") > SENTENCES), "high_relation_density")
        .when(F.col("disagreement") > DISAGREED, "candidate_disagreement")
        .otherwise("normal_route")
    )
    return p.select("unit_id", "confidence", "disagreement", reason.alias("reason"), (reason != "normal_route").alias("triggered"))


def selection(scores: DataFrame, profile: DataFrame, fallback: str) -> DataFrame:
    """(unit_id, choice, stopped_by, oracle, accurate, regret): the strategy an agent takes, against the best by score.

    The agent follows a rule it is sure of if that strategy was tried, else it takes the best score; ties go to the first
    name. A sure route to a strategy that was not tried falls back on the one named.
    """
    b = scores.groupBy("unit_id").agg(F.max("score").alias("top"), F.collect_list(F.struct("strategy", "score")).alias("all"))
    oracle = F.array_min(F.transform(F.filter("all", lambda x: x["score"] == F.col("top")), lambda x: x["strategy"]))
    b = b.select("unit_id", "top", oracle.alias("oracle"), F.map_from_entries("all").alias("by"))
    p = rule_confidence(profile).select("unit_id", "route", "confidence")
    b = b.join(p, "unit_id")
    sure = F.col("confidence") >= SURE
    tried = F.when(F.map_contains_key("by", F.col("route")), F.col("route")).otherwise(F.lit(fallback))
    b = b.withColumn("choice", F.when(sure, tried).otherwise(F.col("oracle")))
    lost = F.round(F.col("top") - F.coalesce(F.element_at("by", F.col("choice")), F.lit(0.0)), 6)
    return b.select("unit_id", "choice", F.when(sure, "rule").otherwise("score").alias("stopped_by"), "oracle", (F.col("choice") == F.col("oracle")).alias("accurate"), lost.alias("regret"))
