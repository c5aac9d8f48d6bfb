"""Answers, citations, metrics, run comparison and service-level checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Support thresholds of a citation, and the budget of a context in tokens.
STRONG, WEAK = 0.5, 0.2
CONTEXT_TOKENS = 1200
EPSILON = 1e-9


def extractive_answer(ranked: DataFrame, n_passages: int = 3, n_sentences: int = 2) -> DataFrame:
    """The best sentence of each of the first passages by shared question words (the first wins), the best two joined.

    ranked: (query_id, question, unit_id, rank, text).
    """
    s = ranked.where(F.col("rank") <= n_passages).select("query_id", "unit_id", "rank", F.array_distinct(T.search_tokens(F.col("question"))).alias("q"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    s = s.withColumn("shared", F.size(F.array_intersect("q", F.array_distinct(T.search_tokens(F.col("sentence"))))))
    best = s.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "unit_id").orderBy(F.desc("shared"), "pos"))).where("place = 1")
    top = best.where(F.col("rank") <= n_sentences)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"]), " ")
    return top.groupBy("query_id").agg(joined.alias("answer"), F.sum("shared").alias("shared_words"))


def claims_of(ranked: DataFrame, n_passages: int = 3) -> DataFrame:
    """(query_id, claim_no, claim, citations): the best sentence of each of the first passages, which it cites."""
    s = ranked.where(F.col("rank") <= n_passages).select("query_id", "unit_id", "rank", F.array_distinct(T.search_tokens(F.col("question"))).alias("q"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    s = s.withColumn("shared", F.size(F.array_intersect("q", F.array_distinct(T.search_tokens(F.col("sentence"))))))
    best = s.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "unit_id").orderBy(F.desc("shared"), "pos"))).where("place = 1")
    return best.select("query_id", F.col("rank").alias("claim_no"), F.col("sentence").alias("claim"), F.array("unit_id").alias("citations"))


# Words that do not count as content of a claim; an answer's metrics leave out all but "whom".
CLAIM_STOP = ("the", "a", "an", "and", "or", "of", "to", "in", "is", "are", "was", "were", "for", "with", "on", "at", "by", "as", "that", "this", "these", "those", "be", "been", "it", "its", "from", "which", "who", "whom", "can", "may")
ANSWER_STOP = tuple(w for w in CLAIM_STOP if w != "whom")
# Grounding and coverage of sufficient evidence, grounding of weak evidence.
GROUNDED, COVERED, WEAKLY_GROUNDED = 0.6, 0.4, 0.3


def support(claim: Column, evidence: Column) -> Column:
    """Share of the claim's content words found in the evidence."""
    c, e = T.content_words(claim, CLAIM_STOP), T.content_words(evidence, CLAIM_STOP)
    return F.when(F.size(c) > 0, F.size(F.array_intersect(c, e)) / F.size(c)).otherwise(F.lit(0.0))


def support_label(share: Column) -> Column:
    return F.when(share >= STRONG, "SUPPORTED").when(share >= WEAK, "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")


def claim_support(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, claim_no, n_citations, n_valid, best, label): citations of passages that are no evidence are dropped."""
    cited = claims.select("query_id", "claim_no", "claim", F.explode_outer("citations").alias("unit_id")).join(evidence, ["query_id", "unit_id"], "left")
    cited = cited.withColumn("s", F.when(F.col("text").isNotNull(), support(F.col("claim"), F.col("text"))))
    by = cited.groupBy("query_id", "claim_no").agg(F.count("unit_id").alias("n_citations"), F.count("s").alias("n_valid"), F.round(F.coalesce(F.max("s"), F.lit(0.0)), 9).alias("best"))
    return by.withColumn("label", support_label(F.col("best")))


def label_histogram(supported: DataFrame) -> DataFrame:
    return supported.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / F.sum(F.count(F.lit(1))).over(Window.partitionBy()), 9).alias("share"))


def answer_metrics(answers: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, grounding, coverage, faithfulness, status): content words of the answer that the evidence holds, the
    share of evidence that claims cite, the share of supported claims, and what these say of the evidence."""
    own = answers.select("query_id", F.explode(T.content_words(F.col("answer"), ANSWER_STOP)).alias("w"))
    held = evidence.select("query_id", F.explode(T.content_words(F.col("text"), ANSWER_STOP)).alias("w")).distinct().withColumn("held", F.lit(1))
    grounding = own.join(held, ["query_id", "w"], "left").groupBy("query_id").agg(F.round(F.avg(F.coalesce("held", F.lit(0))), 4).alias("grounding"))
    cited = claims.select("query_id", F.explode("citations").alias("unit_id")).distinct().withColumn("cited", F.lit(1))
    coverage = evidence.select("query_id", "unit_id").distinct().join(cited, ["query_id", "unit_id"], "left").groupBy("query_id").agg(F.round(F.avg(F.coalesce("cited", F.lit(0))), 4).alias("coverage"))
    faith = claim_support(claims, evidence).groupBy("query_id").agg(F.round(F.avg((F.col("label") == "SUPPORTED").cast("int")), 4).alias("faithfulness"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    m = answers.select("query_id").join(grounding, "query_id", "left").join(coverage, "query_id", "left").join(faith, "query_id", "left").select("query_id", zero("grounding"), zero("coverage"), zero("faithfulness"))
    return m.withColumn("status", F.when((F.col("grounding") >= GROUNDED) & (F.col("coverage") >= COVERED), "sufficient").when(F.col("grounding") >= WEAKLY_GROUNDED, "weak").otherwise("insufficient"))


def validate_citations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per question: citations, phantoms, precision, recall and the number of claims by support label.

    claims: (query_id, claim_no, claim, citations array of unit ids); evidence: (query_id, unit_id, text).
    """
    cited = claims.select("query_id", "claim_no", "claim", F.explode("citations").alias("unit_id")).join(evidence, ["query_id", "unit_id"], "left")
    cited = cited.withColumn("s", F.when(F.col("text").isNotNull(), support(F.col("claim"), F.col("text"))))
    c = cited.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_citations"), F.count_if(F.col("s").isNull()).alias("n_phantom"), F.count_if(F.col("s") >= WEAK).alias("n_good"), F.countDistinct(F.when(F.col("s").isNotNull(), F.col("unit_id"))).alias("n_used"))
    best = cited.groupBy("query_id", "claim_no").agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("best"))
    labels = best.groupBy("query_id").agg(F.count_if(F.col("best") >= STRONG).alias("n_strong"), F.count_if((F.col("best") >= WEAK) & (F.col("best") < STRONG)).alias("n_weak"), F.count_if(F.col("best") < WEAK).alias("n_unsupported"))
    size = evidence.groupBy("query_id").agg(F.countDistinct("unit_id").alias("n_evidence"))
    return c.join(labels, "query_id").join(size, "query_id", "left").select("*", (F.col("n_good") / F.col("n_citations")).alias("precision"), F.coalesce(F.col("n_used") / F.col("n_evidence"), F.lit(0.0)).alias("recall"))


def pack_context(ranked: DataFrame, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """Passages in rank order until the first that overflows the budget."""
    d = ranked.select("query_id", "unit_id", "rank", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))
    run = F.sum("n_tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("used", run).where(F.col("used") <= budget)


def token_f1(pairs: DataFrame) -> DataFrame:
    """Multiset token precision, recall and F1 of (pair_id, answer, reference), after a simple normalisation."""
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " "), " +"), lambda w: (w != "") & ~w.isin("a", "an", "the"))
    p = pairs.select("pair_id", words(F.col("answer")).alias("a"), words(F.col("reference")).alias("r"))
    count = lambda c, n: p.select("pair_id", F.explode(c).alias("w")).groupBy("pair_id", "w").agg(F.count(F.lit(1)).alias(n))
    same = count("a", "x").join(count("r", "y"), ["pair_id", "w"]).groupBy("pair_id").agg(F.sum(F.least("x", "y")).alias("same"))
    d = p.select("pair_id", F.size("a").alias("na"), F.size("r").alias("nr")).join(same, "pair_id", "left")
    n = F.coalesce("same", F.lit(0))
    return d.select("pair_id", F.when((F.col("na") + F.col("nr")) > 0, 2 * n / (F.col("na") + F.col("nr"))).otherwise(F.lit(0.0)).alias("f1"))


def slices(results: DataFrame, dimensions: tuple[str, ...], metric: str) -> DataFrame:
    """Means of a metric by each dimension on its own (grouping sets)."""
    named = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    return results.select(metric, named.alias("s")).groupBy("s.dimension", "s.value").agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"))


def paired_compare(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """Wins, losses, ties and mean difference of two runs on the questions they share."""
    d = a.select("query_id", F.col(metric).alias("x")).join(b.select("query_id", F.col(metric).alias("y")), "query_id").withColumn("d", F.col("y") - F.col("x"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > EPSILON).alias("wins"), F.count_if(F.col("d") < -EPSILON).alias("losses"), F.count_if(F.abs("d") <= EPSILON).alias("ties"), F.avg("d").alias("mean_difference"))


def resampled_means(values: DataFrame, metric: str, resamples: int, seed: int) -> DataFrame:
    """(b, m): means of resamples with replacement; draw i of resample b takes the row that a hash of both names.

    values: (query_id, metric), one row a question of a run.
    """
    own = values.select("query_id", F.col(metric).cast("double").alias("v")).where("v is not null")
    rows = own.withColumn("place", F.row_number().over(Window.orderBy("query_id")) - 1)
    n = own.count()
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = own.sparkSession.range(resamples).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("i")).withColumn("place", F.pmod(draw, F.lit(max(n, 1))).cast("int"))
    return drawn.join(rows, "place").groupBy("b").agg(F.avg("v").alias("m"))


def bootstrap(results: DataFrame, metric: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """Mean of a metric with its 95 % percentile interval."""
    means = resampled_means(results, metric, resamples, seed)
    ends = means.agg(*[F.round(F.expr(f"percentile(m, {q})"), 4).alias(c) for c, q in (("ci_low", 0.025), ("ci_high", 0.975))])
    return results.agg(F.round(F.avg(metric), 4).alias("value")).crossJoin(ends)


def paired_bootstrap(a: DataFrame, b: DataFrame, metric: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """Mean difference of run b from run a on the questions of both, its interval, whether it leaves out zero, and wins."""
    d = a.select("query_id", F.col(metric).alias("x")).join(b.select("query_id", F.col(metric).alias("y")), "query_id").withColumn("d", F.col("y") - F.col("x"))
    ci = bootstrap(d, "d", resamples, seed).select(F.col("value").alias("delta"), "ci_low", "ci_high", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("significant"))
    wins = d.agg(F.round(F.avg("x"), 4).alias("a"), F.round(F.avg("y"), 4).alias("b"), F.count_if(F.col("d") > EPSILON).alias("wins"), F.count_if(F.col("d") < -EPSILON).alias("losses"), F.count_if(F.abs("d") <= EPSILON).alias("ties"))
    return wins.crossJoin(ci)


def gains_and_losses(a: DataFrame, b: DataFrame, metric: str, most: int = 5) -> DataFrame:
    """(query_id, side, place, delta): the questions that gain and lose most."""
    d = a.select("query_id", F.col(metric).alias("x")).join(b.select("query_id", F.col(metric).alias("y")), "query_id").select("query_id", F.round(F.col("y") - F.col("x"), 6).alias("delta"))
    d = d.where(F.abs("delta") > EPSILON).withColumn("side", F.when(F.col("delta") > 0, "gain").otherwise("loss"))
    place = F.row_number().over(Window.partitionBy("side").orderBy(F.desc(F.abs("delta")), "query_id"))
    return d.withColumn("place", place).where(F.col("place") <= most)


def leaderboard(systems: DataFrame, groups: dict[str, tuple[str, ...]], weights: dict[str, float], lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """Adds a score of each group and the weighted whole: metrics scaled to 0..1 over the systems (1 where all are equal),
    turned where lower is better, averaged within their group."""
    whole, out = Window.partitionBy(), systems
    for name, metrics in groups.items():
        scaled = []
        for m in metrics:
            low, high = F.min(m).over(whole), F.max(m).over(whole)
            share = F.when(high == low, F.lit(1.0)).otherwise((F.col(m) - low) / (high - low))
            scaled.append(1 - share if m in lower_is_better else share)
        out = out.withColumn(name, F.round(sum(scaled[1:], scaled[0]) / len(scaled), 6))
    total = sum(weights[g] for g in groups)
    return out.withColumn("composite", F.round(sum((F.col(g) * weights[g] for g in list(groups)[1:]), F.col(next(iter(groups))) * weights[next(iter(groups))]) / total, 6))


def pareto(points: DataFrame, better_high: str, better_low: str) -> DataFrame:
    """Configurations that no other beats on both measures: a running maximum in order of the cost."""
    order = Window.orderBy(better_low, F.desc(better_high)).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("best", F.max(better_high).over(order)).where(F.col("best").isNull() | (F.col(better_high) > F.col("best"))).drop("best")


def regret(results: DataFrame, metric: str) -> DataFrame:
    """Mean regret of each configuration against the best of each question."""
    best = results.groupBy("query_id").agg(F.max(metric).alias("best"))
    return results.join(best, "query_id").groupBy("config").agg(F.avg(F.col("best") - F.col(metric)).alias("mean_regret"), F.count(F.lit(1)).alias("n"))


def latency_summary(events: DataFrame) -> DataFrame:
    v = F.col("value")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean_value"), F.expr("percentile(value, 0.5)").alias("p50"), F.expr("percentile(value, 0.95)").alias("p95"), F.expr("percentile(value, 0.99)").alias("p99"))


def slo(events: DataFrame, p95_limit: float, p99_limit: float) -> DataFrame:
    s = latency_summary(events)
    return s.select("event_type", "p95", "p99", (F.col("p95") <= p95_limit).alias("p95_ok"), (F.col("p99") <= p99_limit).alias("p99_ok"))


def slo_report(requests: DataFrame, limits: dict[str, float], key: str) -> DataFrame:
    """Availability, timeout rate, latency percentiles and mean cost of requests (ok, timed_out, latency, cost), which
    limits they violate (in the order of the names) and whether they keep all."""
    by = requests.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("availability"), F.round(F.avg(F.col("timed_out").cast("int")), 6).alias("timeout_rate"),
        *[F.round(F.expr(f"percentile(latency, {q})"), 6).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)], F.round(F.avg("cost"), 6).alias("cost"),
    )
    broken = F.concat_ws(",", *[F.when(F.col(m) < v if m == "availability" else F.col(m) > v, m) for m, v in sorted(limits.items())])
    return by.withColumn("violations", broken).withColumn("compliant", F.col("violations") == "")


def capacity_curve(reports: DataFrame, load: str) -> DataFrame:
    """One row: the largest load up to which every report is compliant."""
    first_bad = F.min(F.when(~F.col("compliant"), F.col(load))).over(Window.partitionBy())
    return reports.withColumn("bad", first_bad).where(F.col("bad").isNull() | (F.col(load) < F.col("bad"))).agg(F.max(load).alias("capacity"), F.count(F.lit(1)).alias("n_loads"))


def drift(rows: DataFrame, metrics: dict[str, float], early: Column) -> DataFrame:
    """(metric, reference, current, delta, drifted): means before and after, drifted at a difference of the threshold."""
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"), F.lit(float(t)).alias("limit")) for m, t in metrics.items()]))
    d = rows.select(early.alias("early"), named.alias("x")).groupBy("x.metric", "x.limit").agg(F.round(F.avg(F.when(F.col("early"), F.col("x.v"))), 6).alias("reference"), F.round(F.avg(F.when(~F.col("early"), F.col("x.v"))), 6).alias("current"))
    return d.select("metric", "reference", "current", F.round(F.col("current") - F.col("reference"), 6).alias("delta"), (F.abs(F.round(F.col("current") - F.col("reference"), 6)) >= F.col("limit")).alias("drifted"))


#: The ways a hash modulus is taken digit by digit, the buckets of an experiment and its share of traffic.
BUCKETS, TRAFFIC_B = 10_000, 0.10


def ab_assign(users: DataFrame, seed: int = 42, traffic_b: float = TRAFFIC_B) -> DataFrame:
    """Arm A or B of each user by sha256 of seed and id, modulo BUCKETS.

    The 256-bit number's remainder is gathered from its hexadecimal digits, eight at a time.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("user_id").cast("string")), 256)
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substring(digest, k * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    bucket = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: F.pmod(a * (2**32 % BUCKETS) + w, F.lit(BUCKETS)))
    return users.select("user_id").distinct().withColumn("bucket", bucket).withColumn("arm", F.when(F.col("bucket") < traffic_b * BUCKETS, "B").otherwise("A"))


#: What a candidate may lose or gain against the base to be rolled out.
ROLLOUT = {"quality": 0.0, "grounding": -0.03, "citation": -0.03, "latency": 0.15, "cost": 0.15}


def rollout(pairs: DataFrame) -> DataFrame:
    """Adds the checks that fail and whether to promote: base_x and cand_x of each measure. The first three may fall by
    so much, the last two rise by that share."""
    fails = [F.when(F.col(f"cand_{m}") < F.col(f"base_{m}") + d, m) if m in ("quality", "grounding", "citation") else F.when(F.col(f"cand_{m}") > F.col(f"base_{m}") * (1 + d), m) for m, d in ROLLOUT.items()]
    return pairs.withColumn("failed", F.concat_ws(",", *fails)).withColumn("promote", F.col("failed") == "")


def backoff(attempts: DataFrame, base: float = 0.2, most: float = 2.0) -> DataFrame:
    """Adds the wait before each attempt: doubled from base up to most."""
    return attempts.withColumn("wait", F.least(F.lit(most), base * F.pow(F.lit(2.0), F.col("attempt"))))


def value_shares(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of a column's values, nulls among them."""
    whole = Window.partitionBy()
    by = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(whole), 9))


def quartiles(rows: DataFrame, key: str, measure: str, labels: tuple[str, ...] = ("low_overlap", "medium_low", "medium_high", "high_overlap")) -> DataFrame:
    """(key, measure, stratum): equal shares of rows by measure, ties by key."""
    n = F.ntile(len(labels)).over(Window.orderBy(measure, key))
    return rows.select(key, measure, F.element_at(F.array(*map(F.lit, labels)), n).alias("stratum"))


def stratified_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows of each stratum in the order of a hash of key and seed."""
    order = Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def spearman(scores: DataFrame) -> DataFrame:
    """Rank correlation of two scores in each group (ordinal ranks by score, then item): (group_id, item, x, y)."""
    w = Window.partitionBy("group_id")
    r = scores.withColumn("rx", F.row_number().over(w.orderBy("x", "item"))).withColumn("ry", F.row_number().over(w.orderBy("y", "item")))
    return r.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho")).where("n >= 3")


def exact_match(pairs: DataFrame) -> DataFrame:
    """(pair_id, em, precision, recall, f1) of (pair_id, answer, reference): equal token lists, and overlap of token sets."""
    words = lambda c: F.filter(T.search_tokens(F.col(c)), lambda w: ~w.isin("a", "an", "the"))
    p = pairs.select("pair_id", words("answer").alias("a"), words("reference").alias("r"))
    a, r = F.array_distinct("a"), F.array_distinct("r")
    same = F.size(F.array_intersect("a", "r"))
    precision, recall = F.when(F.size(a) > 0, same / F.size(a)).otherwise(0.0), F.when(F.size(r) > 0, same / F.size(r)).otherwise(0.0)
    f1 = F.when(same > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return p.select("pair_id", (F.col("a") == F.col("r")).cast("double").alias("em"), F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"), F.round(f1, 9).alias("f1"))


def rank_metrics_at(ranked: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(k, recall, hit, n): means over the questions with gold at several depths."""
    n = gold.groupBy("query_id").agg(F.countDistinct("unit_id").alias("n_gold")).withColumn("k", F.explode(F.array(*map(F.lit, cuts))))
    hits = ranked.join(gold.distinct(), ["query_id", "unit_id"]).select("query_id", "rank")
    h = n.join(hits, "query_id", "left").groupBy("query_id", "k", "n_gold").agg(F.count_if(F.col("rank") <= F.col("k")).alias("found"))
    return h.groupBy("k").agg(F.round(F.avg(F.col("found") / F.col("n_gold")), 4).alias("recall"), F.round(F.avg((F.col("found") > 0).cast("int")), 4).alias("hit"), F.count(F.lit(1)).alias("n"))


def evidence_metrics(selected: DataFrame, gold: DataFrame, budget: int) -> DataFrame:
    """(query_id, precision, recall, waste): selected (query_id, unit_id, n_tokens) against gold; waste is the share of
    the budget that other passages take."""
    s = selected.join(gold.select("query_id", "unit_id", F.lit(1).alias("g")), ["query_id", "unit_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("g").alias("hit"), F.sum(F.when(F.col("g").isNull(), F.col("n_tokens")).otherwise(0)).alias("off"))
    n = gold.groupBy("query_id").agg(F.countDistinct("unit_id").alias("n_gold"))
    return s.join(n, "query_id").select("query_id", F.round(F.col("hit") / F.col("n"), 9).alias("precision"), F.round(F.col("hit") / F.col("n_gold"), 9).alias("recall"), F.round(F.col("off") / budget, 9).alias("waste"))


def sufficiency(scores: DataFrame) -> DataFrame:
    """Adds score and label: coverage, support and agreement weighed .55, .30, .15."""
    s = F.round(0.55 * F.col("coverage") + 0.30 * F.col("support") + 0.15 * F.col("agreement"), 6)
    return scores.withColumn("score", s).withColumn("label", F.when(s >= 0.75, "SUFFICIENT").when(s >= 0.5, "WEAK").otherwise("INSUFFICIENT"))


def request_cost(requests: DataFrame, prices: dict[str, float]) -> DataFrame:
    """Adds cost: units of each stage by its price, generation and validation twice where an answer was repaired."""
    repaired = F.when(F.col("repair"), 2).otherwise(1)
    parts = [F.col(k) * F.lit(v) * (repaired if k in ("gen_in", "gen_out", "validate") else 1) for k, v in sorted(prices.items())]
    return requests.withColumn("cost", F.round(sum(parts[1:], parts[0]), 9))
