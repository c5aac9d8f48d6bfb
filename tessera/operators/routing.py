"""Questions: their types, key terms and routes, what the evidence covers, and the retry where it covers too little."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# The threshold of a retry, the letters that stand for a word's stem, words that are no key terms, and the
# patterns of question types and relations.
WEAK_COVERAGE, STEM = 0.6, 6
STOP = tuple("the a an of and or to in for with on by is are was were be as at from that this these those what which who how why when where does do did can could may might should would will it its their there any into than then also not no such via per about has have had been being used use using role effect effects known main list name describe explain between".split())
END = r"(?:$|[^a-z0-9_])"
LIST = rf"^\s*(?:list|name|enumerate){END}|^\s*(?:which|what) (?:[a-z0-9_]+ ){{0,3}}are{END}"
SUMMARY = rf"^\s*(?:describe|explain|summari[sz]e|discuss|what is known|what are the (?:main|known)|how (?:does|do|is|are)){END}"
YES_NO = rf"^\s*(?:is|are|does|do|did|can|could|should|was|were|has|have|will){END}"
RELATION = r"(?:^|[^a-z0-9_])(?:(?:inhibits?|activates?|associated with|increases?|decreases?|causes?|prevents?|reduces?|induces?|expressed in|interacts with|sensitizes?|resistant to|responsive to)(?:$|[^a-z0-9_])|target|bind|interact|regulat|mediat|phosphorylat|block|suppress|encode)"


def question_type(question: Column) -> Column:
    """list, summary, yes/no or factoid."""
    q = T.ascii_lower(F.coalesce(question, F.lit("")))
    return F.when(q.rlike(LIST), "list").when(q.rlike(SUMMARY), "summary").when(q.rlike(YES_NO), "yes/no").otherwise("factoid")


def key_terms(question: Column) -> Column:
    """Distinct search tokens of more than two characters that are no stop words, in order."""
    return F.array_distinct(F.filter(T.search_tokens(question), lambda w: (F.char_length(w) > 2) & ~w.isin(*STOP)))


def route_plan(queries: DataFrame, seeds: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """(query_id, type, n_entities, relation_word, n_added, use_graph, use_synonyms, use_tree, rules) of each question.

    BM25 and vectors always run. Two entities of the graph, or one and a relation word, add the graph; a term that the
    dictionary knows adds synonyms; a list or summary without entities adds the topic tree.
    """
    n = seeds.groupBy("query_id").agg(F.countDistinct("entity").alias("n"))
    q = queries.join(n, "query_id", "left")
    if expanded is not None:
        q = q.join(expanded.select("query_id", F.size(F.filter(F.split("added", " "), lambda w: w != "")).alias("added_n")), "query_id", "left")
    q = q.select("query_id", question_type(F.col("question")).alias("type"), F.coalesce("n", F.lit(0)).alias("n_entities"), T.ascii_lower(F.col("question")).rlike(RELATION).alias("relation_word"), (F.coalesce("added_n", F.lit(0)) if expanded is not None else F.lit(0)).cast("long").alias("n_added"))
    graph = (F.col("n_entities") >= 2) | ((F.col("n_entities") == 1) & F.col("relation_word"))
    tree = F.col("type").isin("list", "summary") & (F.col("n_entities") == 0)
    q = q.withColumn("use_graph", graph).withColumn("use_synonyms", F.col("n_added") > 0).withColumn("use_tree", tree)
    fired = F.concat_ws(",", F.when(F.col("use_graph"), "R1"), F.when(F.col("use_synonyms"), "R2"), F.when(F.col("use_tree"), "R3"))
    return q.withColumn("rules", F.when(fired == "", "R0").otherwise(fired))


def term_coverage(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, n_terms, coverage, missing): key terms whose stem some passage of the evidence (query_id, text) holds.

    A question without key terms is covered.
    """
    q = queries.select("query_id", key_terms(F.col("question")).alias("terms"))
    texts = evidence.select("query_id", F.lower("text").alias("text"))
    each = q.select("query_id", F.explode("terms").alias("term")).join(texts, "query_id", "left")
    held = each.groupBy("query_id", "term").agg(F.max(F.coalesce(F.contains("text", F.substring("term", 1, STEM)), F.lit(False))).alias("held"))
    by = held.groupBy("query_id").agg(F.count_if("held").alias("k"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("held"), F.col("term")))), " ").alias("missing"))
    n = F.size("terms")
    return q.join(by, "query_id", "left").select("query_id", n.cast("long").alias("n_terms"), F.when(n == 0, F.lit(1.0)).otherwise(F.round(F.coalesce("k", F.lit(0)) / n, 3)).alias("coverage"), F.coalesce("missing", F.lit("")).alias("missing"))


def retry(queries: DataFrame, first: DataFrame, wide: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, coverage, wide_coverage, round): weakly covered questions take the wide result where it covers more.

    first, wide: (query_id, unit_id) of the two rounds; texts: (unit_id, text).
    """
    own = term_coverage(queries, first.join(texts, "unit_id")).select("query_id", "coverage")
    weak = queries.join(own.where(F.col("coverage") < WEAK_COVERAGE).select("query_id"), "query_id", "left_semi")
    more = term_coverage(weak, wide.join(texts, "unit_id")).select("query_id", F.col("coverage").alias("wide_coverage"))
    better = F.coalesce(F.col("wide_coverage") > F.col("coverage"), F.lit(False))
    return own.join(more, "query_id", "left").withColumn("round", F.when(better, 2).otherwise(1))
