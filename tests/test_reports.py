"""Toy cases of chunk quality and of the reports, against values worked out by hand or by a plain version."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import quality, reports

UNITS = "unit_id long, strategy string, chunk_index int, text string, n_tokens int"


def test_intrinsic(spark):
    p = spark.createDataFrame([(1, "EGFR activates KRAS. It grew"), (2, None)], "unit_id long, text string")
    c = spark.createDataFrame([(1, "a", 0, "EGFR activates KRAS.", 3), (1, "a", 1, "It grew", 2), (1, "b", 0, "It grew", 400), (1, "b", 1, "It grew", 2)], UNITS)
    got = {r["strategy"]: r for r in quality.intrinsic_metrics(p, c).collect()}
    a, b = got["a"], got["b"]
    assert (a["boundary_quality"], a["size_compliance"], a["biomedical_signal"], a["redundancy"], a["token_expansion"]) == (0.5, 1.0, 0.375, 0.0, 1.0)
    assert a["score"] == pytest.approx(0.30 * 0.5 + 0.25 + 0.25 * 0.375 + 0.20)
    assert (b["size_compliance"], b["redundancy"]) == (0.5, 0.5)


def test_integrity_and_cohesion(spark):
    p = spark.createDataFrame([(1, "Aspirin inhibits it. No pain was seen."), (2, "")], "unit_id long, text string")
    c = spark.createDataFrame([(1, "cut", 0, "Aspirin inhibits", 2), (1, "cut", 1, "it. No pain was seen.", 5), (1, "whole", 0, "Aspirin  inhibits it. No pain was seen.", 7)], UNITS)
    got = {(r["strategy"], r["kind"]): (r["n_checked"], r["intact"]) for r in quality.integrity(p, c).collect()}
    assert got == {("cut", "entity"): (1, 1.0), ("cut", "negation"): (1, 1.0), ("cut", "relation"): (1, 0.0), ("whole", "entity"): (1, 1.0), ("whole", "negation"): (1, 1.0), ("whole", "relation"): (1, 1.0)}
    near = {r["strategy"]: (r["icc"], r["dcc"], r["rc"]) for r in quality.cohesion(p, c).collect()}
    assert near == {"cut": (0.5, 1.0, 0.5), "whole": (0.0, 1.0, 1.0)}


def test_selection(spark):
    scores = spark.createDataFrame([(1, "fixed", 0.5), (1, "semantic", 0.7), (2, "fixed", 0.6), (2, "semantic", 0.6), (3, "fixed", 0.2)], "unit_id long, strategy string, score double")
    cols = "unit_id long, n_tokens long, n_sentences long, relation_density double, negation_density double, entity_density double, topic_shift double, route string"
    profile = spark.createDataFrame([(1, 300, 9, 0.0, 0.0, 0.0, 0.8, "semantic"), (2, 300, 9, 0.0, 0.0, 0.0, 0.1, "recursive"), (3, 900, 9, 0.0, 0.0, 0.0, 0.1, "parent_child")], cols)
    got = {r["unit_id"]: (r["choice"], r["stopped_by"], r["oracle"], r["accurate"], r["regret"]) for r in quality.selection(scores, profile, "fixed").collect()}
    assert got == {1: ("semantic", "rule", "semantic", True, 0.0), 2: ("fixed", "score", "fixed", True, 0.0), 3: ("fixed", "rule", "fixed", True, 0.0)}
    apart = spark.createDataFrame([(3, 0.5)], "unit_id long, disagreement double")
    why = {r["unit_id"]: r["reason"] for r in quality.trigger(profile, apart).collect()}
    assert why == {1: "high_topic_shift", 2: "low_router_confidence", 3: "candidate_disagreement"}


def test_parse_list(spark):
    rows = [('["a", " b "]', ["a", "b"]), ("a; b|c,,", ["a", "b", "c"]), ("", []), (None, [])]
    d = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], "i int, v string")
    assert [r["m"] for r in d.orderBy("i").select(reports.parse_list(F.col("v")).alias("m")).collect()] == [w for _, w in rows]


def test_fingerprint_is_that_of_sorted_json(spark):
    row = {"router": 'r"1\\', "corpus": "c[0]"}
    d = spark.createDataFrame([(1, row["router"], row["corpus"])], "id int, router string, corpus string")
    assert reports.fingerprint(d, "id", ("router", "corpus")).first()["fingerprint"] == hashlib.sha256(json.dumps(row, sort_keys=True).encode()).hexdigest()


def test_policy(spark):
    rows = [(2000.0, 8, 1.0, "complex"), (1000.0, 8, 1.0, "complex"), (700.0, 8, 1.0, "complex"), (2000.0, 2, 0.001, "multi-hop"), (2000.0, 8, 1.0, "simple")]
    got = reports.policy(spark.createDataFrame(rows, "remaining_ms double, slots int, money double, complexity string")).collect()
    assert [(r["graph"], r["reranker"], r["repair"], r["top_k"]) for r in got] == [(True, True, True, 10), (False, True, True, 6), (False, False, False, 4), (False, False, False, 10), (False, True, True, 10)]


def test_calibration_effects_and_recovery(spark):
    s = spark.createDataFrame([(1, "a", 0.9, 0.2), (1, "b", 0.1, 0.6), (2, "a", 0.5, 0.4), (2, "b", 0.5, 0.3)], "query_id long, config string, judged double, utility double")
    c = reports.calibration(s, "b").first()
    assert (c["n"], c["oracle_share"], c["regret"], c["picked"], c["default"], c["oracle"]) == (2, 0.5, 0.2, 0.3, 0.45, 0.5)
    pairs = spark.createDataFrame([(1, 0.5, 0.6), (2, 0.5, 0.5), (3, 0.5, 0.4), (4, 1.0, 1.0)], "query_id long, x double, y double")
    assert {r["effect"]: (r["n"], r["share"]) for r in reports.effects(pairs).collect()} == {"HELPED": (1, 0.25), "NEUTRAL": (2, 0.5), "HURT": (1, 0.25)}
    r = reports.recovery(pairs, F.col("x") < 1).first()
    assert r["n_attempts"] == 3 and r["success"] == pytest.approx(1 / 3, abs=1e-6)
    assert reports.recovery(pairs.where("false"), F.lit(True)).first()["success"] is None


def test_failures(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.5, -0.1), (3, 1.0, 1.0, 0.0)], "query_id long, hit double, recall double, delta double")
    assert {r["failure_code"]: (r["failure_name"], r["n"]) for r in reports.failure_counts(reports.failure_tags(d)).collect()} == {"F04": ("lexical miss", 1), "F08": ("reranker", 1), "F13": ("evidence incompleteness", 2)}


def test_provenance_counts_an_edge_once(spark):
    e = spark.createDataFrame([("a", "b", "P", 7), ("a", "c", "P", 7), ("a", "b", "P", 8), ("x", "y", "P", 9)], "src string, dst string, predicate string, unit_id long")
    s = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, entity string")
    got = [(r["unit_id"], r["support"], r["place"]) for r in reports.provenance_scores(e, s).orderBy("place").collect()]
    assert got == [(7, 2, 1), (8, 1, 2)]


def test_utility_select_against_a_plain_version(spark):
    texts = ["gene repair pathway", "gene repair pathway", "protein folding gene", "", "gene", "repair of tissue after injury", "protein folding gene"]
    pool = [(1, 10 + i, i + 1, 1.0 / (i + 1), "gene repair", t) for i, t in enumerate(texts)]
    words = [set(w for w in t.split() if len(w) > 1) for t in texts]
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    taken = []
    while len(taken) < 4:
        worth = lambda i: round(pool[i][3] + 0.25 * jac({"gene", "repair"}, words[i]) + 0.25 - 0.001 * len(texts[i].split()) - 0.55 * max((jac(words[i], words[j]) for j in taken), default=0.0), 9)
        taken.append(max((i for i in range(len(pool)) if i not in taken), key=lambda i: (worth(i), -i)))
    d = spark.createDataFrame(pool, "query_id long, unit_id long, rank int, score double, question string, text string")
    got = [r["unit_id"] for r in reports.utility_select(d).orderBy("place").collect()]
    assert got == [10 + i for i in taken]
    assert reports.utility_select(d.where("false")).count() == 0


def test_graded_metrics_without_gold(spark):
    q = spark.createDataFrame([(1, ""), (2, "")], "query_id long, question string")
    ranked = spark.createDataFrame([(1, 5, 12), (2, 6, 1)], "query_id long, unit_id long, rank int")
    gold = spark.createDataFrame([(1, 5)], "query_id long, unit_id long")
    got = {r["query_id"]: (r["hit"], r["recall"], r["ndcg"], r["mrr"]) for r in reports.graded_metrics(q, ranked, gold).collect()}
    assert got == {1: (0.0, 0.0, 0.0, round(1 / 12, 9)), 2: (None, None, None, 0.0)}


def test_repair_or_abstain(spark):
    rows = [(1, 1, "A.", [3, 2, 3], 0.9), (1, 2, "B.", [2], 0.1), (2, 1, "C.", [5], 0.35), (3, 1, "D.", [], 0.0)]
    c = spark.createDataFrame(rows, "query_id long, claim_no int, claim string, citations array<long>, best double")
    got = {r["query_id"]: (r["decision"], r["n_kept"], r["answer"]) for r in reports.repair_or_abstain(c).collect()}
    assert got == {1: ("REPAIRED", 1, "A. [2] [3]"), 2: ("ANSWER", 1, "C. [5]"), 3: ("ABSTAIN", 0, "")}


def test_commonest_and_best(spark):
    d = spark.createDataFrame([("s", "b"), ("s", "a"), ("s", None), ("s", None), (None, "c")], "source string, lang string")
    assert {r["source"]: (r["lang"], r["n"]) for r in reports.commonest(d, "source", "lang").collect()} == {"s": ("a", 1), None: ("c", 1)}
    j = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.1)], "query_id long, config string, judged double")
    assert reports.best_config(j).first().asDict() == {"query_id": 1, "best": "a", "evidence_score": 0.5, "margin": 0.4}


def test_simulated_requests_repeat(spark):
    a, b = (sorted(map(tuple, reports.simulated_requests(spark, (0.1, 1.2), 50).collect())) for _ in range(2))
    assert a == b and len(a) == 100 and {r[0] for r in a} == {0.1, 1.2}
