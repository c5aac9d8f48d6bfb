"""Scores made in one pass over a passage are those of the plans and of brute force, and nothing is exploded for them."""

import re

import pytest

from tessera.operators import chunking, passage_scores, quality
from tessera.plans import registry, reports

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"W{i}{'.' if i % 7 == 0 else ''} and" if i % 5 else f"not{i % 11}, \u00e4{i % 3}" for i in range(700))
TEXTS = ["", None, " \t\n", "One.  Two three!\tFour\u00a0five.six. \u00c4 No.", "EGFR inhibits KRAS.\n\nThis did\nnot. It, and ,\tit But AND and x; but", "\u212a \u0130b. \u2028", ", ; :", "...", "\u00e4BRCA1 \u00e9no no\u00e9 BRCA1\u2013x; breast\ncancer was  associated\n with it", "Such. Such. Suche is aspirin) [x]", LONG, "a" * 300 + " B. C"]


def _passages(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "unit_id long, text string").select("unit_id", reports.F.coalesce("text", reports.F.lit("")).alias("text"))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_bytes_are_cut_as_by_the_plans(spark):
    got = {(r["unit_id"], r["strategy"], r["chunk_index"], r["text"], r["n_tokens"]) for r in reports._units_of(_passages(spark)).collect()}
    assert got == {(i, k, at, t.decode(), n) for i, text in enumerate(TEXTS) for k, cut in passage_scores.CHUNKERS.items() for at, (t, n) in enumerate(cut((text or "").encode()))}


def _brute_cohesion(passages, chunks):
    words = lambda t: set(re.findall("[a-z0-9-]+", t.lower()))
    out: dict = {}
    for i, strategy, _, text, *_ in chunks:
        s = [words(x) for x in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z0-9])", text) if x.strip(" ")]
        icc = sum(len(a & b) / max(len(a | b), 1) for a, b in zip(s, s[1:], strict=False)) / (len(s) - 1) if len(s) > 1 else 1.0
        known = set().union(*[words(t) for j, t in passages if j == i and i is not None])
        dcc = len(words(text) & known) / len(words(text)) if words(text) else 0.0
        out.setdefault(strategy, []).append((icc, dcc, not re.match(r"(?i)(this|that|these|those|it|they|them|such|the former|the latter)\b", text.strip(" "))))
    return [(k, *[pytest.approx(sum(c) / len(c), abs=2e-6) for c in zip(*v, strict=True)]) for k, v in sorted(out.items())]


def test_cohesion(spark):
    p = _passages(spark)
    u = reports._units_of(p)
    want = _brute_cohesion([(i, t or "") for i, t in enumerate(TEXTS)], _rows(u))
    assert _rows(quality.cohesion(p, u)) == want
    assert _rows(passage_scores.cohesion_means(passage_scores.cohesion_sums(p, reports.STRATEGIES))) == want
    q = [(1, "Alpha beta-x. Gamma"), (1, "delta"), (None, "Alpha")]
    c = [(1, "a", 0, "alpha delta", 2), (1, "a", 1, "Alpha bet", 2), (None, "a", 0, "Alpha", 1), (7, "b", 0, "Alpha. Alpha", 2), (1, "b", 1, "", 0)]
    got = quality.cohesion(spark.createDataFrame(q, "unit_id long, text string"), spark.createDataFrame(c, "unit_id long, strategy string, chunk_index int, text string, n_tokens int"))
    assert _rows(got) == _brute_cohesion(q, c)


def test_cohesion_explodes_nothing(spark):
    """Every word of every chunk was a row that was shuffled and joined before."""
    plan = registry.queries()["chunk_cohesion"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_repeated_ids_go_by_their_chunks(spark):
    p = _passages(spark)
    one, many = reports._by_repeat(p.unionByName(p.where("unit_id in (3, 4)")).unionByName(spark.createDataFrame([(None, "x"), (None, "x")], "unit_id long, text string")))
    assert {r["unit_id"] for r in many.collect()} == {3, 4} and many.count() == 4 and one.count() == len(TEXTS)
    assert reports._by_repeat(p)[1] is None


def test_intrinsic_is_that_of_the_chunks(spark):
    p = _passages(spark)
    assert _rows(passage_scores.intrinsic(p, reports.STRATEGIES)) == _rows(quality.intrinsic_metrics(p, reports._units_of(p)))


def test_routing_profile_of_odd_texts(spark):
    got = {r["unit_id"]: r for r in chunking.routing_profile(_passages(spark)).collect()}
    assert [got[i]["n_tokens"] for i in (0, 2, 5)] == [0, 0, 3] and [got[i]["n_sentences"] for i in (0, 2, 3)] == [0, 1, 3]
    assert got[3]["topic_shift"] == 1.0 and got[9]["topic_shift"] == pytest.approx(0.5)
    assert got[4]["negation_density"] == round(1 / 15, 9) and got[4]["relation_density"] == round(1 / 15, 9) and got[4]["entity_density"] == 0.2


def test_selection_reads_the_text_twice(spark):
    """Scores and routes take one pass each over the text (ten scans and a row for each chunk before)."""
    plan = registry.queries()["chunk_selection"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Relation [") == 2
