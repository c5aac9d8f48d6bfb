"""Chunkers: passages to retrieval units."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

UNIT = "unit_id long, strategy string, chunk_index int, text string, n_tokens int, start_token int, end_token int"
#: Sizes and limits of the chunkers and of the router among them.
FIXED = (256, 32)
CHILD = (96, 16)
ROUTE_SHORT, ROUTE_RELATION, ROUTE_ENTITY, ROUTE_SHIFT, ROUTE_LONG = 180, 0.015, 0.012, 0.65, 700
RELATION = r"^(inhibits?|activates?|induces?|regulates?|binds?|causes?|treats?|reduces?|increases?|decreases?)\W*$"
NEGATION = r"^(no|not|never|without|none|neither|nor)\W*$"
ENTITY = r"^[A-Z0-9]*[A-Z][A-Z0-9-]*[A-Z0-9]\W*$"
CONJUNCTION = r"(?i)\s+(?:and|but|while|whereas|although|because|therefore|however)\s+"


def chunk_id(parent: Column, strategy: Column, index: Column, text: Column) -> Column:
    return F.concat(F.lit("CHK-"), F.substring(F.sha2(F.concat_ws("|", parent.cast("string"), strategy, index.cast("string"), text), 256), 1, 20))


def window_chunks(passages: DataFrame, size: int, overlap: int, strategy: str) -> DataFrame:
    """Sliding token windows; the last is the first that reaches the end."""
    step = size - overlap
    d = passages.select("unit_id", T.tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - F.lit(overlap) - 1), F.lit(step))
    d = d.select("unit_id", "w", F.posexplode(starts).alias("chunk_index", "start_token"))
    end = F.least(F.col("start_token") + size, F.size("w"))
    text = F.array_join(F.slice("w", F.col("start_token") + 1, F.lit(size)), " ")
    out = d.select("unit_id", F.lit(strategy).alias("strategy"), "chunk_index", text.alias("text"), (end - F.col("start_token")).alias("n_tokens"), "start_token", end.alias("end_token"))
    return out.withColumn("chunk_id", chunk_id(F.col("unit_id"), F.col("strategy"), F.col("chunk_index"), F.col("text")))


def fixed_chunks(passages: DataFrame) -> DataFrame:
    return window_chunks(passages, *FIXED, "fixed")


def parent_child_chunks(passages: DataFrame) -> DataFrame:
    return window_chunks(passages, *CHILD, "parent_child")


def _units(pieces: list[str]) -> list[str]:
    return [p for p in (" ".join(x.split()) for x in pieces) if p]


def _cut(sentence: str, size: int) -> list[str]:
    w = sentence.split()
    return [" ".join(w[i : i + size]) for i in range(0, len(w), size)]


_BREAK = re.compile(T.SENTENCE_BREAK)


def fill(lengths: list[int], size: int, cut: frozenset[int] = frozenset(), closing: frozenset[int] = frozenset(), room: int = 0) -> list[int]:
    """The group of each piece when groups are filled in order up to size.

    A piece in ``cut`` opens a group. One in ``closing`` may overflow a group of fewer than ``room`` words, and ends it.
    """
    groups, group, used, ended = [], 0, 0, False
    for i, n in enumerate(lengths):
        over = used + n > size
        stretched = bool(used) and over and i in closing and used < room and not ended
        if used and (ended or i in cut or (over and not stretched)):
            group, used = group + 1, 0
        used, ended = used + n, stretched
        groups.append(group)
    return groups


def gather(pieces: list[str], groups: list[int]) -> list[str]:
    return [" ".join(p for _, p in own) for _, own in groupby(zip(groups, pieces, strict=True), key=itemgetter(0))]


def absorb(units: list[str], least: int, size: int) -> list[str]:
    """Units of fewer than ``least`` words join the one before where both fit."""
    lengths = [len(u.split()) for u in units]
    groups, total = [], 0
    for n in lengths:
        joins = bool(groups) and n < least and total + n <= size
        groups.append(groups[-1] if joins else len(groups))
        total = total + n if joins else n
    return gather(units, groups)


def recursive(text: str, size: int = 256, least: int = 32) -> list[str]:
    """Paragraphs that fit stay whole; others are filled by sentences, long ones cut; small units join the one before."""
    units: list[str] = []
    for paragraph in re.split(r"\n\s*\n", text):
        pieces = [paragraph] if len(paragraph.split()) <= size else [c for s in _BREAK.split(paragraph) for c in _cut(s, size)]
        units += gather(pieces, fill([len(p.split()) for p in pieces], size))
    return absorb(_units(units), least, size)


def biomedical(text: str, size: int = 384, slack: float = 1.15) -> list[str]:
    """Sentences filled up to size; a relation or negation sentence may overflow a little and closes its group."""
    signal = re.compile(f"(?:{RELATION})|(?:{NEGATION})")
    pieces = _BREAK.split(text)
    closing = frozenset(i for i, s in enumerate(pieces) if any(signal.match(w.lower()) for w in s.split()))
    return _units(gather(pieces, fill([len(s.split()) for s in pieces], size, closing=closing, room=int(size * slack))))


def adjacent_similarity(sentences: list[str]) -> list[float]:
    """Jaccard similarity of each sentence's search tokens with those of the one before (a stand-in for embeddings)."""
    words = [set(re.findall(r"[a-z0-9][a-z0-9\-]+", s.lower())) for s in sentences]
    return [len(a & b) / max(len(a | b), 1) for a, b in zip(words, words[1:], strict=False)]


def semantic(text: str, threshold: float = 0.02, size: int = 384, least: int = 40) -> list[str]:
    """Breaks where neighbouring sentences are less alike than the threshold or a unit is full."""
    pieces = _units(_BREAK.split(text))
    cut = frozenset(i + 1 for i, x in enumerate(adjacent_similarity(pieces)) if x < threshold)
    return absorb(gather(pieces, fill([len(s.split()) for s in pieces], size, cut)), least, size)


def semantic_threshold(passages: DataFrame, percentile: float = 0.2) -> DataFrame:
    """One row: the percentile of all neighbouring sentences' similarities, and their number."""
    s = passages.select("unit_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("w", F.array_distinct(T.search_tokens(F.col("sentence"))))
    before = F.lag("w").over(Window.partitionBy("unit_id").orderBy("pos"))
    return s.withColumn("v", before).where("v is not null").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.percentile(T.jaccard(F.col("w"), F.col("v")), F.lit(percentile)), 9).alias("threshold"))


PACKERS = {"recursive": recursive, "biomedical": biomedical, "semantic": semantic}


def packed_chunks(passages: DataFrame, strategy: str) -> DataFrame:
    """A sequential packer over Arrow batches."""
    pack = PACKERS[strategy]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, strategy, k, u, len(u.split()), -1, -1) for i, t in zip(f["unit_id"], f["text"], strict=True) for k, u in enumerate(pack(t or ""))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in UNIT.split(", ")])

    out = passages.select("unit_id", "text").mapInPandas(work, UNIT)
    return out.withColumn("chunk_id", chunk_id(F.col("unit_id"), F.col("strategy"), F.col("chunk_index"), F.col("text")))


def proposition_chunks(passages: DataFrame, most: int = 96) -> DataFrame:
    """Sentences split on conjunctions, trimmed, long ones cut."""
    trimmed = lambda s: F.regexp_replace(s, r"^[ ,;:]+|[ ,;:]+\z", "")
    parts = F.flatten(F.transform(T.sentences(F.col("text")), lambda s: F.transform(F.split(s, CONJUNCTION), trimmed)))
    words = F.transform(F.filter(parts, lambda p: p != ""), lambda p: T.tokens(p))
    cut = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(most)), lambda i: F.slice(w, i + 1, F.lit(most)))))
    d = passages.select("unit_id", F.posexplode(cut).alias("chunk_index", "w"))
    return d.select("unit_id", F.lit("proposition").alias("strategy"), "chunk_index", F.array_join("w", " ").alias("text"), F.size("w").alias("n_tokens"))


def routing_profile(passages: DataFrame) -> DataFrame:
    """Profile of each passage and the chunker chosen for it."""
    from tessera.operators import passage_scores

    density = lambda c: F.round(F.col(c) / F.greatest("n_tokens", F.lit(1)), 9)
    p = passage_scores.profile_counts(passages).select("unit_id", "n_tokens", "n_sentences", density("n_relation").alias("relation_density"), density("n_negation").alias("negation_density"), density("n_entity").alias("entity_density"), F.round("shift", 6).alias("topic_shift"))
    route = (
        F.when(F.col("n_tokens") <= ROUTE_SHORT, "recursive")
        .when((F.col("relation_density") >= ROUTE_RELATION) & (F.col("negation_density") > 0), "biomedical")
        .when(F.col("entity_density") >= ROUTE_ENTITY, "biomedical")
        .when(F.col("topic_shift") >= ROUTE_SHIFT, "semantic")
        .when(F.col("n_tokens") >= ROUTE_LONG, "parent_child")
        .otherwise("recursive")
    )
    return p.withColumn("route", route)


def children(text: str, size: int = CHILD[0], overlap: int = CHILD[1]) -> list[str]:
    """Sliding windows over the words; the last is the first that reaches the end."""
    w = text.split()
    return [" ".join(w[at : at + size]) for at in range(0, max(1, len(w) - overlap), size - overlap)] if w else []


def adaptive_chunks(passages: DataFrame) -> DataFrame:
    """Each passage cut by the chunker its profile routes it to, in one pass."""
    routed = passages.join(routing_profile(passages).select("unit_id", "route"), "unit_id").select("unit_id", "text", "route")
    packers = PACKERS | {"parent_child": children}

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, "adaptive", k, u, len(u.split()), r) for i, t, r in zip(f["unit_id"], f["text"], f["route"], strict=True) for k, u in enumerate(packers[r](t or ""))]
            yield pd.DataFrame(rows, columns=["unit_id", "strategy", "chunk_index", "text", "n_tokens", "routed_to"])

    out = routed.mapInPandas(work, "unit_id long, strategy string, chunk_index int, text string, n_tokens int, routed_to string")
    return out.withColumn("chunk_id", chunk_id(F.col("unit_id"), F.col("strategy"), F.col("chunk_index"), F.col("text")))


def boundary_plan_ok(plan: Column, n: Column) -> Column:
    """Boundaries are strictly increasing integers from 1 to n - 1, at least one."""
    return F.coalesce((F.size(plan) > 0) & F.forall(plan, lambda b: (b >= 1) & (b <= n - 1)) & (F.array_sort(F.array_distinct(plan)) == plan), F.lit(False))


def economics(chunks: DataFrame) -> DataFrame:
    """Chunks, parents, lengths and duplicate share of each strategy."""
    key = T.question_key(F.col("text"))
    return chunks.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.countDistinct("unit_id").alias("n_parents"),
        F.expr("percentile(n_tokens, 0.5)").alias("median_tokens"),
        F.expr("percentile(n_tokens, 0.95)").alias("p95_tokens"),
        (1 - F.countDistinct(F.md5(key)) / F.count(F.lit(1))).alias("duplicate_share"),
    )


def boundary_flags(chunks: DataFrame) -> DataFrame:
    """How many chunks start in mid-sentence, end in mid-sentence or have unbalanced parentheses."""
    t = F.col("text")
    return chunks.groupBy("strategy").agg(
        F.count_if(t.rlike("^[a-z]")).alias("mid_start"),
        F.count_if(~t.rlike("[.!?]$")).alias("mid_end"),
        F.count_if(F.regexp_count(t, F.lit(r"\(")) != F.regexp_count(t, F.lit(r"\)"))).alias("unbalanced"),
    )


def token_coverage(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Share of each passage's token multiset that its chunks hold."""
    count = lambda df: df.select("unit_id", F.explode(T.tokens(F.lower("text"))).alias("t")).groupBy("unit_id", "t").agg(F.count(F.lit(1)).alias("n"))
    a, b = count(passages), count(chunks).withColumnRenamed("n", "m")
    both = a.join(b, ["unit_id", "t"], "left")
    return both.groupBy("unit_id").agg((F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n")).alias("coverage"))


def size_sweep(passages: DataFrame, grid: tuple[tuple[int, int], ...] = ((128, 16), (256, 32), (384, 48), (512, 64))) -> DataFrame:
    """(size, overlap, n_chunks, n_tokens, bytes): what each window size and overlap would store, from lengths alone.

    Bytes are those of vectors of 1536 floats.
    """
    n = passages.select(F.size(T.tokens(F.col("text"))).cast("long").alias("n")).where("n > 0")
    own = F.explode(F.array(*[F.struct(F.lit(a).alias("size"), F.lit(b).alias("overlap")) for a, b in grid]))
    g = n.select("n", own.alias("g")).select("n", "g.size", "g.overlap", (F.col("g.size") - F.col("g.overlap")).alias("step"))
    k = F.floor(F.greatest(F.col("n") - F.col("overlap") - 1, F.lit(0)) / F.col("step")) + 1
    stored = F.col("n") + (k - 1) * F.col("overlap")
    return g.groupBy("size", "overlap").agg(F.sum(k).alias("n_chunks"), F.sum(stored).alias("n_tokens"), (F.sum(k) * (1536 * 4)).alias("bytes"))


def parent_summary(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """One row: parents, children, children a parent at least, on average and at most, and children without a parent."""
    known = chunks.join(passages.select("unit_id", F.lit(True).alias("known")), "unit_id", "left")
    per = known.groupBy("unit_id").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("known").isNull()).alias("orphans"))
    return per.agg(F.count(F.lit(1)).alias("n_parents"), F.sum("k").alias("n_children"), F.min("k").alias("least"), F.round(F.avg("k"), 6).alias("mean"), F.max("k").alias("most"), F.sum("orphans").alias("orphans"))


def best_answer_recall(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, recall): the largest share of an answer's tokens (with repeats) that one chunk holds.

    answers: (query_id, unit_id, answer) names the passage whose chunks may hold it.
    """
    words = lambda df, keys, c, n: df.select(*keys, F.explode(T.search_tokens(F.col(c))).alias("t")).groupBy(*keys, "t").agg(F.count(F.lit(1)).alias(n))
    a, b = words(answers, ("query_id", "unit_id"), "answer", "n"), words(chunks, ("unit_id", "chunk_index"), "text", "m")
    same = a.join(b, ["unit_id", "t"]).groupBy("query_id", "unit_id", "chunk_index").agg(F.sum(F.least("n", "m")).alias("same")).groupBy("query_id").agg(F.max("same").alias("same"))
    total = a.groupBy("query_id", "unit_id").agg(F.sum("n").alias("n")).groupBy("query_id").agg(F.max("n").alias("n"))
    return total.join(same, "query_id", "left").select("query_id", F.round(F.coalesce("same", F.lit(0)) / F.col("n"), 9).alias("recall"))
