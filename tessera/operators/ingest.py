"""Canonicalisation, integrity and profiling of passage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def canonical(docs: DataFrame, prefix: str = "DOC-") -> DataFrame:
    """Canonical ids, hashes and usability of passages."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("canonical_id"),
        F.sha2(text, 256).alias("raw_sha256"),
        F.sha2(T.collapse_spaces(text), 256).alias("normalized_sha256"),
        (~T.is_empty_text(F.col("text"))).alias("is_usable"),
    )


def exact_duplicate_groups(docs: DataFrame) -> DataFrame:
    """Each passage with the first id of its group of equal texts and whether the group has several."""
    groups = docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).agg(F.min("doc_id").alias("group_first_id"), F.count(F.lit(1)).alias("group_size"))
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).join(groups, "sha").select("doc_id", "group_first_id", (F.col("group_size") > 1).alias("is_duplicate"))


def duplicate_summary(docs: DataFrame) -> DataFrame:
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.groupBy(sha.alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


def structural_features(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    n = F.char_length(text)
    share = lambda pattern: F.when(n > 0, F.regexp_count(text, F.lit(pattern)) / n).otherwise(F.lit(0.0))
    return docs.select(
        "doc_id",
        n.cast("long").alias("n_characters"),
        F.size(T.tokens(text)).cast("long").alias("n_words"),
        F.size(T.sentences(text)).cast("long").alias("n_sentences"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        share("[0-9]").alias("digit_share"),
        share("[A-Z]").alias("upper_share"),
        F.regexp_count(text, F.lit(r"https?://")).cast("long").alias("n_urls"),
        F.regexp_count(text, F.lit(r"\(")).cast("long").alias("n_parens"),
    )


def document_profile(docs: DataFrame) -> DataFrame:
    """Densities per token of acronyms, hyphenated and numeric tokens, and mean sentence length."""
    words = T.tokens(F.col("text"))
    d = docs.select("doc_id", words.alias("w"), F.size(T.sentences(F.col("text"))).alias("s"))
    n = F.greatest(F.size("w"), F.lit(1))
    density = lambda pattern: F.size(F.filter("w", lambda x: x.rlike(pattern))) / n
    return d.select("doc_id", density("^[A-Z]{2,}[.,;:]?$").alias("acronym_density"), density("^[A-Za-z]+-[A-Za-z]+").alias("hyphen_density"), density("[0-9]").alias("digit_density"), (F.size("w") / F.greatest(F.col("s"), F.lit(1))).alias("words_per_sentence"))


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls and distinct values, from one aggregation."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"z_{c}") for c in df.columns], *[F.countDistinct(c).alias(f"u_{c}") for c in df.columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"z_{c}").alias("n_null"), F.col(f"u_{c}").alias("n_unique")) for c in df.columns]))
    return one.select(rows.alias("r")).select("r.*")


def quality_gate(docs: DataFrame) -> DataFrame:
    """Counts that decide whether an ingested table is accepted."""
    return docs.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("doc_id").alias("n_ids"),
        F.count_if(T.is_empty_text(F.col("text"))).alias("n_empty"),
        F.countDistinct(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("n_texts"),
    ).withColumn("hard_error", (F.col("n_rows") == 0) | (F.col("n_ids") < F.col("n_rows"))).withColumn("warn_duplicates", F.col("n_texts") < F.col("n_rows"))


def length_statistics(docs: DataFrame, by: str) -> DataFrame:
    n = F.size(T.tokens(F.col("text")))
    return docs.withColumn("k", n).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("k").alias("mean_words"), F.expr("percentile(k, 0.5)").alias("median_words"), F.expr("percentile(k, 0.95)").alias("p95_words"))


#: Bytes of needles that one automaton holds; more are searched in several passes.
NEEDLE_BYTES = 16 << 20


def _containing(needles: list[tuple[int, str]]):
    import ahocorasick
    import pyarrow as pa

    def work(batches):
        of: dict[str, list[int]] = {}
        for i, text in needles:
            of.setdefault(text, []).append(i)
        automaton = ahocorasick.Automaton()
        for text in filter(None, of):
            automaton.add_word(text, text)
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            found = []
            for unit, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = {t for _, t in automaton.iter(text)} if len(automaton) else set()
                found += [(i, unit) for t in seen | ({""} & of.keys()) for i in of[t]]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["query_id", "unit_id"])

    return work


def gold_by_containment(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, unit_id, gold_rank) of the passages that contain a benchmark text; items are a stated query set.

    All items are looked for in one pass over a passage. Null texts contain nothing and are in nothing.
    """
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // NEEDLE_BYTES))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("unit_id"), "text")
    hits = None
    for block in range(blocks):
        own = items.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)).select("item_id", "text")
        found = texts.mapInArrow(_containing([(r["item_id"], r["text"]) for r in own.collect()]), "query_id long, unit_id long")
        hits = found if hits is None else hits.unionByName(found)
    return hits.withColumn("gold_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("unit_id")))


def frequency_concentration(gold: DataFrame, share: float = 0.1) -> DataFrame:
    """What share of all gold links the most linked passages hold."""
    counts = gold.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("units"))
    ranked = counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "unit_id")))
    top = ranked.crossJoin(F.broadcast(total)).where(F.col("place") <= F.ceil(F.col("units") * share))
    return top.agg(F.sum("n").alias("top_links"), F.max("links").alias("links"), F.max("units").alias("units"))


def duplicate_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(group_no, n, ids) of texts that occur more than once, numbered in the order of their first ids."""
    g = docs.groupBy(F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(id_col)), lambda x: x.cast("string")), ",").alias("ids")).where("n > 1")
    return g.withColumn("group_no", F.row_number().over(Window.orderBy("first")).cast("long")).select("group_no", "n", "ids")


# Marks of specialist prose.
ACRONYM, HYPHENATED, DIGITS, GREEK = r"[A-Z][A-Z0-9]+", r"[A-Za-z0-9_]+-[A-Za-z0-9_]+", r"[0-9]", "αβγδεζηθικλμνξοπρσςτυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"


def signal_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and densities of acronyms, hyphenated terms, tokens with digits and Greek letters, by white-space tokens
    without marks at their ends."""
    t = F.coalesce(text_col, F.lit(""))
    d = docs.select(id_col, t.alias("t"), F.transform(T.tokens(t), lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", "")).alias("w"))
    n = F.greatest(F.size("w"), F.lit(1))
    count = lambda pattern: F.size(F.filter("w", lambda x: x.rlike(pattern))).cast("long")
    d = d.select(id_col, n.alias("n"), count(f"^{ACRONYM}$").alias("acronyms"), count(f"^{HYPHENATED}").alias("hyphenated"), count(DIGITS).alias("digit_tokens"), (F.char_length("t") - F.char_length(F.translate("t", GREEK, ""))).cast("long").alias("greek"))
    return d.select(id_col, "acronyms", "hyphenated", "digit_tokens", "greek", *[F.round(F.col(c) / F.col("n"), 9).alias(f"{c}_density") for c in ("acronyms", "hyphenated", "digit_tokens")])


def corpus_profile(features: DataFrame) -> DataFrame:
    """(metric, value): means over the corpus and the shares of rows with a mark."""
    one = features.agg(F.count(F.lit(1)).cast("double").alias("rows"), *[F.avg(f"{c}_density").alias(f"mean_{c}_density") for c in ("acronyms", "hyphenated", "digit_tokens")], (100 * F.avg((F.col("acronyms") > 0).cast("int"))).alias("any_acronym_pct"), (100 * F.avg((F.col("greek") > 0).cast("int"))).alias("any_greek_pct"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(c), 6).alias("value")) for c in one.columns])).alias("x")).select("x.*")


def all_known(gold: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, n_gold, n_known, usable): a question is usable if all its gold units are known."""
    k = gold.join(known.select("unit_id", F.lit(1).alias("k")), "unit_id", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"), F.count("k").alias("n_known"))
    return k.withColumn("usable", F.col("n_gold") == F.col("n_known"))


def evidence_complexity(gold_counts: DataFrame) -> DataFrame:
    """Names how many passages a question's evidence takes: (query_id, n_gold)."""
    n = F.col("n_gold")
    return gold_counts.select("query_id", "n_gold", F.when(n <= 1, "single-passage").when(n == 2, "two-passage").when(n <= 5, "multi-passage-3-to-5").otherwise("multi-passage-6-plus").alias("complexity"))


def parse_ids(text: Column) -> Column:
    """Distinct numbers of a list as text ([3, 1, 3], "3;1", or loose digits), in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("long")))
