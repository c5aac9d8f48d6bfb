"""Quality rules by distribution divergence, in DataFrame functions only.

A document's character classes and common words are counted into two histograms and compared with its language's
reference, gathered from the whole corpus, by Jensen-Shannon distance; short documents are left to the base rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WHITE, Workspace, let, sized, text_of

# The character classes of the histogram; what is in none of them counts as other.
CLASSES = {
    "lower": r"\p{Ll}",
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "white": r"[\x20\x09-\x0D]",
    "point": r"[.,;:!?'\"()-]",
    "symbol": r"[#*$%&|<>@^~_=+/\\{}\[\]]",
}
#: Common words a reference holds, and the bytes of references up to which they are broadcast.
TOP_WORDS, SENT_BYTES = 24, 8 << 20
#: Salts under which the words of one language are ranked first, so that no task ranks a whole language.
SALTS = 64


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE + "+"), "")


def repeated_words(words: Column) -> Column:
    """Positions covered by 3-word windows that occur at least twice, from an array of words.

    A text whose windows all have different hashes has no repeats. Of the others the windows are sorted by 40 bits of
    the hash with their positions below it in one number; those whose hash bits have an equal neighbour are candidates,
    equal windows always among them. The candidates alone are sorted by their words, where equal ones are neighbours
    whatever their hashes. Beyond 2**24 words every window is a candidate. The union of the repeats' positions is a sum
    over them in order: each adds what it covers before the next.
    """

    def hashes(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def suspects(h: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return F.shiftright(a.bitwiseXOR(b), 24) == 0

        def of(s: Column) -> Column:
            near = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
            return F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int"))

        packed = F.transform(h, lambda x, i: F.shiftleft(x, 24).bitwiseOR((i + 1).cast("long")))
        return F.when(F.size(h) < (1 << 24) - 2, let(F.sort_array(packed), of)).otherwise(F.sequence(F.lit(1), F.size(h)))

    def repeats(w: Column, places: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return F.coalesce(reduce(lambda x, y: x & y, [a[n] == b[n] for n in "abc"]), F.lit(False))

        def of(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
            return F.sort_array(F.transform(twice, lambda x: x["at"]))

        in_words = F.transform(places, lambda i: F.struct(*[F.element_at(w, i + n).alias("abc"[n]) for n in range(3)], i.alias("at")))
        return let(F.sort_array(in_words), of)

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def of(w: Column) -> Column:
        found = lambda h: let(repeats(w, suspects(h)), covered)
        return let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found(h)))

    whole = let(words, of)
    return F.when(F.size(words) >= 3, whole).otherwise(F.lit(0)).cast("long")


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of an array of counts from an array of shares."""

    def of(total: Column) -> Column:
        def part(p: Column, q: Column) -> Column:
            m = (p + q) / 2
            return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))

        parts = F.zip_with(counts, reference, lambda c, q: part(c / total, q))
        return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))

    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, let(total, of)).otherwise(F.lit(0.0))


def language_words(docs: DataFrame, lang: Column, text: Column, ws: Workspace) -> DataFrame:
    """(lang, words, n): the TOP_WORDS commonest words of every language with their counts; lang null: of all rows."""
    w = docs.select(lang.alias("lang"), F.explode(_words(F.lower(text))).alias("word"))
    counts = ws.table(w.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    pooled = counts.groupBy("word").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string"))
    both = counts.where("lang is not null").unionByName(pooled)
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("n"), "word")
    salted = both.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS))).withColumn("place", F.row_number().over(best("lang", "salt"))).where(F.col("place") <= TOP_WORDS)
    ranked = salted.withColumn("place", F.row_number().over(best("lang"))).where(F.col("place") <= TOP_WORDS)
    tops = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "n", "word"))).alias("tops"))
    return tops.select("lang", F.transform("tops", lambda x: x["word"]).alias("words"), F.transform("tops", lambda x: x["n"]).alias("n"))


def _judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str, carry: tuple[str, ...], min_words: int, max_repeat: int, max_class_distance: float, max_word_distance: float) -> tuple[DataFrame, Workspace]:
    """id, the carried columns in one structure (so that their names cannot clash), counts, distances and verdict."""
    ws = Workspace(docs.sparkSession, "quality-rules")
    lang = docs[lang_col].cast("string")
    refs = ws.table(language_words(docs, lang, text_of(docs, text_col), ws), "words")
    src = docs.select(docs[id_col].alias("id"), lang.alias("lang"), text_of(docs, text_col).alias("text"), F.struct(*[docs[c] for c in carry] or [F.lit(0).alias("none")]).alias("carried"))
    own = sized(refs.select(F.col("lang").alias("ref_lang"), F.col("words").alias("refs")), SENT_BYTES)
    d = src.join(own, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    longest = F.coalesce(F.array_max(F.transform("refs", lambda w: F.char_length(w))), F.lit(0)).alias("longest")
    d = d.select("id", "carried", "text", "lang", longest, F.coalesce("refs", F.array().cast("array<string>")).alias("refs"), _words(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))

    def histogram(found: Column, refs_: Column, n: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(1), F.lit(TOP_WORDS)), lambda k: F.size(F.filter(found, lambda p: p == k)).cast("long"))
        return F.concat(counts, F.array((n - F.size(found)).cast("long")))

    # Lower case never has fewer characters, so longer words than the longest of the reference need no look-up.
    short = F.filter("words", lambda w: F.char_length(w) <= F.col("longest"))
    found = F.filter(F.transform(short, lambda w: F.array_position(F.col("refs"), F.lower(w))), lambda p: p > 0)
    # Of a class with many characters the rest is removed, which is faster than finding each.
    counted = {"lower": F.char_length(F.regexp_replace("text", r"\P{Ll}+", "")), "white": F.char_length("text") - F.char_length(F.regexp_replace("text", WHITE, ""))}
    classes = [counted.get(k, F.regexp_count("text", F.lit(p))).cast("long").alias(k) for k, p in CLASSES.items()]
    d = d.select(
        "id", "carried", "lang",
        F.size("words").cast("long").alias("n_words"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        let(found, lambda p: histogram(p, F.col("refs"), F.size("words"))).alias("word_counts"),
        F.char_length("text").cast("long").alias("chars"),
        *classes,
    )
    d = d.withColumn("word_chars", F.col("chars") - F.col("white")).withColumn("class_counts", F.array(*CLASSES, F.col("chars") - reduce(lambda a, b: a + b, [F.col(c) for c in CLASSES])))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    d = ws.table(d.drop(*CLASSES, "chars").withColumn("base_failed", base_failed), "counts")

    n_class = len(CLASSES) + 1
    good = d.where("n_words > 0")
    sums = [F.sum(F.element_at("class_counts", i + 1)).alias(f"c{i}") for i in range(n_class)] + [F.sum(F.element_at("word_counts", i + 1)).alias(f"w{i}") for i in range(TOP_WORDS + 1)]
    by_lang = good.where("lang is not null").groupBy("lang").agg(*sums)
    totals = lambda p, n: F.greatest(reduce(lambda a, b: a + b, [F.col(f"{p}{i}") for i in range(n)]), F.lit(1))
    common = refs.where("lang is null").select("n")
    pooled = good.agg(*sums[:n_class], F.sum("n_words").alias("total")).crossJoin(common)
    counted = [F.coalesce(F.get("n", F.lit(i)), F.lit(0)) for i in range(TOP_WORDS)]
    pooled = pooled.select(F.lit(None).cast("string").alias("lang"), *[f"c{i}" for i in range(n_class)], *[c.alias(f"w{i}") for i, c in enumerate(counted)], (F.col("total") - reduce(lambda a, b: a + b, counted)).alias(f"w{TOP_WORDS}"))
    ref = by_lang.unionByName(pooled).select(F.col("lang").alias("ref_lang"), F.array(*[F.col(f"c{i}") / totals("c", n_class) for i in range(n_class)]).alias("ref_c"), F.array(*[F.col(f"w{i}") / totals("w", TOP_WORDS + 1) for i in range(TOP_WORDS + 1)]).alias("ref_w"))
    ref = ws.table(ref, "shares")
    out = d.join(sized(ref, SENT_BYTES), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    no_class, no_word = F.array(*[F.lit(0.0)] * n_class), F.array(*[F.lit(0.0)] * (TOP_WORDS + 1))
    out = out.withColumn("class_distance", F.round(js_distance(F.col("class_counts"), F.coalesce("ref_c", no_class)), 6)).withColumn("word_distance", F.round(js_distance(F.col("word_counts"), F.coalesce("ref_w", no_word)), 6))
    kept = ~F.col("base_failed") & (F.col("class_distance") <= max_class_distance) & (F.col("word_distance") <= max_word_distance)
    return out.withColumn("kept", kept), ws


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50, max_repeat: int = 50, max_class_distance: float = 0.28, max_word_distance: float = 0.45) -> DataFrame:
    """Base counts, distances to the language reference and the verdict of each row.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance and
    word_distance. A null text is empty; rows without words fail the base rules; every language has its own reference,
    however few its rows; a null language uses that of all rows; null ids stay null; among words equally common the
    first in code point order enters the reference; repeated rows repeat their result; an empty table gives an empty
    result; other columns are ignored, whatever their names. Texts may have any length.
    """
    out, ws = _judged(docs, id_col, text_col, lang_col, (), min_words, max_repeat, max_class_distance, max_word_distance)
    return ws.result(out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50, max_repeat: int = 50, max_class_distance: float = 0.28, max_word_distance: float = 0.45) -> DataFrame:
    """The rows that the rules of ``quality_rules`` keep, with all their columns and each as often as it was there."""
    out, ws = _judged(docs, id_col, text_col, lang_col, tuple(docs.columns), min_words, max_repeat, max_class_distance, max_word_distance)
    return ws.result(out.where("kept").select("carried.*"))
