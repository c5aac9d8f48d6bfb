"""A training corpus from documents: quality rules, exact and near deduplication, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import WHITE, Workspace, sized


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the quality rules reject go; null texts are empty and go, repeated rows stay or go
    together, an empty table stays empty."""
    from tessera.llm.quality_rules import keep_good

    return keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of equal texts stays.

    Where rows repeat an id (null ids count as equal), the id alone does not say which row stays: of those the rows with
    a kept text stay, one of each text. Null texts equal empty ones; an empty table stays empty.
    """
    from tessera.llm.exact_dedup import exact_dedup

    decided = exact_dedup(docs.select("doc_id", "text"))
    ids = Workspace(spark, "exact-stage").table(decided.groupBy(F.col("doc_id").alias("_c_id")).agg(F.max("kept").alias("_c_any"), F.count(F.lit(1)).alias("_c_n")).where("_c_n > 1 or not _c_any"), "ids")
    same = docs["doc_id"].eqNullSafe(F.col("_c_id"))
    stay = docs.join(sized(ids), same, "left_anti")
    twice = ids.where("_c_n > 1 and _c_any").select("_c_id")
    if twice.isEmpty():
        return stay
    bare = F.sha2(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), WHITE, ""), 256)
    repeated = docs.join(sized(twice), same, "left_semi").withColumn("_c_sha", bare)
    keys = decided.where("kept").select(F.col("doc_id").alias("_c_id"), F.col("text_sha256").alias("_c_key")).distinct()
    repeated = repeated.join(keys, repeated["doc_id"].eqNullSafe(F.col("_c_id")) & (F.col("_c_sha") == F.col("_c_key")), "left_semi")
    return stay.unionByName(repeated.dropDuplicates(["doc_id", "_c_sha"]).drop("_c_sha"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one row of each component of near copies stays, also where ids repeat or are null.

    Rows without words are near nothing and stay; an empty table stays empty.
    """
    from tessera.llm.chosen_path import keep_one

    return keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: a document stays as often as the mix takes it, none to twice (its rows repeat).

    The mix takes blocks of words; a document's share, taken over size, is rounded up or down by a seeded hash of its
    id, so that the words of a source stay near its target. Rows of one id (null ids too) share one number. Rows without
    words are not taken; an empty table stays empty.
    """
    from tessera.llm.mixing import mix

    taken = mix(docs.select("doc_id", "text", "source")).groupBy(F.col("doc_id").alias("_c_id")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    chance = F.pmod(F.xxhash64(F.lit(29), "_c_id"), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + chance).cast("int")
    taken = Workspace(spark, "mixing-stage").table(taken.select("_c_id", F.least(times, F.lit(2)).alias("_c_times")).where("_c_times > 0"), "times")
    joined = docs.join(sized(taken), docs["doc_id"].eqNullSafe(F.col("_c_id")))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_c_times"))).alias("_c_copy")).drop("_c_copy")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the documents of the mix, cut and packed into sequences of 2048 tokens.

    Null texts are empty and one token long; repeated rows are packed each; an empty table gives no sequence.
    """
    import public_tokenizers

    from tessera.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenisation and block selection are beyond SQL; tests/llm holds the stages' rows against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again by the next."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = ws.table(docs, f"stage{i}")
    return ws.result(docs)
