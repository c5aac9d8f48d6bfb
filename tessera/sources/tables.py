"""Scans and sinks: Parquet tables with the columns a plan needs, question sets, run store."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder; only the named columns reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than the cluster has cores is dealt out, so that a single file does not run in one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Tables held at a time; the oldest is let go when another comes, and made again should a plan still read it.
HELD = 12
_held: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """A table that a plan reads several times is made once, at once, and kept on the disks of the executors that made it.

    Made within the plan, its readers would start together and each executor make parts anew; its size would not be known.
    A mark of its own keeps another call on the same path from finding it: files may have changed.
    """
    df = df.where(F.lit(uuid.uuid4().hex) != "")
    while len(_held) >= HELD:
        _held.pop(0).unpersist()
    _held.append(df.persist(StorageLevel.DISK_ONLY))
    df.count()
    return df


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id and text of documents, null text as empty."""
    return spread(scan(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), F.coalesce("text", F.lit("")).alias("text")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("question"))


def resolve_column(df: DataFrame, *candidates: str) -> str:
    """The first candidate that the table has, case-insensitively."""
    by_lower = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in by_lower:
            return by_lower[c.lower()]
    raise ValueError(f"none of {candidates} among {df.columns}")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a hash of key and seed, the same in every run."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, schema hash and an order-insensitive hash of all records."""
    schema = hashlib.sha256(json.dumps(sorted(df.dtypes)).encode()).hexdigest()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).cast("string").alias("records_hash")).withColumn("schema_hash", F.lit(schema))


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(frames.items()):
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def write_table(df: DataFrame, path: str, *partition_by: str, mode: str = "error") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


class RunStore:
    """Append-only runs and their per-question results in one folder; a run's state is its latest record."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, run_id: str, seq: int, status: str, config: dict, metrics: dict | None = None) -> None:
        row = [(run_id, seq, status, json.dumps(config, sort_keys=True), json.dumps(metrics or {}, sort_keys=True))]
        self.spark.createDataFrame(row, "run_id string, seq long, status string, config string, metrics string").write.mode("append").parquet(f"{self.path}/runs")

    def latest(self) -> DataFrame:
        runs = self.spark.read.parquet(f"{self.path}/runs")
        return runs.groupBy("run_id").agg(F.max_by(F.struct("seq", "status", "config", "metrics"), "seq").alias("r")).select("run_id", "r.*").orderBy(F.desc("seq"))

    def put_questions(self, run_id: str, rows: DataFrame) -> None:
        rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{self.path}/questions")

    def questions(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/questions").where(F.col("run_id") == run_id)
