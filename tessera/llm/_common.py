"""Shared plumbing of the training-data operators: scratch tables and sized broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts state it: [\x20\x09-\x0D].
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]"
WHITE_BYTES = b" \t\n\x0b\x0c\r"

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Only a local master, whose executors are the driver, may do without: a temporary folder is made then. On a
    cluster a missing setting is an error, as every executor would write to a disk of its own.
    """
    global _own_root
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_root


def delete_path(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def make_dirs(spark: SparkSession, uri: str) -> str:
    """Makes a folder and returns its fully qualified address."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    return fs.makeQualified(path).toString()


class Workspace:
    """Intermediate tables of one operator call, written to the shared folder.

    Writing a table cuts lineage in a way that survives lost executors: later steps reread files.
    ``result`` writes the final table and removes the intermediate ones at once; the final one goes
    when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, list[str]] = {}
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        p = f"{self.base}/{name}-{self.made}"
        self.paths.setdefault(name, []).append(p)
        return p

    def table(self, df: DataFrame, name: str) -> DataFrame:
        p = self.path(name)
        df.write.option("compression", "zstd").parquet(p)
        return self.spark.read.schema(df.schema).parquet(p)

    def drop(self, *names: str) -> None:
        for n in names:
            for p in self.paths.pop(n, ()):
                delete_path(self.spark, p)

    def result(self, df: DataFrame) -> DataFrame:
        out = self.table(df, "result")
        self.drop(*[n for n in self.paths if n != "result"])
        atexit.register(_forget, self.spark, self.base)
        return out


def _forget(spark: SparkSession, base: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete_path(spark, base)
    except Exception:  # the session may be gone already; the folder is scratch space
        pass


def weight(df: DataFrame) -> Column:
    """Bytes of a row, about: eight a fixed value, the length of strings and binaries, the elements of arrays."""
    parts = [F.lit(16)]
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)) + 8)
        elif kind == "array<string>":
            parts.append(F.coalesce(F.octet_length(F.concat_ws("", c)) + 16 * F.size(c), F.lit(8)))
        elif kind.startswith("array<"):
            parts.append(F.greatest(16 * F.size(c), F.lit(8)))
        else:
            parts.append(F.lit(8))
    return sum(parts[1:], parts[0]).cast("long")


def sized(df: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """A broadcast hint if a sum over the table proves that it has at most max_bytes, else the table as it is.

    The sum is a pass of its own: give it a table that is written, not a long plan.
    """
    return F.broadcast(df) if (df.agg(F.sum(weight(df)).alias("n")).first()["n"] or 0) <= max_bytes else df


def global_rank(df: DataFrame, ws: Workspace, name: str, *order: Column) -> DataFrame:
    """Adds ``place``, 1 to n in the given order, without a task that holds all rows.

    Rows are dealt by range and written with the number of their range; the counts of the ranges (one row a range)
    say where each begins.
    """
    dealt = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt = ws.table(dealt.withColumn("range_no", F.spark_partition_id()), name)
    sizes = {r["range_no"]: r["n"] for r in dealt.groupBy("range_no").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    starts, at = [], 0
    for k in sorted(sizes):
        starts.append((k, at))
        at += sizes[k]
    begin = df.sparkSession.createDataFrame(starts, "range_no int, range_start long")
    inside = F.row_number().over(Window.partitionBy("range_no").orderBy(*order))
    return dealt.withColumn("inside", inside).join(F.broadcast(begin), "range_no").withColumn("place", F.col("range_start") + F.col("inside")).drop("range_no", "range_start", "inside")


def text_of(df: DataFrame, name: str) -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once: a lambda variable is bound, not inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_remainder(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def union_find(n: int):
    """(find, union) over 0..n-1; the smaller root stays the root."""
    up = list(range(n))

    def find(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def union(a: int, b: int) -> None:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)

    return find, union
