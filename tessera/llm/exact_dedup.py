"""Exact deduplication with a log-structured merge index over text digests.

1. Map tasks fill a memtable (digest -> classes of byte-equal texts). At a byte or row bound it is flushed as a
   run: entries in digest order, one per class, with the members and the class's text. Copies within a memtable
   never leave it as separate texts, so a group that holds a third of all rows is one entry per run.
2. Compaction tasks own digest ranges. Each batch of run entries becomes a sorted run with a Bloom filter; a new
   run is looked up in the older ones through their filters, runs are merged when there are several, and the merge
   keeps the smallest identifier of each digest. Digests found in two or more entries are the hits.
3. Hits receive byte verification: their texts meet in two rounds (about the square root of the runs at a time, then
   the winners), streaming, one text per class in memory. Entries with equal digests but other bytes stay apart.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WHITE_BYTES, Workspace, sized, text_of

RUN_SCHEMA = "run long, digest binary, cls int, best_chars long, best_id long, n long, ids array<long>, chars array<long>, text binary"


class Bloom:
    """A Bloom filter over 64-bit hashes, ten bits and four probes a key."""

    def __init__(self, hashes: np.ndarray):
        self.bits = max(64, 1 << int(math.ceil(math.log2(10 * max(1, len(hashes))))))
        self.words = np.zeros(self.bits // 8, np.uint8)
        for at in self._probes(hashes):
            np.bitwise_or.at(self.words, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _probes(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        for i in range(4):
            yield ((a + np.uint64(i) * b) & np.uint64(self.bits - 1)).astype(np.int64)

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._probes(hashes):
            out &= (self.words[at >> 3] >> (at & 7)) & 1 == 1
        return out


class LsmIndex:
    """Sorted digest runs with filters; merges keep the smallest identifier of a digest."""

    FAN_IN = 6

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray, Bloom]] = []
        self.hits: set[bytes] = set()

    @staticmethod
    def _hash(digests: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(digests.view(np.uint8).reshape(len(digests), 32)[:, :8]).view(np.uint64).ravel()

    def put(self, digests: np.ndarray, idents: np.ndarray) -> None:
        """A batch of entries becomes a run: sorted, repeated digests within it are hits too."""
        order = np.lexsort((idents, digests))
        digests, idents = digests[order], idents[order]
        first = np.ones(len(digests), bool)
        first[1:] = digests[1:] != digests[:-1]
        self.hits.update(digests[~first].tolist())
        digests, idents = digests[first], idents[first]
        hashes = self._hash(digests)
        for old, _, bloom in self.runs:
            if len(maybe := digests[bloom.maybe(hashes)]):
                at = np.minimum(np.searchsorted(old, maybe), len(old) - 1)
                self.hits.update(maybe[old[at] == maybe].tolist())
        self.runs.append((digests, idents, Bloom(hashes)))
        if len(self.runs) >= self.FAN_IN:
            self.compact()

    def compact(self) -> None:
        digests = np.concatenate([r[0] for r in self.runs])
        idents = np.concatenate([r[1] for r in self.runs])
        order = np.lexsort((idents, digests))
        digests, idents = digests[order], idents[order]
        first = np.ones(len(digests), bool)
        first[1:] = digests[1:] != digests[:-1]
        digests = digests[first]
        self.runs = [(digests, idents[first], Bloom(self._hash(digests)))]


def _flush_runs(memtable_bytes: int, memtable_rows: int, digest_bytes: int):
    def flush(memtable: dict, run: int) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in range(9)]
        for digest in sorted(memtable):
            for cls, (text, ids, chars) in enumerate(memtable[digest]):
                members = sorted(zip(ids, chars, strict=True), key=lambda m: (-m[1], m[0] is None, m[0] or 0))
                ids, chars = map(list, zip(*members, strict=True))  # the best member comes first
                values = (run, digest, cls, chars[0], ids[0], len(ids), ids, chars, text)
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = ["run", "digest", "cls", "best_chars", "best_id", "n", "ids", "chars", "text"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, memtable, used, n = TaskContext.get().partitionId() << 32, {}, 0, 0
        for batch in batches:
            for i, c, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                text = t.translate(None, WHITE_BYTES)
                digest = hashlib.sha256(text).digest()[:digest_bytes].ljust(32, b"\0")
                classes = memtable.setdefault(digest, [])
                known = next((x for x in classes if x[0] == text), None)
                if known is None:
                    classes.append(known := (text, [], []))
                    used += len(text)
                known[1].append(i)
                known[2].append(c)
                n += 1
                if used >= memtable_bytes or n >= memtable_rows:
                    yield flush(memtable, run)
                    run, memtable, used, n = run + 1, {}, 0, 0
        if memtable:
            yield flush(memtable, run)

    return work


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = LsmIndex()
    for batch in batches:
        if batch.num_rows:
            digests = np.array(batch.column(0).to_pylist(), "S32")
            index.put(digests, np.asarray(batch.column(1).to_numpy(zero_copy_only=False)))
    hits = [h.ljust(32, b"\0") for h in sorted(index.hits)]
    yield pa.RecordBatch.from_arrays([pa.array(hits, pa.binary())], ["digest"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in (digest, grp) order: the first entry with the same bytes is an entry's root; roots keep their text."""
    key, classes = None, []
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for digest, grp, run, cls, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if (digest, grp) != key:
                key, classes = (digest, grp), []
            root = next((r for r in classes if r[2] == text), None)
            new = root is None
            if new:
                classes.append(root := (run, cls, text))
            for column, value in zip(out, (digest, run, cls, root[0], root[1], text if new else None), strict=True):
                column.append(value)
        types = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["digest", "run", "cls", "root_run", "root_cls", "text"])


_VERIFIED = "digest binary, run long, cls int, root_run long, root_cls int, text binary"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_bytes: int = 16 << 20, memtable_rows: int = 50_000, digest_bytes: int = 32) -> DataFrame:
    """Groups rows whose texts are equal after deleting ASCII white space; one row of each group stays.

    Returns one row per input row: id, keep_id, group_size, kept, text_sha256 (hex of the normalised UTF-8).
    The row with the most code points stays, then the one with the smallest id (null ids last). Null texts are
    empty, and empty texts equal each other. Of repeated rows that tie on both, exactly one is kept. An empty table
    gives an empty result; other columns are ignored. ``digest_bytes`` below 32 shortens the index's digests (the
    result stays exact, since hits are verified byte by byte; tests force collisions with it).
    """
    ws = Workspace(docs.sparkSession, "exact-dedup")
    text = text_of(docs, text_col)
    src = docs.select(docs[id_col].cast("long").alias("id"), F.char_length(text).cast("long").alias("chars"), text.cast("binary").alias("text"))
    runs = ws.table(src.mapInArrow(_flush_runs(memtable_bytes, memtable_rows, digest_bytes), RUN_SCHEMA), "runs")

    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = ws.table(runs.select("digest", "run").repartition(n_parts, "digest").mapInArrow(_compact, "digest binary"), "hits")
    per_group = max(1, math.isqrt(runs.select("run").distinct().count()))
    entries = runs.join(sized(hits), "digest", "left_semi").select("digest", F.pmod(F.hash("run"), F.lit(per_group)).alias("grp"), "run", "cls", "text")
    one = ws.table(entries.repartition(n_parts, "digest", "grp").sortWithinPartitions("digest", "grp", "run", "cls").mapInArrow(_verify, _VERIFIED), "verified")
    again = one.where("text is not null").select("digest", F.lit(0).alias("grp"), "run", "cls", "text")
    two = again.repartition(n_parts, "digest").sortWithinPartitions("digest", "run", "cls").mapInArrow(_verify, _VERIFIED)
    two = two.select("digest", F.col("run").alias("root_run"), F.col("cls").alias("root_cls"), F.col("root_run").alias("top_run"), F.col("root_cls").alias("top_cls"))
    roots = one.drop("text").join(two, ["digest", "root_run", "root_cls"]).select("digest", "run", "cls", "top_run", "top_cls")

    rank = F.struct((-F.col("best_chars")).alias("c"), F.col("best_id").isNull().alias("no"), F.coalesce("best_id", F.lit(0)).alias("i"), "run", "cls")
    members = runs.drop("text").join(roots, ["digest", "run", "cls"], "left")
    members = members.withColumn("top_run", F.coalesce("top_run", "run")).withColumn("top_cls", F.coalesce("top_cls", "cls"))
    members = ws.table(members, "members")
    groups = members.groupBy("digest", "top_run", "top_cls").agg(F.sum("n").alias("group_size"), F.min(rank).alias("best"))
    multi = groups.join(roots.select("digest", "top_run", "top_cls").distinct(), ["digest", "top_run", "top_cls"], "left_semi")
    alone = F.struct((-F.col("best_chars")).alias("c"), F.col("best_id").isNull().alias("no"), F.coalesce("best_id", F.lit(0)).alias("i"), "run", "cls")
    joined = members.join(multi, ["digest", "top_run", "top_cls"], "left").select(
        "run", "cls", "ids", "chars", "digest", F.coalesce("group_size", "n").alias("group_size"), F.coalesce("best", alone).alias("best")
    )
    exploded = joined.select("*", F.posexplode(F.arrays_zip("ids", "chars")).alias("pos", "m"))
    out = exploded.select(
        F.col("m.ids").alias(id_col),
        F.when(~F.col("best.no"), F.col("best.i")).alias("keep_id"),
        "group_size",
        ((F.col("run") == F.col("best.run")) & (F.col("cls") == F.col("best.cls")) & (F.col("pos") == 0)).alias("kept"),
        "digest", "run", "cls",
    )
    if digest_bytes == 32:
        out = out.withColumn("text_sha256", F.lower(F.hex("digest")))
    else:
        out = out.join(runs.select("digest", "run", "cls", F.sha2("text", 256).alias("text_sha256")), ["digest", "run", "cls"])
    return ws.result(out.select(id_col, "keep_id", "group_size", "kept", "text_sha256"))
