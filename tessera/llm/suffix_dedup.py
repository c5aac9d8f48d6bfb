"""Removal of repeated byte strings by a distributed suffix sort with bucket-pointer refinement.

A 200-byte window belongs to one anchor: the 24-gram in it with the smallest hash (ties: the leftmost). Equal windows
have equal anchors at equal places, so suffixes need to be sorted only among those of one anchor, and only anchors
that occur twice matter. Documents are kept in parts (a bounded number of bytes each, one bucket of a table, so the
text is never shuffled). Each part reports its distinct anchors; told which of them repeat, it sends the segments of
text around them, equal segments once. The tasks that receive the segments sort their suffixes: initial buckets by
8-grams, refined by sorting on pairs of bucket identifiers (own, and that of a later offset), whose updates serve the
next, twice as deep round, until the buckets are 200 bytes deep. Buckets with two or more suffixes are the repeats.
An anchor with more segments than a task's even share is split by the next gram: the windows of its segments are grouped
by the smallest gram under another hash besides, again with equal windows together, until groups are small or the
grams are used up; then they are refined like the others. Equal segments meet in order and are known as repeats without
being held, so a task holds different segments only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, sized, text_of
from .chosen_path import mix64

GRAM, CHUNK = 24, 2 << 20
_TABLE = np.random.default_rng(77).integers(1, 1 << 63, 256, np.uint64)
_P = 0x9E3779B97F4A7C15


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all 24-grams, by doubling."""
    p = [np.uint64(pow(_P, 1 << k, 1 << 64)) for k in range(5)]
    with np.errstate(over="ignore"):
        h = _TABLE[b]
        for k in range(3):
            h = h[: -(1 << k)] + p[k] * h[1 << k :]
        h8 = h
        h16 = h8[:-8] + p[3] * h8[8:]
        return mix64(h16[: len(b) - GRAM + 1] + p[4] * h8[16 : 16 + len(b) - GRAM + 1])


def anchor_runs(b: np.ndarray, doc: np.ndarray, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of the runs of windows that share an anchor.

    ``doc`` numbers the document of each byte; windows lie within one document. At most 2**24 bytes at a time. Another
    ``salt`` is another order of the grams.
    """
    n, w = len(b), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = mix64(gram_hashes(b) ^ np.uint64(salt)) if salt else gram_hashes(b)
    low = np.uint64((1 << 24) - 1)
    m = len(h)
    v = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
    v[:m] = (h & ~low) | np.arange(m, dtype=np.uint64)
    v = v.reshape(-1, w)
    pre = np.minimum.accumulate(v, 1).ravel()
    suf = np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()
    n_win = n - length + 1
    at = (np.minimum(suf[:n_win], pre[w - 1 : w - 1 + n_win]) & low).astype(np.int64)
    ok = doc[:n_win] == doc[length - 1 :]
    start = ok.copy()
    start[1:] &= ~(ok[:-1] & (at[1:] == at[:-1]))
    end = ok.copy()
    end[:-1] &= ~(ok[1:] & (at[1:] == at[:-1]))
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    return h[at[first]], first, last


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """(bytes, document of each byte, (document, its offset less the chunk's place)) of about CHUNK bytes.

    A longer document comes in overlapping stretches, so each window lies in exactly one chunk. The overlap is one
    byte less than a window.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def pack():
        b = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        doc = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
        return b, doc, [(x[0], x[1]) for x in held]

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK):
            piece = text[at : at + CHUNK + length - 1]
            if len(piece) < length:
                continue
            held.append((i, at, piece))
            size += len(piece)
            if size >= CHUNK:
                yield pack()
                held, size = [], 0
    if held:
        yield pack()


def _parts(part_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            parts = []
            for size in batch.column(1).to_pylist():
                if used and used + size > part_bytes:
                    part, used = part + 1, 0
                parts.append(part)
                used += size + 64
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), *batch.columns], ["part", "id", "n", "text"])

    return work


def _anchors(length: int):
    def work(key, rows):
        found = [anchor_runs(b, doc, length)[0] for b, doc, _ in _chunks(rows.column("text").to_pylist(), length)]
        g, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        return pa.table({"part": pa.array(np.full(len(g), key[0].as_py()), pa.int64()), "g": pa.array(g.view(np.int64)), "many": pa.array(n > 1)})

    return work


def part_segments(texts: list[bytes], repeated: np.ndarray, length: int) -> tuple[list[tuple[int, bytes]], list[int], list[tuple[int, int, int]]]:
    """Distinct (anchor, segment), how often each occurs in the part, and occurrences (segment, document, start)."""
    known: dict[tuple[int, bytes], int] = {}
    counts: list[int] = []
    places: list[tuple[int, int, int]] = []
    for b, doc, origin in _chunks(texts, length):
        g, first, last = anchor_runs(b, doc, length)
        if not len(g) or not len(repeated):
            continue
        hit = repeated[np.minimum(np.searchsorted(repeated, g), len(repeated) - 1)] == g
        raw = b.tobytes()
        lengths = np.bincount(doc, minlength=len(origin))
        begins = np.cumsum(lengths) - lengths
        for h, a, z in zip(g[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
            key = (h, raw[a : z + length])
            seg = known.setdefault(key, len(known))
            if seg == len(counts):
                counts.append(0)
            counts[seg] += 1
            i = doc[a]
            places.append((seg, origin[i][0], origin[i][1] + a - int(begins[i])))
    return list(known), counts, places


def _segments(length: int):
    def work(key, rows, told):
        repeated = np.sort(told.column("g").to_numpy().view(np.uint64))
        own, counts, _ = part_segments(rows.column("text").to_pylist(), repeated, length)
        return pa.table({
            "g": pa.array(np.array([k[0] for k in own], np.uint64).view(np.int64)),
            "part": pa.array([key[0].as_py()] * len(own), pa.int64()),
            "seg": pa.array(range(len(own)), pa.int64()),
            "base": pa.array([0] * len(own), pa.int64()),
            "many": pa.array([c > 1 for c in counts], pa.bool_()),
            "bytes": pa.array([k[1] for k in own], pa.binary()),
        })

    return work


def refine_buckets(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows' suffixes share a bucket ``length`` bytes deep.

    Bucket-pointer refinement: buckets of 8-grams, then rounds in which the unfinished suffixes are sorted by (bucket,
    bucket at the offset where the known depth ends); singletons are finished.
    """
    data = np.frombuffer(b"".join(segments) + bytes(8), np.uint8)
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    room = np.repeat(ends, sizes) - np.arange(n)  # bytes from here to the segment's end
    grams = np.zeros(n, np.uint64)
    for k in range(8):
        grams |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    depth = min(8, length)
    if depth < 8:
        grams &= np.uint64((1 << (8 * depth)) - 1)
    bucket = n + np.arange(n)  # finished suffixes have buckets of their own
    live = np.flatnonzero(room >= depth)

    def update(keys: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = np.unique(keys, return_inverse=True, return_counts=True)[1:]
        shared = counts[ids] > 1
        new = n + np.arange(n)
        new[live[shared]] = ids[shared]
        return new, live[shared]

    bucket, live = update(grams[live], live)
    while depth < length and len(live):
        step = min(depth, length - depth)
        live = live[room[live] >= depth + step]
        bucket, live = update((bucket[live].astype(np.uint64) << np.uint64(32)) | bucket[live + step].astype(np.uint64), live)
        depth += step
    out = np.zeros(n, bool)
    out[live] = True
    return [out[e - s : e - length + 1] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


_SEGMENT = "g long, part long, seg long, base long, many boolean, bytes binary"
_SEGMENT_COLUMNS = ("g", "part", "seg", "base", "many", "bytes")
_COVER = "part long, seg long, lo long, hi long"


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def _refine(length: int, batch_bytes: int = 3 << 20):
    """Rows sorted by anchor and bytes: whole anchors are gathered up to a size and sorted together.

    A segment equal to the one before is a repeat from end to end; so is that one. Only different ones are held.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]
        held: list[list] = []
        size, last = 0, None

        def add(part: int, seg: int, lo: int, hi: int) -> None:
            for column, value in zip(out, (part, seg, lo, hi), strict=True):
                column.append(value)

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["part", "seg", "lo", "hi"])
            for column in out:
                column.clear()
            return rows

        def solve() -> None:
            for (part, seg, base, many, segment), flags in zip(held, refine_buckets([h[4] for h in held], length), strict=True):
                for lo, hi in [(0, len(segment) - length)] if many else _ranges(flags):
                    add(part, seg, base + lo, base + hi)
            held.clear()

        for batch in batches:
            for g, part, seg, base, many, segment in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if g == last and held and held[-1][4] == segment:
                    held[-1][3] = True
                    add(part, seg, base, base + len(segment) - length)
                    continue
                if g != last and size >= batch_bytes:
                    solve()
                    size = 0
                last = g
                held.append([part, seg, base, many, segment])
                size += len(segment)
            if len(out[0]) > 50_000:
                yield flush()
        if held:
            solve()
        yield flush()

    return work


def _split(length: int, salt: int):
    """The segments of hot anchors, cut where the smallest gram under another hash changes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            g, texts = batch.column(0).to_numpy().view(np.uint64), batch.column(5).to_pylist()
            b, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
            begins, rows, at = np.cumsum(sizes) - sizes, [], 0
            while at < len(texts):  # segments are short; so many at a time as anchor_runs takes
                end = max(at + 1, int(np.searchsorted(begins + sizes, begins[at] + CHUNK)))
                lo, hi = begins[at], begins[end - 1] + sizes[end - 1]
                h, first, last = anchor_runs(b[lo:hi], np.repeat(np.arange(at, end), sizes[at:end]), length, salt)
                rows.append((h, first + lo, last + lo))
                at = end
            h, first, last = (np.concatenate(x) for x in zip(*rows, strict=True))
            own = np.searchsorted(begins, first, "right") - 1
            raw = b.tobytes()
            with np.errstate(over="ignore"):
                key = mix64(g[own] * np.uint64(3) + h)
            yield pa.RecordBatch.from_arrays([
                pa.array(key.view(np.int64)), batch.column(1).take(pa.array(own)), batch.column(2).take(pa.array(own)),
                pa.array(batch.column(3).to_numpy()[own] + first - begins[own]), batch.column(4).take(pa.array(own)),
                pa.array([raw[x : y + length] for x, y in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()),
            ], batch.schema.names)

    return work


def _remove(length: int):
    def work(key, rows, told):
        texts = rows.column("text").to_pylist()
        seg = told.column("seg").to_numpy(zero_copy_only=False)
        is_anchor = told.column("g").is_valid().to_numpy(zero_copy_only=False)
        repeated = np.sort(told.column("g").filter(pa.array(is_anchor)).to_numpy().view(np.uint64))
        cover: dict[int, list[tuple[int, int]]] = {}
        for s, lo, hi in zip(seg[~is_anchor].tolist(), told.column("lo").to_numpy(zero_copy_only=False)[~is_anchor].tolist(), told.column("hi").to_numpy(zero_copy_only=False)[~is_anchor].tolist(), strict=True):
            cover.setdefault(int(s), []).append((int(lo), int(hi)))
        _, _, places = part_segments(texts, repeated, length)
        spans: dict[int, list[tuple[int, int]]] = {}
        for s, i, start in places:
            for lo, hi in cover.get(s, ()):
                spans.setdefault(i, []).append((start + lo, start + hi + length))
        out: list[list] = [[] for _ in range(5)]
        for i, text in enumerate(texts):
            merged: list[list[int]] = []
            for a, b in sorted(spans.get(i, ())):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            kept, at = [], 0
            for a, b in merged:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            values = (sum(b - a for a, b in merged), len(merged), hashlib.sha256(b"".join(kept)).hexdigest(), [m[0] for m in merged], [m[1] for m in merged])
            for column, value in zip(out, values, strict=True):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["n_removed", "n_spans", "kept_sha256", "span_starts", "span_ends"]
        return pa.table({"id": rows.column("id"), "n_bytes": rows.column("n")} | {k: pa.array(c, t) for k, c, t in zip(names, out, types, strict=True)})

    return work


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, part_bytes: int = 8 << 20, hot_least: int = 1024, levels: int = 4) -> DataFrame:
    """Removes each byte covered by a ``length``-byte string that also starts anywhere else, same row included.

    Returns one row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, span_starts, span_ends (bytes).
    Matches lie within one row's UTF-8 text and are judged on the input. Null texts are empty; texts shorter than
    ``length`` keep all bytes; repeated rows are copies of each other; null ids are kept as they are; an empty table
    gives an empty result; other columns are ignored; a text may have any length. length must be at least 25.
    ``hot_least`` and ``levels`` say from how many segments and how often an anchor is split; results do not depend on
    them.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix-dedup")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = text_of(docs, text_col).cast("binary")
    src = docs.select(docs[id_col].cast("long").alias("id"), F.octet_length(text).cast("long").alias("n"), text.alias("text"))
    name = f"suffix_dedup_{uuid.uuid4().hex}"
    src.mapInArrow(_parts(part_bytes), "part long, id long, n long, text binary").write.bucketBy(n_parts, "part").option("compression", "zstd").option("path", ws.path("parts")).saveAsTable(name)
    parts = spark.table(name)

    def of(side: DataFrame, work, schema: str) -> DataFrame:
        return parts.groupBy("part").cogroup(side.groupBy("part")).applyInArrow(work, schema)

    # The anchors come grouped by part straight from the buckets; only (anchor, part) is shuffled.
    anchors = ws.table(parts.groupBy("part").applyInArrow(_anchors(length), "part long, g long, many boolean"), "anchors")
    repeated = anchors.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("any")).where("n > 1 or any").select("g")
    told = ws.table(anchors.select("part", "g").join(sized(ws.table(repeated, "repeated")), "g", "left_semi").select("part", "g"), "told")
    ws.drop("anchors", "repeated")
    found = ws.table(of(told, _segments(length), _SEGMENT), "segments")
    # An anchor is hot if its segments alone are more than a task's even share; it is split by further grams.
    limit = max(hot_least, found.count() // n_parts)
    cover = None
    for level in range(levels + 1):
        hot = ws.table(found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("g"), "hot")
        done = level == levels or hot.isEmpty()
        few = found if done else found.join(sized(hot), "g", "left_anti")
        own = few.repartition(n_parts, "g").sortWithinPartitions("g", "bytes").mapInArrow(_refine(length), _COVER)
        cover = own if cover is None else cover.unionByName(own)
        if done:
            break
        found = ws.table(found.join(sized(hot), "g", "left_semi").select(*_SEGMENT_COLUMNS).mapInArrow(_split(length, level + 1), _SEGMENT), "split")
    cover = ws.table(cover, "cover")
    ws.drop("segments", "split", "hot")
    both = told.select("part", "g", *[F.lit(None).cast("long").alias(c) for c in ("seg", "lo", "hi")]).unionByName(cover.select("part", F.lit(None).cast("long").alias("g"), "seg", "lo", "hi"))
    try:
        out = ws.result(of(both, _remove(length), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>").withColumnRenamed("id", id_col))
    finally:
        spark.sql(f"DROP TABLE {name}")
    return out
