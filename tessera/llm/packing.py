"""Packing token sequences by minimum bin slack.

Tokenising tasks cut documents into pieces and number the pieces of each length. Only the histogram of lengths
(at most ``capacity`` rows) goes to the driver, which fills bins one pattern at a time: the longest length left opens
the bin, a bitset subset-sum over the lengths left finds the fullest feasible combination, and that pattern is
removed as often as the counts allow. Pieces then look up their bin by length and number.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Workspace, text_of


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats) whose sum is the largest possible up to room, by bitset subset-sum.

    Bit s of ``reach`` says that sum s can be made of the lengths seen so far; a snapshot after each copy gives the
    way back. Ends early once room itself is reached.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            after = (reach | reach << length) & mask
            if after == reach:
                break
            steps.append((length, reach))
            reach = after
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> at & 1:
            chosen.append(length)
            at -= length
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins), by minimum bin slack with the longest piece fixed."""
    left, out = {k: v for k, v in histogram.items() if v > 0}, []
    longest = sorted(left)
    while left:
        while longest[-1] not in left:
            longest.pop()
        top = longest[-1]
        left[top] -= 1
        rest = fullest({k: v for k, v in left.items() if v > 0}, capacity - top)
        left[top] += 1
        pattern = [top, *rest]
        need: dict[int, int] = {}
        for x in pattern:
            need[x] = need.get(x, 0) + 1
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((pattern, times))
    return out


def slots(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first number, pieces of it in a bin, first bin, offset of the first) in number order."""
    used: dict[int, int] = {}
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    bin_id = 0
    for pattern, times in plan:
        offset = 0
        for length in dict.fromkeys(pattern):
            n = pattern.count(length)
            table.setdefault(length, []).append((used.get(length, 0), n, bin_id, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        bin_id += times
    return {k: np.array(v, np.int64) for k, v in table.items()}


_PIECE = "part long, id long, piece int, start long, length long, ids_crc32 long, rank long"


# The tokenizer's split into contractions, letters, single digits and the rest, over plain Latin text.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
PLAIN = re.compile(f"[!-~{LETTERS}]+")


class WordIds(dict):
    """Ids of white-space separated words as little-endian bytes, kept for words met again: the last ``most`` words that
    were new, and those before them, from which a word met again comes back.

    The tokenizer drops white space and never joins across it. A word of plain Latin letters and printable ASCII is
    lower-cased and split here and only its pieces go through the merges; any other word, or one that may hold a
    special token, goes through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 150_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole, self.most, self.old = Tokenizer.from_file(path), most, {}
        self.merge = self.whole.model.tokenize
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in set(plain)]
        self.chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def piece(self, text: str) -> bytes:
        units = text if text.isascii() else "".join(map(self.chars.__getitem__, text.encode()))
        return array("I", [t.id for t in self.merge(units)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if (got := self.old.get(word)) is None:
            got = self.find(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got

    def find(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone are one piece
            low = word.lower()
            return self[low] if low != word else self.piece(word.decode())
        if word[:-1].isalpha() and 32 < word[-1] < 127 and not word[-1:].isdigit():  # and so is one sign behind them
            return self[word[:-1].lower()] + self[word[-1:]]
        text = word.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            low = text.lower()
            parts = PIECES.findall(low)
            return b"".join([self[x.encode()] for x in parts]) if len(parts) > 1 else self.piece(low)
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


def _tokenise(path: str, end_id: int, capacity: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(path).__getitem__
        end = array("I", [end_id]).tobytes()
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = b"".join([*map(ids_of, text.split()), end])
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    for column, value in zip(out, (part, i, piece, at // 4, length, zlib.crc32(own), rank), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["part", "id", "piece", "start", "length", "ids_crc32", "rank"])

    return work


def _place(table: dict[int, np.ndarray]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length).tolist():
                at = np.flatnonzero(length == one)
                rows = table[one][np.searchsorted(table[one][:, 0], rank[at], side="right") - 1]
                inside = rank[at] - rows[:, 0]
                bins[at] = rows[:, 2] + inside // rows[:, 1]
                offsets[at] = rows[:, 3] + inside % rows[:, 1] * one
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offsets)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return work


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs the tokenised rows, each followed by ``end_id``, into sequences of at most ``capacity`` tokens.

    Returns one row per piece: id, piece, start, length, ids_crc32, sequence_id, offset. Only rows longer than the
    capacity are cut. A null or empty text is the end id alone; repeated rows and null ids are packed like any
    others; an empty table gives an empty result. The tokenizer must drop white space (as word-level BPE does).
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    src = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).cast("binary").alias("text"))
    pieces = ws.table(src.mapInArrow(_tokenise(tokenizer_path, end_id, capacity), _PIECE), "pieces")
    cells = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = ws.table(cells.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "cells")
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = slots(plan_bins(histogram, capacity))
    ranked = pieces.join(cells.drop("n"), ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    placed = ranked.mapInArrow(_place(table), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return ws.result(placed.withColumnRenamed("id", id_col))
