"""Scores of passages and of their chunks in one pass over the text, with nothing exploded or shuffled.

Tasks work on UTF-8 bytes: there white space, digits and cases are those of ASCII, as in the patterns of the plans. A
passage is cut here by the same rules as by the chunkers of the plans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, quality

_BREAK = re.compile(rb"[.!?]\s+(?=[A-Z0-9])")  # T.SENTENCE_BREAK with the sign before it, which is found faster
_CONJUNCTION = re.compile(chunking.CONJUNCTION.encode())
_CONJUNCTIONS = re.findall(rb"[a-z]{3,}", chunking.CONJUNCTION.encode())
_WORD = re.compile(rb"[a-z0-9-]+")
_ANY_WORD = re.compile(rb"[A-Za-z0-9-]").search
_SEARCH = re.compile(rb"[a-z0-9][a-z0-9\-]+")
_SIGNALS = tuple((weight, re.compile(pattern.encode())) for weight, pattern in ((2, quality.ENTITY), (1, quality.RELATION), (1, quality.NEGATION)))
_BACK = re.compile(quality.BACK_REFERENCE.encode())
_BEYOND = re.compile(r"[^\x00-\x7F\W]")
_CLOSED = (b".", b"!", b"?", b")", b"]")
#: Token patterns of the routing profile, in the order of its counts.
_ROUTED = tuple(re.compile(p.encode()) for p in ("(?i)" + chunking.RELATION, "(?i)" + chunking.NEGATION, chunking.ENTITY))
#: Rows that go to a task at a time: some MB of text.
BATCH = 500


def sentences(text: bytes) -> list[bytes]:
    at, out = 0, []
    for m in _BREAK.finditer(text):
        if s := text[at : m.start() + 1].strip(b" "):
            out.append(s)
        at = m.end()
    if s := text[at:].strip(b" "):
        out.append(s)
    return out


def windows(size: int, overlap: int) -> Callable[[bytes], list[tuple[bytes, int]]]:
    def cut(text: bytes) -> list[tuple[bytes, int]]:
        w = text.split()
        return [(b" ".join(own := w[at : at + size]), len(own)) for at in range(0, max(1, len(w) - overlap), size - overlap)] if w else []

    return cut


def propositions(text: bytes, most: int = 96) -> list[tuple[bytes, int]]:
    out = []
    for s in sentences(text):
        low = s.lower()
        for part in _CONJUNCTION.split(s) if any(c in low for c in _CONJUNCTIONS) else (s,):
            if part := part.strip(b" ,;:"):
                w = part.split()
                out += [(b" ".join(own := w[at : at + most]), len(own)) for at in range(0, max(1, len(w)), most)]
    return out


#: Chunkers of bytes by strategy: the chunks of a text in order, with their numbers of tokens.
CHUNKERS = {"fixed": windows(*chunking.FIXED), "parent_child": windows(*chunking.CHILD), "proposition": propositions}


def _edges(text: bytes) -> bytes:
    return text if text.isascii() else _BEYOND.sub("_", text.decode()).encode()


def _low(text: bytes) -> bytes:
    """Lower case as far as it gives ASCII: two letters beyond it have a lower case within."""
    if not text.isascii():
        text = text.replace("\u0130".encode(), "i\u0307".encode()).replace("\u212a".encode(), b"k")
    return text.lower()


def _alike(a: frozenset, b: frozenset) -> float:
    same = len(a & b)
    return same / n if (n := len(a) + len(b) - same) else 0.0


def _mean(values: Iterable[float], n: int) -> float:
    total = 0.0
    for v in values:  # in order and plainly, as the plans add
        total += v
    return total / n


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("unit_id", F.col("text").cast("binary").alias("text"), *columns)


def _in_small_batches(work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                yield work(batch.slice(at, BATCH))

    return run


# --- routing profile -----------------------------------------------------------------------------------------------


def profile_counts(passages: DataFrame) -> DataFrame:
    """(unit_id, n_tokens, n_sentences, n_relation, n_negation, n_entity, shift): counts of tokens by pattern and the mean
    unlikeness of neighbouring sentences."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        rows = []
        for text in batch.column(1).to_pylist():
            counts = [0, 0, 0]
            w = (text := text or b"").split()
            for x in w:
                if (bits := known.get(x)) is None:
                    bits = known[x] = sum(1 << i for i, p in enumerate(_ROUTED) if p.search(x))
                if bits:
                    for i in range(3):
                        counts[i] += bits >> i & 1
            s = [frozenset(_SEARCH.findall(x.lower())) for x in sentences(text)]
            shift = _mean((1 - _alike(a, b) for a, b in zip(s, s[1:], strict=False)), len(s) - 1) if len(s) > 1 else 0.0
            rows.append((len(w), len(s), *counts, shift))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.float64())], ["unit_id", "n_tokens", "n_sentences", "n_relation", "n_negation", "n_entity", "shift"])

    kind = passages.schema["unit_id"].dataType.simpleString()
    return _texts(passages).mapInArrow(_in_small_batches(work), f"unit_id {kind}, n_tokens long, n_sentences long, n_relation long, n_negation long, n_entity long, shift double")


# --- intrinsic scores ----------------------------------------------------------------------------------------------


def intrinsic_counts(passages: DataFrame, strategies: tuple[str, ...]) -> DataFrame:
    """What intrinsic_metrics adds up, for passages of distinct ids cut by the strategies named."""
    names = ["n_chunks", "n_closed", "n_small", "n_signals", "n_distinct", "n_tokens", "n_source"]

    def signals(text: bytes, chunks: dict[str, list[tuple[bytes, int]]]) -> dict[str, int]:
        """By strategy; what no chunk can hold, as the passage has none, is not looked for."""
        flat = _edges(b" ".join(text.split()))
        asked = [(weight, p.search) for weight, p in _SIGNALS if p.search(flat)]
        return {k: sum(weight for t in map(_edges, (t for t, _ in c)) for weight, search in asked if search(t)) if asked else 0 for k, c in chunks.items()}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, kinds, rows = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            text = text or b""
            chunks = {k: c for k in strategies if (c := CHUNKERS[k](text))}
            told, n_source = signals(text, chunks), max(len(text.split()), 1)
            for k, c in chunks.items():
                at.append(i)
                kinds.append(k)
                rows.append((len(c), sum(t.endswith(_CLOSED) for t, _ in c), sum(n <= quality.MAX_TOKENS for _, n in c), told[k], len({t for t, _ in c}), sum(n for _, n in c), n_source))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), *[pa.array(c, pa.int64()) for c in columns]], ["unit_id", "strategy", *names])

    kind = passages.schema["unit_id"].dataType.simpleString()
    return _texts(passages.where("unit_id is not null")).mapInArrow(_in_small_batches(work), f"unit_id {kind}, strategy string, " + ", ".join(f"{n} long" for n in names))


def intrinsic(passages: DataFrame, strategies: tuple[str, ...]) -> DataFrame:
    """intrinsic_metrics of the chunks of the strategies named, for passages of distinct ids."""
    n = F.col("n_chunks")
    signal = F.least(F.lit(1.0), F.col("n_signals") / (4 * n))
    c = intrinsic_counts(passages, strategies).select("unit_id", "strategy", "n_chunks", (F.col("n_closed") / n).alias("closed"), (F.col("n_small") / n).alias("small"), signal.alias("signal"), (1 - F.col("n_distinct") / n).alias("repeats"), "n_tokens", "n_source")
    return quality.intrinsic_scores(c)


# --- cohesion ------------------------------------------------------------------------------------------------------

_SUMS = "strategy string, n long, icc double, dcc double, rc double, n_rc long"
Chunk = tuple[str, int, bytes | None]


def _add_cohesion(sums: dict[str, list], chunks: Iterable[Chunk], passages: list[bytes]) -> None:
    """Adds the scores of the chunks (strategy, index, text) of the passages of one id to the sums of their strategies.

    A chunk that lies in a passage between its spaces or commas has words of that passage only; others are compared by
    their vocabulary. Rows of the same strategy and index are taken together, as one chunk's words.
    """
    seen: dict[bytes, frozenset] = {}  # sentences that several chunks share are read once

    def vocabulary(text: bytes) -> frozenset:
        if (got := seen.get(text)) is None:
            got = seen[text] = frozenset(_WORD.findall(_low(text)))
        return got

    flat = b" ".join(w for t in passages for w in t.split())
    end, at, last = len(flat), 0, None
    held: dict[tuple[str, int], list[bytes]] = {}
    alien = set()  # keys of chunks that are not known to lie in a passage
    for strategy, index, text in chunks:
        total = sums.setdefault(strategy, [0, 0.0, 0.0, 0.0, 0])
        total[0] += 1
        if text is not None:
            first = text[:64].strip(b" ") if text[:1] != b" " else text.strip(b" ")[:64]
            total[3] += not _BACK.search(_edges(first.decode(errors="ignore").encode()))
            total[4] += 1
        held.setdefault((strategy, index), []).append(text := text or b"")
        s = sentences(text) if _BREAK.search(text) else ()
        total[1] += _mean(map(_alike, (v := [vocabulary(x) for x in s]), v[1:]), len(v) - 1) if len(s) > 1 else 1.0
        if strategy != last:
            at, last = 0, strategy
        found = flat.find(text, at)
        if found < 0 or not ((not found or flat[found - 1] in b" ,;:") and ((to := found + len(text)) == end or flat[to] in b" ,;:")):
            alien.add((strategy, index))
        else:
            at = found
    known = frozenset().union(*[_WORD.findall(_low(t)) for t in passages]) if alien else frozenset()
    for (strategy, index), texts in held.items():
        if (strategy, index) in alien:
            words = [frozenset(_WORD.findall(_low(t))) for t in texts]
            if n := sum(map(len, words)):
                sums[strategy][2] += len(texts) * (sum(len(w & known) for w in words) / n)
        elif any(_ANY_WORD(t) or _ANY_WORD(_low(t)) for t in texts):
            sums[strategy][2] += len(texts)


def _sums_batch(sums: dict[str, list]) -> pa.RecordBatch:
    columns = list(zip(*[(k, *v) for k, v in sums.items()], strict=True)) or [()] * 6
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["strategy", "n", "icc", "dcc", "rc", "n_rc"])


def cohesion_sums(passages: DataFrame, strategies: tuple[str, ...]) -> DataFrame:
    """Sums of the scores of chunks by strategy and batch, for passages of distinct ids; a null id is matched with no passage."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[str, list] = {}
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or b""
            chunks = ((k, at, t) for k in strategies for at, (t, _) in enumerate(CHUNKERS[k](text)))
            _add_cohesion(sums, chunks, [] if i is None else [text])
        return _sums_batch(sums)

    return _texts(passages).mapInArrow(_in_small_batches(work), _SUMS)


def cohesion_sums_of(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same for any chunks, brought together with the passages of their id."""
    one = F.struct("strategy", "chunk_index", F.col("text").cast("binary").alias("text"))
    texts = passages.where("unit_id is not null").groupBy("unit_id").agg(F.collect_list(F.col("text").cast("binary")).alias("passages"))
    own = chunks.where("unit_id is not null").groupBy("unit_id").agg(F.collect_list(one).alias("chunks")).join(texts, "unit_id", "left").select("chunks", "passages")
    rest = chunks.where("unit_id is null").select(F.array(one).alias("chunks"), F.lit(None).cast("array<binary>").alias("passages"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[str, list] = {}
        for c, p in zip(batch.column(0), batch.column(1), strict=True):
            _add_cohesion(sums, ((x["strategy"], x["chunk_index"], x["text"]) for x in c.as_py()), p.as_py() or [])
        return _sums_batch(sums)

    return own.unionByName(rest).mapInArrow(_in_small_batches(work), _SUMS)


def cohesion_means(sums: DataFrame) -> DataFrame:
    """(strategy, icc, dcc, rc) of sums."""
    mean = lambda c, n: F.round(F.sum(c) / F.nullif(F.sum(n), F.lit(0)), 6).alias(c)
    return sums.groupBy("strategy").agg(mean("icc", "n"), mean("dcc", "n"), mean("rc", "n_rc"))
