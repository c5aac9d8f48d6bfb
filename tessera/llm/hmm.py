"""Hidden Markov language model over words, trained by Baum-Welch with counts aggregated across partitions.

States emit words in classes: each of the commonest words is a class of its own, so that states see it as it is; the
rest share hash classes, of which each emits its words by their smoothed shares in the training tokens. Scaled forward
recursion over a document's classes gives the exact probability of its class sequence; the words' shares complete it.

Documents are trained on whole. A long one is computed in stretches at once: each stretch's transfer matrix tells how
it passes the state on, so that every stretch starts from the state its document really has there, and transitions from
one stretch to the next are counted like others.

Counting tasks cut their documents into parts with a vocabulary each; a document is stored as numbers in its part's
vocabulary. Only (word, part) rows are shuffled to learn the corpus counts, and return to the part by its number, so
frequent words move once a part, not once an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Workspace, crc_remainder, global_rank, sized, text_of

CLASSES, COUNTS = 2048, 4096  # hash classes; expected counts that a row of the E step holds
_PART = "part long, id long, held_out boolean, ids binary, word binary, idx int, n_train long"
_DOC = "id long, held_out boolean, n_tokens long, n_known long, base_score double, word_score double, classes binary"


class Numbers(dict):
    """Word -> its number, given when it is first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _count(part_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used = TaskContext.get().partitionId() << 24, 0
        vocabulary = Numbers()
        counts = np.zeros(1 << 12, np.int64)

        def words() -> Iterator[pa.RecordBatch]:
            own = list(vocabulary)
            for at in range(0, len(own), 20_000):
                some = own[at : at + 20_000]
                k = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.binary()), pa.array(some, pa.binary()), pa.array(range(at, at + k), pa.int32()), pa.array(counts[at : at + k], pa.int64())], names)

        names = ["part", "id", "held_out", "ids", "word", "idx", "n_train"]
        for batch in batches:
            texts, held = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            parts, ids = [], []
            for out, text in zip(held, texts, strict=True):
                if used and used + len(text) > part_bytes:
                    yield from words()
                    part, used, vocabulary = part + 1, 0, Numbers()
                    counts[:] = 0
                used += len(text) + 64
                own = text.lower().split()
                row = np.fromiter(map(vocabulary.__getitem__, own), np.int32, len(own))
                if len(vocabulary) > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(counts), len(vocabulary)), np.int64)])
                if not out:
                    counts[: len(vocabulary)] += np.bincount(row, minlength=len(vocabulary))
                parts.append(part)
                ids.append(row.tobytes())
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], names)
        yield from words()

    return work


def _encode(total: int, distinct: int, ends: int, class_n: np.ndarray, class_v: np.ndarray):
    """Rows sorted by (part, kind, idx): a part's vocabulary with corpus counts, then its documents.

    Classes from CLASSES on are those of single words, which emit nothing else; the end token has the last class.
    """
    end_class = np.uint16(len(class_n))
    base_of = lambda c: np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, cls, ready = None, [], [], None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            parts, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(parts) | np.diff(kinds)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)], strict=True):
                if lo == hi:
                    continue
                if parts[lo] != part:
                    part, count, cls, ready = parts[lo], [], [], None
                if kinds[lo] == 0:
                    count.append(batch.column(2)[lo:hi].to_numpy())
                    cls.append(batch.column(3)[lo:hi].to_numpy())
                    continue
                if ready is None:
                    cc, kk = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (count, cls))
                    ready = (cc > 0, base_of(cc), np.where(kk < CLASSES, np.log10((cc + 0.1) / (class_n[kk] + 0.1 * (class_v[kk] + 1))), 0.0), kk.astype(np.uint16))
                for i, held, ids in zip(*(batch.column(x)[lo:hi].to_pylist() for x in (4, 5, 6)), strict=True):
                    own = np.frombuffer(ids, np.int32)
                    values = (i, held, len(own) + 1, int(ready[0][own].sum()) + (ends > 0), float(ready[1][own].sum() + base_of(ends)), float(ready[2][own].sum()), np.append(ready[3][own], end_class).tobytes())
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["id", "held_out", "n_tokens", "n_known", "base_score", "word_score", "classes"])

    return work


class Hmm:
    """start (S), move (S, S) and emit (classes + 1, S) of a hidden Markov model."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, class_counts: np.ndarray, states: int, seed: int = 3) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = (class_counts[:, None] + 0.5) * rng.uniform(0.1, 1.9, (len(class_counts), states))
        move = 0.9 * np.eye(states) + 0.1 * rng.uniform(0.5, 1.5, (states, states)) / states  # states begin as topics
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def from_counts(cls, counts: np.ndarray, states: int) -> Hmm:
        """The model of expected counts (start, move, emit flattened), each class and step smoothed a little."""
        start = counts[:states] + 0.1
        move = counts[states : states + states * states].reshape(states, states) + 0.1
        emit = counts[states + states * states :].reshape(-1, states) + 0.01
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def forward(self, sequences: list[np.ndarray], keep: bool = False, prior: np.ndarray | None = None):
        """Natural log likelihoods by scaled forward recursion, all sequences a step at a time, longest first.

        Arrays hold a column a sequence. ``prior`` gives each its own distribution of the first state. With ``keep`` the
        steps (classes seen, state, scale) and the order of their columns come too.
        """
        lengths, order, flat, begins = self._sorted(sequences)
        move, emit = np.ascontiguousarray(self.move.T), np.ascontiguousarray(self.emit.T)
        total, steps = np.zeros(len(lengths)), []
        alive, alpha = len(lengths), None
        for t in range(int(lengths[0])):
            while lengths[alive - 1] <= t:
                alive -= 1
            seen = flat[begins[:alive] + t]
            alpha = emit.take(seen, 1) * ((self.start[:, None] if prior is None else prior[:, order]) if t == 0 else move @ alpha[:, :alive])
            scale = alpha.sum(0)
            alpha /= scale
            if keep:
                steps.append((seen, alpha, scale))
            else:
                total[:alive] += np.log(scale)
        if keep:
            return steps, order
        out = np.empty(len(lengths))
        out[order] = total
        return out

    @staticmethod
    def _sorted(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, longest first, the order that sorts so, all classes in one array and where each sequence begins."""
        lengths = np.array([len(s) for s in sequences])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        return lengths, order, np.concatenate([sequences[o] for o in order]).astype(np.int64), np.cumsum(lengths) - lengths

    def transfer(self, stretches: list[np.ndarray]) -> np.ndarray:
        """For each stretch the matrix (state at its end, state before it) that passes the state on, up to a factor."""
        states = len(self.start)
        lengths, order, flat, begins = self._sorted(stretches)
        move, emit = np.ascontiguousarray(self.move.T), np.ascontiguousarray(self.emit.T)
        out, alive = np.repeat(np.eye(states)[:, :, None], len(lengths), 2), len(lengths)
        for t in range(int(lengths[0])):
            while lengths[alive - 1] <= t:
                alive -= 1
            step = (move @ out[:, :, :alive].reshape(states, -1)).reshape(states, states, alive)
            step *= emit.take(flat[begins[:alive] + t], 1)[:, None, :]
            step /= step.sum((0, 1))
            out[:, :, :alive] = step
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return out[:, :, back]

    def expected(self, sequences: list[np.ndarray], stretch: int = 1000) -> tuple[np.ndarray, float]:
        """Expected start, move and emit counts of the sequences, flattened (the E step), and their log likelihood."""
        states, emit = len(self.start), np.ascontiguousarray(self.emit.T)
        cuts = [(s, at) for s in sequences for at in range(0, len(s), stretch)]
        stretches, first = [s[at : at + stretch] for s, at in cuts], np.array([at == 0 for _, at in cuts])
        later = np.flatnonzero(~first)
        come, leave = np.zeros((states, len(cuts))), np.ones((states, len(cuts)))  # state before, future after
        if len(later):
            passed = self.transfer([stretches[k] for k in later])
            long = np.flatnonzero(first & np.append(~first[1:], False))
            steps, order = self.forward([stretches[k] for k in long], True)
            ends = np.empty((states, len(long)))
            for _, alpha, _ in steps:
                ends[:, : alpha.shape[1]] = alpha  # what a column holds last is its sequence's end
            state = np.zeros((states, len(cuts)))
            state[:, long[order]] = ends
            for n, k in enumerate(later.tolist()):
                come[:, k] = state[:, k - 1]
                own = passed[:, :, n] @ come[:, k]
                state[:, k] = own / own.sum()
            for n, k in reversed([*enumerate(later.tolist())]):
                own = leave[:, k] @ passed[:, :, n]
                leave[:, k - 1] = own / own.sum()
        steps, order = self.forward(stretches, True, np.where(first, self.start[:, None], self.move.T @ come))
        leave, come, first = leave[:, order], come[:, order], first[order]
        move = np.zeros((states, states))
        seen, gamma, ll = [], [], 0.0
        beta = ahead_of = None
        for t in range(len(steps) - 1, -1, -1):
            obs, alpha, scale = steps[t]
            n = alpha.shape[1]
            k = 0
            if ahead_of is not None:
                beta *= emit.take(ahead_of[0], 1)
                beta /= ahead_of[2]
                k = beta.shape[1]
                move += alpha[:, :k] @ beta.T
                ahead = self.move @ beta
            if k < n:  # sequences that end here
                own = leave[:, k:n] / (alpha[:, k:] * leave[:, k:n]).sum(0)
                ahead = np.concatenate([ahead, own], 1) if k else own
            beta, ahead_of = ahead, steps[t]
            ll += float(np.log(scale).sum())
            seen.append(obs)
            gamma.append(alpha * beta)
        if not first.all():
            beta = beta * emit.take(ahead_of[0], 1) / ahead_of[2]
            move += come[:, ~first] @ beta[:, ~first].T
        all_seen = np.concatenate(seen)
        by_state = [np.bincount(all_seen, np.concatenate([g[s] for g in gamma]), len(self.emit)) for s in range(states)]
        return np.concatenate([gamma[-1][:, first].sum(1), (move * self.move).ravel(), np.stack(by_state, 1).ravel()]), ll


def _batches_of(rows: Iterator[tuple], limit: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _e_step(model: tuple, limit: int):
    """A task's summed counts, in rows of COUNTS numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, task = Hmm(*model), TaskContext.get().partitionId()
        total = None
        rows = ((np.frombuffer(x, np.uint16),) for b in batches for x in b.column(0).to_pylist())
        for group in _batches_of(rows, limit):
            counts, _ = hmm.expected([g[0] for g in group])
            total = counts if total is None else total + counts
        if total is not None:
            cut = [total[at : at + COUNTS].tobytes() for at in range(0, len(total), COUNTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([task] * len(cut), pa.int32()), pa.array(cut, pa.binary())], ["k", "task", "v"])

    return work


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of a number, in the order of their tasks so that reruns agree."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = np.frombuffer(v)
            sums[k] = sums[k] + own if k in sums else own
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["k", "v"])


def _score(model: tuple, limit: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = Hmm(*model)
        rows = (r for b in batches for r in zip(*(b.column(x).to_pylist() for x in range(6)), (np.frombuffer(x, np.uint16) for x in b.column(6).to_pylist()), strict=True))
        for group in _batches_of(rows, limit):
            ll = hmm.forward([g[6] for g in group]) / np.log(10)
            columns = [list(c) for c in zip(*(g[:6] for g in group), strict=True)]
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=False)), pa.array(np.array(columns[5]) + ll)], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return work


def own_words(counts: DataFrame, ws: Workspace, most: int, least: int) -> DataFrame:
    """(word, cls): the commonest words, at most ``most`` and each seen ``least`` times, with classes from CLASSES on.

    ``counts`` has word and c. Counts are binned in eighths of a power of two; the bins that fit whole are taken.
    """
    level = F.floor(F.log2("c") * 8).cast("int")
    bins = counts.where(F.col("c") >= least).groupBy(level.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # eight rows a power of two
    bound, used = 1 << 20, 0
    for r in sorted(bins, reverse=True):
        used += r["n"]
        if used > most:
            break
        bound = r["b"]
    few = global_rank(counts.where((F.col("c") >= least) & (level >= bound)).select("word", "c"), ws, "own-words", F.desc("c"), F.col("word"))
    return ws.table(few.select("word", (F.col("place") - 1 + CLASSES).cast("int").alias("own")), "own")


def hmm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 10, held: int = 0, states: int = 6, rounds: int = 6, part_bytes: int = 24 << 20, limit: int = 1_000_000, max_own: int = 16_384, min_own: int = 5) -> DataFrame:
    """Scores every row by a hidden Markov model and by smoothed unigrams, learned from rows outside the fold.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). The at most ``max_own`` commonest
    words with at least ``min_own`` training occurrences have classes of their own: that bounds the model that each task
    holds and the counts that come to the driver; all other words are in hash classes and keep their own counts there.
    A null or empty text is the end token alone; repeated rows count and are scored each; null ids count as empty text
    in the fold's crc32; a text may have any length; without training rows all words are unknown; an empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "hmm")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(docs[id_col].cast("long").alias("id"), (crc_remainder(docs[id_col], mod) == held).alias("held_out"), text_of(docs, text_col).cast("binary").alias("text"))
    rows = ws.table(src.mapInArrow(_count(part_bytes), _PART), "parts")
    by_word = Window.partitionBy("word")
    words = rows.where("word is not null").select("word", "part", "idx", "n_train")
    words = words.select("word", "part", "idx", F.sum("n_train").over(by_word).alias("c"), (F.min("part").over(by_word) == F.col("part")).alias("first"))
    words = ws.table(words, "words")
    own = own_words(words.where("first and c > 0"), ws, max_own, min_own)
    n_own = own.count()
    words = words.join(sized(own), "word", "left").select("part", "idx", "c", "first", F.coalesce("own", F.pmod(F.xxhash64("word"), F.lit(CLASSES)).cast("int")).alias("cls"))
    ends = rows.where("ids is not null and not held_out").count()
    stats = words.where("first and c > 0").groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # a row a class
    class_n, class_v = np.zeros(CLASSES + n_own, np.int64), np.zeros(CLASSES + n_own, np.int64)
    for r in stats:
        class_n[r["cls"]], class_v[r["cls"]] = r["n"], r["v"]
    total, distinct = int(class_n.sum()) + ends, int(class_v.sum()) + (ends > 0)

    vocabulary = words.select("part", F.lit(0).alias("kind"), "c", "cls", F.lit(None).cast("long").alias("id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("binary").alias("ids"), "idx")
    texts = rows.where("ids is not null").select("part", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("int").alias("cls"), "id", "held_out", "ids", F.lit(None).cast("int").alias("idx"))
    # A part is a bounded number of bytes; ranges deal parts evenly however many there are.
    dealt = max(n_parts, rows.where("ids is not null").select("part").distinct().count())
    both = vocabulary.unionByName(texts).repartitionByRange(dealt, "part").sortWithinPartitions("part", "kind", "idx").drop("idx")
    coded = ws.table(both.mapInArrow(_encode(total, distinct, ends, class_n, class_v), _DOC), "coded")
    ws.drop("parts", "words")

    model = Hmm.initial(np.append(class_n, ends).astype(float), states)
    size = states + states * states + (CLASSES + n_own + 1) * states
    for _ in range(rounds if ends else 0):
        step = coded.where("not held_out").select("classes").mapInArrow(_e_step((model.start, model.move, model.emit), limit), "k int, task int, v binary")
        sums = step.repartition(n_parts, "k").sortWithinPartitions("k", "task").mapInArrow(_add, "k int, v binary").collect()  # the model's numbers
        counts = np.concatenate([np.frombuffer(r["v"]) for r in sorted(sums, key=lambda r: r["k"])]) if sums else np.zeros(size)
        model = Hmm.from_counts(counts, states)
    scored = coded.mapInArrow(_score((model.start, model.move, model.emit), limit), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return ws.result(scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"))
