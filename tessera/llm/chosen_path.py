"""MinHash near-deduplication as a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are one class from the start. Each class representative descends
independent trees: a node selects one or two of 128 minwise tokens (1 / similarity on average, which keeps the expected
number of paths on which a pair at the threshold stays together at one) and branches each set by its value of the
token. Nodes of at most SMALL sets are compared exhaustively by sketch.

Larger nodes of the first level are linked in blocks (each set with its most alike predecessor and the node's first
set), and confirmed links join sets to components. Pairs within a component need no comparison, so a node is settled
once at most MINOR of its sets lie outside its largest component: these are compared with the whole node, and each names
its most alike set of every foreign component. Other nodes branch again; at the last depth all are settled, block by
block. What such a set named and what was refuted is then looked at as a relation of a set and a component: the set is
compared, on full sets, with all of the component's members, again in blocks. So the work on a large group grows with
its sets outside the component, no pair that a node holds goes unseen, and no list of a group's pairs is made.

A pair at the threshold survives a tree of d levels with probability 0.81, 0.69, 0.60, 0.53 for d = 1..4; the number of
trees follows from the recall asked of pairs at the threshold at the last depth.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, sized, text_of
from .components import connected_components

TOKENS, SMALL, MINOR, BLOCK, DEPTH = 128, 32, 256, 256, 4
SURVIVES = (0.81, 0.69, 0.60, 0.53)  # a pair at the threshold in a tree of so many levels
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: the finalizer of splitmix64


def mix64(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, kept for words met again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text (ASCII lower case and white space)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        k = min(width, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(h)])
    return np.unique(h)


_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(0, 1 << 32, TOKENS, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = (_RNG.integers(0, 1 << 32, TOKENS, np.uint64) | np.uint64(1)).astype(np.uint32)


def min_tokens(h: np.ndarray) -> np.ndarray:
    """The minwise values of a set of hashes."""
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    lo, hi = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 2048):
            v = lo[at : at + 2048, None] * _A + hi[at : at + 2048, None] * _B
            np.minimum(out, v.min(0), out=out)
    return out


def trees_for(recall: float) -> int:
    """Trees that keep a pair at the threshold together at the last depth with at least this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - SURVIVES[DEPTH - 1]))


def _sets(width: int, trees: int):
    tokens = np.concatenate([t for _, t, _ in _first_tokens(trees)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, uid = WordHashes(), TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes, digests, sketches, firsts = [], [], [], []
            texts = batch.column(1).to_pylist()
            for text in texts:
                s = shingle_set(text, hashes, width)
                mins = min_tokens(s)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketches.append(mins.astype(np.uint8).tobytes())
                firsts.append(mins[tokens].tobytes())
            uids = np.arange(uid, uid + len(texts))
            uid += len(texts)
            columns = [pa.array(uids), batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(firsts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[1:]], ["uid", "id", "n", "digest", "sketch", "firsts", *batch.schema.names[1:]])

    return work


def _choose(path: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The tokens that each node selects: (rows, token) once for all rows, once more for a third of the nodes."""
    with np.errstate(over="ignore"):
        h = mix64(path + np.uint64(77))
    first = (h % np.uint64(TOKENS)).astype(np.int64)
    second = (first + 1 + (h >> np.uint64(8)) % np.uint64(TOKENS - 1)).astype(np.int64) % TOKENS
    every = np.arange(len(path))
    more = every[(h >> np.uint64(40)) % np.uint64(3) == 0]
    return [(every, first), (more, second[more])]


def _child(path: np.ndarray, token: np.ndarray, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(path * np.uint64(3) + token.astype(np.uint64)) + value.astype(np.uint64))


_NODE = "node long, uid long, n long, sketch binary"


def _rows(paths: np.ndarray, uid: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(uid), pa.array(n), pa.array([s.tobytes() for s in sketch], pa.binary())], ["node", "uid", "n", "sketch"])


def _first_tokens(trees: int) -> list[tuple[int, np.ndarray, np.uint64]]:
    """(tree, the tokens that its root selects, the root's path)."""
    roots = [(tree, mix64(np.full(1, 1000 + tree, np.uint64))) for tree in range(trees)]
    return [(tree, np.array([t[0] for rows, t in _choose(path) if len(rows)]), path[0]) for tree, path in roots]


def _roots(trees: int):
    chosen = [(path, token) for _, tokens, path in _first_tokens(trees) for token in tokens]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                uid, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, TOKENS)
                firsts = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, len(chosen))
                for k, (path, token) in enumerate(chosen):
                    yield _rows(_child(np.full(len(uid), path), np.full(len(uid), token), firsts[:, k]), uid, n, sketch)

    return work


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            path, uid, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            sketch = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, TOKENS)
            for rows, token in _choose(path):
                if len(rows):
                    yield _rows(_child(path[rows], token, sketch[rows, token]), uid[rows], n[rows], sketch[rows])


def _alike(sketch: np.ndarray, n: np.ndarray, cut: float, threshold: int) -> np.ndarray:
    """Pairs whose sketches agree in at least cut of the tokens and whose sizes allow the similarity."""
    agree = (sketch[:, None, :] == sketch[None, :, :]).sum(2)
    sizes = 100 * np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])
    return np.where(sizes & (agree >= cut * TOKENS), agree, 0)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Rows of one key at a time from batches sorted by their first ``keys`` columns."""
    held, columns = None, []
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != held:
                if columns:
                    yield held, dict(zip(names, map(list, zip(*columns, strict=True)), strict=True))
                held, columns = row[:keys], []
            columns.append(row)
    if columns:
        yield held, dict(zip(names, map(list, zip(*columns, strict=True)), strict=True))


def _pairs_out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], ["a", "b"])


def _arrays(g: dict[str, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(g["uid"]), np.array(g["n"]), np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(-1, TOKENS)


def _compare_small(cut: float, threshold: int):
    """All alike pairs of a node of the ``size`` column's value or less; of larger nodes' blocks each set with its most
    alike predecessor and with the node's first set. ``first`` says that the pair is such a best one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int, bool]] = set()

        def flush() -> pa.RecordBatch:
            rows = [*zip(*out, strict=True)] or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.bool_())], ["a", "b", "first"])

        for _, g in _groups(batches, 2):
            large = g["pivot"][0] is not None
            if large or len(g["uid"]) > 1:
                uid, n, sketch = _arrays(g)
                like = np.tril(_alike(sketch, n, cut, threshold), -1)
                best = like.argmax(1)
                found = [(i, j) for i, j in enumerate(best.tolist()) if like[i, j]] if large else zip(*np.nonzero(like), strict=True)
                for i, j in found:
                    out.add((int(min(uid[i], uid[j])), int(max(uid[i], uid[j])), bool(large or best[i] == j)))
                if large:
                    out.update((int(min(u, p)), int(max(u, p)), True) for u, p in zip(uid, g["pivot"], strict=True) if u != p)
            if len(out) > 50_000:
                yield flush()
        yield flush()

    return work


def _cross_blocks(cut: float, threshold: int):
    """Sets outside the node's largest component (side 0) against the block's others: each names its most alike set of
    every foreign component."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g in _groups(batches, 3):
            uid, n, sketch = _arrays(g)
            side, comp = np.array(g["side"]), np.array(g["comp"])
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            pairs = []
            for at in left.tolist():
                agree = (sketch[right] == sketch[at]).sum(1)
                ok = (comp[right] != comp[at]) & (agree >= cut * TOKENS) & (100 * np.minimum(n[right], n[at]) >= threshold * np.maximum(n[right], n[at]))
                named, level = right[ok], agree[ok]
                if len(named):
                    order = np.lexsort((uid[named], -level, comp[named]))
                    _, first = np.unique(comp[named][order], return_index=True)
                    pairs += [(int(uid[at]), int(o)) for o in uid[named[order[first]]]]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    return work


def _full_blocks(threshold: int):
    """Sets (side 0) against members of a component (side 1) on full sets: one link a set and block is enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g in _groups(batches, 3):
            uid, side = np.array(g["uid"]), np.array(g["side"])
            right = np.flatnonzero(side == 1)
            if not len(right) or len(right) == len(uid):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in g["own"]]
            sizes = np.array([len(sets[k]) for k in right])
            joined, begins = np.concatenate([sets[k] for k in right]), np.cumsum(sizes) - sizes
            links = []
            for at in np.flatnonzero(side == 0).tolist():
                own = sets[at]
                hit = own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined
                both = np.add.reduceat(hit, begins, dtype=np.int64)
                ok = 100 * both >= threshold * (sizes + len(own) - both)
                if ok.any():
                    links.append((int(uid[at]), int(uid[right[ok.argmax()]])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    return work


def _confirm(threshold: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= threshold * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return work


def _near(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: int, recall: float, cut: float, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame, Workspace]:
    """The rows with their sets, and (digest, component_id, keeper) of the classes in components of several rows."""
    spark = docs.sparkSession
    ws = Workspace(spark, "near-dedup")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trees = trees_for(recall)
    carried = [F.struct(*[docs[c] for c in carry]).alias("carried")] if carry else []
    src = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).cast("binary").alias("text"), *carried)
    schema = "uid long, id long, n long, digest binary, sketch binary, firsts binary, text binary"
    sets = ws.table(src.mapInArrow(_sets(width, trees), f"{schema}, carried {src.schema['carried'].dataType.simpleString()}" if carry else schema), "sets")
    least = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "uid"))
    classes = sets.where("n > 0").groupBy("digest").agg(F.min(F.struct("uid", "n", "sketch", "firsts")).alias("rep"), least.alias("low"), F.count(F.lit(1)).alias("members"))
    classes = ws.table(classes.select("digest", "rep.uid", "rep.n", "rep.sketch", "rep.firsts", "low", "members"), "classes")

    def reshingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            own = [shingle_set(t, hashes, width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["uid", "own"])

    def full(wanted: DataFrame, name: str) -> DataFrame:
        wanted = ws.table(wanted.distinct(), f"{name}-wanted")
        return ws.table(sets.select("uid", "text").join(sized(wanted), "uid", "left_semi").mapInArrow(reshingle, "uid long, own binary"), f"{name}-sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = ws.table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-pairs")
        own = full(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")), name)
        both = pairs.join(own.select(F.col("uid").alias("a"), F.col("own").alias("x")), "a").join(own.select(F.col("uid").alias("b"), F.col("own").alias("y")), "b").select("a", "b", "x", "y")
        return ws.table(both.mapInArrow(_confirm(threshold), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")), f"{name}-links")

    def in_components(df: DataFrame, comps: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(sized(comps.select(F.col("u").alias(column), F.col("root").alias(name))), column, "left").withColumn(name, F.coalesce(name, column))

    def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        return in_components(in_components(pairs, comps, "a", "comp_a"), comps, "b", "comp_b").where("comp_a <> comp_b")

    def compared(rows: DataFrame, big: DataFrame, name: str) -> DataFrame:
        """Pairs of small nodes; links of large nodes' blocks only where they have no components yet."""
        some = rows.join(sized(big), "node", "left") if big is not None else rows.withColumn("size", F.lit(None).cast("long")).withColumn("pivot", F.lit(None).cast("long"))
        some = some.withColumn("block", F.coalesce(F.pmod(F.xxhash64("uid"), F.ceil(F.col("size") / BLOCK)), F.lit(0)))
        some = some.select("node", "block", "uid", "n", "sketch", "pivot").repartition(n_parts, "node", "block").sortWithinPartitions("node", "block", "uid")
        return ws.table(some.mapInArrow(_compare_small(cut, threshold), "a long, b long, first boolean"), name)

    def large_nodes(rows: DataFrame) -> DataFrame | None:
        big = ws.table(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("uid").alias("pivot")).where(F.col("size") > SMALL), "big")
        return None if big.isEmpty() else big

    def cross(open_: DataFrame) -> DataFrame:
        minor_blocks, all_blocks, own = F.ceil(F.col("minor") / MINOR), F.ceil(F.col("size") / BLOCK), F.xxhash64("uid")
        left = open_.where("comp <> main").select("node", F.pmod(own, minor_blocks).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), all_blocks - 1)).alias("j"), "uid", "n", "sketch", "comp", F.lit(0).alias("side"))
        right = open_.select("node", F.explode(F.sequence(F.lit(0).cast("long"), minor_blocks - 1)).alias("i"), F.pmod(own, all_blocks).alias("j"), "uid", "n", "sketch", "comp", F.lit(1).alias("side"))
        return left.unionByName(right).repartition(n_parts, "node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(_cross_blocks(cut, threshold), "a long, b long")

    rows = classes.select("uid", "n", "sketch", "firsts").mapInArrow(_roots(trees), _NODE)
    big = large_nodes(rows)
    level = compared(rows, big, "level0")
    links = confirmed(level.where("first").select("a", "b"), "first")
    comps = ws.table(connected_components(links, ws), "components")
    pairs, named = [level.where("not first").select("a", "b")], []
    for depth in range(DEPTH):
        if big is None:
            break
        large = ws.table(in_components(rows.join(sized(big.select("node")), "node", "left_semi"), comps, "uid", "comp"), "large")
        main = large.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("node").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("size"))
        main = ws.table(main.select("node", "size", F.col("top.comp").alias("main"), (F.col("size") - F.col("top.k")).alias("minor")).where("minor > 0"), "main")
        open_ = ws.table(large.join(sized(main), "node"), "open")
        ws.drop("large")
        last = depth == DEPTH - 1
        named.append(ws.table(cross(open_ if last else open_.where(F.col("minor") <= MINOR)), "crossed"))
        if last or main.where(F.col("minor") > MINOR).isEmpty():
            break
        rows = ws.table(open_.where(F.col("minor") > MINOR).select("node", "uid", "n", "sketch").mapInArrow(_branch, _NODE), "branched")
        ws.drop("open")
        big = large_nodes(rows)
        small = rows.join(sized(big.select("node")), "node", "left_anti") if big is not None else rows
        pairs.append(compared(small, None, f"level{depth + 1}").select("a", "b"))

    named = ws.table(reduce(DataFrame.unionByName, named).distinct(), "named") if named else None
    union = reduce(DataFrame.unionByName, pairs if named is None else [*pairs, named])
    more = confirmed(apart(union, comps).select("a", "b"), "cross")
    if not more.isEmpty():
        links = ws.table(links.unionByName(more), "links")
        comps = ws.table(connected_components(links, ws), "components")
    if named is not None:
        # A set named a component of which other members may still be alike enough: compare it with all of them.
        both = named.select("a", "b").unionByName(named.select(F.col("b").alias("a"), F.col("a").alias("b")))
        relations = apart(both, comps).select("a", "comp_a", "comp_b").distinct()
        members = in_components(classes.select("uid", "n"), comps, "uid", "comp")
        sizes = ws.table(members.groupBy("comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles")), "sizes")
        own, other = sizes.select(F.col("comp").alias("comp_a"), F.col("k").alias("k_a")), sizes.select(F.col("comp").alias("comp_b"), F.col("k").alias("k_b"), "shingles")
        relations = relations.join(own, "comp_a").join(other, "comp_b").where("k_a < k_b or (k_a = k_b and comp_a > comp_b)")
        relations = ws.table(relations.select(F.col("a").alias("uid"), F.col("comp_b").alias("comp"), F.greatest(F.ceil(F.col("k_b") / BLOCK), F.ceil(F.col("shingles") / (1 << 22))).alias("blocks")), "relations")
        if not relations.isEmpty():
            asked = relations.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / MINOR).alias("groups"), F.max("blocks").alias("blocks"))
            asked = ws.table(asked, "asked")
            key = F.xxhash64("uid")
            left = relations.drop("blocks").join(sized(asked), "comp").select("comp", F.pmod(key, "groups").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), "uid", F.lit(0).alias("side"))
            right = members.join(sized(asked), "comp").select("comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("i"), F.pmod(key, "blocks").alias("j"), "uid", F.lit(1).alias("side"))
            work = ws.table(left.unionByName(right), "work")
            work = work.join(full(work.select("uid"), "work"), "uid").select("comp", "i", "j", "uid", "side", "own")
            more = ws.table(work.repartition(n_parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_full_blocks(threshold), "u long, v long"), "member-links")
            if not more.isEmpty():
                comps = ws.table(connected_components(ws.table(links.unionByName(more), "links"), ws), "components")

    whole = in_components(classes.select("digest", "uid", "low", "members"), comps, "uid", "root")
    lows = whole.groupBy("root").agg(F.min("low").alias("low"), F.sum("members").alias("rows")).where("rows > 1").select("root", F.col("low.id").alias("component_id"), F.col("low.uid").alias("keeper"))
    # A row that is alone in its component names itself, so most rows need no partner in the last join.
    return sets, ws.table(whole.select("digest", "root").join(lows, "root").select("digest", "component_id", "keeper"), "named-classes"), ws


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 75, recall: float = 0.9998, cut: float = 0.6) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least threshold percent on word shingles.

    Returns one row per input row: id, n_shingles, component_id, kept. component_id is the smallest id reachable.
    Null and empty texts are linked with nothing and are kept. Texts shorter than ``width`` words are one shingle.
    Rows with equal sets are linked. Null ids are larger than others; among repeated rows with the smallest id of a
    component all are kept (kept says id = component_id). An empty table gives an empty result; other columns are
    ignored; texts may have any length. ``recall`` is that of pairs at the threshold that go down to the last depth;
    ``cut`` is the share of 128 sketch bytes below which a pair is not confirmed: four standard deviations under the
    threshold.
    """
    sets, named, ws = _near(docs, id_col, text_col, width, threshold, recall, cut, ())
    out = sets.select("id", "n", "digest").join(sized(named.select("digest", "component_id", F.lit(True).alias("in_group"))), "digest", "left")
    component = F.when((F.col("n") == 0) | F.col("in_group").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return ws.result(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 75, recall: float = 0.9998, cut: float = 0.6) -> DataFrame:
    """The rows of docs, with all their columns, less near copies: exactly one row of each component stays.

    It is one with the smallest id (null ids last), also where rows repeat an id. Rows without words stay.
    """
    sets, named, ws = _near(docs, id_col, text_col, width, threshold, recall, cut, tuple(docs.columns))
    out = sets.select("uid", "n", "digest", "carried").join(sized(named.select("digest", "keeper")), "digest", "left")
    return ws.result(out.where("n = 0 or keeper is null or keeper = uid").select("carried.*"))
