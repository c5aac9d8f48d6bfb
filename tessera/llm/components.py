"""Connected components by alternating large-star and small-star steps, each a join and an aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch of links without those that close a circle: the same components, at most one link a vertex."""
    for batch in batches:
        up: dict[int, int] = {}

        def find(a: int) -> int:
            up.setdefault(a, a)
            while up[a] != a:
                up[a] = up[up[a]]
                a = up[a]
            return a

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        pairs = [(a, find(a)) for a in list(up) if find(a) != a]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])


def connected_components(links: DataFrame, ws: Workspace) -> DataFrame:
    """(u, root) for each vertex but the roots, from links (u, v); root is the smallest vertex reachable.

    Stars converge in a logarithmic number of rounds; each is written to the shared folder. Hubs are safe: minima are
    aggregated before the shuffle, and joins on a hub can be split.
    """
    edges = ws.table(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(_forest, "u long, v long").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = ws.table(small.where("u <> v").distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), (F.count(F.lit(1)) - F.countDistinct("u")).alias("open")).first()
        if (state["n"], state["h"]) == last:
            return edges.select("u", F.col("v").alias("root"))
        last = (state["n"], state["h"])
