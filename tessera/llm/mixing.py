"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded block selection.

DataFrame and SQL functions only. The words of the mix are so many blocks of equal size. Sources get integer quotas of
blocks by highest quotients target / (2q + 1); each source is cut into shards (rows by a seeded hash, so many that a
shard stays small), which get integer quotas of the source's blocks in the same way. A shard's rows form one stream of
words in a seeded order, cut into blocks; all its blocks are taken as often as its quota allows, and of the rest of the
quota the blocks that come first in a seeded order of their numbers.

A source may hold most rows, and there may be as many sources as hosts: sources, candidates for a seat and shards are
ranked over ranges, never in one task, and only sums over all sources come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, Workspace, global_rank, sized, text_of


def target_levels(sources: DataFrame, total: float, cap: float) -> DataFrame:
    """Adds ``target``: total shared by weight, none above cap * source_size, the excess reshared by weight.

    ``sources`` has source_size and weight. The shared rate rises while sources reach their caps; each step is a sum
    over the sources (of whole numbers, so that the order of summation is no matter).
    """
    rate, capped = 0.0, -1
    while True:
        full = F.col("source_size") * F.lit(cap) < F.lit(rate) * F.col("weight")
        s = sources.agg(F.sum(F.when(full, 1).otherwise(0)).alias("n"), F.sum(F.when(full, F.col("source_size"))).alias("spent"), F.sum(F.when(full, F.lit(0)).otherwise(F.col("weight"))).alias("open")).first()
        if s["n"] is None or s["n"] == capped or not s["open"]:
            break
        capped, rate = s["n"], (total - (s["spent"] or 0) * cap) / s["open"]
    shared = F.lit(rate) * F.col("weight")
    return sources.withColumn("target", F.least(F.col("source_size") * F.lit(cap), F.lit(float("inf")) if s["open"] == 0 else shared).cast("double"))


def apportion(parties: DataFrame, group: str, seats: str, claim: str, limit: str, ws: Workspace, name: str) -> DataFrame:
    """Adds ``quota``: the seats of each group by Sainte-Lague's highest quotients claim / (2q + 1) among its parties.

    ``parties`` has group, party (a number that is its own), the group's seats, the claim (0 or more) and the limit of a
    quota. Highest quotients are rounded shares of a common divisor, so a quota differs from the exact share by at most
    the share's part of half the parties and one: seats below are sure, and only the few about the share are ranked.
    Ties go to the smaller party.
    """
    sums = ws.table(parties.groupBy(group).agg(F.sum(claim).alias("claims"), F.count(F.lit(1)).alias("parties")), f"{name}-sums")
    p = parties.join(sized(sums), group)
    p = p.withColumn("share", F.coalesce(F.col(seats) * F.col(claim) / F.nullif(F.col("claims").cast("double"), F.lit(0.0)), F.lit(0.0)))
    slack = F.ceil(F.col("share") / F.greatest(F.col(seats), F.lit(1)) * F.col("parties") / 2) + 2
    p = p.withColumn("sure", F.least(F.greatest(F.floor("share") - slack, F.lit(0)), F.col(limit))).withColumn("most", F.least(F.floor("share") + slack, F.col(limit)))
    p = ws.table(p, name)
    seat = F.explode(F.expr("CASE WHEN most > sure THEN sequence(sure, most - 1) END"))
    candidates = p.select(F.col(group).alias("g"), "party", F.col(claim).alias("claim"), seat.alias("seat"))
    ranked = ws.table(global_rank(candidates, ws, f"{name}-candidates", F.col("g"), F.desc(F.col("claim") / (2 * F.col("seat") + 1)), F.col("party"), F.col("seat")), f"{name}-ranked")
    groups = p.groupBy(F.col(group).alias("g")).agg((F.first(seats) - F.sum("sure")).alias("open")).join(ranked.groupBy("g").agg(F.min("place").alias("begin")), "g")
    groups = ws.table(groups, f"{name}-groups")
    won = ranked.select("g", "party", "place").join(sized(groups), "g").where(F.col("place") - F.col("begin") < F.col("open")).groupBy("party").agg(F.count(F.lit(1)).alias("won"))
    return p.join(sized(ws.table(won, f"{name}-won")), "party", "left").withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0))).drop("claims", "parties", "share", "sure", "most", "won")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, block: int = 32, shard_rows: int = 2048, seed: int = 17) -> DataFrame:
    """How many words of each row the mix takes: id, size, source_size, target, taken.

    size counts ASCII-white-space words (null text: 0). Sources in code point order, null last, weigh ``weights`` in
    turn and share ``share`` times all words, each at most ``cap`` times its own (the excess is reshared). The same
    input gives the same mix. One row per input row; repeated rows are rows of their own (which of several equal rows
    is taken is immaterial); null ids are ids like others; rows without words take 0, as do sources without; a text
    may have any length; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    text = text_of(docs, text_col)
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = ws.table(docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), docs[id_col], text).alias("ord")), "sizes")

    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sources = ws.table(global_rank(sources, ws, "sources", F.col("source").isNull(), F.col("source")).withColumnRenamed("place", "party"), "ranked-sources")
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("party") - 1, F.lit(len(weights))) + 1).cast("int")))
    total = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    sources = target_levels(sources, total * share, cap)
    seats = round((sources.agg(F.sum("target").alias("t")).first()["t"] or 0) / block)
    sources = sources.withColumn("one", F.lit(0)).withColumn("seats", F.lit(seats).cast("long")).withColumn("limit", cap * F.ceil(F.col("source_size") / block))
    sources = ws.table(apportion(sources, "one", "seats", "target", "limit", ws, "source-quotas").select("party", "source", "source_size", "target", "quota", F.ceil(F.col("n_rows") / shard_rows).alias("n_shards")), "quotas")

    named = sources.select("party", F.col("source").alias("s"), "n_shards")
    rows = rows.join(sized(named), F.col("source").eqNullSafe(F.col("s"))).select("party", F.pmod(F.xxhash64(F.lit(seed + 1), "ord"), "n_shards").alias("shard"), "id", "size", "ord")
    cells = ws.table(rows.groupBy("party", "shard").agg(F.sum("size").alias("cell")), "cells")
    claims = cells.join(sized(sources.select("party", "quota")), "party").select(F.col("party").alias("of"), "shard", "cell", F.col("quota").alias("seats"), (cap * F.ceil(F.col("cell") / block)).alias("limit"))
    claims = global_rank(claims, ws, "shards", F.col("of"), F.col("shard")).withColumnRenamed("place", "party")
    shards = apportion(claims, "of", "seats", "cell", "limit", ws, "shard-quotas")

    def order(j: Column) -> Column:
        return F.xxhash64(F.lit(seed + 2), "party", "shard", j)

    # The blocks of the last, partial round: those whose number is among the first in a seeded order. One number for one
    # shard is a one-to-one hash, so that exactly so many lie below the bound.
    n = F.greatest(F.ceil(F.col("cell") / block), F.lit(1))
    shards = shards.select(F.col("of").alias("party"), "shard", n.alias("n"), "quota")
    numbers = F.sort_array(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), order))
    shards = shards.withColumn("times", F.floor(F.col("quota") / F.col("n"))).withColumn("bound", F.get(numbers, F.pmod("quota", "n").cast("int")))
    plan = ws.table(shards.select("party", "shard", "times", "bound"), "plan")

    within = Window.partitionBy("party", "shard").orderBy("ord", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = rows.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("end", F.col("start") + F.col("size"))
    d = d.join(sized(plan), ["party", "shard"]).join(sized(sources.select("party", "source_size", "target")), "party")

    def words(j: Column) -> Column:
        times = F.col("times") + F.when(order(j) < F.col("bound"), 1).otherwise(0)
        return times * (F.least(F.col("end"), (j + 1) * block) - F.greatest(F.col("start"), j * block))

    first, last = F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)
    taken = F.when(F.col("size") > 0, F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda a, j: a + words(j))).otherwise(F.lit(0))
    return ws.result(d.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken")))
