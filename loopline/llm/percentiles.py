"""Percentiles per group over very large columns, exact or within a stated error, and mergeable.

A summary is a table of group, value and count. It is built with map-side combining, so a hot
group shrinks before it moves; summaries of separate days or partitions are merged by adding
counts. Percentiles of a summary are selected by distributed multi-select: the blocks of a
group propose local medians, the weighted median of the proposals is the pivot, counts below,
at and above the pivot rule ranges out, and this repeats for every group and rank at once
until what is left of a group fits one block, where the rank is read off directly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopline.session import drop_stage, stage


def summarise(df: DataFrame, by: list[str], value: Column, resolution: float = 0.0) -> DataFrame:
    """Mergeable summary: ``by``, ``value`` (double), ``c`` (bigint). Nulls and NaN are left out.

    With ``resolution`` r > 0 values are moved to the middle of their cell of width r, which
    bounds every percentile's error by r / 2 and the summary's size by range / r per group.
    """
    v = value.cast("double")
    if resolution:
        v = F.when(~F.isnan(v), (F.floor(v / resolution) + 0.5) * resolution)
    return df.select(*by, v.alias("value")).where("value is not null and not isnan(value)").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("c"))


def merge(*summaries: DataFrame, by: list[str]) -> DataFrame:
    """One summary of all the rows behind several; further columns, such as a day, are summed over."""
    return reduce(DataFrame.unionByName, [s.select(*by, "value", "c") for s in summaries]).groupBy(*by, "value").agg(F.sum("c").alias("c"))


def _within(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The value at rank ``k`` of each key's rows, all of a key in one place: keys, ``pct``, ``value``."""
    upto = Window.partitionBy(*keys, "pct").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cum", F.sum("c").over(upto)).where("cum >= k and cum - c < k").select(*keys, "pct", "value")


def percentiles(summary: DataFrame, by: list[str], pcts: list[int], block_values: int = 64) -> DataFrame:
    """``by``, ``n`` and one column ``p<pct>`` for each percentage: the value at rank ceil(pct * n / 100).

    This is the nearest-rank definition, always an observed value (the lower median for 50);
    ties need no rule. Null is a group of its own. Groups without values give no row, an empty
    summary none. ``block_values`` is the most distinct values of a group that one block may
    hold: groups with more go through pivot rounds over several blocks.
    """
    pcts = sorted(set(pcts))
    keys = [f"__g{i}" for i in range(len(by))]
    cells = stage(summary.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], "value", "c"), "cells")
    # a struct is never null, so null groups join like any other
    gid = F.struct(*keys)
    cells = cells.select(F.xxhash64(gid).alias("h"), gid.alias("g"), "value", "c")
    sizes = stage(cells.groupBy("h", "g").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d")), "sizes")
    small = cells.join(sizes.where(F.col("d") <= block_values), ["h", "g"])
    upto = Window.partitionBy("h", "g").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rank = lambda p: F.expr(f"(n * {p} + 99) div 100")
    read = small.withColumn("cum", F.sum("c").over(upto)).groupBy("h", "g").agg(
        F.first("n").alias("n"),
        *[F.max(F.when((F.col("cum") >= rank(p)) & (F.col("cum") - F.col("c") < rank(p)), F.col("value"))).alias(f"p{p}") for p in pcts],
    )
    parts = [read]
    big = sizes.where(F.col("d") > block_values)
    if big.limit(1).count():
        parts.append(_multi_select(cells, big, pcts, block_values))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(*[F.col("g")[k].alias(b) for b, k in zip(by, keys)], "n", *[f"p{p}" for p in pcts])


def _few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` to be broadcast if it is counted to have few rows; the rows of large groups are then read where they lie."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _multi_select(cells: DataFrame, big: DataFrame, pcts: list[int], block_values: int) -> DataFrame:
    ranks = F.array(*[F.struct(F.lit(p).alias("pct"), F.expr(f"(n * {p} + 99) div 100").alias("k")) for p in pcts])
    blocks = F.greatest(F.lit(1), F.ceil(F.col("d") / block_values)).cast("int")
    rows = stage(
        cells.join(big.select("h", "g", blocks.alias("blocks")), ["h", "g"])
        .withColumn("block", F.pmod(F.xxhash64("value"), F.col("blocks")).cast("int")).drop("blocks"),
        "hot",
    )
    state = stage(
        big.select("h", "g", F.explode(ranks).alias("r"), "d").select(
            "h", "g", "r.pct", "r.k", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), "d"
        ),
        "state",
    )
    done: list[DataFrame] = []
    keys = ["h", "g", "pct"]
    while state.limit(1).count():
        live = rows.join(_few(state), ["h", "g"]).where("value > lo and value < hi")
        final = state.where(F.col("d") <= block_values).select(*keys)
        if final.limit(1).count():
            done.append(stage(_within(live.where(F.col("d") <= block_values), ["h", "g"]), "found"))
        more = state.where(F.col("d") > block_values)
        if not more.limit(1).count():
            break
        live = live.where(F.col("d") > block_values)
        proposed = live.groupBy(*keys, "block").agg(F.percentile_approx("value", 0.5, 200).alias("pivot"), F.sum("c").alias("w"))
        order = Window.partitionBy(*keys).orderBy("pivot", "block").rowsBetween(Window.unboundedPreceding, 0)
        pivots = (
            proposed.withColumn("cum", F.sum("w").over(order)).withColumn("all", F.sum("w").over(Window.partitionBy(*keys)))
            .where("2 * cum >= all").groupBy(*keys).agg(F.min("pivot").alias("pivot"))
        )
        counted = live.join(_few(stage(pivots, "pivots")), keys).groupBy(*keys, "pivot", "k", "lo", "hi").agg(
            F.sum(F.when(F.col("value") < F.col("pivot"), F.col("c")).otherwise(0)).alias("lt"),
            F.sum(F.when(F.col("value") == F.col("pivot"), F.col("c")).otherwise(0)).alias("eq"),
            F.count(F.when(F.col("value") < F.col("pivot"), 1)).alias("below"),
            F.count(F.when(F.col("value") > F.col("pivot"), 1)).alias("above"),
        )
        counted = stage(counted, "counted")
        hit = counted.where("k > lt and k <= lt + eq")
        done.append(hit.select("h", "g", "pct", F.col("pivot").alias("value")))
        low, high = F.col("k") <= F.col("lt"), F.col("k") > F.col("lt") + F.col("eq")
        state = stage(
            counted.where(low | high).select(
                *keys,
                F.when(low, F.col("k")).otherwise(F.col("k") - F.col("lt") - F.col("eq")).alias("k"),
                F.when(low, F.col("lo")).otherwise(F.col("pivot")).alias("lo"),
                F.when(low, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
                F.when(low, F.col("below")).otherwise(F.col("above")).alias("d"),
            ),
            "state",
        )
        ranges = state.groupBy("h", "g").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))  # one for each percentile at most
        wanted = F.exists("ranges", lambda r: (F.col("value") > r["lo"]) & (F.col("value") < r["hi"]))
        kept = stage(rows.join(_few(ranges), ["h", "g"]).where(wanted).select("h", "g", "value", "c", "block"), "hot")
        drop_stage(rows)
        rows = kept
    found = reduce(DataFrame.unionByName, done)
    return big.select("h", "g", "n").join(
        found.groupBy("h", "g").agg(*[F.max(F.when(F.col("pct") == p, F.col("value"))).alias(f"p{p}") for p in pcts]), ["h", "g"]
    )
