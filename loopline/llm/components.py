"""Connected components of pairwise links on a two-dimensional grid.

Vertices are hashed into k blocks and every edge belongs to the grid cell of its two blocks,
so a vertex with a huge share of the edges is spread over k cells, and a cell that still
holds too many edges is cut into slices by a hash of the edge. Each cell or slice runs a local
union-find; each vertex then takes the least of the representatives its row and column of
cells gave it as parent. Representatives that got a smaller parent elsewhere are followed to
the end of their chain by pointer doubling; every vertex with a parent leaves the graph, and
the ends met at one vertex are linked for the next round. Rounds end when no edge is left,
then parents are followed back through the rounds.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopline.session import drop_stage, stage


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of an edge list and the least vertex of each one's component (union-find by minimum)."""
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)  # sorted, so the least index is the least name
    a, b = flat[: len(u)], flat[len(u) :]
    parent = np.arange(len(names))
    while len(a):
        ra, rb = parent[a], parent[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return names, names[parent]


def _cell(part: pd.DataFrame) -> pd.DataFrame:
    names, roots = local_roots(part["u"].to_numpy(dtype=object), part["v"].to_numpy(dtype=object))
    return pd.DataFrame({"v": names, "rep": roots})


def _mapped(df: DataFrame, column: str, top: DataFrame) -> DataFrame:
    """``df`` with a column's vertices replaced by their top where they have one."""
    t = top.select(F.col("v").alias("__v"), F.col("parent").alias("__top"))
    return df.join(t, F.col(column) == F.col("__v"), "left").withColumn(column, F.coalesce("__top", column)).drop("__v", "__top")


def _tops(hubs: DataFrame) -> DataFrame:
    """Follow chains of representatives to their ends by doubling; ``hubs`` holds those that have a parent."""
    hubs = stage(hubs, "hubs")
    while True:
        up = hubs.select(F.col("v").alias("__v"), F.col("parent").alias("__top"))
        longer = hubs.join(up, hubs["parent"] == up["__v"], "left")
        if not longer.where("__top is not null").limit(1).count():
            return hubs
        hubs = stage(longer.select("v", F.coalesce("__top", "parent").alias("parent")), "hubs")


def components(pairs: DataFrame, a: str, b: str, cell_edges: int = 200_000, max_rounds: int = 60) -> DataFrame:
    """Every linked string vertex with the least vertex of its component: columns ``vertex, component``.

    Links are undirected; repeated, reversed and self links are harmless, and a vertex with
    only a self link is its own component. Links with a null end are left out. No links give
    no rows. ``cell_edges`` is the intended size of a grid cell; the grid is made as large as
    the counted edges need, and a cell of more than twice as many, as a hub's, is sliced, so
    one task holds a bounded part of the edges whatever their skew.
    """
    links = pairs.select(F.col(a).cast("string").alias("u"), F.col(b).cast("string").alias("v")).where("u is not null and v is not null")
    links = stage(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    edges, parents = links.where("u <> v"), []
    left = edges.count()
    while left:
        if len(parents) >= max_rounds:
            raise RuntimeError("components did not settle")
        k = max(1 if parents else 2, math.ceil(math.sqrt(left / cell_edges)))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
        placed = edges.withColumn("row", block("u")).withColumn("col", block("v"))
        slices = F.ceil(F.col("count") / cell_edges).cast("int").alias("slices")
        full = placed.groupBy("row", "col").count().where(F.col("count") > 2 * cell_edges).select("row", "col", slices)
        placed = placed.join(full, ["row", "col"], "left").withColumn("part", F.pmod(F.xxhash64("u", "v"), F.coalesce("slices", F.lit(1))))
        reps = placed.select("row", "col", "part", "u", "v").groupBy("row", "col", "part").applyInPandas(_cell, "v string, rep string")
        met = stage(reps.groupBy("v").agg(F.min("rep").alias("parent"), F.collect_set("rep").alias("reps")), "round")
        top = _tops(met.where("v <> parent and array_contains(reps, v)").select("v", "parent"))
        parents.append(stage(_mapped(met.where("v <> parent").select("v", "parent"), "parent", top), "parents"))
        met_pairs = met.select("parent", F.explode("reps").alias("rep")).where("rep <> parent").distinct()
        linked = _mapped(_mapped(met_pairs, "parent", top), "rep", top).where("rep <> parent").select(
            F.least("parent", "rep").alias("u"), F.greatest("parent", "rep").alias("v")
        ).distinct()
        if len(parents) > 1:
            drop_stage(edges)
        edges = stage(linked, "edges")
        left = edges.count()
    seen = links.select(F.col("u").alias("vertex")).union(links.select("v")).distinct()
    if not parents:
        return seen.select("vertex", F.col("vertex").alias("component"))

    def lift(later: DataFrame, earlier: DataFrame) -> DataFrame:
        up = later.select(F.col("v").alias("p"), F.col("parent").alias("root"))
        moved = earlier.join(up, earlier["parent"] == up["p"], "left").select("v", F.coalesce("root", "parent").alias("parent"))
        return moved.unionByName(later)

    roots = reduce(lift, reversed(parents))
    return seen.join(roots, seen["vertex"] == roots["v"], "left").select("vertex", F.coalesce("parent", "vertex").alias("component"))
