"""Aligning routes, stations and intervals between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_priority(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key, the order being total; combined on the map side."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def fill_gaps(own: DataFrame, other: DataFrame, key: str, fields: list[str], pair: tuple[str, str], source: str) -> DataFrame:
    """Null fields of ``own`` filled from ``other``, latitude and longitude only together; ``filled`` lists what was."""
    o = other.select(key, *[F.col(c).alias(f"__{c}") for c in [*fields, *pair]])
    j = own.join(o, key, "left")
    lost = F.col(pair[0]).isNull() | F.col(pair[1]).isNull()
    both = F.col(f"__{pair[0]}").isNotNull() & F.col(f"__{pair[1]}").isNotNull()
    names = F.filter(
        F.array(
            *[F.when(F.col(c).isNull() & F.col(f"__{c}").isNotNull(), F.lit(f"{c}:{source}")) for c in fields],
            F.when(lost & both, F.lit(f"position:{source}")),
        ),
        lambda x: x.isNotNull(),
    )
    keep = [c for c in own.columns if c not in fields and c not in pair]
    return j.select(
        *keep, *[F.coalesce(c, f"__{c}").alias(c) for c in fields],
        *[F.when(lost, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in pair], names.alias("filled"),
    )


def pair_offset(a: DataFrame, b: DataFrame, key: str, place: str, at: str) -> DataFrame:
    """Most frequent time difference between two sources of a route over stations that stand once in both.

    Result: the key, ``offset``, ``n`` (stations at that offset), ``total`` and ``strict`` (a
    majority). Ties go to the smallest offset in size, then value.
    """
    def single(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(at).isNotNull() & F.col(place).isNotNull()).groupBy(key, place).agg(F.min(at).alias(name), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")

    j = single(a, "x").join(single(b, "y"), [key, place])
    counts = j.groupBy(key, (F.col("x") - F.col("y")).alias("offset")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.max(F.struct("n", (-F.abs("offset")).alias("s"), (-F.col("offset")).alias("o"))).alias("m"), F.sum("n").alias("total"))
    return best.select(key, (-F.col("m.o")).alias("offset"), F.col("m.n").alias("n"), "total", (F.col("m.n") * 2 > F.col("total")).alias("strict"))


def slot_alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stops of two routes of a train that differ in code but hold the same slot between common stops.

    Both sides have ``train_number, pos, station_code``. A stop of ``a`` without a partner in
    ``b`` pairs with the only such stop of ``b`` between the same common neighbours, if it is
    itself the only one of ``a`` there.
    """
    first = lambda df, n: df.groupBy("train_number", "station_code").agg(F.min("pos").alias(n))
    both = first(a, "pa").join(first(b, "pb"), ["train_number", "station_code"])
    w = Window.partitionBy("train_number").orderBy("pos")
    marked = a.join(both.select("train_number", "station_code", "pa", "pb"), ["train_number", "station_code"], "left").withColumn(
        "at", F.when(F.col("pos") == F.col("pa"), F.col("pb"))
    )
    slots = marked.withColumn("lo", F.max("at").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "hi", F.min("at").over(w.rowsBetween(1, Window.unboundedFollowing))
    ).where("pa is null and lo < hi")
    lone = slots.groupBy("train_number", "lo", "hi").agg(F.min("pos").alias("pos_a"), F.min("station_code").alias("code_a"), F.count(F.lit(1)).alias("n")).where("n = 1")
    free = b.join(both, ["train_number", "station_code"], "left_anti").select("train_number", F.col("pos").alias("pos_b"), F.col("station_code").alias("code_b"))
    return lone.drop("n").join(free, "train_number").where("pos_b > lo and pos_b < hi").groupBy("train_number", "pos_a", "code_a").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos_b").alias("pos_b"), F.min("code_b").alias("code_b")
    ).where("n = 1").drop("n")


def gap_clusters(rows: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """Clusters of a key's times, cut where the next one is more than ``gap`` later."""
    times = rows.select(key, at).where(F.col(at).isNotNull()).groupBy(key, at).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key).orderBy(at)
    cut = (F.col(at) - F.lag(at).over(w) > gap).cast("int")
    marked = times.withColumn("cluster", F.sum(F.coalesce(cut, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy(key, "cluster").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("values"))


def merged_intervals(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping inclusive intervals of each key, with how many went into each."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col(start) > before).cast("int")
    marked = rows.withColumn("part", F.sum(F.coalesce(fresh, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "part").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("part")


def drop_contained(sets: DataFrame, key: str, values: str) -> DataFrame:
    """Sets of a key that no other set of that key strictly contains; equal sets are one."""
    s = sets.select(key, F.array_sort(F.array_distinct(values)).alias(values)).distinct()
    o = s.select(F.col(key).alias("__k"), F.col(values).alias("__v"))
    inside = (F.col(key) == F.col("__k")) & (F.size("__v") > F.size(values)) & (F.size(F.array_except(values, "__v")) == 0)
    return s.join(o, inside, "left_anti")


def line_support(routes: DataFrame, gaps: DataFrame) -> DataFrame:
    """For pairs of stations around a gap, how many trains serve a third one between them, either way.

    ``routes``: ``train_number, pos, station_code``; ``gaps``: ``before, after``. Result:
    ``before, after, code, n``.
    """
    g = gaps.where("before is not null and after is not null and before <> after").select("before", "after").distinct()
    first = routes.groupBy("train_number", "station_code").agg(F.min("pos").alias("pos"))
    p = first.select("train_number", F.col("station_code").alias("before"), F.col("pos").alias("p"))
    q = first.select("train_number", F.col("station_code").alias("after"), F.col("pos").alias("q"))
    spans = g.join(p, "before").join(q, ["train_number", "after"])
    mid = first.select("train_number", F.col("station_code").alias("code"), "pos")
    inside = F.col("pos").between(F.least("p", "q") + 1, F.greatest("p", "q") - 1)
    return spans.join(mid, "train_number").where(inside).groupBy("before", "after", "code").agg(F.countDistinct("train_number").alias("n"))


def match_names(names: DataFrame, dictionary: DataFrame, keys: list[tuple[str, Column, Column]]) -> DataFrame:
    """Codes of names by a cascade of ever looser keys, each used only where it gives one code.

    ``names`` has ``name``; ``dictionary`` has ``code, label``. ``keys`` lists (step, key of a
    name, key of a label). A name whose key has several codes is ``ambiguous`` at that step and
    not tried further; one without any is ``none``. Result: ``name, code, how``.
    """
    left, done = names.select("name").distinct(), None
    for step, of_name, of_label in keys:
        d = dictionary.select(of_label.alias("k"), "code").where("k is not null and k <> '' and code is not null").distinct()
        d = d.groupBy("k").agg(F.min("code").alias("code"), F.count(F.lit(1)).alias("n"))
        j = left.withColumn("k", of_name).join(d, "k", "left")
        hit = j.where("n is not null").select("name", F.when(F.col("n") == 1, F.col("code")).alias("code"), F.when(F.col("n") == 1, F.lit(step)).otherwise("ambiguous").alias("how"))
        done = hit if done is None else done.unionByName(hit)
        left = j.where("n is null").select("name")
    return done.unionByName(left.select("name", F.lit(None).cast("string").alias("code"), F.lit("none").alias("how")))
