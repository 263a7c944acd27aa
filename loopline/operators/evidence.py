"""Comparing what several sources say about one fact: agreement, majority, update, conflict.

Input is long: one row for each item, field and source, with ``prio`` (1 is the source shown),
``upstream`` (sources sharing one count once), ``counted`` (whether it is evidence) and
``value`` (text; null means not reported).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Overall statuses from the least to the most verified.
STRENGTH = ["conflict", "not_checked", "single_source", "updated", "partially_confirmed", "majority", "confirmed"]


def settle(reports: DataFrame, keys: list[str], applies: bool = True, operational: bool = False) -> DataFrame:
    """Status of every field: confirmed, single_source, majority, updated or conflict, and the value to show.

    All reports equal: confirmed if two upstreams back it, else single_source. Otherwise
    majority if one value has more upstreams than any other and at least two; updated if the
    primary stands alone against exactly one value of two or more services that share one
    upstream other than the primary's, none on that upstream dissenting, or, with
    ``operational``, the other way round; else conflict. A value that would replace the
    primary's counts only if it ``applies``. Values compare exactly; for tolerances see
    :func:`tolerant_groups`. Fields nobody reports have no row.
    """
    r = reports.where("value is not null")
    groups = r.groupBy(*keys, "value").agg(
        F.countDistinct(F.when(F.col("counted"), F.col("upstream"))).alias("support"), F.countDistinct(F.when(F.col("counted"), F.col("source"))).alias("services"),
        F.max(F.when((F.col("prio") == 1) & F.col("counted"), 1).otherwise(0)).alias("own"), F.max(F.when(F.col("prio") == 1, 1).otherwise(0)).alias("shown"),
        F.collect_set(F.when(F.col("counted"), F.col("upstream"))).alias("ups"), F.min("prio").alias("first"),
        F.max(F.when(F.col("prio") == 1, F.col("upstream"))).alias("own_up"),
    )
    packed = groups.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_values"), F.collect_list(F.struct("support", "services", "own", "shown", "value", "ups", "first")).alias("all"),
        F.max("own_up").alias("own_up"), F.max(F.when(F.col("shown") == 1, F.col("value"))).alias("primary"),
    )
    g = F.filter("all", lambda x: x["services"] > 0)
    ranked = F.reverse(F.array_sort(F.transform(g, lambda x: F.struct(x["support"].alias("support"), (-x["first"]).alias("f"), x["value"].alias("value")))))
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    ups = F.size(F.array_distinct(F.flatten(F.transform("all", lambda x: x["ups"]))))
    mine = F.get(F.filter(g, lambda x: x["own"] == 1), F.lit(0))
    rivals = F.filter(g, lambda x: (x["own"] == 0) & (x["services"] >= 2))
    rival = F.get(rivals, F.lit(0))
    shared = F.get(rival["ups"], F.lit(0))
    dissent = F.exists(F.filter(g, lambda x: x["value"] != rival["value"]), lambda x: F.array_contains(x["ups"], shared))
    majority = (top["support"] >= 2) & (top["support"] > F.coalesce(second["support"], F.lit(0)))
    update = (mine["services"] == 1) & (F.size(rivals) == 1) & (F.size(rival["ups"]) == 1) & (shared != F.col("own_up")) & ~dissent
    others = F.filter(g, lambda x: x["own"] == 0)
    other = F.get(others, F.lit(0))
    mirror = F.lit(operational) & (mine["services"] >= 2) & (F.size(mine["ups"]) == 1) & (F.size(others) == 1) & (other["support"] == 1) & ~F.array_contains(other["ups"], F.col("own_up"))
    value = F.when(F.col("n_values") == 1, F.get("all", F.lit(0))["value"]).when(majority, top["value"]).when(update, rival["value"]).when(mirror, F.col("primary"))
    replaces = F.col("primary").isNotNull() & (value != F.col("primary"))
    status = (
        F.when((F.col("n_values") == 1) & (ups >= 2), "confirmed").when(F.col("n_values") == 1, "single_source")
        .when(F.coalesce(replaces, F.lit(False)) & ~F.lit(applies), "conflict").when(majority, "majority").when(update | mirror, "updated").otherwise("conflict")
    )
    out = packed.select(*keys, status.alias("status"), "primary", (ups > 0).alias("counted"), value.alias("value"))
    return out.withColumn("shown", F.when(F.col("status") == "conflict", F.col("primary")).otherwise(F.coalesce("value", "primary"))).drop("value")


def roll_up(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Overall status of an item from its fields' statuses; not_checked if no source of any field is evidence.

    ``fields`` may have ``counted``, as :func:`settle` gives it; without it every field has evidence.
    """
    n = lambda s: F.count_if(F.col("status") == s)
    evidence = F.col("counted") if "counted" in fields.columns else F.lit(True)
    overall = (
        F.when(n("conflict") > 0, "conflict").when(F.count_if(evidence) == 0, "not_checked").when(n("updated") > 0, "updated")
        .when(n("confirmed") + n("majority") == 0, "single_source").when(n("single_source") > 0, "partially_confirmed")
        .when(n("majority") > 0, "majority").otherwise("confirmed")
    )
    return fields.groupBy(*keys).agg(overall.alias("overall"), F.count(F.lit(1)).alias("n_fields"), n("conflict").alias("n_conflicts"))


def weakest(status: Column) -> Column:
    """Aggregate: the least verified of several overall statuses."""
    order = F.array(*[F.lit(s) for s in STRENGTH])
    return F.coalesce(F.get(order, F.min(F.array_position(order, status)).cast("int") - 1), F.lit("not_checked"))


def tolerant_groups(values: Column, tolerance: float) -> Column:
    """Groups of an ordered list of numbers: each joins the first group whose first member is near enough.

    Order matters because nearness is not transitive: evidence goes first, then by priority.
    """
    empty = F.array().cast("array<array<double>>")

    def add(acc: Column, v: Column) -> Column:
        hit = F.array_position(F.transform(acc, lambda g: F.abs(g[0] - v) <= tolerance), F.lit(True))
        grown = F.transform(acc, lambda g, i: F.when(i + 1 == hit, F.concat(g, F.array(v))).otherwise(g))
        return F.when(hit > 0, grown).otherwise(F.concat(acc, F.array(F.array(v))))

    return F.aggregate(values.cast("array<double>"), empty, add)


def merge_visits(rides: DataFrame, sources: list[str]) -> DataFrame:
    """Rides of a train from several sources merged into rows, each ride in exactly one.

    ``rides`` has ``train_number, source, dep``. Two sources that list a train equally often
    pair its rides in order of departure, others pair the first rides of equal departure. A
    ride belongs to the first source in order whose ride it pairs with, else it is a row of
    its own. Result: ``train_number, source, visit, dep, matched, missing``. Other sources'
    rides are left out; nulls in ``dep`` come first.

    One round of equi-joins on (train, visit or departure) for each two sources; the sources
    are a short list, the rides any number.
    """
    at = Window.partitionBy("train_number", "source").orderBy("dep")
    mine = rides.where(F.col("source").isin(sources)).select("train_number", "source", "dep").withColumn("visit", F.row_number().over(at) - 1)
    listed = mine.groupBy("train_number").agg(*[F.count_if(F.col("source") == s).alias(f"n{k}") for k, s in enumerate(sources)])
    same = Window.partitionBy("train_number", "source", "dep").orderBy("visit")
    free = mine.withColumn("nth", F.row_number().over(same)).join(listed, "train_number")
    left = {s: free.where(F.col("source") == s) for s in sources}
    out = []
    for k, s in enumerate(sources):
        rows = left[s].withColumn("turn", F.row_number().over(Window.partitionBy("train_number", "dep").orderBy("visit")))
        for j, o in enumerate(sources[k + 1 :], k + 1):
            even = F.col(f"n{k}") == F.col(f"n{j}")
            key = F.when(even, F.struct(F.lit(True).alias("by_visit"), F.col("visit").alias("x"))).otherwise(F.struct(F.lit(False).alias("by_visit"), F.col("dep").cast("int").alias("x")))
            theirs = left[o].where(even | (F.col("nth") == 1)).select("train_number", key.alias("key"), F.col("visit").alias(f"m{j}"))
            pair = rows.select("train_number", "visit", "turn", F.when(even | (F.col("turn") == 1), key).alias("key")).join(theirs, ["train_number", "key"])
            rows = rows.join(pair.select("train_number", "visit", f"m{j}"), ["train_number", "visit"], "left")
            left[o] = left[o].join(pair.select("train_number", F.col(f"m{j}").alias("visit")), ["train_number", "visit"], "left_anti")
        later = {o: F.col(f"m{j}").isNotNull() for j, o in enumerate(sources) if j > k}
        pick = lambda want: F.array_compact(F.array(*[F.when(later.get(o, F.lit(False)) == want, F.lit(o)) for o in sources if o != s]))
        none = F.array().cast("array<string>")
        many = len(sources) > 1
        out.append(rows.select("train_number", "source", "visit", "dep", (pick(True) if many else none).alias("matched"), (pick(False) if many else none).alias("missing")))
    return reduce(DataFrame.unionByName, out)


def copied_positions(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``counted``: false for a position that is no evidence of its own.

    That is one from a source that is not ``independent`` (a column; missing means all are),
    and one identical to an independent one of higher priority, which is a copy.
    """
    own = F.col("independent") if "independent" in positions.columns else F.lit(True)
    w = Window.partitionBy(*keys, "lat", "lon", own).orderBy("prio")
    return positions.withColumn("counted", own & (F.row_number().over(w) == 1))
