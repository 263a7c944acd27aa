"""Building routes from printed columns: cutting, offsets, merging, chaining, and choosing codes."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopline.functions import clock
from loopline.operators.grouped import per_group
from loopline.operators.nearby import haversine_km


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first of rows that agree in ``keys``, in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def table_refs(cell: Column) -> Column:
    """Table numbers a cell refers to, as integers in order."""
    return F.transform(F.regexp_extract_all(cell, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))


def cell_times(cell: Column, first: Column, last: Column) -> Column:
    """Arrival and departure, in minutes, of a cell with one or two printed times.

    Two times are both; a single one is the departure, at the last stop the arrival; at the
    first stop an arrival is never given. ``flagged`` marks a second time at either end.
    """
    t = F.transform(F.regexp_extract_all(cell, F.lit(r"(\d{1,2}[.:]\d{2})"), F.lit(1)), clock.printed_clock)
    a, b = F.get(t, F.lit(0)), F.get(t, F.lit(1))
    two = b.isNotNull()
    return F.struct(
        F.when(~first, F.when(two | last, a)).alias("arr"), F.when(~last, F.coalesce(b, a)).alias("dep"), (two & (first | last)).alias("flagged")
    )


def assign_cells(numbers: list[str], values: list[str], allowed: dict[str, set[str]]) -> dict[str, str]:
    """Values of a shared cell given to train numbers: the only full assignment that is allowed, else single fits.

    Without a unique full assignment a number still gets a value that only it may have and
    that is its only one; other numbers get none.
    """
    ok = lambda n, v: v in allowed.get(n, set())
    if len(numbers) == len(values) <= 6:
        full = {p for p in permutations(values) if all(ok(n, v) for n, v in zip(numbers, p))}
        if len(full) == 1:
            return dict(zip(numbers, full.pop()))
    fits = {n: {v for v in values if ok(n, v)} for n in numbers}
    return {n: next(iter(f)) for n, f in fits.items() if len(f) == 1 and sum(f <= g for g in fits.values()) == 1}


def consistent_times(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Whether two segments print the same times at every station they share, and how many calls they share.

    Both sides have the keys, ``station_code``, ``arr`` and ``dep``. Two calls agree if the times
    of one are all among the other's and neither role has two different times. Every call of
    a station is held against every call there of the other segment.
    """
    x = a.select(*keys, "station_code", F.col("arr").alias("a1"), F.col("dep").alias("d1"))
    y = b.select(*keys, "station_code", F.col("arr").alias("a2"), F.col("dep").alias("d2"))
    p, q = F.array_compact(F.array("a1", "d1")), F.array_compact(F.array("a2", "d2"))
    inside = (F.size(F.array_except(p, q)) == 0) | (F.size(F.array_except(q, p)) == 0)
    differ = F.coalesce(F.col("a1") != F.col("a2"), F.lit(False)) | F.coalesce(F.col("d1") != F.col("d2"), F.lit(False))
    return x.join(y, [*keys, "station_code"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("shared"), F.bool_and(inside & ~differ).alias("consistent"))


OFFSETS = "train_number string, segment bigint, component bigint, offset int, clash boolean"


def segment_offsets(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Groups of a train's segments joined by time offsets, and each one's offset to the least of its group.

    ``segments``: ``train_number, segment``; ``links``: ``train_number, a, b, offset`` meaning
    that b's clock plus offset is a's. Offsets spread along the links breadth first; ``clash``
    marks groups in which another link disagrees. One train's segments are a bounded group.
    """
    rows = segments.select("train_number", F.col("segment").cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(0).alias("offset")).unionByName(
        links.select("train_number", F.col("a").cast("bigint"), F.col("b").cast("bigint"), F.col("offset").cast("int"))
    )

    def spread(train: str, group: list[dict]) -> list[tuple]:
        nodes = sorted({r[c] for r in group for c in ("a", "b") if r[c] is not None})
        near: dict[int, list[tuple[int, int]]] = {n: [] for n in nodes}
        for r in group:
            if r["b"] is not None:
                near[r["a"]].append((r["b"], r["offset"]))
                near[r["b"]].append((r["a"], -r["offset"]))
        at: dict[int, int] = {}
        out = []
        for root in nodes:
            if root in at:
                continue
            at[root], queue, clash = 0, [root], False
            for n in queue:
                for m, o in sorted(near[n]):
                    if m not in at:
                        at[m] = at[n] + o
                        queue.append(m)
                    elif at[m] != at[n] + o:
                        clash = True
            out += [(train, n, root, at[n], clash) for n in queue]
        return out

    return per_group(rows, "train_number", spread, OFFSETS)


def merged_events(events: DataFrame, key: str, place: str, gap: int = 360) -> DataFrame:
    """Calls of a route at a place from several segments made one call each.

    ``events``: key, place, ``name``, ``arr``, ``dep`` on a common clock. Times of a place more
    than ``gap`` minutes apart are different calls. Within a call an arrival or departure all
    reports agree on is kept, else it is null and ``unsure``; the name is the most frequent,
    the least of equals.
    """
    e = events.withColumn("at", F.coalesce("arr", "dep"))
    w = Window.partitionBy(key, place).orderBy("at")
    cut = F.coalesce((F.col("at") - F.lag("at").over(w) > gap).cast("int"), F.lit(0))
    e = e.withColumn("__cut", cut).withColumn("call", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__cut")
    names = e.where("name is not null").groupBy(key, place, "call", "name").agg(F.count(F.lit(1)).alias("c"))
    name = names.groupBy(key, place, "call").agg(F.min(F.struct((-F.col("c")).alias("c"), "name"))["name"].alias("name"))
    one = lambda c: F.when(F.count_distinct(c) == 1, F.max(c))
    calls = e.groupBy(key, place, "call").agg(
        one("arr").alias("arr"), one("dep").alias("dep"), ((F.count_distinct("arr") > 1) | (F.count_distinct("dep") > 1)).alias("unsure"), F.count(F.lit(1)).alias("reports")
    )
    return calls.join(name, [key, place, "call"], "left")


CHAINS = "train_number string, part bigint, chain bigint, place int"


def chain_parts(parts: DataFrame, gap: int = 720) -> DataFrame:
    """Parts of a train strung together where one's last stop and clock lead to exactly one other part.

    ``parts``: ``train_number, part, first_code, last_code, first_at, last_at``. A part follows
    another if it starts at the station where that one ends, within ``gap`` minutes on the
    clock, and neither has another such neighbour. Parts of a ring stay alone. One train's
    parts are a bounded group.
    """
    def chain(train: str, group: list[dict]) -> list[tuple]:
        rows = sorted(group, key=lambda r: r["part"])
        after: dict[int, list[int]] = {r["part"]: [] for r in rows}
        before: dict[int, list[int]] = {r["part"]: [] for r in rows}
        for a in rows:
            for b in rows:
                if a["part"] != b["part"] and a["last_code"] == b["first_code"] and (b["first_at"] - a["last_at"]) % clock.DAY <= gap:
                    after[a["part"]].append(b["part"])
                    before[b["part"]].append(a["part"])
        follow = {a: bs[0] for a, bs in after.items() if len(bs) == 1 and len(before[bs[0]]) == 1}
        led, out = set(follow.values()), []
        for r in rows:
            p, n, seen = r["part"], 0, set()
            if p in led:
                continue
            while p is not None and p not in seen:
                seen.add(p)
                out.append((train, p, r["part"], n))
                p, n = follow.get(p), n + 1
        done = {o[1] for o in out}
        return out + [(train, r["part"], r["part"], 0) for r in rows if r["part"] not in done]

    return per_group(parts.select("train_number", "part", "first_code", "last_code", "first_at", "last_at"), "train_number", chain, CHAINS)


def choose_by_detour(gaps: DataFrame, candidates: DataFrame, positions: DataFrame, support: DataFrame, margin_km: float = 10.0) -> DataFrame:
    """A code for each stop with several candidates: the least detour by a clear margin, else the best line support.

    ``gaps``: ``train_number, seq, name, before, after``; ``candidates``: ``name, code``;
    ``positions``: ``code, lat, lon``; ``support``: ``before, after, code, n``. Result:
    ``train_number, seq, code, how`` with how one of ``detour``, ``support``, ``open``.
    """
    def at(prefix: str, key: str) -> DataFrame:
        return positions.select(F.col("code").alias(key), F.col("lat").alias(f"{prefix}_lat"), F.col("lon").alias(f"{prefix}_lon"))

    d = gaps.join(candidates, "name").join(at("c", "code"), "code").join(at("b", "before"), "before").join(at("a", "after"), "after")
    c = F.col
    way = haversine_km(c("b_lat"), c("b_lon"), c("c_lat"), c("c_lon")) + haversine_km(c("c_lat"), c("c_lon"), c("a_lat"), c("a_lon")) - haversine_km(c("b_lat"), c("b_lon"), c("a_lat"), c("a_lon"))
    d = d.select("train_number", "seq", "before", "after", "code", way.alias("detour")).join(support, ["before", "after", "code"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    near = Window.partitionBy("train_number", "seq").orderBy("detour", "code")
    lines = Window.partitionBy("train_number", "seq").orderBy(F.desc("n"), "code")
    d = d.withColumns({"r": F.row_number().over(near), "next_detour": F.lead("detour").over(near), "l": F.row_number().over(lines), "next_n": F.lead("n").over(lines)})
    g = d.groupBy("train_number", "seq").agg(
        F.max(F.when(c("r") == 1, c("code"))).alias("nearest"), F.max(F.when(c("r") == 1, F.coalesce(c("next_detour") - c("detour"), F.lit(float("inf"))))).alias("lead"),
        F.max(F.when(c("l") == 1, c("code"))).alias("busiest"), F.max(F.when(c("l") == 1, c("n") - F.coalesce(c("next_n"), F.lit(0)))).alias("more"),
    )
    return g.select(
        "train_number", "seq", F.when(c("lead") >= margin_km, c("nearest")).when(c("more") > 0, c("busiest")).alias("code"),
        F.when(c("lead") >= margin_km, "detour").when(c("more") > 0, "support").otherwise("open").alias("how"),
    )


def pair_verdicts(pairs: DataFrame, near_km: float = 1.0, far_km: float = 5.0) -> DataFrame:
    """Whether two codes mean one station.

    ``pairs``: ``km`` (null if unknown), ``same_route`` (a shared slot with equal times) and
    ``duplicate`` (one list holds both at one place), ``live_a``, ``live_b`` (null unknown).
    Rejected: a status is unknown, both codes are in use, far apart, or not both near, with one
    code in use, and backed by a route or a duplicate. Otherwise accepted.
    """
    said = lambda c: F.coalesce(c, F.lit(False))
    one = F.col("live_a") != F.col("live_b")
    verdict = (
        F.when(F.col("live_a").isNull() | F.col("live_b").isNull(), "status unknown").when(F.col("live_a") & F.col("live_b"), "both in use")
        .when(said(F.col("km") > far_km), "far apart").when(said(one & (F.col("km") <= near_km)) & (said(F.col("same_route")) | said(F.col("duplicate"))), "accepted").otherwise("too little evidence")
    )
    return pairs.withColumn("reason", verdict).withColumn("verdict", F.when(F.col("reason") == "accepted", "accepted").otherwise("rejected"))
