"""Mapping typed values to the entries of a reference list, misses reported.

A symmetric-delete dictionary of the reference names finds every entry within a bounded edit
distance of a typed base name by equality of deletion variants; the hits are ranked by
weighted Damerau-Levenshtein cost, then by how often the entry is used. Only distinct typed
values are read, and only distinct base names looked up, so a value typed a billion times
costs one lookup. Variants are made, hashed and joined by built-in functions; Python reads
the names and weighs the few inexact hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopline.llm.names import near, read_name
from loopline.session import stage

VOWELS = set("aeiou")


def deletes(base: Column, most: int) -> Column:
    """The base and every string made by deleting up to ``most`` of its letters, at least one letter being left."""
    def one(text: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))

    none = F.array().cast("array<string>")
    out = last = F.array(base)
    for k in range(1, most + 1):
        last = F.when(F.length(base) > k, F.array_distinct(F.flatten(F.transform(last, one)))).otherwise(none)
        out = F.concat(out, last)
    return F.array_distinct(out)


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """Hash-partitioned with a fixed number of tasks, as small rows that cost much time must not be coalesced by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def parsed(values: DataFrame, text: str) -> DataFrame:
    """``values`` with ``base``, ``qualifier`` and ``wide`` of a name column; unreadable names have an empty base."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = [read_name(t) for t in b[text]]
            yield b.assign(base=[n.base for n in names], qualifier=[n.qualifier for n in names], wide=[n.city_wide for n in names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema)
    return _spread(values, text).mapInPandas(run, f"{schema}, base string, qualifier string, wide boolean")


@lru_cache(maxsize=100_000)
def weighted_cost(a: str, b: str) -> float:
    """Damerau-Levenshtein cost where vowel slips (0.6) and transpositions (0.8) weigh less than 1."""
    before: list[float] = []
    last = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            swap = 0.0 if x == y else 0.6 if x in VOWELS and y in VOWELS else 1.0
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + swap)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 0.8)
            row.append(d)
        before, last = last, row
    return last[-1]


def _near(pairs: DataFrame, most: int) -> DataFrame:
    """``pairs`` of ``base`` and ``matched`` at most ``most`` edits apart, with ``edits`` and ``cost``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(edits=[near(x, y, most) for x, y in zip(b["base"], b["matched"])])
            b = b[b["edits"] <= most]
            yield b.assign(cost=[weighted_cost(x, y) for x, y in zip(b["base"], b["matched"])])

    # a transposition is one edit here and two to the built-in function
    pairs = pairs.where(F.levenshtein("base", "matched", 2 * most) >= 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return _spread(pairs, "base", "matched").mapInPandas(run, f"{schema}, edits int, cost double")


def lookup(typed: DataFrame, reference: DataFrame, most: int = 2, broadcast_bytes: int = 64_000_000) -> DataFrame:
    """Each distinct typed value with its entry, or nulls for a miss.

    ``typed`` has the string column ``typed``; ``reference`` has ``entry`` (bigint), ``name``
    and ``uses`` (bigint). Columns of the result: ``typed, base, qualifier, entry, matched,
    edits, cost``. Names that stand for all stations of a town are no entry and mean none. The
    dictionary is broadcast if its counted rows take at most ``broadcast_bytes``; beyond that
    the same join shuffles. Null, empty and unreadable values are misses; an empty reference
    makes all misses.
    """
    values = stage(parsed(typed.select("typed").distinct(), "typed"), "typed-values")
    sayable = (F.col("base") != "") & ~F.col("wide")
    names = reference.select("entry", "name", F.coalesce("uses", F.lit(0)).alias("uses")).where("name is not null and entry is not null")
    names = parsed(names, "name").where(sayable).groupBy(F.col("base").alias("matched"), "qualifier", "entry").agg(F.max("uses").alias("uses"))
    names = stage(names, "reference-names")
    rank = F.min(F.struct("cost", (-F.col("uses")).alias("unused"), "entry", "matched", "edits")).alias("top")

    wanted = values.where(sayable).select("base", "qualifier").distinct()
    # a base that stands in the list costs nothing, so nothing can be nearer: only the others need variants
    same = names.withColumn("base", F.col("matched")).withColumns({"edits": F.lit(0), "cost": F.lit(0.0)})
    exact = wanted.join(same, ["base", "qualifier"]).groupBy("base", "qualifier").agg(rank)
    key = F.xxhash64("variant", "qualifier").alias("key")
    dictionary = stage(names.withColumn("variant", F.explode(deletes(F.col("matched"), most))).select(key, F.col("qualifier").alias("q"), "matched", "entry", "uses"), "dictionary")
    size = dictionary.agg(F.count(F.lit(1)), F.sum(F.length("matched") + F.length("q"))).first()
    if 64 * size[0] + 4 * (size[1] or 0) <= broadcast_bytes:
        dictionary = F.broadcast(dictionary)
    tried = wanted.join(names.select(F.col("matched").alias("base"), "qualifier").distinct(), ["base", "qualifier"], "left_anti")
    tried = _spread(tried, "base", "qualifier").withColumn("variant", F.explode(deletes(F.col("base"), most))).select("base", "qualifier", key)
    pairs = tried.join(dictionary, "key").where("qualifier = q").select("base", "qualifier", "matched", "entry", "uses").distinct()
    inexact = _near(pairs, most).groupBy("base", "qualifier").agg(rank)
    hits = exact.unionByName(inexact).select(F.col("base").alias("b"), F.col("qualifier").alias("q"), "top.*")
    found = values.join(hits, (F.col("base") == F.col("b")) & (F.col("qualifier") == F.col("q")) & ~F.col("wide"), "left")
    return stage(found.select("typed", "base", "qualifier", "entry", "matched", "edits", "cost"), "found-names")


def without_rivals(found: DataFrame, rivals: DataFrame) -> DataFrame:
    """Undo inexact matches of values that lie closer to a known name outside the reference list.

    ``found`` is a result of :func:`lookup` with at most two edits; ``rivals`` has the column
    ``name``. A match with k edits is undone if a rival base other than the matched one lies
    within k - 1 edits. Both sides meet on deletion variants of one letter at most, in a
    shuffled join, so the rival list may be of any size.
    """
    doubtful = found.where("edits > 0").select("base", "matched", "edits").distinct()
    variant = lambda df, c: df.withColumn("variant", F.explode(deletes(F.col(c), 1)))
    r = parsed(rivals.select("name").where("name is not null").distinct(), "name").where("base <> '' and not wide").select(F.col("base").alias("rival")).distinct()
    close = variant(doubtful, "base").join(variant(r, "rival"), "variant").where("rival <> matched").select("base", F.col("matched").alias("taken"), F.col("edits").alias("slips"), F.col("rival").alias("matched")).distinct()
    lost = _near(close, 1).where("edits < slips").select(F.col("base").alias("b"), F.col("taken").alias("m")).distinct()
    gone = F.col("b").isNotNull()
    blank = [F.when(~gone, F.col(c)).alias(c) for c in ("entry", "matched", "edits", "cost")]
    return found.join(lost, (F.col("base") == F.col("b")) & (F.col("matched") == F.col("m")), "left").select("typed", "base", "qualifier", *blank)
