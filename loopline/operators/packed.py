"""Splitting fields that pack several values under inconsistent delimiters and quoting.

Each run of letters and digits is masked by one sign, which leaves a delimiter skeleton whose
signs stand for the parts of the field one to one. Skeletons are counted, every distinct one
is resolved once into the places of its values, the most frequent are broadcast, and places
are applied as slices of the parts in the JVM. Fields with another skeleton are resolved where
they stand. Values whose content decides the split (runs of known codes, strings of seven
binary digits) are split after extraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopline.session import stage

#: The class codes that may stand unseparated.
CLASS_CODES = ["1A", "2A", "3A", "3E", "SL", "FC", "EC", "CC", "2S"]

ORDINARY = r"[\p{L}\p{N}]++"
PART = r"[\p{L}\p{N}]++|(?s:[^\p{L}\p{N}])"
MASK = "a"
PLACES = "array<struct<start:int,size:int,quoted:boolean>>"


def resolve(skeleton: str) -> list[tuple[int, int, bool]]:
    """(start from 1, length, quoted) of each value of a skeleton.

    A quote opens a value if the same quote closes it later, a doubled quote inside being
    one; a quote that never closes only separates. Empty quoted places give no value.
    """
    out, i, n = [], 0, len(skeleton)
    while i < n:
        c = skeleton[i]
        if c == MASK:
            j = i
            while j < n and skeleton[j] == MASK:
                j += 1
            out.append((i + 1, j - i, False))
            i = j
        elif c in "\"'":
            j = i + 1
            while j < n:
                if skeleton[j] == c:
                    if j + 1 < n and skeleton[j + 1] == c:
                        j += 2
                        continue
                    break
                j += 1
            if j < n:
                if skeleton[i + 1 : j].strip():
                    out.append((i + 2, j - i - 1, True))
                i = j + 1
            else:
                i += 1
        else:
            i += 1
    return out


def _resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, list[dict]] = {}
    for b in batches:
        for x in b["skeleton"].unique():
            if x not in known:
                if len(known) > 10_000:
                    known.clear()
                known[x] = [{"start": s, "size": k, "quoted": q} for s, k, q in resolve(x)]
        yield b.assign(places=[known[x] if x in known else [{"start": s, "size": k, "quoted": q} for s, k, q in resolve(x)] for x in b["skeleton"]])


def split_values(df: DataFrame, keys: list[str], raw: str, codes: list[str] = CLASS_CODES, most_rules: int = 10_000, longest_rule: int = 256) -> DataFrame:
    """One row per packed value: the keys, ``pos`` (int from 1) and ``val``.

    Null, empty and value-free fields give no row. Values keep their spelling and repeat as
    often as they stand. An unquoted value that is a run of ``codes`` or of seven binary
    digits gives each code or digit. ``keys`` should identify a field; other columns and
    their names play no part. The rules broadcast are those of the ``most_rules`` most
    frequent skeletons of up to ``longest_rule`` signs, so at most some 25 MB at the defaults;
    only where there are more do the other fields go through Python, row by row, with the
    same result and without a join.
    """
    base = df.select(*keys, F.col(raw).cast("string").alias("__raw")).where(F.col("__raw").isNotNull()).withColumn(
        "skeleton", F.regexp_replace("__raw", ORDINARY, MASK)
    )
    counted = stage(base.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n")), "skeletons")
    rules = counted.where(F.length("skeleton") <= longest_rule).orderBy(F.desc("n"), "skeleton").limit(most_rules).select("skeleton")
    rules = F.broadcast(stage(rules.mapInPandas(_resolved, f"skeleton string, places {PLACES}"), "rules"))
    placed = base.join(rules, "skeleton")
    if counted.count() > rules.count():
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
        rest = base.join(rules.select("skeleton"), "skeleton", "left_anti").select(*base.columns)
        placed = placed.unionByName(rest.mapInPandas(_resolved, f"{schema}, places {PLACES}"))
    run = "^(?:" + "|".join(codes) + ")+$"

    def values(p: Column) -> Column:
        text = F.array_join(F.slice("__parts", p["start"], p["size"]), "")
        quote = F.get("__parts", p["start"] - 2)
        return (
            F.when(p["quoted"], F.array(F.replace(text, F.concat(quote, quote), quote)))
            .when(text.rlike("^[01]{7}$"), F.regexp_extract_all(text, F.lit("[01]"), F.lit(0)))
            .when(text.rlike(run), F.regexp_extract_all(text, F.lit("|".join(codes)), F.lit(0)))
            .otherwise(F.array(text))
        )

    return (
        placed.withColumn("__parts", F.regexp_extract_all("__raw", F.lit(PART), F.lit(0)))
        .select(*keys, F.posexplode(F.flatten(F.transform("places", values))).alias("__p", "val"))
        .select(*keys, (F.col("__p") + 1).cast("int").alias("pos"), "val")
    )
