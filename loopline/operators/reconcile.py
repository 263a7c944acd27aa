"""Differences between two copies of a table, field by field.

Both sides are unpivoted to key-field-value rows, united with signed presence and grouped;
cells that cancel are equal. The first grouping combines on the map side, so keys repeated
many times on a side shrink before they move, and only what does not cancel is shuffled a
second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRESENT = "\x00present"


def cells(df: DataFrame, keys: dict[str, Column], fields: dict[str, Column], sign: int) -> DataFrame:
    """One row per key and field with the field's canonical text, and one for the key itself."""
    rows = [F.struct(F.lit(PRESENT).alias("field"), F.lit(None).cast("string").alias("value"))]
    rows += [F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()]
    return df.select(*[c.alias(k) for k, c in keys.items()], F.explode(F.array(*rows)).alias("cell")).select(
        *keys, "cell.field", "cell.value", F.lit(sign).alias("sign")
    )


def differences(
    main: DataFrame,
    mirror: DataFrame,
    keys: dict[str, tuple[Column, Column]],
    fields: dict[str, tuple[Column, Column]],
) -> DataFrame:
    """Rows missing on either side and fields whose values differ.

    ``keys`` and ``fields`` map an output name to the expression on either side; a field's
    expression gives its canonical form, so what counts as equal is the caller's choice.

    Result: the keys and ``field``, which is the field's name for a key on both sides with
    different values, ``missing_in_mirror`` or ``missing_in_main`` for a key on one side.
    Null equals null (also in keys) and differs from any value. Repeated rows count once; a
    key with several values on a side differs unless the other side has the same set of
    values. Two empty tables give no rows. Columns not named play no part.
    """
    both = cells(main, {k: a for k, (a, _) in keys.items()}, {k: a for k, (a, _) in fields.items()}, 1).unionByName(
        cells(mirror, {k: b for k, (_, b) in keys.items()}, {k: b for k, (_, b) in fields.items()}, -1)
    )
    names = list(keys)
    left = (
        both.groupBy(*names, "field", "value")
        .agg(F.max(F.when(F.col("sign") > 0, 1).otherwise(0)).alias("a"), F.max(F.when(F.col("sign") < 0, 1).otherwise(0)).alias("b"))
        .where("a <> b")
    )
    per_key = left.groupBy(*names).agg(
        F.max(F.when(F.col("field") == PRESENT, F.col("a") - F.col("b"))).alias("side"),
        F.collect_set(F.when(F.col("field") != PRESENT, F.col("field"))).alias("changed"),
    )
    return per_key.select(
        *names,
        F.explode(
            F.when(F.col("side") == 1, F.array(F.lit("missing_in_mirror")))
            .when(F.col("side") == -1, F.array(F.lit("missing_in_main")))
            .otherwise(F.col("changed"))
        ).alias("field"),
    )


def set_text(c: Column) -> Column:
    """A list as the text of its set of elements: order and repetition do not count."""
    return F.to_json(F.array_sort(F.array_distinct(c)))
