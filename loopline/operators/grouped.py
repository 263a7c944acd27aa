"""Python folds over small groups, many groups to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_group(df: DataFrame, key: str, fold: Callable[[object, list[dict]], list[tuple]], schema: str) -> DataFrame:
    """``fold(key, rows)`` of every group, its tuples as rows of ``schema``.

    For groups with a natural bound (one train's runs or parts). They are packed into arrays
    by a JVM aggregation and reach Python many to a batch, so the cost is the rows', not a
    call for each group. Rows come in no particular order; null is a group of its own.
    """
    columns = [c.split()[0] for c in schema.split(", ")]
    packed = df.groupBy(key).agg(F.collect_list(F.struct(*[c for c in df.columns if c != key])).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [t for k, rows in zip(b[key], b["rows"]) for t in fold(k, list(rows))]
            yield pd.DataFrame(out, columns=columns, dtype=object)

    return packed.mapInPandas(run, schema)
