"""All pairs of points within a distance, by overlapping latitude strips and a local sweep.

Strips are cut at quantiles of the latitude, never thinner than the radius, and a strip that
holds too many locations is cut into tiles by longitude, never narrower than a few radii. So
a location is copied into one strip and one tile beside its own at most, however dense the
points. Each tile is sorted by latitude and swept with an active set ordered by longitude, and
the tile of the lower location owns a pair, so no pair is seen twice. Rows at one place are
one location while sweeping and come back by a join, so a place holding a large share of all
rows costs the sweep one entry.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from math import asin, cos, degrees, radians, sin, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopline.session import stage

EARTH_KM = 6371.0


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in kilometres; null if any coordinate is null."""
    h = F.pow(F.sin((F.radians(lat_b) - F.radians(lat_a)) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(
        F.sin((F.radians(lon_b) - F.radians(lon_a)) / 2), 2
    )
    return F.when(h.isNotNull(), 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def _km(lat_a: float, lon_a: float, lat_b: float, lon_b: float) -> float:
    h = sin((radians(lat_b) - radians(lat_a)) / 2) ** 2 + cos(radians(lat_a)) * cos(radians(lat_b)) * sin((radians(lon_b) - radians(lon_a)) / 2) ** 2
    return 2 * EARTH_KM * asin(min(1.0, sqrt(h)))


def sweep(lat: np.ndarray, lon: np.ndarray, owned: np.ndarray, km: float) -> Iterator[tuple[int, int]]:
    """Index pairs (lower, upper) within ``km``, the lower one owned; input in order of latitude.

    The active set holds the locations at most ``km`` south of the current one, in order of
    longitude, so only those inside the longitude reach are measured.
    """
    reach = degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-12
    active: list[tuple[float, int]] = []
    oldest = 0
    for i in range(len(lat)):
        y, x = lat[i], lon[i]
        while oldest < i and lat[oldest] < y - reach:
            if owned[oldest]:
                del active[bisect_left(active, (lon[oldest], oldest))]
            oldest += 1
        wide = reach / max(1e-6, cos(radians(min(89.9, abs(y) + reach)))) * (1 + 1e-6)
        for k in range(bisect_left(active, (x - wide, -1)), bisect_right(active, (x + wide, len(lat)))):
            j = active[k][1]
            if _km(lat[j], lon[j], y, x) <= km:
                yield j, i
        if owned[i]:
            insort(active, (x, i))


def pairs_within(points: DataFrame, id_col: str, lat: str, lon: str, km: float, per_tile: int = 5000) -> DataFrame:
    """Pairs of different rows at most ``km`` apart, each once with the smaller id first.

    Result: ``<id>_a``, ``<id>_b``, ``distance_km``. Rows with a null or non-finite position, or
    one off the globe, are no points; rows at one place pair with each other at distance 0;
    repeated ids are one row. Pairs across the 180th meridian are found. ``per_tile`` is the
    intended number of locations in a tile and sets only the work's granularity.
    """
    a, b = f"{id_col}_a", f"{id_col}_b"
    rows = points.select(F.col(id_col).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).where(
        "id is not null and lat between -90 and 90 and lon between -180 and 180"
    )
    rows = stage(rows.distinct(), "points")
    spots = stage(rows.select("lat", "lon").distinct(), "spots")
    reach = degrees(km / EARTH_KM) * 1.0001 + 1e-9
    n = spots.count()
    strips = min(max(1, -(-n // per_tile)), 10_000)
    cuts: list[float] = []
    for cut in sorted(spots.approxQuantile("lat", [i / strips for i in range(1, strips)], 0.2 / strips)) if strips > 1 else []:
        if not cuts or cut - cuts[-1] >= reach:
            cuts.append(cut)

    @F.pandas_udf("array<struct<strip:int,own:boolean,cell:double>>")
    def strips_of(y: pd.Series) -> pd.Series:
        """The strips a location is in, its own first, with the width of their cells: four times the reach where it is widest."""
        y = y.to_numpy()
        first, last = np.searchsorted(cuts, y - reach, side="right"), np.searchsorted(cuts, y, side="right")
        edge = np.maximum(np.abs(np.array([-90.0, *cuts])), np.abs(np.array([*cuts, 90.0]))) + reach
        # the outermost strips reach as far as their points do, so their cells go by the points' own bounds
        edge = np.minimum(edge, bound + reach)
        cell = 4 * reach / np.maximum(1e-6, np.cos(np.radians(np.minimum(89.9, edge)))) * (1 + 1e-6)
        return pd.Series([[(int(s), s == l, float(cell[s])) for s in range(l, f - 1, -1)] for f, l in zip(first, last)])

    bound = spots.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    copies = spots.select("lat", "lon", F.explode(strips_of("lat")).alias("s")).select("lat", "lon", "s.strip", "s.own", "s.cell")
    copies = stage(copies.withColumn("at", F.floor((F.col("lon") + 180) / F.col("cell"))), "copies")
    # tiles are runs of whole cells that hold about per_tile locations
    upto = Window.partitionBy("strip").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    held = copies.where("own").groupBy("strip", "at").agg(F.count(F.lit(1)).alias("c"))
    tiles = held.select("strip", "at", F.floor(F.coalesce(F.sum("c").over(upto), F.lit(0)) / per_tile).alias("tile"))
    # a copy is needed in every cell its reach touches; around the meridian it goes once more by 360 degrees
    wide = F.col("cell") / 4
    turned = F.filter(F.array(F.lit(0.0), F.when(F.col("lon") + 180 < wide, 360.0), F.when(180 - F.col("lon") < wide, -360.0)), lambda t: t.isNotNull())
    seen = copies.select("lat", "lon", "strip", "own", "cell", "at", F.explode(turned).alias("turn")).withColumn("x", F.col("lon") + F.col("turn"))
    touched = F.array_distinct(F.transform(F.array(-wide, F.lit(0.0), wide), lambda o: F.floor((F.col("x") + o + 180) / F.col("cell"))))
    seen = seen.select("lat", "lon", "strip", "x", (F.col("own") & (F.col("turn") == 0)).alias("own"), F.col("at").alias("home"), F.explode(touched).alias("at"))
    placed = seen.join(tiles, ["strip", "at"]).groupBy("lat", "lon", "strip", "tile", "x").agg(F.bool_or(F.col("own") & (F.col("at") == F.col("home"))).alias("own"))

    def local(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["lat", "x"], kind="stable")
        y, x, true = part["lat"].to_numpy(), part["x"].to_numpy(), part["lon"].to_numpy()
        found = list(sweep(y.tolist(), x.tolist(), part["own"].to_numpy().tolist(), km))
        j, i = (np.array(v, dtype=int) for v in (zip(*found) if found else ((), ())))
        return pd.DataFrame({"lat_a": y[j], "lon_a": true[j], "lat_b": y[i], "lon_b": true[i]})

    near = placed.groupBy("strip", "tile").applyInPandas(local, "lat_a double, lon_a double, lat_b double, lon_b double")
    ra = rows.select(F.col("id").alias("i"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    rb = rows.select(F.col("id").alias("j"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    apart = near.join(ra, ["lat_a", "lon_a"]).join(rb, ["lat_b", "lon_b"]).select(
        "i", "j", haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("distance_km")
    )
    together = (
        ra.join(rb, (F.col("lat_a") == F.col("lat_b")) & (F.col("lon_a") == F.col("lon_b")) & (F.col("i") < F.col("j")))
        .select("i", "j", F.lit(0.0).alias("distance_km"))
    )
    return apart.unionByName(together).select(F.least("i", "j").alias(a), F.greatest("i", "j").alias(b), "distance_km").where(F.col(a) != F.col(b))
