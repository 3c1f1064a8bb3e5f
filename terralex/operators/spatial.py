"""Joins of points to areas, and the cascade of name lookups."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terralex.functions.geo import Ring
from terralex.functions.geo import edges as edges_of
from terralex.functions.text import normal_key, or_empty

#: Rank of a gazetteer entry by feature code, then by class.
FEATURE_CODES = {"PPLC": 0, "PPLA": 1, "PPLA2": 2, "PPLA3": 3, "PPLA4": 4, "PPL": 5, "PPLX": 6}
FEATURE_CLASSES = {"P": 10, "A": 20, "S": 30, "T": 40, "H": 50, "L": 60}


def edge_table(spark: SparkSession, areas: dict[str, list[Ring]], cell: float = 1.0) -> DataFrame:
    """Edges of areas (area, x1, y1, x2, y2), once for each row of grid cells left of them, so that a ray to the right meets them.

    The number of rows follows the boundaries' lengths in cells, not the points; they are made where they are used.
    """
    edges = [(area, *map(float, e), float(min(x for r in rings for x, _ in r))) for area, rings in areas.items() for e in edges_of(rings)]
    rows = spark.createDataFrame(edges, "area string, x1 double, y1 double, x2 double, y2 double, low double")
    at = lambda c: F.floor(c / F.lit(cell))
    rows = rows.withColumn("cy", F.explode(F.sequence(at(F.least("y1", "y2")), at(F.greatest("y1", "y2")))))
    return rows.withColumn("cx", F.explode(F.sequence(at(F.col("low")), at(F.greatest("x1", "x2"))))).drop("low")


def points_in_areas(points: DataFrame, edges: DataFrame, cell: float = 1.0) -> DataFrame:
    """point, area for each area that holds a point (columns point, x, y): an equi-join on grid cells, parity of crossings as residual.

    A point on a boundary lies in no area.
    """
    at = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    crossing = F.when((y1 > y) != (y2 > y), x < (x2 - x1) * (y - y1) / (y2 - y1) + x1).otherwise(False)
    on = ((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    met = at.join(edges, ["cx", "cy"]).withColumns({"_c": crossing, "_on": on}).where("_c or _on")
    return met.groupBy("point", "area").agg(F.count_if("_c").alias("n"), F.max("_on").alias("edge")).where("n % 2 = 1 and not edge").select("point", "area")


def gazetteer_names(places: DataFrame) -> DataFrame:
    """One best place for each normalised name. places: place_id, name, asciiname (or none), alternates (comma list), feature_class, feature_code, population, lat, lon."""
    code, cls = (F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) for m in (FEATURE_CODES, FEATURE_CLASSES))
    rank = F.coalesce(F.try_element_at(code, F.col("feature_code")), F.try_element_at(cls, F.col("feature_class")), F.lit(99))
    names = F.array_distinct(F.concat(F.array("name", *([F.coalesce("asciiname", F.lit(""))] if "asciiname" in places.columns else [])), F.filter(F.split(or_empty(F.col("alternates")), ","), lambda x: x != "")))
    rows = places.withColumns({"key": F.explode(names), "priority": rank}).withColumn("key", normal_key(F.col("key"))).where("key <> ''")
    best = Window.partitionBy("key").orderBy("priority", F.col("population").desc_nulls_last(), "place_id")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def first_match(df: DataFrame, key: str, dims: list[tuple[str, DataFrame, str, list[str]]]) -> DataFrame:
    """Looks a key up in dimensions in order; the first that holds it gives the payload and match_source.

    dims: (label, dimension, its key column, payload columns). Dimensions have unique keys after the first
    row of each, in order of all their payload columns. All are joined in one pass, not one after another.
    """
    payload = dims[0][3]
    found: list[tuple[str, str]] = []
    for i, (label, dim, dim_key, columns) in enumerate(dims):
        once = dim.groupBy(F.col(dim_key).alias(key)).agg(F.min(F.struct(*columns)).alias(f"_m{i}"))
        df = df.join(once, key, "left")
        found.append((label, f"_m{i}"))
    source: Column = F.lit(None).cast("string")
    hit: Column = F.lit(None)
    for label, c in reversed(found):
        source = F.when(F.col(c).isNotNull(), F.lit(label)).otherwise(source)
    hit = F.coalesce(*(F.col(c) for _, c in found))
    df = df.withColumns({"match_source": source, "_hit": hit})
    return df.withColumns({p: F.col("_hit")[p] for p in payload}).drop("_hit", *(c for _, c in found))


def search_places(places: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Places whose names equal, begin with or hold the query, best first. places: place_id, name, priority, population."""
    q = normal_key(F.lit(query))
    name = normal_key(F.col("name"))
    rank = F.when(name == q, 0).when(name.startswith(q), 1).when(name.contains(q), 2)
    best = places.withColumn("rank", rank).where("rank is not null").groupBy("place_id").agg(F.min(F.struct("rank", "priority", (-F.col("population")).alias("p"), "name")).alias("m"))
    return best.select("place_id", "m.name", F.col("m.rank").alias("rank"), F.col("m.priority").alias("priority"), (-F.col("m.p")).alias("population")).orderBy("rank", "priority", F.desc("population"), "name", "place_id").limit(limit)


def fuzzy_suggestions(names: DataFrame, candidates: DataFrame, top: int = 3, cutoff: float = 0.78) -> DataFrame:
    """name, suggestion, score, rank: the closest of the candidates by difflib's ratio, a name itself not counted.

    Of s letters in both names, a ratio of at least `cutoff` leaves at most (1 - cutoff) s unmatched, so the
    cutoff s / 2 matched ones lie in at most (1 - cutoff) s + 1 runs: if they are more than the runs, one run
    has two letters. Names meet candidates that share a two-letter run, and where s may be too small for
    that, those that share a letter. Blocks are equi-joins, so no pair is made that shares nothing.
    """
    surplus = 1.5 * cutoff - 1
    short = 1 / surplus if surplus > 0 else math.inf  # from more letters in both on, a two-letter run is sure

    def keys(c: Column) -> Column:
        runs = lambda k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        letters = F.lit(True) if math.isinf(short) else F.length(c) <= short
        return F.array_distinct(F.concat(runs(2), F.when(letters, runs(1)).otherwise(F.array().cast("array<string>"))))

    a = names.select("name").distinct().withColumn("g", F.explode(keys(F.col("name"))))
    b = candidates.select(F.col("name").alias("suggestion")).distinct().withColumn("g", F.explode(keys(F.col("suggestion"))))
    close = 2 * F.least(F.length("name"), F.length("suggestion")) >= cutoff * (F.length("name") + F.length("suggestion")) - 1e-9
    pairs = a.join(b, "g").where(close & (F.col("name") != F.col("suggestion"))).select("name", "suggestion").distinct()

    def ratio(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            matchers = (difflib.SequenceMatcher(None, s, n) for n, s in zip(f["name"], f["suggestion"], strict=True))
            f["score"] = [m.ratio() if m.quick_ratio() >= cutoff else 0.0 for m in matchers]
            yield f[f["score"] >= cutoff]

    scored = pairs.mapInPandas(ratio, "name string, suggestion string, score double")
    order = Window.partitionBy("name").orderBy(F.desc("score"), "suggestion")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
