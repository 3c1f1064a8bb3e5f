"""Sentiment tables: balances, extremes, frames, keywords, funnels. Every result has a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terralex.functions.text import listed, truthy

SENTIMENTS = ["negative", "neutral", "positive"]
#: Units that a region needs, by table.
MIN_UNITS, MIN_UNITS_PER_LANGUAGE, MIN_MENTIONS = 500, 98, 30


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def balances(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the three sentiments by keys, their shares, and positive less negative share."""
    n = {s: F.sum((F.col("sentiment") == s).cast("long")) for s in SENTIMENTS}
    out = df.where(F.col("sentiment").isin(SENTIMENTS)).groupBy(*keys).agg(n["negative"].alias("n_neg"), n["neutral"].alias("n_neu"), n["positive"].alias("n_pos"))
    out = out.withColumn("n_units", F.col("n_neg") + F.col("n_neu") + F.col("n_pos"))
    return out.withColumns({"pct_neg": share(F.col("n_neg"), F.col("n_units")), "pct_pos": share(F.col("n_pos"), F.col("n_units"))}).withColumn("balance", F.col("pct_pos") - F.col("pct_neg"))


def region_table(df: DataFrame, group: str, region: str, min_units: int = MIN_UNITS) -> DataFrame:
    """Balances of regions with enough units, and an average row per group over all its rows."""
    regions = balances(df.where(F.col(region).isNotNull()), [group, region]).where(F.col("n_units") >= min_units)
    average = balances(df, [group]).withColumn(region, F.lit("average"))
    return regions.withColumn("level", F.lit("region")).unionByName(average.withColumn("level", F.lit("country")))


def extremes(regions: DataFrame, keys: list[str], tail: int = 3) -> DataFrame:
    """The lowest balances, at most half of all regions, and the highest of the others; role and rank."""
    n = Window.partitionBy()
    low = Window.orderBy("balance", F.desc("n_units"), *keys)
    # a few thousand regions at most come this far: one task may order them
    ranked = regions.where("balance is not null").select(*keys, "balance", "n_units").withColumns({"lo": F.row_number().over(low), "n": F.count("*").over(n)})
    ranked = ranked.withColumn("role", F.when(F.col("lo") <= F.least(F.lit(tail), F.ceil(F.col("n") / 2)), "low"))
    high = Window.partitionBy(F.col("role").isNull()).orderBy(F.desc("balance"), F.desc("n_units"), *keys)
    ranked = ranked.withColumn("hi", F.row_number().over(high))
    out = ranked.withColumn("role", F.coalesce("role", F.when(F.col("hi") <= tail, "high"))).where("role is not null")
    return out.select(*keys, "balance", "n_units", "role", F.when(F.col("role") == "low", F.col("lo")).otherwise(F.col("hi")).cast("int").alias("rank"))


def extreme_pair(regions: DataFrame, keys: list[str]) -> DataFrame:
    """The region of the lowest balance and, among the others, that of the highest; none if there is no second."""
    pair = extremes(regions, keys, tail=1)
    return pair.withColumn("n", F.count("*").over(Window.partitionBy())).where("n = 2").drop("n", "rank")


def rows_of_extremes(df: DataFrame, chosen: DataFrame, keys: list[str], uid: str) -> DataFrame:
    """Rows of the chosen regions (those of `extremes`: six at most), each uid once in a region, with role and rank."""
    own = df.join(F.broadcast(chosen.select(*keys, "role", "rank")), keys)
    return own.dropDuplicates([*keys, uid])


def dense_balances(df: DataFrame, chosen: DataFrame, keys: list[str], item: str, items: list[str]) -> DataFrame:
    """Balances of each item in each chosen region, with counts of 0 and a null balance for absent items."""
    frame = chosen.select(*keys, F.explode(F.array(*(F.lit(i) for i in items))).alias(item))
    found = balances(df.join(F.broadcast(chosen.select(*keys)), keys, "left_semi"), [*keys, item])
    out = frame.join(found, [*keys, item], "left")
    return out.na.fill(0, ["n_neg", "n_neu", "n_pos", "n_units"])


def with_overall(df: DataFrame, item: str, rows: DataFrame, overall: str = "All sentences") -> DataFrame:
    """Balances of rows by item, and one row over all of df."""
    whole = balances(df.withColumn(item, F.lit(overall)), [item])
    return balances(rows, [item]).unionByName(whole)


def keyword_distribution(triples: DataFrame, keys: list[str]) -> DataFrame:
    """Sentiment counts side by side for each (frame, keyword), ordered by total, positive, neutral, negative; index from 1 in a frame."""
    wide = balances(triples, keys).select(*keys, "n_neg", "n_neu", "n_pos", F.col("n_units").alias("total"))
    w = Window.partitionBy(keys[0]).orderBy(F.desc("total"), F.desc("n_pos"), F.desc("n_neu"), F.desc("n_neg"), *keys[1:])
    return wide.withColumn("index", F.row_number().over(w))


def polar_items(df: DataFrame, item: str, least: int = MIN_MENTIONS, tail: int = 15) -> DataFrame:
    """Of items with enough mentions, those of the highest and of the lowest balance; an item may be in both lists."""
    found = balances(df, [item]).where(F.col("n_units") >= least)
    ends = [("top", F.desc("balance")), ("bottom", F.col("balance"))]
    top, bottom = (top_per_group(found, [], [order, F.desc("n_units"), item], tail).withColumn("end", F.lit(end)) for end, order in ends)
    return top.unionByName(bottom)


def units_per_document(df: DataFrame, document: str) -> DataFrame:
    """Documents, units, mean units of a document, and the share of documents with several."""
    n = df.groupBy(document).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_units"), F.avg("n").alias("mean_units"), share(F.count(F.when(F.col("n") > 1, 1)), F.count("*")).alias("pct_multiple"))


def mentions(df: DataFrame, keys: list[str], listed: str, item: str = "frame") -> DataFrame:
    """One row for each item of an array column; rows without items go."""
    return df.select("*", F.explode(listed).alias(item)).groupBy(*keys, item).agg(F.count("*").alias("mentions"))


def dense_shares(counts: DataFrame, group: str, item: str, items: list[str]) -> DataFrame:
    """Shares of each item in each group, with rows of none for absent items; shares of a group add up to 100, or are 0.

    One aggregation by group with a sum for each item, so counts are computed once.
    """
    sums = [F.sum(F.when(F.col(item) == i, F.col("mentions")).otherwise(0)).cast("long").alias(f"_{n}") for n, i in enumerate(items)]
    rows = counts.groupBy(group).agg(*sums)
    total = reduce(lambda a, b: a + b, (F.col(f"_{n}") for n in range(len(items))))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias(item), F.col(f"_{n}").alias("mentions")) for n, i in enumerate(items))))
    out = rows.select(group, total.alias("_t"), each.alias("_e")).select(group, "_e.*", "_t")
    return out.withColumn("share", F.coalesce(share(F.col("mentions"), F.col("_t")), F.lit(0.0))).drop("_t")


def top_per_group(df: DataFrame, groups: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group, numbered by rank; order must be total."""
    w = Window.partitionBy(*groups).orderBy(*order) if groups else Window.orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_per_group(df, keys, order, 1).drop("rank")


def funnel(steps: dict[str, DataFrame], document: str, group: str) -> DataFrame:
    """Rows and distinct documents of each step by group."""
    out = None
    for i, (name, df) in enumerate(steps.items()):
        one = df.groupBy(group).agg(F.count("*").alias("n_rows"), F.countDistinct(document).alias("n_documents")).select(F.lit(i + 1).alias("step"), F.lit(name).alias("name"), group, "n_rows", "n_documents")
        out = one if out is None else out.unionByName(one)
    return out


def unmatched_report(df: DataFrame, key: str, value: str, text: str, top: int = 3) -> DataFrame:
    """For each key: rows, its most frequent value, the most frequent ones joined, the first texts by order."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v")))), 1, top).alias("b"), F.sum("n").alias("n"))
    texts = top_per_group(df.select(key, F.substring(text, 1, 180).alias("t")).distinct(), [key], ["t"], top).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), " || ").alias("examples"))
    return best.select(key, "n", F.element_at("b", 1)["v"].alias("mode"), F.array_join(F.transform("b", lambda x: x["v"]), "; ").alias("modes")).join(texts, key)


def smoothed(df: DataFrame, time: str, value: str, width: int = 10) -> DataFrame:
    """Centred rolling mean over width rows; null where the window isn't full."""
    w = Window.orderBy(time).rowsBetween(-(width // 2), width - width // 2 - 1)
    return df.withColumn("smooth", F.when(F.count("*").over(w) == width, F.avg(value).over(w)))


def scored_areas(areas: DataFrame, scores: DataFrame, key: str, min_units: int = MIN_UNITS) -> DataFrame:
    """Every area with its units and balance, 0 where it has none, and whether its units are enough to show."""
    out = areas.join(scores.select(key, "n_units", "balance"), key, "left").na.fill(0, ["n_units", "balance"])
    return out.withColumn("has_enough_data", F.col("n_units") >= min_units)


def first_wins(parts: list[DataFrame], keys: list[str], order: list) -> DataFrame:
    """Rows of all parts by name, one for each key: of the earliest part, there the first by order."""
    out = None
    for i, part in enumerate(parts):
        one = part.withColumn("part", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return keep_first(out, keys, ["part", *order]).drop("part")


def document_table(df: DataFrame, region: str, document: str, overall: str = "All") -> DataFrame:
    """Units, distinct documents and units per document of each region, numbered with the row over all first."""
    n = [F.count("*").alias("n_units"), F.countDistinct(document).alias("n_documents")]
    rows = df.where(F.col(region).isNotNull()).groupBy(region).agg(*n).withColumn("is_region", F.lit(1))
    rows = rows.unionByName(df.agg(*n).select(F.lit(overall).alias(region), "n_units", "n_documents", F.lit(0).alias("is_region")))
    rows = rows.withColumn("units_per_document", F.try_divide(F.col("n_units"), F.col("n_documents")))
    return rows.withColumn("position", F.row_number().over(Window.orderBy("is_region", F.desc("n_units"), region))).drop("is_region")  # a row per region


def unwrapped(df: DataFrame, keys: list[str], value: str, several: str) -> DataFrame:
    """Per key the one value it has, `several` if there are more, null if there is none; sets are never gathered."""
    low, high = F.min(value), F.max(value)
    return df.groupBy(*keys).agg(F.when(low == high, low).when(low < high, F.lit(several)).alias(value))


def merged_vocabulary(vocabulary: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A vocabulary (category, keyword) with the keywords of accepted reviews, and the audit of each (row, category, keyword, status).

    reviews: row (order), include, categories and keywords joined by semicolons. Categories keep their spelling, keywords are
    compared without regard to case: of those that several rows add, the first does. A new category is reported by its first row.
    """
    asked = reviews.where(truthy(F.col("include"))).select("row", F.posexplode(listed(F.col("categories"))).alias("c", "category"), listed(F.col("keywords")).alias("ks"))
    have = vocabulary.select("category", F.lower("keyword").alias("norm")).distinct()
    fresh = asked.join(vocabulary.select("category").distinct(), "category", "left_anti")
    created = fresh.groupBy("category").agg(F.min("row").alias("row")).select("row", "category", F.lit(None).cast("string").alias("keyword"), F.lit("created_category").alias("status"))
    words = asked.select("row", "c", "category", F.posexplode("ks").alias("k", "keyword")).withColumn("norm", F.lower("keyword"))
    first = Window.partitionBy("category", "norm").orderBy("row", "c", "k")
    words = words.withColumn("_n", F.row_number().over(first)).join(have.withColumn("_old", F.lit(True)), ["category", "norm"], "left")
    said = words.withColumn("status", F.when(F.col("_old") | (F.col("_n") > 1), "already_present").otherwise("added_keyword"))
    added = said.where("status = 'added_keyword'").select("category", "keyword")
    return vocabulary.select("category", "keyword").union(added), created.union(said.select("row", "category", "keyword", "status"))


def wide_scores(df: DataFrame, key: str, model: str, value: str, models: list[str]) -> DataFrame:
    """A row for each key with a column for each model, from one pass over long rows; of several values the greatest."""
    return df.groupBy(key).agg(*(F.max(F.when(F.col(model) == m, F.col(value))).alias(m) for m in models))


def mapped_points(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Rows whose coordinates are numbers, with these as numbers."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in (lon, lat)}).where(F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(lon) & ~F.isnan(lat))


def markdown_report(df: DataFrame, group: str, order: str, line: Column, most: int = 5) -> DataFrame:
    """group, report: a heading and the first lines of each group."""
    n = Window.partitionBy(group).orderBy(order)
    lines = df.select(group, F.row_number().over(n).alias("n"), line.alias("line")).where(F.col("n") <= most)
    listed_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n")
    return lines.groupBy(group).agg(listed_.alias("l")).select(group, F.concat(F.lit("## "), F.col(group), F.lit("\n\n"), F.col("l")).alias("report"))


#: Rank of a row's geometry by its layer.
LAYERS = {"polygons": 0, "points": 1}


def one_geometry(df: DataFrame, key: str, layer: str, order: str, matched: Column | None = None) -> DataFrame:
    """One row for each key: that of the best layer (polygons, points, others), then the first in order; only matched ones if asked."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LAYERS.items() for x in kv)), F.col(layer)), F.lit(99))
    rows = df if matched is None else df.where(matched)
    others = [c for c in df.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(rank, F.col(order))).alias("m")).select(key, "m.*")


def assignment_audit(points: DataFrame, inside: DataFrame, point: str) -> DataFrame:
    """kind, n: how many points came in, lie in an area, lie in none."""
    both = points.select(point).distinct().join(inside.select(point).distinct().withColumn("_in", F.lit(True)), point, "left")
    n = both.agg(F.count("*").alias("input"), F.count("_in").alias("assigned"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("n")) for k, v in (("input", F.col("input")), ("assigned", F.col("assigned")), ("unassigned", F.col("input") - F.col("assigned")))))
    return n.select(F.explode(kinds).alias("k")).select("k.*")


def extreme_matrix(rows: DataFrame, pair: DataFrame, keys: list[str], item: str, items: list[str]) -> DataFrame:
    """item, position, low, high and their shares: how often the rows of the two extreme regions (pair: keys, role) hold each item, in the order given."""
    sums = [F.sum(F.when((F.col(item) == i) & (F.col("role") == r), 1).otherwise(0)).cast("long").alias(f"_{r}{n}") for n, i in enumerate(items) for r in ("low", "high")]
    one = rows.join(pair.select(*keys, "role"), keys).agg(*sums)
    total = {r: reduce(lambda a, b: a + b, (F.coalesce(f"_{r}{n}", F.lit(0)) for n in range(len(items)))) for r in ("low", "high")}
    cells = [F.struct(F.lit(i).alias(item), F.lit(n + 1).alias("position"), *(x for r in ("low", "high") for x in (F.coalesce(f"_{r}{n}", F.lit(0)).alias(r), F.coalesce(share(F.col(f"_{r}{n}"), total[r]), F.lit(0.0)).alias(f"{r}_share")))) for n, i in enumerate(items)]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def map_scores(df: DataFrame, code: str, name: str) -> DataFrame:
    """area, n_units, balance by a region's code, or its name where it has none; a missing balance is 0."""
    area = F.coalesce(F.nullif(F.trim(F.col(code)), F.lit("")), F.col(name))
    out = balances(df.withColumn("area", area).where("area is not null"), ["area"])
    return out.select("area", "n_units", F.coalesce("balance", F.lit(0.0)).alias("balance"))


def stacked(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """metric, value: global figures one below the other, as text."""
    one = df.agg(*(c.cast("string").alias(f"_{i}") for i, c in enumerate(metrics.values())))
    return one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"_{i}").alias("value")) for i, m in enumerate(metrics)))).alias("m")).select("m.*")


def document_key(df: DataFrame, candidates: list[str], parts: list[str]) -> Column:
    """A document's key: the first of the columns that rows have, else the parts that they have, joined."""
    for c in candidates:
        if c in df.columns:
            return F.col(c).cast("string")
    return F.concat_ws("||", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts if c in df.columns))


def tracked(df: DataFrame, key: Column, group: str, groups: list[str], steps: dict[str, Column]) -> DataFrame:
    """step, name, and rows and distinct documents of each group in columns of its own.

    steps: how many rows a row of df stands for at each step. All steps are counted in one pass: by document, then by group.
    """
    weights = [w.cast("long").alias(f"_{i}") for i, w in enumerate(steps.values())]
    per = df.select(group, key.alias("_key"), *weights).groupBy(group, "_key").agg(*(F.sum(f"_{i}").alias(f"_{i}") for i in range(len(steps))))
    of = lambda g, c: F.sum(F.when(F.col(group) == g, c).otherwise(0)).cast("long")
    sums = [x for i in range(len(steps)) for g in groups for x in (of(g, F.col(f"_{i}")).alias(f"_{i}_{g}_r"), of(g, (F.col(f"_{i}") > 0).cast("int")).alias(f"_{i}_{g}_d"))]
    cells = [F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("name"), *(F.coalesce(f"_{i}_{g}_{k}", F.lit(0)).alias(f"{g}_{n}") for g in groups for k, n in (("r", "rows"), ("d", "documents")))) for i, name in enumerate(steps)]
    return per.agg(*sums).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def ranked_wide(ranked: DataFrame, groups: list[str], value: str, k: int) -> DataFrame:
    """A row for each group with the values of ranks 1 to k in columns first to last."""
    return ranked.groupBy(*groups).agg(*(F.max(F.when(F.col("rank") == i, F.col(value))).alias(f"rank_{i}") for i in range(1, k + 1)))


def keywords_wide(hits: DataFrame, group: str, keyword: str, unit: str, k: int = 10) -> DataFrame:
    """A row for each group with its k most frequent keywords, each with its share of the group's units."""
    n = hits.groupBy(group, keyword).agg(F.countDistinct(unit).alias("n"))
    total = hits.groupBy(group).agg(F.countDistinct(unit).alias("total"))
    top = top_per_group(n, [group], [F.desc("n"), keyword], k).join(total, group)
    label = F.concat(F.col(keyword), F.lit(" ("), F.format_string("%.1f", F.round(share(F.col("n"), F.col("total")), 1)), F.lit("%)"))
    return ranked_wide(top.withColumn("label", label), [group], "label", k)


def monthly(df: DataFrame, month: str, value: str) -> DataFrame:
    """month, total, its share of all in percent, the share smoothed over ten months, and the year's total. One row for each month of df."""
    out = df.withColumn("pct", share(F.col(value), F.sum(value).over(Window.partitionBy())))
    out = smoothed(out, month, "pct")
    return out.withColumn("year_total", F.sum(value).over(Window.partitionBy(F.substring(month, 1, 4))))


def outliers(df: DataFrame, key: str, value: str, least: float = 20.0, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """n, mean, median, p90, p95, p99, longest, threshold (the 99th percentile, `least` at least); and the k rows of the greatest values."""
    p = lambda q: F.percentile(value, q)
    stats = df.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max(value).alias("longest"))
    return stats.withColumn("threshold", F.greatest(F.lit(least), F.col("p99"))), df.orderBy(F.desc_nulls_last(value), key).limit(k)
