"""From a place's name to a point and a region: who needs one, external points, overrides, gazetteer, remembered answers, regions.

Rows carry loc (the first candidate of an answer), granularity, country_assignment, location, and the columns of PLACED,
which the steps fill in turn; a step leaves rows alone that have a place already.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex.functions.text import normal_key, or_empty
from terralex.operators.countries import NOTHING, country_candidates, country_name, country_of_id, first_candidate, scope_of
from terralex.operators.spatial import points_in_areas

#: What a place consists of.
PLACED = {"geo_level": "string", "geo_source": "string", "geo_match_type": "string", "geo_name": "string", "lat": "double", "lon": "double", "polygon": "string", "country_id": "string", "region_id": "string", "region_name": "string"}
#: Places outside all regions, by name.
EXTERNAL = {
    "kenia": ("Kenya", -0.0236, 37.9062),
    "kenya": ("Kenya", -0.0236, 37.9062),
    "calefornia": ("California, United States", 36.7783, -119.4179),
    "california": ("California, United States", 36.7783, -119.4179),
    "californie": ("California, United States", 36.7783, -119.4179),
    "curacao": ("Curaçao", 12.1696, -68.9900),
}
UNRESOLVED = "unresolved"


def unplaced(df: DataFrame) -> DataFrame:
    """Rows with empty columns for their place."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in PLACED.items() if c not in df.columns})


def useful(granularity: Column, assignment: Column, location: Column) -> Column:
    """Whether an answer is fine enough to be placed: of a level below country, and not of several countries."""
    level = F.lower(F.trim(or_empty(granularity)))
    return ~level.isin("", "none", "country") & (F.trim(or_empty(assignment)) != "multiple_countries") & (F.size(country_candidates(location)) <= 1)


def has_geometry() -> Column:
    return F.col("lat").isNotNull() | F.col("polygon").isNotNull()


def ignored() -> Column:
    return F.lower(or_empty(F.col("geo_match_type"))) == "ignored_location"


def unmatched() -> Column:
    """Whether a row still needs a place."""
    return (F.trim(or_empty(F.col("loc"))) != "") & useful(F.col("granularity"), F.col("country_assignment"), F.col("location")) & ~has_geometry() & ~ignored()


def skips_geocoding(location: Column, assignment: Column, scope: list[str] | None = None) -> Column:
    """Whether an answer names nothing, or several countries."""
    nothing = normal_key(first_candidate(location)).isin("", "none", "nan", "null")
    return nothing | (F.trim(or_empty(assignment)) == "multiple_countries") | (F.size(country_candidates(location, scope)) > 1)


def placed(df: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """Puts values into the rows that a condition holds for; the condition is taken before anything changes."""
    df = df.withColumn("_when", F.coalesce(when, F.lit(False)))
    return df.withColumns({c: F.when(F.col("_when"), v).otherwise(F.col(c)) for c, v in values.items()}).drop("_when")


def external_points(df: DataFrame) -> DataFrame:
    """Places outside all regions come first, whatever a row had before; it loses its polygon."""
    known = F.create_map(*(x for k, (name, lat, lon) in EXTERNAL.items() for x in (F.lit(k), F.struct(F.lit(name).alias("name"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon")))))
    df = df.withColumn("_at", F.try_element_at(known, normal_key(F.col("loc"))))
    values = {"geo_level": F.lit("external"), "geo_source": F.lit("manual_override"), "geo_match_type": F.lit("override_point"), "geo_name": F.col("_at.name"), "lat": F.col("_at.lat"), "lon": F.col("_at.lon"), "polygon": F.lit(None).cast("string")}
    return placed(df, F.col("_at").isNotNull(), values).drop("_at")


def region_keys(regions: DataFrame) -> DataFrame:
    """key, region: ids and names of regions (region_id, region_name, level, country_id, lat, lon, polygon); of a key the first region in order of its id."""
    rows = regions.select(F.explode(F.array(normal_key(F.col("region_id")), normal_key(F.col("region_name")))).alias("key"), F.struct("region_id", "region_name", "level", "country_id", "lat", "lon", "polygon").alias("region"))
    return rows.where("key <> ''").groupBy("key").agg(F.min_by("region", "region.region_id").alias("region"))


def with_exact_regions(df: DataFrame, regions: DataFrame, countries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Rows that need a place and whose name is that of a country, or else the name or id of a region: its centre, polygon, level and country.

    countries: country, country_id, lat, lon, polygon.
    """
    name = country_name(F.col("loc"))
    c = countries.select(F.col("country").alias("_c"), F.struct(F.col("country").alias("region_name"), F.lit("country").alias("level"), "country_id", "lat", "lon", "polygon").alias("_cr"))
    r = region_keys(regions).select(F.col("key").alias("_k"), F.col("region").alias("_r"))
    df = df.withColumns({"_skip": skips_geocoding(F.col("location"), F.col("country_assignment"), scope) | has_geometry(), "_c": name, "_k": normal_key(F.col("loc"))})
    df = df.join(c, "_c", "left").join(r, "_k", "left")
    of = lambda f: F.coalesce(F.col(f"_cr.{f}"), F.col(f"_r.{f}"))
    values = {"geo_level": of("level"), "geo_source": F.lit("shapes"), "geo_match_type": F.when(F.col("_cr").isNotNull(), "country_exact").otherwise("region_exact"), "geo_name": of("region_name"), "lat": of("lat"), "lon": of("lon"), "polygon": of("polygon"), "country_id": of("country_id"), "region_id": F.col("_r.region_id"), "region_name": F.when(F.col("_cr").isNull(), F.col("_r.region_name"))}
    return placed(df, ~F.col("_skip") & (F.col("_cr").isNotNull() | F.col("_r").isNotNull()), values).drop("_skip", "_c", "_k", "_cr", "_r")


def with_overrides(df: DataFrame, overrides: DataFrame, regions: DataFrame) -> DataFrame:
    """Overrides by hand for rows that need a place. overrides: row (order), location, action, target_name, country_id, nuts2_id, nuts3_id, lat, lon, all text but row.

    Of a location's overrides the last one counts. `ignore` marks it, `point` needs coordinates, `nuts2` and `nuts3`
    a region of that level, by id or else by name; an override that lacks these does nothing.
    """
    o = overrides.withColumn("key", normal_key(F.col("location"))).groupBy("key").agg(F.max_by(F.struct(*(c for c in overrides.columns if c != "row")), "row").alias("o")).select("key", "o.*")
    o = o.withColumn("action", F.lower(F.trim(or_empty(F.col("action")))))
    by_id, by_name = (region_keys(regions).select(F.col("key").alias(k), F.col("region").alias(r)) for k, r in (("_ik", "_ir"), ("_nk", "_nr")))
    o = o.withColumns({"_ik": normal_key(F.when(F.col("action") == "nuts2", F.col("nuts2_id")).when(F.col("action") == "nuts3", F.col("nuts3_id"))), "_nk": normal_key(F.col("target_name"))})
    o = o.join(by_id, "_ik", "left").join(by_name, "_nk", "left").withColumn("region", F.coalesce("_ir", "_nr"))
    o = o.select("key", F.struct("action", "target_name", "location", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), F.nullif(F.trim(or_empty(F.col("country_id"))), F.lit("")).alias("country_id"), "region").alias("_o"))
    df = df.withColumns({"_need": unmatched(), "key": normal_key(F.col("loc"))}).join(o, "key", "left")
    act, hit = F.col("_o.action"), F.col("_need") & F.col("_o").isNotNull()
    name = F.coalesce(F.nullif(F.trim(or_empty(F.col("_o.target_name"))), F.lit("")), F.nullif(F.trim(or_empty(F.col("_o.location"))), F.lit("")), F.col("loc"))
    kind = F.when(act == "ignore", "ignore").when((act == "point") & F.col("_o.lat").isNotNull() & F.col("_o.lon").isNotNull(), "point").when(act.isin("nuts2", "nuts3") & (F.col("_o.region.level") == act), "region")
    df = df.withColumn("_k", F.when(hit, kind))
    k, r = F.col("_k"), F.col("_o.region")
    values = {
        "geo_level": F.when(k == "ignore", "ignored").when(k == "point", F.coalesce(F.nullif("granularity", F.lit("")), F.lit("point"))).otherwise(act),
        "geo_source": F.lit("manual_override"),
        "geo_match_type": F.when(k == "ignore", "ignored_location").when(k == "point", "override_point").otherwise(F.concat(F.lit("override_"), act)),
        "geo_name": F.when(k == "region", r["region_name"]).otherwise(name),
        "lat": F.when(k == "point", F.col("_o.lat")).when(k == "region", r["lat"]), "lon": F.when(k == "point", F.col("_o.lon")).when(k == "region", r["lon"]),
        "polygon": F.when(k == "region", r["polygon"]),
        "country_id": F.when(k == "point", F.coalesce("_o.country_id", "country_id")).when(k == "region", r["country_id"]).otherwise(F.col("country_id")),
        "region_id": F.when(k == "region", r["region_id"]), "region_name": F.when(k == "region", r["region_name"]),
    }
    return placed(df, k.isNotNull(), values).drop("_need", "key", "_o", "_k")


def with_gazetteer(df: DataFrame, names: DataFrame) -> DataFrame:
    """Exact names of a gazetteer for rows that need a place. names: key (unique), name, lat, lon, country_code."""
    g = names.select("key", F.struct("name", "lat", "lon", "country_code").alias("_g"))
    df = df.withColumns({"_need": unmatched(), "key": normal_key(F.col("loc"))}).join(g, "key", "left")
    level = F.coalesce(F.nullif("granularity", F.lit("")), F.lit("gazetteer_point"))
    values = {"geo_level": level, "geo_source": F.lit("geonames"), "geo_match_type": F.lit("geonames_exact"), "geo_name": F.col("_g.name"), "lat": F.col("_g.lat"), "lon": F.col("_g.lon"), "country_id": F.col("_g.country_code")}
    return placed(df, F.col("_need") & F.col("_g").isNotNull(), values).drop("_need", "key", "_g")


def with_remembered(df: DataFrame, cache: DataFrame, country: str, codes: str) -> DataFrame:
    """Remembered answers of a geocoder for rows that need a place: those to the name as it is, else to the name with the country, if that is one and not in the name.

    cache: key (`query||codes`, as written), lat, lon, name, provider. Of a row's answers the first counts, even if it has no coordinates.
    """
    one = scope_of({"country": country})
    query = F.trim(or_empty(F.col("loc")))
    biased = F.when(query.rlike(rf"(?iU)\b{re.escape(one[0])}\b"), query).otherwise(F.concat(query, F.lit(f", {one[0]}"))) if len(one) == 1 else query
    answer = F.struct("lat", "lon", "name", "provider")
    plain, second = (cache.select(F.col("key").alias(k), answer.alias(a)) for k, a in (("_k1", "_a1"), ("_k2", "_a2")))
    df = df.withColumns({"_need": unmatched(), "_k1": F.concat(query, F.lit(f"||{codes}")), "_k2": F.concat(biased, F.lit(f"||{codes}"))})
    df = df.join(plain, "_k1", "left").join(second, "_k2", "left").withColumn("_a", F.coalesce("_a1", "_a2"))
    source = F.concat(F.replace(normal_key(F.coalesce("_a.provider", F.lit("geocoder"))), F.lit(" "), F.lit("_")), F.lit("_cache"))
    level = F.coalesce(F.nullif("granularity", F.lit("")), F.lit("point"))
    values = {"geo_level": level, "geo_source": source, "geo_match_type": source, "geo_name": F.coalesce("_a.name", query), "lat": F.col("_a.lat"), "lon": F.col("_a.lon")}
    return placed(df, F.col("_need") & F.col("_a.lat").isNotNull() & F.col("_a.lon").isNotNull(), values).drop("_need", "_k1", "_k2", "_a1", "_a2", "_a")


def with_regions(df: DataFrame, key: str, regions: DataFrame, edges: DataFrame, cell: float = 1.0) -> DataFrame:
    """Adds admin_level and country_name, and the region that a row's point lies in.

    Rows of level country keep no region, and are named by their country, that of their id, or the name found; an
    Italian nuts2 row can't name a nuts3 region and keeps none. regions: region_id, region_name, level, country_id.
    """
    level = F.lower(or_empty(F.col("geo_level")))
    country, coarse = level == "country", (level == "nuts2") & F.coalesce(F.col("country_id") == "ITA", F.lit(False))
    points = df.where(~country & ~coarse & F.col("lat").isNotNull()).select(F.col(key).alias("point"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    inside = points_in_areas(points, edges, cell).groupBy("point").agg(F.min("area").alias("_area"))
    r = regions.select(F.col("region_id").alias("_area"), F.struct("region_id", "region_name", "level", "country_id").alias("_r"))
    df = df.join(inside.withColumnRenamed("point", key), key, "left").join(r, "_area", "left")
    blank = lambda c: F.nullif(F.trim(or_empty(c)), F.lit(""))
    own = F.when(~country & ~coarse, F.col("_r"))
    return df.withColumns({
        "admin_level": F.when(country, "country").when(coarse, "nuts2").otherwise(own["level"]),
        "country_name": F.when(country, F.coalesce(blank(F.col("country")), country_of_id(F.col("country_id")), F.col("geo_name"))).otherwise(country_of_id(own["country_id"])),
        "country_id": F.coalesce(own["country_id"], F.col("country_id")),
        "region_id": F.when(country | coarse, F.lit(None)).otherwise(F.coalesce(own["region_id"], F.col("region_id"))),
        "region_name": F.when(country | coarse, F.lit(None)).otherwise(F.coalesce(own["region_name"], F.col("region_name"))),
    }).drop("_area", "_r")


def geometry_of(polygon: Column, point: Column) -> Column:
    """struct(geometry, layer): the polygon if there is one, else the point."""
    says = lambda c: F.trim(or_empty(c)) != ""
    return F.struct(F.when(says(polygon), polygon).when(says(point), point).alias("geometry"), F.when(says(polygon), "polygons_wkt").when(says(point), "points_wkt").alias("layer"))


def only_region(points: DataFrame, edges: DataFrame, cell: float = 1.0) -> DataFrame:
    """point, area, problem: the one region that holds a point; a point in none or in several has a problem instead."""
    found = points_in_areas(points, edges, cell).groupBy("point").agg(F.count("*").alias("n"), F.min("area").alias("a"))
    valid = F.col("y").between(-90, 90) & F.col("x").between(-180, 180)
    both = points.join(found, "point", "left")
    return both.select("point", F.when(valid & (F.col("n") == 1), F.col("a")).alias("area"), F.when(~valid, "no such place").when(F.col("n").isNull(), "in no region").when(F.col("n") > 1, "in several regions").alias("problem"))


def region_key(level: Column, country_id: Column, nuts2_id: Column, location: Column | None = None) -> Column:
    """country:ID, nuts2:ID, none for an answer without a place, or unresolved."""
    key = F.when((F.lower(or_empty(level)) == "country") & country_id.isNotNull(), F.concat(F.lit("country:"), country_id)).when(F.trim(or_empty(nuts2_id)) != "", F.concat(F.lit("nuts2:"), nuts2_id))
    none = F.when(F.lower(F.trim(or_empty(location))).isin(NOTHING), "none") if location is not None else F.lit(None)
    return F.coalesce(key, none, F.lit(UNRESOLVED))


def is_region_row(region: Column, admin_level: Column | None = None, country: Column | None = None) -> Column:
    """Whether a row stands for a region: of a regional level, or, in tables without levels, not named like its country or an average."""
    named = F.trim(or_empty(region)) != ""
    if admin_level is not None:
        return named & F.lower(F.trim(or_empty(admin_level))).isin("nuts2", "nuts3")
    key = normal_key(region)
    return named & (key != normal_key(country if country is not None else F.lit(""))) & ~key.isin("average", "country average")


def picked_column(columns: list[str], patterns: list[str]) -> str | None:
    """The first column that the first matching pattern fits, without regard to case."""
    return next((c for p in patterns for c in columns if re.search(p, c, re.IGNORECASE)), None)


def coverage(df: DataFrame, areas: DataFrame, codes: str = "codes") -> DataFrame:
    """Each row once for each area that its `+`-joined codes name: GM with four digits, PV, or NL for all provinces. areas: code, edge columns.

    Codes without an area stay, with a problem.
    """
    rows = df.withColumn("code", F.explode_outer(F.filter(F.transform(F.split(or_empty(F.col(codes)), r"\+"), lambda x: F.upper(F.trim(x))), lambda x: x != "")))
    digits = F.regexp_replace("code", r"\D", "")
    rows = rows.withColumn("code", F.when(F.col("code").startswith("GM"), F.concat(F.lit("GM"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))).otherwise(F.col("code")))
    known = areas.select("code").distinct().withColumn("area", F.col("code"))
    whole = known.where(F.col("code").startswith("PV")).select(F.lit("NL").alias("code"), "area")
    out = rows.join(known.union(whole), "code", "left")
    return out.withColumn("problem", F.when(F.col("code").isNull(), "empty classification").when(F.col("area").isNull(), F.concat(F.lit("not found: "), "code")))

