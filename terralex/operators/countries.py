"""Countries: aliases, candidates of a label, assignment, and the fallback within a document."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terralex.functions.text import folded, normal_key, or_empty

#: Countries in their order, codes, names in other languages, and labels of several countries.
COUNTRIES = ["Germany", "Austria", "Switzerland", "Netherlands", "Italy"]
ISO3 = {"AUT": "Austria", "DEU": "Germany", "ITA": "Italy", "NLD": "Netherlands", "CHE": "Switzerland"}
ISO2 = {"AT": "Austria", "CH": "Switzerland", "DE": "Germany", "IT": "Italy", "NL": "Netherlands"}
NAMES = {
    "Germany": ["Germany", "Deutschland", "Duitsland", "Germania", "Allemagne", "Bundesrepublik Deutschland", "BRD"],
    "Austria": ["Austria", "Österreich", "Oesterreich", "Oostenrijk", "Autriche"],
    "Switzerland": ["Switzerland", "Schweiz", "Suisse", "Svizzera", "Zwitserland", "Switserland"],
    "Netherlands": ["Netherlands", "Nederland", "The Netherlands", "Holland", "Paesi Bassi", "Niederlande"],
    "Italy": ["Italy", "Italia", "Italien", "Italië", "Italie"],
}
SEVERAL = {
    ("Germany", "Austria", "Switzerland"): [
        "German-speaking countries", "German speaking countries", "DACH", "D-A-CH", "Germany/Austria/Switzerland", "Germany, Austria and Switzerland",
        "Deutschland Österreich Schweiz", "Deutschland, Österreich und Schweiz",
    ],
}
NOTHING = ["", "none", "nan", "null", "<na>"]


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain(*pairs.items())))


def plain_key(name: str) -> str:
    """What `country_key` makes of a name, for the tables of this module."""
    text = "".join(c for c in unicodedata.normalize("NFKD", name.strip().lower()) if not unicodedata.combining(c))
    return re.sub(r"[^\w\s.'/&,]", "", re.sub(r"\s+", " ", re.sub(r"[-_]+", " ", text.replace("’", "'")))).strip()


def country_key(label: Column) -> Column:
    """A label in lower case without accents, blanks for - and _, no punctuation but . ' / & and commas."""
    c = F.regexp_replace(F.translate(folded(F.trim(or_empty(label))), "’", "'"), "[-_]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"[^\p{L}\p{N}_\s.'/&,]", ""))


def country_name(label: Column) -> Column:
    """The canonical country of a name or three-letter code; null if there is none."""
    names = {plain_key(alias): c for c, aliases in NAMES.items() for alias in aliases}
    return F.coalesce(F.try_element_at(_map(names), country_key(label)), F.try_element_at(_map(ISO3), F.upper(F.trim(or_empty(label)))))


def country_of_id(code: Column) -> Column:
    """The canonical country of a three- or two-letter code."""
    return F.try_element_at(_map(ISO3 | ISO2), F.upper(F.trim(or_empty(code))))


def country_candidates(label: Column, scope: list[str] | None = None) -> Column:
    """Canonical countries that a label names, in canonical order, within a scope: a label of several, a single one, or a list of at least two parts."""
    several = {plain_key(x): list(countries) for countries, labels in SEVERAL.items() for x in labels}
    group = F.try_element_at(F.create_map(*(x for k, cs in several.items() for x in (F.lit(k), F.array(*(F.lit(c) for c in cs))))), country_key(label))
    parts = F.filter(F.transform(F.split(or_empty(label), r"(?iU)\s*(?:,|;|\||/|&|\band\b|\bund\b|\ben\b|\bet\b)\s*"), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.when(F.size(parts) > 1, F.transform(parts, country_name)).otherwise(F.array().cast("array<string>"))
    found = F.coalesce(group, F.when(country_name(label).isNotNull(), F.array(country_name(label))), listed)
    order = F.array(*(F.lit(c) for c in (COUNTRIES if not scope else [c for c in COUNTRIES if c in scope])))
    return F.array_intersect(order, F.array_compact(found))


def assign_country(df: DataFrame, location: str, granularity: str, scope: list[str] | None = None) -> DataFrame:
    """Adds country_candidates, country_assignment, country, has_single_country and multi_country_scope."""
    level = F.lower(F.trim(or_empty(F.col(granularity)))) == "country"
    df = df.withColumn("country_candidates", country_candidates(F.col(location), scope))
    n = F.size("country_candidates")
    kind = F.when(n == 1, "single_country").when(n > 1, "multiple_countries").when(level, "no_country").otherwise("not_country_level")
    return df.withColumns({"country_assignment": kind, "country": F.when(n == 1, F.element_at("country_candidates", 1)), "has_single_country": n == 1, "multi_country_scope": F.lit(len(scope or []) > 1)})


def single_country(assignment: Column, country: Column, country_id: Column) -> Column:
    """A row's one country: the one assigned, else that of its id, unless several were named."""
    kind = F.trim(or_empty(assignment))
    named = country_name(country)
    return F.when((kind == "single_country") & named.isNotNull(), named).when(kind != "multiple_countries", country_of_id(country_id))


def normal_payload(df: DataFrame, location: str, granularity: str, scope: list[str] | None = None) -> DataFrame:
    """assign_country, and the answer itself put straight: one country by its canonical name and at level country, several or an unknown one as NONE."""
    df = assign_country(df, location, granularity, scope)
    kind = F.col("country_assignment")
    level = F.lower(F.trim(or_empty(F.col(granularity)))) == "country"
    nothing = (kind == "multiple_countries") | ((kind != "single_country") & level)
    place = F.when(kind == "single_country", F.col("country")).when(nothing, "NONE").otherwise(F.col(location))
    grain = F.when(kind == "single_country", "country").when(nothing, "none").otherwise(F.col(granularity))
    return df.withColumns({location: place, granularity: grain})


def scope_of(config: dict, language: str | None = None) -> list[str]:
    """Countries in scope by a configuration: by language, for all, or by one of the older keys; in canonical order."""
    lang = (language or config.get("language") or "").strip()
    scope = config.get("country_scope") or {}
    by_language = scope.get("countries_by_language") or scope.get("by_language") or {}
    countries = scope.get("countries")
    older = config.get("countries") or {}
    if lang in by_language:
        found = by_language[lang]
    elif isinstance(countries, dict) and lang in countries:
        found = countries[lang]
    elif countries:
        found = countries
    elif isinstance(older, dict) and lang in older:
        found = older[lang]
    else:
        found = config.get("country") or lang
    names = {plain_key(a): c for c, aliases in NAMES.items() for a in aliases}
    names |= {plain_key(a): list(cs) for cs, labels in SEVERAL.items() for a in labels} | {k.lower(): c for k, c in ISO3.items()}
    parts = [found] if isinstance(found, str) else list(found)
    flat = [c for x in parts for p in ([x] if plain_key(x) in names else re.split(r"[,;|/]", x)) for c in (lambda v: v if isinstance(v, list) else [v] if v else [])(names.get(plain_key(p)))]
    return [c for c in COUNTRIES if c in flat]


def document_text(df: DataFrame, document: str, order: str, body: str, paragraph: str) -> DataFrame:
    """document, text: the first body that isn't blank, else the paragraphs in order with an empty line between them."""
    says = ~F.lower(F.trim(or_empty(F.col(body)))).isin(NOTHING)
    whole = F.min_by(F.when(says, F.trim(F.col(body))), F.when(says, F.col(order)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.trim(or_empty(F.col(paragraph))).alias("p"))))
    return df.groupBy(document).agg(F.coalesce(whole, F.trim(F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n"))).alias("text"))


def best_mention(df: DataFrame, unit: str, place: str, text: str, importance: str) -> DataFrame:
    """unit, place, score: of the places named for a unit the one of the best score: twice its mentions, nearness to the text's beginning, importance."""
    low, name = F.lower(or_empty(F.col(text))), F.lower(F.col(place))
    times = (F.length(low) - F.length(F.replace(low, name, F.lit("")))) / F.length(name)
    first = F.position(name, low) - 1
    score = 2 * times + F.when(first >= 0, 1 / (1 + first / 100)).otherwise(0.0) + F.col(importance)
    rows = df.select(unit, place, score.alias("score"))
    return rows.groupBy(unit).agg(F.min_by(F.struct(place, "score"), F.struct(-F.col("score"), place)).alias("m")).select(unit, f"m.{place}", "m.score")


def clean_place(c: Column) -> Column:
    """A place name without what stands in brackets and without leading administrative words."""
    c = F.regexp_replace(or_empty(c), r"\([^)]*\)", " ")
    c = F.regexp_replace(c, r"(?iu)^\s*(?:gemeente|provincie|stad|regio|comune|provincia|regione|citt[aà]|stadt|landkreis|kreis|gemeinde)\s+(?:di\s+|van\s+)?", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def first_candidate(c: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(F.split(or_empty(c), r"[,/;&]|\s+en\s+"), lambda x: F.trim(x)), lambda x: x != ""), 0), F.lit(""))


def document_fallback(df: DataFrame, scope: list[str], answers: DataFrame | None = None, status: str | None = None) -> DataFrame:
    """Fills location for rows without a specific one from the other rows of their document.

    df: document, row_order, location, granularity, and a status if its column is named: only rows with ok or empty are
    filled. One distinct specific place in the document is copied; else one distinct country; else what was answered for
    the whole document (answers: document, location, granularity); else the scope's only country, or none. What isn't
    the document's own is to be reviewed, with the reason.
    """
    key = normal_key(F.col("location"))
    level = F.lower(F.trim(or_empty(F.col("granularity"))))
    empty = key.isin(NOTHING) | level.isin("none", "")
    country = ~empty & (level == "country")
    doc = Window.partitionBy("document")
    done = F.col(status).isin("ok", "empty") if status else F.lit(True)
    df = df.withColumns({"_key": F.when(country, F.coalesce(country_name(F.col("location")), key)).otherwise(key), "_specific": ~empty & ~country, "_country": country, "_done": done})
    pick = lambda flag, value: F.min_by(F.when(F.col(flag), value), F.when(F.col(flag), F.col("row_order"))).over(doc)
    distinct = lambda flag: F.size(F.collect_set(F.when(F.col(flag), F.col("_key"))).over(doc))
    df = df.withColumns({"_ns": distinct("_specific"), "_nc": distinct("_country"), "_s": pick("_specific", F.struct("location", "granularity")), "_c": pick("_country", F.col("_key"))})
    if answers is None:
        df = df.withColumn("_a", F.lit(None).cast("struct<location: string, granularity: string>"))
    else:
        said = ~normal_key(F.col("location")).isin(NOTHING) & ~F.lower(F.trim(or_empty(F.col("granularity")))).isin("none", "")
        df = df.join(answers.where(said).select("document", F.struct("location", "granularity").alias("_a")), "document", "left")
    open_ = ~F.col("_specific") & F.col("_done")
    by_place, by_country = open_ & (F.col("_ns") == 1), open_ & (F.col("_ns") == 0) & (F.col("_nc") == 1)
    by_answer = open_ & ~by_place & ~by_country & F.col("_a").isNotNull()
    left = open_ & ~by_place & ~by_country & ~by_answer
    one = len(scope) == 1
    several = [] if one else [f"no single country-level fallback is possible for multi-country scope ({', '.join(scope)})"]
    reason = F.when(F.col("_ns") > 1, "multiple_document_locations").otherwise("no_document_paragraph_locations")
    return df.select(
        "document", "row_order",
        F.when(by_place, F.col("_s.location")).when(by_country, F.col("_c")).when(by_answer, F.col("_a.location")).when(left, scope[0] if one else "NONE").otherwise(F.col("location")).alias("location"),
        F.when(by_place, F.col("_s.granularity")).when(by_country, "country").when(by_answer, F.col("_a.granularity")).when(left, "country" if one else "none").otherwise(F.col("granularity")).alias("granularity"),
        F.when(by_place, "document_single_location").when(by_country, "country_all_document_locations").when(by_answer, "document_llm").when(left, "country_fallback" if one else "multi_country_fallback").when(F.col("_specific"), "paragraph").alias("location_source"),
        (by_answer | left).alias("needs_review"),
        F.when(by_answer, reason).when(left, F.concat_ws(";", reason, F.lit("document_llm_no_location"), *(F.lit(x) for x in several))).alias("review_reason"),
    )
