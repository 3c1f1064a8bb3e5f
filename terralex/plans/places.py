"""Queries on countries, the geocoding cascade and regions, over places derived from the driver's tables, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.functions import geo
from terralex.functions import text as T
from terralex.operators import countries as C
from terralex.operators import geocoding as P
from terralex.operators import spatial as S
from terralex.plans.queries import AREAS, _EDGES, query, table

#: Labels that answers hold here, with the countries that each names.
LABELS = [
    ("Germany", "Germany"), ("BRD", "Germany"), ("Österreich", "Austria"), ("DACH", "Germany Austria Switzerland"), ("D-A-CH", "Germany Austria Switzerland"), ("German-speaking countries", "Germany Austria Switzerland"), ("Deutschland, Österreich und Schweiz", "Germany Austria Switzerland"),
    ("Italia und NLD", "Netherlands Italy"), ("Niederlande/Switserland", "Switzerland Netherlands"), ("Delft", ""), ("Atlantis", ""), ("", ""), ("NLD", "Netherlands"), ("NL", ""), ("Bundesrepublik Deutschland", "Germany"), ("Italy and Mars", "Italy"), ("NONE", ""),
]
LEVELS = ["country", "city", "none"]
_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"
_NAMED = "labels_of(i, label, countries) as (values " + ", ".join(f"({i}, {_QUOTED(a)}, {_QUOTED(b)})" for i, (a, b) in enumerate(LABELS)) + ")"
_ANSWERS = f"{_NAMED}, answers as (select c_custkey id, c_nationkey document, label as location, ['country', 'city', 'none'][c_custkey // 17 % 3 + 1] granularity, countries, case when countries = '' then 0 else len(string_split(countries, ' ')) end n from customer join labels_of on i = c_custkey % {len(LABELS)})"


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def answers(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), F.col("c_nationkey").alias("document"), _pick([a for a, _ in LABELS], k % len(LABELS)).alias("location"), _pick(LEVELS, F.floor(k / 17) % 3).alias("granularity"))


@query(f"with {_ANSWERS} select id, countries candidates, case when n = 1 then 'single_country' when n > 1 then 'multiple_countries' when granularity = 'country' then 'no_country' else 'not_country_level' end assignment, case when n = 1 then countries end country, n = 1 has_single_country from answers")
def c3_country_candidates(spark, sf):
    out = C.assign_country(answers(spark, sf), "location", "granularity")
    return out.select("id", F.array_join("country_candidates", " ").alias("candidates"), F.col("country_assignment").alias("assignment"), "country", "has_single_country")


@query(f"with {_ANSWERS}, ids as (select *, ['DEU', 'it', '', 'XX'][id % 4 + 1] country_id from answers) select id, case when n = 1 then countries when n < 2 then case id % 4 when 0 then 'Germany' when 1 then 'Italy' end end country from ids")
def c5_row_country(spark, sf):
    out = C.assign_country(answers(spark, sf).withColumn("country_id", _pick(["DEU", "it", "", "XX"], F.col("id") % 4)), "location", "granularity")
    return out.select("id", C.single_country(F.col("country_assignment"), F.col("country"), F.col("country_id")).alias("country"))


@query(f"with {_ANSWERS} select id, case when n = 1 then countries when n > 1 or granularity = 'country' then 'NONE' else location end as location, case when n = 1 then 'country' when n > 1 or granularity = 'country' then 'none' else granularity end granularity from answers")
def c7_normal_payload(spark, sf):
    return C.normal_payload(answers(spark, sf), "location", "granularity").select("id", "location", "granularity")


@query("""with r as (select *, case when turn % 3 = 1 and conv_id % 2 = 0 then ' The body ' || turn || ' ' end body from conversations)
select conv_id, coalesce(trim(arg_min(body, turn)), trim(string_agg(trim(coalesce(text, '')), e'\\n\\n' order by turn))) text from r group by conv_id""")
def c9_document_text(spark, sf):
    body = F.when((F.col("turn") % 3 == 1) & (F.col("conv_id") % 2 == 0), F.concat(F.lit(" The body "), F.col("turn"), F.lit(" ")))
    return C.document_text(table(spark, sf, "conversations").withColumn("body", body), "conv_id", "turn", "body", "text")


@query("""with p(place, importance) as (values ('the', 0.1), ('und', 0.2), ('la', 0.3), ('zzz', 0.4)),
s as (select doc_id, place, importance, lower(coalesce(text, '')) t, strpos(lower(coalesce(text, '')), place) - 1 as spot from documents, p),
c as (select *, 2 * ((length(t) - length(replace(t, place, ''))) / length(place)) + case when spot >= 0 then 1 / (1 + spot / 100.0) else 0 end + importance score from s)
select doc_id, arg_max(place, score) place, round(max(score), 6) score from c group by doc_id""")
def c12_best_mention(spark, sf):
    named = F.explode(F.array(*(F.struct(F.lit(p).alias("place"), F.lit(i).alias("importance")) for p, i in (("the", 0.1), ("und", 0.2), ("la", 0.3), ("zzz", 0.4)))))
    rows = table(spark, sf, "documents").select("doc_id", "text", named.alias("p")).select("doc_id", "text", "p.*")
    return C.best_mention(rows, "doc_id", "place", "text", "importance").select("doc_id", "place", F.round("score", 6).alias("score"))


_TWO = """rows as (select c_custkey row_order, c_custkey // 4 as document, ['Delft', 'Utrecht', 'Duitsland', 'NONE', 'Germany', 'NONE', 'NONE'][c_custkey % 7 + 1] location, ['city', 'city', 'country', 'none', 'country', 'none', 'none'][c_custkey % 7 + 1] granularity, case when c_custkey % 13 = 0 then 'error' else 'ok' end status from customer),
g as (select document, count(distinct location) filter (where granularity = 'city') ns, count(*) filter (where granularity = 'country') nc, arg_min(location, row_order) filter (where granularity = 'city') s from rows group by document),
j as (select r.*, ns, s, case when granularity = 'city' then 'paragraph' when status = 'error' then null when ns = 1 then 'document_single_location' when ns = 0 and nc > 0 then 'country_all_document_locations' when document % 3 = 0 then 'document_llm' else 'multi_country_fallback' end src from rows r join g using (document))"""


@query(f"""with {_TWO} select document, row_order, case src when 'document_single_location' then s when 'country_all_document_locations' then 'Germany' when 'document_llm' then 'Leiden' when 'multi_country_fallback' then 'NONE' else location end as location,
case src when 'document_single_location' then 'city' when 'country_all_document_locations' then 'country' when 'document_llm' then 'municipality' when 'multi_country_fallback' then 'none' else granularity end granularity, src location_source, coalesce(src in ('document_llm', 'multi_country_fallback'), false) needs_review,
case when src in ('document_llm', 'multi_country_fallback') then case when ns > 1 then 'multiple_document_locations' else 'no_document_paragraph_locations' end || case src when 'document_llm' then '' else ';document_llm_no_location;no single country-level fallback is possible for multi-country scope (Germany, Netherlands)' end end review_reason from j""")
def c8_document_answers(spark, sf):
    """All branches: unfinished rows, one place, one country by two names, an answer for the document, none."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        F.expr("c_custkey div 4").alias("document"), k.alias("row_order"), _pick(["Delft", "Utrecht", "Duitsland", "NONE", "Germany", "NONE", "NONE"], k % 7).alias("location"),
        _pick(["city", "city", "country", "none", "country", "none", "none"], k % 7).alias("granularity"), F.when(k % 13 == 0, "error").otherwise("ok").alias("status"))
    said = rows.select("document").distinct().select("document", F.when(F.col("document") % 3 == 0, "Leiden").otherwise("NONE").alias("location"), F.lit("municipality").alias("granularity"))
    return C.document_fallback(rows, ["Germany", "Netherlands"], said, "status")


# ---- the cascade

PLACES = ["Kenia", "Curaçao", "Noplace", "Hill", "Rijswijk", "Toscana", "alias", "ghost", "Delft", "Essen", "Unknown", "Boxtel", "Italy", "DACH", ""]
LEVEL = ["city", "municipality", "country", "none"]
REGIONS = [("NL33", "Zuid-Holland", "nuts2", "NLD"), ("ITI1", "Toscana", "nuts2", "ITA"), ("ITI19", "Siena", "nuts3", "ITA")]
OVERRIDES = [
    ("Noplace", "point", "", "", "", "", "1", "2"), ("noplace", "ignore", "", "", "", "", "", ""), ("Hill", "point", "The Hill", "NLD", "", "", "52.5", "4.5"),
    ("Rijswijk", "nuts2", "", "", "NL33", "", "", ""), ("Toscana", "nuts3", "Toscana", "", "", "", "", ""), ("alias", "nuts3", "siena", "", "", "", "", ""), ("ghost", "point", "", "", "", "", "x", "2"),
]
GAZETTEER = [("delft", "Delft", 52.0, 4.36, "NL"), ("hill", "Hill", 1.0, 1.0, "DE"), ("toscana", "Toscana town", 43.0, 11.0, "IT")]
CACHE = [("Essen||nl", 51.4, 7.0, "Essen DE", "nominatim"), ("Boxtel, Netherlands||nl", 51.6, 5.3, None, "Photon X"), ("Unknown||nl", None, 5.0, "no", "nominatim")]


def _frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _asked(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("id"), _pick(PLACES, k % len(PLACES)).alias("loc"), _pick(LEVEL, F.floor(k / 15) % 4).alias("granularity"))
    return P.unplaced(rows.withColumns({"location": F.col("loc"), "country_assignment": F.when(F.col("id") % 31 == 0, "multiple_countries").otherwise("not_country_level")}))


def _regions(spark) -> DataFrame:
    return _frame(spark, [(i, n, lv, c, 40.0 + j, 10.0 + j, f"POLYGON {j}") for j, (i, n, lv, c) in enumerate(REGIONS)], "region_id string, region_name string, level string, country_id string, lat double, lon double, polygon string")


_ASKED = f"asked as (select c_custkey id, {[p for p in PLACES]}[c_custkey % {len(PLACES)} + 1] loc, {LEVEL}[c_custkey // 15 % 4 + 1] granularity, c_custkey % 31 = 0 several from customer), need as (select *, loc <> '' and granularity in ('city', 'municipality') and not several and loc <> 'DACH' fine from asked)"
#: What each place gets where it is needed: by override, gazetteer, remembered answer.
_FOUND = """found(loc, lev, src, kind, name, la, lo, cid) as (values ('Noplace', 'ignored', 'manual_override', 'ignored_location', 'noplace', null, null, null), ('Hill', null, 'manual_override', 'override_point', 'The Hill', 52.5, 4.5, 'NLD'),
('Rijswijk', 'nuts2', 'manual_override', 'override_nuts2', 'Zuid-Holland', 40, 10, 'NLD'), ('alias', 'nuts3', 'manual_override', 'override_nuts3', 'Siena', 42, 12, 'ITA'),
('Toscana', null, 'geonames', 'geonames_exact', 'Toscana town', 43, 11, 'IT'), ('Delft', null, 'geonames', 'geonames_exact', 'Delft', 52, 4.36, 'NL'),
('Essen', null, 'nominatim_cache', 'nominatim_cache', 'Essen DE', 51.4, 7, null), ('Boxtel', null, 'photon_x_cache', 'photon_x_cache', 'Boxtel', 51.6, 5.3, null))"""


@query(f"""with {_ASKED}, {_FOUND}, external(loc, name, la, lo) as (values ('Kenia', 'Kenya', -0.0236, 37.9062), ('Curaçao', 'Curaçao', 12.1696, -68.99))
select n.id, case when e.loc is not null then 'external' when f.loc is not null then coalesce(f.lev, granularity) end geo_level, case when e.loc is not null then 'manual_override' else f.src end geo_source,
case when e.loc is not null then 'override_point' else f.kind end geo_match_type, coalesce(e.name, f.name) geo_name, coalesce(e.la, f.la)::double lat, coalesce(e.lo, f.lo)::double lon, f.cid country_id
from need n left join external e on e.loc = n.loc left join found f on f.loc = n.loc and fine""")
def j6_geocoding_cascade(spark, sf):
    """External points, overrides, gazetteer, remembered answers, each for the rows that still need a place."""
    rows = P.external_points(_asked(spark, sf))
    overrides = _frame(spark, [(i, *o) for i, o in enumerate(OVERRIDES)], "row int, location string, action string, target_name string, country_id string, nuts2_id string, nuts3_id string, lat string, lon string")
    rows = P.with_overrides(rows, overrides, _regions(spark))
    rows = P.with_gazetteer(rows, _frame(spark, GAZETTEER, "key string, name string, lat double, lon double, country_code string"))
    rows = P.with_remembered(rows, _frame(spark, CACHE, "key string, lat double, lon double, name string, provider string"), "Nederland", "nl")
    return rows.select("id", "geo_level", "geo_source", "geo_match_type", "geo_name", "lat", "lon", "country_id")


@query(f"""with {_ASKED}, hit(loc, lev, kind, name, la, cid, rid) as (values ('Toscana', 'nuts2', 'region_exact', 'Toscana', 41, 'ITA', 'ITI1'), ('Italy', 'country', 'country_exact', 'Italy', 42.5, 'ITA', null))
select id, lev geo_level, kind geo_match_type, name geo_name, la::double lat, cid country_id, rid region_id from asked left join hit on hit.loc = asked.loc and not several""")
def j3_exact_regions(spark, sf):
    countries = _frame(spark, [("Italy", "ITA", 42.5, 12.5, "POLYGON IT")], "country string, country_id string, lat double, lon double, polygon string")
    return P.with_exact_regions(_asked(spark, sf), _regions(spark), countries).select("id", "geo_level", "geo_match_type", "geo_name", "lat", "country_id", "region_id")


@query(f"with {_ASKED} select id, fine from need")
def p8_unmatched_mask(spark, sf):
    return _asked(spark, sf).select("id", P.unmatched().alias("fine"))


@query(f"with {_ASKED} select id, granularity in ('city', 'municipality') and not several and loc <> 'DACH' useful from need")
def p7_useful_granularity(spark, sf):
    return _asked(spark, sf).select("id", P.useful(F.col("granularity"), F.col("country_assignment"), F.col("location")).alias("useful"))


@query(f"with {_ASKED} select id, loc in ('', 'DACH') or several skipped from need")
def p9_skip_geocoding(spark, sf):
    return _asked(spark, sf).select("id", P.skips_geocoding(F.col("location"), F.col("country_assignment")).alias("skipped"))


_AT = "spots as (select c_custkey point, (c_custkey % 41 * 2.5)::double x, (c_custkey // 41 % 41 * 2.5)::double y, ['city', 'country', 'nuts2', 'nuts3'][c_custkey % 4 + 1] lev, case when c_custkey % 3 = 0 then 'ITA' else 'NLD' end cid from customer)"
_ON = "(x2 - x1) * (y - y1) = (y2 - y1) * (x - x1) and x between least(x1, x2) and greatest(x1, x2) and y between least(y1, y2) and greatest(y1, y2)"
_STRICT = f"{_EDGES}, {_AT}, met as (select point, area, ((y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) c, ({_ON}) o from spots join edges on true), inside as (select point, area from met group by all having sum(coalesce(c, false)::int) % 2 = 1 and not bool_or(o))"


def _grid(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("point"), (k % 41 * 2.5).alias("x"), (F.floor(k / 41) % 41 * 2.5).alias("y"), _pick(["city", "country", "nuts2", "nuts3"], k % 4).alias("geo_level"), F.when(k % 3 == 0, "ITA").otherwise("NLD").alias("country_id"))


@query(f"with {_STRICT} select point, area from inside")
def j10_boundary_points(spark, sf):
    """Points of a lattice, many of them on boundaries, which lie in no area."""
    return S.points_in_areas(_grid(spark, sf).select("point", "x", "y"), S.edge_table(spark, AREAS, cell=5.0), cell=5.0)


@query(f"""with {_STRICT}, r(area, cid2, lv) as (values ('north', 'DEU', 'nuts2'), ('south', 'AUT', 'nuts2'), ('ring', 'ITA', 'nuts3')), one as (select point, min(area) area from inside group by point),
j as (select spots.*, area, cid2, lv, lev = 'country' country, lev = 'nuts2' and cid = 'ITA' coarse from spots left join one using (point) left join r using (area))
select point, case when country then 'country' when coarse then 'nuts2' else lv end admin_level, case when country then case cid when 'ITA' then 'Italy' else 'Netherlands' end when not coarse then case cid2 when 'DEU' then 'Germany' when 'AUT' then 'Austria' when 'ITA' then 'Italy' end end country_name,
case when not country and not coarse and cid2 is not null then area end region_id, case when not country and not coarse then coalesce(cid2, cid) else cid end country_id from j""")
def j11_admin_regions(spark, sf):
    rows = _grid(spark, sf).select("point", F.col("x").alias("lon"), F.col("y").alias("lat"), "geo_level", "country_id", F.lit("").alias("country"))
    r = _frame(spark, [("north", "North", "nuts2", "DEU"), ("south", "South", "nuts2", "AUT"), ("ring", "Ring", "nuts3", "ITA")], "region_id string, region_name string, level string, country_id string")
    return P.with_regions(P.unplaced(rows), "point", r, S.edge_table(spark, AREAS, cell=5.0), cell=5.0).select("point", "admin_level", "country_name", "region_id", "country_id")


@query(f"with {_STRICT}, n as (select point, count(*) n, min(area) a from inside group by point) select point, case when y <= 90 and n = 1 then a end area, case when y > 90 then 'no such place' when n is null then 'in no region' when n > 1 then 'in several regions' end problem from spots left join n using (point)")
def j13_only_region(spark, sf):
    return P.only_region(_grid(spark, sf).select("point", "x", "y"), S.edge_table(spark, AREAS, cell=5.0), cell=5.0)


@query("select c_custkey id, case c_custkey % 4 when 0 then 'POLYGON ((0 0))' when 1 then 'POINT (1 2)' when 2 then 'POLYGON ((1 1))' end geometry, case c_custkey % 4 when 0 then 'polygons_wkt' when 1 then 'points_wkt' when 2 then 'polygons_wkt' end layer from customer")
def j12_geometry_preference(spark, sf):
    k = F.col("c_custkey") % 4
    got = P.geometry_of(F.when(k == 0, "POLYGON ((0 0))").when(k == 2, "POLYGON ((1 1))").otherwise(" "), F.when(k < 3, "POINT (1 2)"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), got.alias("g")).select("id", "g.*")


@query("select c_custkey id, case c_custkey % 5 when 0 then 'country:NLD' when 1 then 'nuts2:NL33' when 2 then 'none' else 'unresolved' end region from customer")
def e9_region_key(spark, sf):
    k = F.col("c_custkey") % 5
    key = P.region_key(F.when(k == 0, "Country").otherwise("city"), F.when(k != 3, "NLD"), F.when(k == 1, "NL33").when(k == 4, " "), F.when(k == 2, "NONE").otherwise("Delft"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), key.alias("region"))


@query("select c_custkey id, c_custkey % 6 in (0, 1) levelled, c_custkey % 3 = 0 named from customer")
def p10_region_rows(spark, sf):
    k = F.col("c_custkey")
    region, level = F.when(k % 3 == 0, "Pisa").when(k % 3 == 1, "Country average").otherwise("Italy"), F.when(k % 6 == 0, "NUTS3").when(k % 6 == 1, "nuts2").otherwise("country")
    return table(spark, sf, "customer").select(k.alias("id"), P.is_region_row(region, level).alias("levelled"), P.is_region_row(region, None, F.lit("Italy")).alias("named"))


@query("select doc_id from documents where regexp_matches(source, '(?i)^SRC[0-2]$') and lang <> 'en'")
def p12_region_filter(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(F.col(P.picked_column(d.columns, ["^region", "source"])).rlike("(?i)^SRC[0-2]$") & (F.col("lang") != "en")).select("doc_id")


@query("""with a(code, area) as (values ('GM0014', 'GM0014'), ('PV20', 'PV20'), ('PV21', 'PV21'), ('NL', 'PV20'), ('NL', 'PV21')), c as (select s_suppkey id, unnest(case s_suppkey % 5 when 0 then ['GM0014', 'PV20'] when 1 then ['NL'] when 2 then ['GM9999'] when 3 then [null] else ['PV21', 'GM0014'] end) code from supplier)
select id, c.code, area, case when c.code is null then 'empty classification' when area is null then 'not found: ' || c.code end problem from c left join a on a.code = c.code""")
def j16_coverage(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), _pick(["gm14+pv20", " NL ", "GM9999", "", "PV21+ GM0014"], F.col("s_suppkey") % 5).alias("codes"))
    return P.coverage(s, _frame(spark, [("GM0014",), ("PV20",), ("PV21",)], "code string")).select("id", "code", "area", "problem")


@query(f"with {_EDGES}, spots as (select c_custkey point, (c_custkey * 37 % 1000) / 10.0::double + 0.013 x, (c_custkey * 91 % 1000) / 10.0::double + 0.017 y from customer), hit as (select point, area from spots join edges on (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 group by all having count(*) % 2 = 1) select distinct point, case area when 'ring' then 'east' else 'west' end area from hit where area in ('north', 'south', 'ring')")
def j2_country_shapes(spark, sf):
    """Points in countries: shapes whose regions' common borders are dissolved."""
    shapes = geo.dissolved({a: AREAS[a] for a in ("north", "south", "ring")}, {"north": "west", "south": "west", "ring": "east"})
    k = F.col("c_custkey")
    at = table(spark, sf, "customer").select(k.alias("point"), ((k * 37 % 1000) / 10 + 0.013).alias("x"), ((k * 91 % 1000) / 10 + 0.017).alias("y"))
    return S.points_in_areas(at, S.edge_table(spark, shapes, cell=5.0), cell=5.0)


@query("select c_custkey id, (c_custkey % 100)::double lon, 1.5::double lat from customer where c_custkey % 4 <> 0")
def a21_map_points(spark, sf):
    from terralex.operators.aggregates import mapped_points

    k = F.col("c_custkey")
    return mapped_points(table(spark, sf, "customer").select(k.alias("id"), F.when(k % 8 == 0, "n/a").when(k % 4 != 0, (k % 100).cast("string")).alias("lon"), F.lit("1.5").alias("lat")), "lon", "lat")


# ---- text with what extraction leaves


_BARE = r"regexp_replace(coalesce(text, ''), '[0-9\\]', '', 'g')"


@query(rf"""with r as (select doc_id, 'A title' || chr(10) || '333 words ' || {_BARE} t from documents), s as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{{3,}}', e'\n\n', 'g') t from r) select doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') text from s""")
def t7_artifacts(spark, sf):
    """Texts (their own digits out, on which the SQL's patterns can't look ahead) behind lines with all kinds of artefacts."""
    t = F.concat(F.lit("-3 A "), F.col("doc_id"), F.lit(" Page of 7 title\n1 22 333 words "), F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(" \\'e9 \\* "), F.regexp_replace(T.or_empty(F.col("text")), r"[0-9\\]", ""))
    return table(spark, sf, "documents").select("doc_id", T.without_artifacts(t).alias("text"))


@query("select doc_id, doc_id % 6 in (0, 1, 2, 3) corrupt from documents")
def t8_corrupt(spark, sf):
    k = F.col("doc_id") % 6
    title = F.when(k == 0, " ").when(k == 1, "Times New Roman 12").when(k == 2, "3 Page of 4").otherwise("A title")
    body = F.when(k == 3, F.lit("0123456789abcdef 0123456789ABCDEF x 00112233445566778")).when(k == 4, F.lit("g0123456789abcdef 0123456789ABCDEFz 00112233445566778 aaaaaaaaaaaaaaaa")).otherwise(F.lit(""))
    return table(spark, sf, "documents").select("doc_id", T.looks_corrupt(title, F.lit("De Krant"), body).alias("corrupt"))


@query("""select doc_id, unnest(case doc_id % 4 when 0 then ['Dhr. Jansen kwam z.B. mit Dr. Who.', 'Then 3 left.', 'Done.'] when 1 then ['He said "No.', 'Yes it is!'] when 2 then ['Plain text without an end'] else ['Vgl. Abb.', 'Nr. 3 d.h. alles.', 'Ende'] end) sentence from documents""")
def g4_guarded_sentences(spark, sf):
    t = _pick(["Dhr. Jansen kwam z.B. mit Dr. Who. Then 3 left.\nDone.", 'He said "No." Yes it is!', " Plain text without an end ", "Vgl. Abb. Nr. 3 d.h. alles.  Ende"], F.col("doc_id") % 4)
    return table(spark, sf, "documents").select("doc_id", F.explode(T.guarded_sentence_list(t)).alias("sentence"))


@query(r"""with r as (select doc_id, coalesce(lang, '') || ' Näme -- of (' || source || ')' t from documents) select doc_id, trim(regexp_replace(lower(t), '[^\p{L}\p{N}_]+', '-', 'g'), '-') slug, case when length(t) <= 12 then t else rtrim(substring(t, 1, 11)) || '…' end short, doc_id % 3 = 0 yes from r""")
def x1_scalars(spark, sf):
    t = F.concat(F.coalesce("lang", F.lit("")), F.lit(" Näme -- of ("), F.col("source"), F.lit(")"))
    return table(spark, sf, "documents").select("doc_id", T.slug(t).alias("slug"), T.cut_off(t, 12).alias("short"), T.truthy(F.when(F.col("doc_id") % 3 == 0, " YES").otherwise("n")).alias("yes"))


@query("select conv_id, turn, coalesce(lag(text) over w, '') prev_sentence, coalesce(lead(text) over w, '') next_sentence from conversations window w as (partition by conv_id order by turn)")
def g14_neighbour_sentences(spark, sf):
    from terralex.operators.segment import neighbour_sentences

    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("uid"), F.col("turn").alias("sentence_id"), F.col("text").alias("sentence_text"))
    return neighbour_sentences(c).select(F.col("uid").alias("conv_id"), F.col("sentence_id").alias("turn"), "prev_sentence", "next_sentence")


@query(r"""select doc_id, array_to_string(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n\s*\n+'), lambda b: trim(regexp_replace(b, '\s*\n\s*', ' ', 'g'))), lambda b: b <> ''), chr(10) || chr(10)) text from documents""")
def g2_joined_lines(spark, sf):
    from terralex.operators.segment import joined_lines

    return table(spark, sf, "documents").select("doc_id", joined_lines(F.col("text")).alias("text"))


@query("""select doc_id, unnest([0, 1])::int part, unnest(['A ' || doc_id, source || chr(10) || 'more']) part_text from documents""")
def t2_export_parts(spark, sf):
    from terralex.operators.segment import export_parts

    t = F.concat(F.lit(" \n End of document A "), F.col("doc_id"), F.lit(" END OF DOCUMENT\n"), F.col("source"), F.lit("\nmore End of Document  "))
    return export_parts(table(spark, sf, "documents").select("doc_id", t.alias("text")), "text").select("doc_id", "part", "part_text")


_DATES = ["maandag 5 mei 2020", "7. März 2021, Sonntag", "12 gennaio 2019", "March 3, 2018", "31-12-2017", "2016-02-29", "30 februari 2016", ""]


@query("select doc_id, [date '2020-05-05', date '2021-03-07', date '2019-01-12', date '2018-03-03', date '2017-12-31', date '2016-02-29', null, null][doc_id % 8 + 1]::varchar as day from documents")
def t6_parsed_dates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.parsed_date(_pick(_DATES, F.col("doc_id") % 8)).cast("string").alias("day"))


@query("select doc_id, ['5 May 2020', '7 March 2021', '12 January 2019', 'March 3 2018', '31-12-2017', '2016-02-29', '30 February 2016', ''][doc_id % 8 + 1] as day from documents")
def t5_english_dates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.english_date(_pick(_DATES, F.col("doc_id") % 8)).alias("day"))


@query("select doc_id, case doc_id % 3 when 0 then lang || '|merged_short' when 1 then 'layout_boundary|' || lang || '|merged_short' else 'unknown' end reason from documents")
def g10_reasons(spark, sf):
    k = F.col("doc_id") % 3
    a = F.when(k == 0, F.concat("lang", F.lit("|"), "lang")).when(k == 1, F.concat(F.lit("layout_boundary|"), F.col("lang")))
    return table(spark, sf, "documents").select("doc_id", T.joined_reasons(a, F.when(k < 2, F.concat(F.lit("merged_short|"), F.col("lang")))).alias("reason"))


@query("""select doc_id, 'Na_me-' || doc_id || '-' || substring(sha1('/a b/Na me-' || doc_id || '.rtf'), 1, 10) source_id from documents""")
def s5_source_ids(spark, sf):
    from terralex.sources.files import source_id

    return table(spark, sf, "documents").select("doc_id", source_id(F.concat(F.lit("/a b/Na me-"), F.col("doc_id"), F.lit(".rtf"))).alias("source_id"))


_PLACE_NAMES = ["Gemeente Delft", "provincia di Pisa (Toscana)", "Landkreis  Aalen", "Stad Utrecht, Leiden", "Rome / Milano", "Baden en Wien", " ; Essen; Bonn", ""]


@query("select c_custkey id, ['Delft', 'Pisa', 'Aalen', 'Utrecht, Leiden', 'Rome / Milano', 'Baden en Wien', '; Essen; Bonn', ''][c_custkey % 8 + 1] place from customer")
def c10_clean_places(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), C.clean_place(_pick(_PLACE_NAMES, F.col("c_custkey") % 8)).alias("place"))


@query("select c_custkey id, ['Gemeente Delft', 'provincia di Pisa (Toscana)', 'Landkreis  Aalen', 'Stad Utrecht', 'Rome', 'Baden', 'Essen', ''][c_custkey % 8 + 1] place from customer")
def c11_first_candidates(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), C.first_candidate(_pick(_PLACE_NAMES, F.col("c_custkey") % 8)).alias("place"))


@query("select c_custkey id, ['Germany', 'Austria', null, 'Italy', 'Netherlands', null][c_custkey % 6 + 1] country from customer")
def c2_country_of_id(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), C.country_of_id(_pick(["deu", " AT ", "Austria", "IT", "NLD", ""], F.col("c_custkey") % 6)).alias("country"))


@query("select o_orderkey from orders where o_orderkey not in (select o_orderkey from orders where o_orderstatus in ('F', 'P'))")
def r6_open_work(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey").join(o.where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey"), "o_orderkey", "left_anti")
