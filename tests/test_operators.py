import difflib
import json
import random
import struct
import zipfile
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terralex.functions import text as T
from terralex.functions.geo import box, centroid, dissolved, polygon_wkt
from terralex.operators import aggregates as A
from terralex.operators import countries as C
from terralex.operators import evaluation as E
from terralex.operators import memo as M
from terralex.operators import segment as G
from terralex.operators import spatial as S
from terralex.sources import files as W
from terralex.sources.files import rtf_text, sniffed_separator
from terralex.streaming.incremental import new_bodies, remember


def test_threshold_choice(spark):
    rows = [("YES", "YES", 0.9), ("YES", "YES", 0.9), ("YES", "YES", 0.9), ("YES", "NO", 0.1), ("NO", "NO", 0.8)]
    df = spark.createDataFrame(rows, "gold string, predicted string, confidence double")
    curve = E.threshold_curve(df)
    assert E.chosen_threshold(curve, 0.8).first()["threshold"] == 0.8
    assert E.chosen_threshold(curve, 1.0).first()["threshold"] == 0.0


def test_absent_class_counts_as_zero(spark):
    df = spark.createDataFrame([("YES", "YES")], "gold string, predicted string")
    assert E.scores(df, [], ["YES", "NO"]).first()["macro_f1"] == 0.5


def test_frame_shares_and_empty_lists(spark):
    df = spark.createDataFrame([("A", "Operational risk;Costs"), ("A", "Costs"), ("B", ""), ("B", " ; "), ("B", None)], "region string, frames string")
    counts = A.mentions(df.withColumn("f", T.listed(F.col("frames"))), ["region"], "f")
    shares = {(r["region"], r["frame"]): r["share"] for r in A.dense_shares(counts, "region", "frame", ["Operational risk", "Costs"]).collect()}
    assert round(shares["A", "Costs"], 2) == 66.67 and ("B", "Costs") not in shares


def test_extremes_are_disjoint(spark):
    df = spark.createDataFrame([(r, float(b), 500) for r, b in zip("ABCDEFG", range(-30, 40, 10), strict=True)], "region string, balance double, n_units long")
    got = {(r["role"], r["rank"]): r["region"] for r in A.extremes(df, ["region"]).collect()}
    assert [got["low", i] for i in (1, 2, 3)] == ["A", "B", "C"] and [got["high", i] for i in (1, 2, 3)] == ["G", "F", "E"]


def test_countries(spark):
    df = spark.createDataFrame([("DACH", "country"), ("Deutschland", "country"), ("Italia und NLD", "country"), ("Delft", "city"), (None, "country")], "loc string, gran string")
    got = [(r["country_assignment"], r["country"]) for r in C.assign_country(df, "loc", "gran").collect()]
    assert got == [("multiple_countries", None), ("single_country", "Germany"), ("multiple_countries", None), ("not_country_level", None), ("no_country", None)]


def test_document_fallback(spark):
    df = spark.createDataFrame([("a", 1, "Delft", "city"), ("a", 2, "NONE", "none"), ("b", 1, "NONE", "none")], "document string, row_order int, location string, granularity string")
    got = {(r["document"], r["row_order"]): (r["location"], r["location_source"]) for r in C.document_fallback(df, ["Netherlands"]).collect()}
    assert got == {("a", 1): ("Delft", "paragraph"), ("a", 2): ("Delft", "document_single_location"), ("b", 1): ("Netherlands", "country_fallback")}


def test_points(spark):
    areas = {"Pisa": [box(10, 42, 11, 44)], "Siena": [box(11, 42, 12, 44)], "hole": [box(0, 0, 10, 10), box(4, 4, 6, 6)]}
    pts = spark.createDataFrame([(1, 10.5, 43.0), (2, 11.5, 43.0), (3, 5.0, 5.0), (4, 1.0, 1.0), (5, 50.0, 50.0)], "point int, x double, y double")
    assert {(r["point"], r["area"]) for r in S.points_in_areas(pts, S.edge_table(spark, areas)).collect()} == {(1, "Pisa"), (2, "Siena"), (4, "hole")}
    assert centroid(box(0, 0, 2, 4)) == (1.0, 2.0)


def test_fuzzy_suggestions_equal_difflib(spark):
    random.seed(6)
    names = ["essen", "esben", "breda", "bruda", "lodi", "lordi", "abcd", "abxcd", "ab", "axb", "a", ""]
    names += ["".join(random.choices("aelnort", k=random.randint(2, 8))) for _ in range(120)]
    names = sorted(set(names))
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for cutoff in (0.78, 0.6):
        want = {(n, s) for n in names for s in difflib.get_close_matches(n, [x for x in names if x != n], 999, cutoff)}
        assert {(r["name"], r["suggestion"]) for r in S.fuzzy_suggestions(df, df, 999, cutoff).collect()} == want


def test_memo_calls_once_for_each_key(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, "b")], "id int, text string")
    cache = spark.createDataFrame([], "key string, value string, seq long")
    calls = spark.sparkContext.accumulator(0)

    def shout(texts):
        calls.add(len(texts))
        return [x.upper() for x in texts]

    rows, new = M.memo_classify(df, "text", M.fingerprint(F.lit("m"), F.col("text")), cache, shout, str(tmp_path / "a"))
    assert new.count() == 2
    assert {(r["id"], r["raw"], r["status"]) for r in rows.collect()} == {(1, "A", "ok"), (2, "A", "ok"), (3, None, "empty"), (4, "B", "ok")}
    assert calls.value == 2
    _, again = M.memo_classify(df, "text", M.fingerprint(F.lit("m"), F.col("text")), new, lambda xs: 1 / 0, str(tmp_path / "b"))
    assert again.count() == 0


def test_memo_keeps_errors_of_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "slow")], "id int, text string")
    cache = spark.createDataFrame([], "key string, value string, seq long")
    tried = spark.sparkContext.accumulator(0)

    def fussy(texts):
        if texts == ["slow"]:
            tried.add(1)
            raise M.Passing("later")
        if texts == ["bad"]:
            raise ValueError("no")
        return texts

    rows, new = M.memo_classify(df, "text", F.sha2("text", 256), cache, fussy, str(tmp_path / "a"), wait=(0.0, 0.0))
    got = {r["id"]: (r["status"], r["error"]) for r in rows.collect()}
    assert got == {1: ("ok", None), 2: ("error", "ValueError: no"), 3: ("error", "Passing: later")} and new.count() == 1 and tried.value == 3
    again, _ = M.memo_classify(df, "text", F.sha2("text", 256), new, lambda xs: xs, str(tmp_path / "b"))
    assert {r["status"] for r in again.collect()} == {"ok"}


def test_sentiment_responses():
    assert M.sentiment_of('x {"sentiment": "Negative", "confidence": 3} y') == ("negative", 1.0, "ok")
    assert M.sentiment_of('{"error": "No sentence provided."}')[0] == "neutral"
    assert M.sentiment_of("???") == (None, 0.0, "error")


def test_segmentation_keeps_all_words():
    text = "A heading\n\n" + " ".join(f"Word{i} is here." for i in range(200)) + "\n\nshort end"
    for embed in (None, lambda xs: [[1.0, float(i % 3)] for i, _ in enumerate(xs)], lambda xs: 1 / 0):
        parts = G.paragraphs_of(text, embed)
        assert " ".join(p.text for p in parts).split() == text.split() and all(len(p.text.split()) <= 200 for p in parts)
        assert parts[0].reasons[0] == "heading_attached"


def test_paragraphs_split_where_the_content_shifts():
    text = " ".join(f"Sea water is wet and number {i} is deep blue today." for i in range(10)) + " " + " ".join(f"Hills are dry and stone {i} lies on a green meadow." for i in range(10))
    parts = G.paragraphs_of(text, lambda xs: [[1.0, 0.0] if "Sea" in x else [0.0, 1.0] for x in xs])
    assert [("Sea" in p.text, "Hills" in p.text) for p in parts if p.reasons[0] == "semantic_topic_shift"] == [(False, True)] * 2
    assert parts[0].reasons == ("layout_boundary", "max_length_constraint") and not any("Sea" in p.text and "Hills" in p.text for p in parts)
    assert next(p.before for p in parts if "semantic_topic_shift" in p.reasons) == 0.0


def test_short_paragraphs_join():
    text = "One short line of text.\n\nAnother short one follows here.\n\n" + "Words are here and there. " * 20
    assert len(G.paragraphs_of(text)) > 1 and "merged_short" in G.paragraphs_of(text)[0].reasons
    alone = " ".join(["word"] * 30) + "."
    assert [p.text for p in G.paragraphs_of(f"{alone}\n\n{alone}")] == [alone, alone]


def test_layout_blocks():
    text = "A head\nThe first line ends.\nNext begins here and hyphen-\nated words join\nlower goes on\nCopyright 2020\nSee https://a.b\nMore text"
    assert [(p.text, p.reasons[0]) for p in G.layout_blocks(text)] == [
        ("A head", "layout_boundary"), ("The first line ends.", "single_newline_layout_boundary"),
        ("Next begins here and hyphenated words join lower goes on", "single_newline_layout_boundary"), ("See https://a.b More text", "layout_boundary"),
    ]


def test_dates_and_text(spark):
    df = spark.createDataFrame([("maandag 5 mei 2020", "Dr. Who came. It rained."), ("5. März 2021", ""), ("nonsense", None)], "d string, t string")
    got = df.select(T.parsed_date(F.col("d")).cast("string").alias("d"), T.guarded_sentence_list(F.col("t")).alias("s")).collect()
    assert [r["d"] for r in got] == ["2020-05-05", "2021-03-05", None] and got[0]["s"] == ["Dr. Who came.", "It rained."]


def test_finished_rows_replace_the_old_result(spark, tmp_path):
    path = str(tmp_path / "out")
    done, open_ = (spark.createDataFrame([(1, s)], "id int, status string") for s in ("ok", "error"))
    W.write_finished(done, path, "status")
    with pytest.raises(ValueError, match="1 rows are unfinished"):
        W.write_finished(open_, path, "status")
    assert spark.read.csv(path, header=True).count() == 1
    W.write_finished(done.union(done), path, "status")
    assert spark.read.csv(path, header=True).count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A b.RTF").write_bytes(rb"{\rtf1 Hello}")
    (tmp_path / "c.pdf").write_bytes(b"%PDF one|Page 1 of 2|two")
    (tmp_path / "doclist.rtf").write_bytes(b"{}")
    got = {r["relative_path"]: (r["folder"], r["text"], r["source_id"][:-10]) for r in W.exports(spark, str(tmp_path), lambda b: b[5:].decode().replace("|", "\n").split("\n\n")).collect()}
    assert got == {"sub/A%20b.RTF": ("sub", "Hello", "A_20b-"), "c.pdf": ("", "one\ntwo", "c-")} or {k.replace("%20", " ") for k in got} == {"sub/A b.RTF", "c.pdf"}
    (tmp_path / "cache.jsonl").write_text('{"key": "a||nl", "status": "ok", "result": {"lat": "1", "lon": 2}}\nbroken\n{"key": "a||nl", "status": "ok", "provider": "p", "result": {"lat": 3, "lon": 4}}\n{"query": "b", "country_codes": "nl", "status": "error"}\n{"query": " b ", "country_codes": "nl", "status": "ok", "result": {"lat": 5, "lon": 6, "disp": "B"}}\n')
    assert {(r["key"], r["lat"], r["provider"]) for r in W.geocoder_cache(spark, [str(tmp_path / "cache.jsonl")]).collect()} == {("a||nl", 3.0, "p"), ("b||nl", 5.0, "geocoder")}
    (tmp_path / "o.csv").write_text("location,action\nHill,ignore\n")
    (tmp_path / "empty.csv").write_text("")
    assert [tuple(r) for r in W.override_table(spark, str(tmp_path / "o.csv"), ["location", "action", "lat"]).collect()] == [("Hill", "ignore", "")]
    assert W.override_table(spark, str(tmp_path / "empty.csv"), ["location"]).count() == 0
    assert W.many_csv(spark, [str(tmp_path / "o.csv"), str(tmp_path / "empty.csv"), str(tmp_path / "none.csv")], "location string, action string").count() == 1
    area = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    shapes = [{"properties": {"CNTR_CODE": c, "LEVL_CODE": lv, "NUTS_ID": i, "NUTS_NAME": i}, "geometry": g} for c, lv, i, g in (("IT", 3, "ITI17", area), ("IT", 2, "ITI1", area), ("DE", 3, "DE1", area), ("IT", 3, "ITX", None))]
    (tmp_path / "s.geojson").write_text(json.dumps({"features": shapes}))
    assert [r["id"] for r in W.features(spark, [str(tmp_path / "s.geojson")], expected=1).collect()] == ["ITI17"]
    with pytest.raises(ValueError, match="expected 107"):
        W.features(spark, [str(tmp_path / "s.geojson")], expected=107)
    assert W.merged_patterns(["a"], "b\n# c\n\na\n", ["d", "b"]) == ["a", "b", "d"]
    assert W.lexicon("strong: [a, ' a ']\ncontextual: []\ncompeting: [c]")["strong"] == ["a"]
    W.append_lines(spark.createDataFrame([("k", "v")], "key string, value string"), str(tmp_path / "log"))
    W.append_lines(spark.createDataFrame([("k", "w")], "key string, value string"), str(tmp_path / "log"))
    assert W.json_cache(spark, [str(tmp_path / "log")], "string").count() == 2
    with zipfile.ZipFile(tmp_path / "nl.zip", "w") as z:
        z.writestr("NL.txt", "1\tDelft\tDelft\t\t52.0\t4.4\tP\tPPL\tNL" + "\t" * 10 + "\n2\tNowhere" + "\t" * 17 + "\n")
    assert [r["name"] for r in W.gazetteer(spark, [str(tmp_path / "nl.zip")]).collect()] == ["Delft"]
    assert [tuple(r) for r in W.decimal_comma(spark.createDataFrame([(0.5, 1)], "a double, b int")).collect()] == [("0,5", 1)]


def test_boundaries_with_a_supplement(spark, tmp_path):
    wkb = struct.pack("<BIII", 1, 3, 1, 4) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0)
    kind = "country_id string, parent_id string, parent_name string, parent_subtype string, shape_class string, parent string, geometry binary"
    row = lambda c, i, lv: (c, i, i, lv, "land", "nuts", wkb)
    spark.createDataFrame([row("NLD", "NL33", "2"), row("NLD", "NL333", "3"), row("ITA", "ITI1", "2")], kind).write.parquet(str(tmp_path / "s.parquet"))
    with pytest.raises(ValueError, match="ITA"):
        W.boundaries(spark, [str(tmp_path / "s.parquet")])
    spark.createDataFrame([row("ITA", "ITI17", "3")], kind).write.parquet(str(tmp_path / "s_italian_nuts3.parquet"))
    got = W.boundaries(spark, [str(tmp_path / "s.parquet")]).collect()
    assert {r["parent_id"]: r["rings"] for r in got} == {i: [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]] for i in ("NL33", "ITI17")}


def test_layers_are_written_apart(spark, tmp_path):
    W.write_layers(spark.createDataFrame([(1, "POINT (1 2)", None), (2, "POINT (1 2)", "POLYGON (())"), (3, "", "")], "id int, p string, q string"), str(tmp_path / "l"), "p", "q")
    assert [[r["id"] for r in spark.read.parquet(str(tmp_path / "l" / d)).collect()] for d in ("points", "polygons")] == [[1], [2]]


def test_a_merge_with_conflicts_changes_nothing(spark):
    base, ours, theirs = (spark.createDataFrame([(1, a), (2, b)], "k int, v int") for a, b in ((0, 0), (1, 0), (0, 5)))
    assert {(r["k"], r["v"]) for r in E.whole_merge(base, ours, theirs, "k", "v").collect()} == {(1, 1), (2, 5)}
    with pytest.raises(ValueError, match="1 rows"):
        E.whole_merge(base, ours, spark.createDataFrame([(1, 7), (2, 5)], "k int, v int"), "k", "v")


def test_geometry():
    two = [box(0, 0, 1, 1), box(2.1234567, 0, 3, 1)]
    assert polygon_wkt(two).startswith("MULTIPOLYGON") and "2.1234567" in polygon_wkt(two)
    assert polygon_wkt([box(0, 0, 10, 10), box(4, 4, 6, 6)]).startswith("POLYGON ((0")
    merged = dissolved({"a": [box(0, 0, 1, 1)], "b": [box(1, 0, 2, 1)]}, {"a": "x", "b": "x"})["x"]
    assert sum(abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False)) / 2) for r in merged) == 2.0


def test_scope_of_countries():
    assert C.scope_of({"country_scope": {"countries_by_language": {"german": "DACH"}}}, "german") == ["Germany", "Austria", "Switzerland"]
    assert C.scope_of({"countries": {"dutch": ["Nederland"]}}, "dutch") == ["Netherlands"] and C.scope_of({"country": "Italy, Austria"}) == ["Austria", "Italy"]


def test_balanced_assignment(spark):
    rows = E.balanced_assignment(spark.range(10_001), "id", ["a", "b", "c"]).collect()
    assert Counter(r["rater"] for r in rows) == {"a": 3334, "b": 3334, "c": 3333}
    assert sorted(rows, key=lambda r: r["id"]) == sorted(rows, key=lambda r: (r["rater"], r["id"]))


def test_buckets_are_stable(spark):
    rows = spark.createDataFrame([("a",), ("uid-17",), ("ü",)], "uid string").select("uid", E.bucket("uid").alias("b")).collect()
    assert all(r["b"] == zlib.crc32(r["uid"].encode()) % 100 for r in rows)


def test_a_repeated_key_fails(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="repeated keys"):
        E.checked_join(a.select("k"), a, ["k"]).count()


def test_a_stream_classifies_new_bodies_once(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 01:00:00"), (3, "b", "2024-01-01 02:00:00")]
    docs = spark.createDataFrame(rows, "id int, text string, at string").selectExpr("id", "text", "to_timestamp(at) at")
    docs.write.parquet(str(tmp_path / "in"))
    cache = str(tmp_path / "cache")
    for n in (2, 3):
        stream = new_bodies(spark, str(tmp_path / "in"), "id int, text string, at timestamp", "text", "at")
        remember(stream, cache, str(tmp_path / "check"), lambda df: df.select("body_hash", "text")).awaitTermination()
        assert spark.read.parquet(cache).count() == n
        docs.where("id = 3").selectExpr("4 id", "'c' text", "at").write.mode("append").parquet(str(tmp_path / "in"))


def test_sources():
    assert rtf_text(rb"{\rtf1{\fonttbl{\f0 Arial;}}Caf\'e9\par Body}") == "Café\nBody" and sniffed_separator("a;b;c") == ";"
