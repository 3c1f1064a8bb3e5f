"""Queries on evaluation, samples, annotation, remembered classification and vocabularies, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.operators import aggregates as A
from terralex.operators import evaluation as E
from terralex.operators import memo as M
from terralex.plans.queries import _VOCAB, _WORDS, _frame_rows, query, rounded, table

# ---- evaluation: two models on two tasks; one model fails for one task

_SAID = """said as (select doc_id sample_id, model, task, case when task = 'quality' then case when quality = 1 then 'good' else 'bad' end else lang end gold,
case when task = 'quality' then case when n_chars % (m + 3) = 0 then '__unsupported__' when n_chars > 900 + 300 * m then 'good' else 'bad' end when (doc_id + m) % 3 = 0 then 'en' else lang end prediction,
round((n_chars * (m + 1)) % 50 / 50.0, 2)::double confidence, case when m = 1 and task = 'lang' or doc_id % 17 = 0 then 'down' else '' end error, (doc_id % 10 / 4.0)::double as seconds
from documents join labels using (doc_id), (values ('m0', 0), ('m1', 1)) v(model, m), (values ('quality'), ('lang')) t(task))"""
_JUDGED = f"{_SAID}, base as (select *, error = '' and prediction <> '__unsupported__' valid from said), judged as (select *, 'all' subset from base union all select *, 'human' from base where gold in ('good', 'en'))"
_EVALUATED = f"""{_JUDGED}, wanted as (select distinct model, task, subset, label from (select distinct model, task, subset, unnest(case when task = 'quality' then ['good', 'bad'] end) label from judged union all select model, task, subset, gold from judged where task = 'lang' union all select model, task, subset, prediction from judged where task = 'lang' and valid)),
t as (select distinct model, task, subset, confidence threshold from judged union select distinct model, task, subset, unnest([0.0, 1.0])::double from judged),
total as (select model, task, subset, count(*) n_samples, avg((gold = prediction)::int) accuracy, count(*) filter (where error <> '') errors, sum(seconds) runtime_seconds, avg(seconds) mean_seconds_per_sample from judged group by all),
curve as (select model, task, subset, threshold, count(j.gold) n_accepted, count(j.gold) / any_value(n_samples)::double coverage, avg((j.gold = j.prediction)::int) acc from t join total using (model, task, subset) left join (select * from judged where valid) j using (model, task, subset) where j.gold is null or confidence >= threshold group by all),
chosen as (select * from (select *, row_number() over (partition by model, task, subset order by acc desc, coverage desc, threshold) r from curve where coverage >= 0.3 and acc is not null) where r = 1),
accepted as (select j.* from judged j join chosen c using (model, task, subset) where valid and confidence >= threshold),
f1 as (select model, task, subset, avg(coalesce(2.0 * hit / nullif(g + p, 0), 0)) macro_f1 from (select w.model, w.task, w.subset, w.label, (select count(*) from judged j where j.model = w.model and j.task = w.task and j.subset = w.subset and j.gold = w.label) g, (select count(*) from judged j where j.model = w.model and j.task = w.task and j.subset = w.subset and j.prediction = w.label) p, (select count(*) from judged j where j.model = w.model and j.task = w.task and j.subset = w.subset and j.prediction = w.label and j.gold = w.label) hit from wanted w) group by all),
f2 as (select model, task, subset, avg(coalesce(2.0 * hit / nullif(g + p, 0), 0)) accepted_macro_f1 from (select w.model, w.task, w.subset, w.label, (select count(*) from accepted j where j.model = w.model and j.task = w.task and j.subset = w.subset and j.gold = w.label) g, (select count(*) from accepted j where j.model = w.model and j.task = w.task and j.subset = w.subset and j.prediction = w.label) p, (select count(*) from accepted j where j.model = w.model and j.task = w.task and j.subset = w.subset and j.prediction = w.label and j.gold = w.label) hit from wanted w semi join accepted using (model, task, subset)) group by all),
report as (select model, task, subset, n_samples, errors, case when errors = n_samples then 'model setup failed' when threshold is not null then 'ok' else 'no threshold meets minimum coverage' end status, threshold, case when errors < n_samples then accuracy end accuracy, case when errors < n_samples then macro_f1 end macro_f1, acc accepted_accuracy, accepted_macro_f1, coalesce(coverage, 0) coverage, coalesce(n_accepted, 0) n_accepted, runtime_seconds, mean_seconds_per_sample from total left join f1 using (model, task, subset) left join chosen using (model, task, subset) left join f2 using (model, task, subset))"""


def _said(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    d = d.withColumn("v", F.explode(F.array(*(F.struct(F.lit(f"m{m}").alias("model"), F.lit(m).alias("m"), F.lit(t).alias("task")) for m in (0, 1) for t in ("quality", "lang"))))).select("*", "v.*")
    quality, n, m = F.col("task") == "quality", F.col("n_chars"), F.col("m")
    return d.select(
        F.col("doc_id").alias("sample_id"), "model", "task", F.when(quality, F.when(F.col("quality") == 1, "good").otherwise("bad")).otherwise(F.col("lang")).alias("gold"),
        F.when(quality, F.when(n % (m + 3) == 0, "__unsupported__").when(n > 900 + 300 * m, "good").otherwise("bad")).when((F.col("doc_id") + m) % 3 == 0, "en").otherwise(F.col("lang")).alias("prediction"),
        F.round(n * (m + 1) % 50 / 50, 2).alias("confidence"), F.when((m == 1) & ~quality | (F.col("doc_id") % 17 == 0), "down").otherwise("").alias("error"), (F.col("doc_id") % 10 / 4).alias("seconds"),
    )


def _report(spark, sf) -> DataFrame:
    base = _said(spark, sf).withColumn("valid", (F.col("error") == "") & (F.col("prediction") != M.UNSUPPORTED))
    judged = base.withColumn("subset", F.explode(F.when(F.col("gold").isin("good", "en"), F.array(F.lit("all"), F.lit("human"))).otherwise(F.array(F.lit("all")))))
    return E.evaluated(judged, {"quality": ["good", "bad"]}, 0.3)


@query(f"with {_EVALUATED} select model, task, subset, n_samples, errors, status, threshold, round(accuracy, 6) accuracy, round(macro_f1, 6) macro_f1, round(accepted_accuracy, 6) accepted_accuracy, round(accepted_macro_f1, 6) accepted_macro_f1, round(coverage, 6) coverage, n_accepted, round(runtime_seconds, 6) runtime_seconds, round(mean_seconds_per_sample, 6) mean_seconds_per_sample from report")
def e4_evaluated(spark, sf):
    return rounded(_report(spark, sf).select("model", "task", "subset", "n_samples", "errors", "status", "threshold", "accuracy", "macro_f1", "accepted_accuracy", "accepted_macro_f1", "coverage", "n_accepted", "runtime_seconds", "mean_seconds_per_sample"))


_METRICS = ", ".join(f"round(max(case when task = '{t}' and errors < n_samples then {m} end), 6) {t}_{c}" for t in ("quality", "lang") for c, m in (("accuracy", "accuracy"), ("f1", "macro_f1"), ("threshold", "threshold"), ("coverage", "coverage")))


@query(f"with {_EVALUATED} select model, {_METRICS}, round(sum(case when errors < n_samples then runtime_seconds end) / sum(case when errors < n_samples then n_samples end), 6) average_runtime_seconds from report where subset = 'all' group by model")
def e5_model_summary(spark, sf):
    report = _report(spark, sf).withColumn("row", F.lit(1))
    old = report.withColumns({"row": F.lit(0), "accuracy": F.lit(0.5)})
    return rounded(E.model_summary(old.union(report), {"quality": "quality", "lang": "lang"}))


@query(f"with {_SAID} select model, task, sample_id, prediction || case when sample_id % 4 = 0 then '!' else '' end prediction from said where sample_id % 9 <> 0 or model = 'm0'")
def e7_rescored(spark, sf):
    """The last of each sample's predictions."""
    said = _said(spark, sf).where("sample_id % 9 <> 0 or model = 'm0'").select("model", "task", "sample_id", "prediction", F.lit(0).alias("row"))
    again = said.where("sample_id % 4 = 0").withColumns({"row": F.lit(1), "prediction": F.concat("prediction", F.lit("!"))})
    return E.rescored(again.union(said), _samples(spark, sf))[0].select("model", "task", "sample_id", "prediction")


def _samples(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").select(F.explode(F.array(F.lit("quality"), F.lit("lang"))).alias("task"), F.col("doc_id").alias("sample_id")).distinct()


@query(f"with {_SAID} select model, task, sample_id, 'missing' problem from said where sample_id % 9 = 0 and model = 'm1'")
def e7_problems(spark, sf):
    said = _said(spark, sf).where("sample_id % 9 <> 0 or model = 'm0'").select("model", "task", "sample_id", "prediction", F.lit(0).alias("row"))
    return E.rescored(said, _samples(spark, sf))[1]


_LEVELS = "['paragraph', 'document_llm', 'country_fallback'][turn % 3 + 1]"


@query(f"with r as (select conv_id, turn, {_LEVELS} src from conversations), c as (select *, case when src <> 'paragraph' and conv_id % 2 = 0 then (conv_id % 7 + 1) / count(*) filter (where src <> 'paragraph') over (partition by conv_id)::double else 0 end document_seconds from r) select conv_id, turn, round(document_seconds, 6) document_seconds, round(0.5 + document_seconds, 6) as seconds from c")
def e10_document_seconds(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.element_at(F.array(*(F.lit(x) for x in ("paragraph", "document_llm", "country_fallback"))), (F.col("turn") % 3 + 1).cast("int")).alias("src"), F.lit(0.5).alias("seconds"))
    calls = c.where("conv_id % 2 = 0").select("conv_id").distinct().withColumn("seconds", (F.col("conv_id") % 7 + 1).cast("double"))
    return rounded(E.with_document_seconds(c, calls, "conv_id", "src").select("conv_id", "turn", "document_seconds", "seconds"))


@query("""with k as (select sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) sample_key, text, doc_id from documents where trim(text) <> ''), m as (select sample_key, min({'text': text, 'doc_id': doc_id}) m from k group by sample_key), c as (select sample_key, m.doc_id doc_id from m order by sha256('7:' || sample_key), sample_key limit 40)
select sample_key, doc_id, (row_number() over (order by sample_key))::int sample_id from c""")
def e11_blind_sample(spark, sf):
    return E.blind_sample(table(spark, sf, "documents").select("text", "doc_id"), "text", 40, 7).select("sample_key", "doc_id", "sample_id")


@query("""with s as (select 0 i, 'frame' stage, doc_id, sha256('42:' || doc_id) h from documents where lang = 'en' union all select 1, 'sentiment', doc_id, sha256('52:' || doc_id) from documents union all select 2, 'paragraph', doc_id, sha256('42:' || doc_id) from documents where n_chars > 500),
r as (select *, row_number() over (partition by i order by h, doc_id) r from s) select stage, doc_id, (row_number() over (order by i, h, doc_id))::int sample_id from r where r <= case i when 2 then 10 else 30 end""")
def e13_staged_samples(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return E.staged_samples([("frame", d.where("lang = 'en'"), 30, 42), ("sentiment", d, 30, 52), ("paragraph", d.where("n_chars > 500"), 10, 42)], "doc_id")


@query("select doc_id, case when doc_id % 3 = 0 or doc_id % 50 = 0 then 'conflict' else 'saved' end state from labels where doc_id % 2 = 0")
def e17_save_conflicts(spark, sf):
    saved = table(spark, sf, "labels").where("doc_id % 50 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).alias("updated"))
    edits = table(spark, sf, "labels").where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("updated"))
    return E.save_conflicts(saved, edits, "doc_id")


@query("select doc_id, prediction from (select doc_id, 'p' || doc_id prediction, doc_id % 2 task, doc_id % 5 = 0 failed from documents) where task = 0 and not failed")
def e20_resumable(spark, sf):
    now, old = (E.signature({"model": "m", "tries": n}, {"classify.py": "0a"}) for n in (1, 2))
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id")).alias("prediction"), F.lit("m").alias("model"), (F.col("doc_id") % 2).cast("string").alias("task"), F.when(F.col("doc_id") % 5 == 0, "failed").alias("error"))
    saved = d.withColumn("signature", F.when(F.col("task") == "0", now).otherwise(old))
    asked = spark.createDataFrame([("m", "0", now), ("m", "1", now)], "model string, task string, signature string")
    return E.resumable(saved, asked)[0].select("doc_id", "prediction")


@query("select o_orderkey, n_name from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey")
def r12_checked_joins(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = E.checked_join(o, table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), ["c_custkey"])
    return E.checked_join(c, table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).select("o_orderkey", "n_name")


# ---- tables put together


@query("""with l as (select c_nationkey unit, c_mktsegment model, max(c_acctbal) v from customer group by all) select unit, max(case when model = 'BUILDING' then v end) building, max(case when model = 'MACHINERY' then v end) machinery from l group by unit""")
def r11_wide_scores(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("unit"), F.lower("c_mktsegment").alias("model"), F.col("c_acctbal").alias("v"))
    return A.wide_scores(c, "unit", "model", "v", ["building", "machinery"])


_FRAMES = f"{_WORDS}, {_VOCAB}, hits as (select source, frame, w keyword, doc_id from documents join words using (doc_id) join vocab using (w)), fr0 as (select source, frame, count(distinct doc_id) mentions from hits group by source, frame), fr as (select *, row_number() over (partition by source order by mentions desc, frame) r from fr0), kw0 as (select source, frame, keyword, count(*) n from hits group by source, frame, keyword), kw as (select *, row_number() over (partition by source, frame order by n desc, keyword) r from kw0)"


@query(f"with {_FRAMES} select source, frame, mentions, fr.r::int as rank, keyword, n from fr left join (select * from kw where r <= 3) k using (source, frame) where fr.r <= 2")
def r10_frames_and_keywords(spark, sf):
    """The two frames of each source, each with its three keywords."""
    hits = _frame_rows(spark, sf)
    frames = A.top_per_group(hits.groupBy("source", "frame").agg(F.countDistinct("doc_id").alias("mentions")), ["source"], [F.desc("mentions"), "frame"], 2)
    words = A.top_per_group(hits.groupBy("source", "frame", "keyword").agg(F.count("*").alias("n")), ["source", "frame"], [F.desc("n"), "keyword"], 3).drop("rank")
    return frames.join(words, ["source", "frame"], "left").select("source", "frame", "mentions", "rank", "keyword", "n")


_REVIEWS = """reviews as (select s_suppkey as row, s_suppkey % 3 <> 0 inc, unnest(case s_suppkey % 4 when 0 then ['Costs'] when 1 then ['New one'] when 2 then ['Costs', 'New one'] else [] end) category, 'word' || (s_suppkey % 5) keyword from supplier)"""
_HAVE = "have(category, keyword) as (values ('Costs', 'WORD1'), ('Costs', 'price'))"
_MERGED = f"{_REVIEWS}, {_HAVE}, asked as (select * from reviews where inc), numbered as (select a.*, row_number() over (partition by a.category, keyword order by row) n, exists (select 1 from have h where h.category = a.category and lower(h.keyword) = a.keyword) old from asked a)"


def _reviews(spark, sf) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    r = table(spark, sf, "supplier").select(k.alias("row"), F.when(k % 3 != 0, "yes").otherwise("").alias("include"), F.when(k % 4 == 0, "Costs").when(k % 4 == 1, " New one ;").when(k % 4 == 2, "Costs; New one").otherwise("").alias("categories"), F.concat(F.lit("word"), k % 5).alias("keywords"))
    return spark.createDataFrame([("Costs", "WORD1"), ("Costs", "price")], "category string, keyword string"), r


@query(f"with {_MERGED} select * from have union all select category, keyword from numbered where n = 1 and not old")
def u6_vocabulary(spark, sf):
    return A.merged_vocabulary(*_reviews(spark, sf))[0]


@query(f"with {_MERGED} select row, category, keyword, case when n = 1 and not old then 'added_keyword' else 'already_present' end status from numbered union all select min(row), category, null, 'created_category' from asked where category = 'New one' group by category")
def u6_vocabulary_audit(spark, sf):
    return A.merged_vocabulary(*_reviews(spark, sf))[1]


@query("""with r as (select lang, doc_id, row_number() over (partition by lang order by doc_id) n, source from documents) select lang, '## ' || lang || chr(10) || chr(10) || string_agg('- ' || doc_id || ' from ' || source, chr(10) order by n) report from r where n <= 5 group by lang""")
def k6_markdown_report(spark, sf):
    return A.markdown_report(table(spark, sf, "documents"), "lang", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(" from "), F.col("source")))


# ---- answers of classifiers


_PLACE = """case doc_id % 5 when 0 then '{"location": " Delft ", "granularity": "City", "confidence": 0.8, "reasoning_short": "named"}' when 1 then 'Well: {"location": "none", "granularity": "city", "confidence": 2} ok' when 2 then '{"location": "Mars", "granularity": "planet", "confidence": "x"}' when 3 then 'no idea' else '{"location": "Italia", "granularity": "country"}' end"""


@query("""select doc_id, case doc_id % 5 when 0 then 'Delft' when 4 then 'Italia' else 'NONE' end as location, case doc_id % 5 when 0 then 'city' when 4 then 'country' else 'none' end granularity, (case doc_id % 5 when 0 then 0.8 when 1 then 1.0 else 0 end)::double confidence, case doc_id % 5 when 0 then 'named' when 3 then 'Invalid JSON.' else '' end reasoning, case doc_id % 5 when 3 then 'error' else 'ok' end status from documents""")
def m2_parse_location(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.parsed_location(F.expr(_PLACE)).alias("p")).select("doc_id", "p.*")


@query("""with h as (select doc_id, lang, e'["small", false]\\nGermany\\n' || lang || e'\\n{"strong": ["a", "b"]}\\n' || coalesce(text, '') k from documents) select doc_id, sha256(k) as key from h""")
def m1_topic_key(spark, sf):
    d = table(spark, sf, "documents")
    key = None
    for lang in ("de", "en", "es", "fr"):
        one = F.when(F.col("lang") == lang, M.topic_key(F.col("text"), "small", "Germany", lang, {"strong": ["a", "b"]}))
        key = one if key is None else F.coalesce(key, one)
    other = M.fingerprint(F.lit('["small", false]'), F.lit("Germany"), F.col("lang"), F.lit('{"strong": ["a", "b"]}'), F.col("text"))
    return d.select("doc_id", F.coalesce(key, other).alias("key"))


_ASPECTS = """case doc_id % 4 when 0 then '{"is_opinion": true, "aspects": [{"phrase": " low cost ", "category": "Costs", "polarity": "Positive", "certainty": "0.9"}, {"phrase": "", "category": "costs"}, {"phrase": "noise", "category": "odd", "polarity": "angry", "certainty": 7}]}' when 1 then '{"is_opinion": false, "aspects": [{"phrase": "x"}]}' when 2 then 'none' else 'So {"is_opinion": true, "aspects": []}' end"""


@query("""select doc_id, phrase, category, polarity, certainty::double certainty from documents join (values (0, 'low cost', 'costs', 'positive', 0.9), (0, 'noise', 'other', 'neutral', 1.0)) v(k, phrase, category, polarity, certainty) on doc_id % 4 = k""")
def m9_aspects(spark, sf):
    a = M.aspects(F.expr(_ASPECTS), ["costs", "noise"])
    return table(spark, sf, "documents").select("doc_id", F.explode(a).alias("a")).select("doc_id", "a.*")


@query("""select doc_id, phrase, polarity from documents left join (values (0, 'a', 'positive'), (0, 'b', null), (1, 'c', 'negative')) v(k, phrase, polarity) on doc_id % 3 = k""")
def m10_zipped_aspects(spark, sf):
    k = F.col("doc_id") % 3
    empty = F.array().cast("array<string>")
    d = table(spark, sf, "documents").select("doc_id", F.when(k == 0, F.array(F.lit("a"), F.lit("b"))).when(k == 1, F.array(F.lit("c"))).otherwise(empty).alias("phrase"), F.when(k == 0, F.array(F.lit("positive"))).when(k == 1, F.array(F.lit("negative"))).otherwise(empty).alias("polarity"))
    return M.zipped_aspects(d, ["phrase", "polarity"], ["doc_id"])


@query("""with p as (select doc_id, unnest(['1', '2', 'Neutral', '4', 'very positive']) l, unnest([n_chars % 7, n_chars % 5, n_chars % 11, n_chars % 3, n_chars % 13]) v from documents), s as (select doc_id, case when l in ('1', '2') then 'negative' when l = 'Neutral' then 'neutral' else 'positive' end prediction, sum(v) v from p group by all), r as (select *, row_number() over (partition by doc_id order by v desc, prediction) r from s) select doc_id, prediction, round(v / 40.0, 6) confidence from r where r = 1""")
def m11_collapsed_classes(spark, sf):
    n = F.col("n_chars")
    five = F.explode(F.array(*(F.struct(F.lit(label).alias("label"), (n % m).alias("v")) for label, m in (("1", 7), ("2", 5), ("Neutral", 11), ("4", 3), ("very positive", 13)))))
    rows = table(spark, sf, "documents").select("doc_id", five.alias("p")).select("doc_id", "p.*")
    return rounded(M.collapsed(rows, "doc_id", "label", "v").withColumn("confidence", F.col("confidence") / 40))


@query("""select doc_id, ['positive', 'negative', 'neutral', 'neutral', null][doc_id % 5 + 1] sentiment from documents""")
def m13_sentiment_name(spark, sf):
    said = F.element_at(F.array(*(F.lit(x) for x in (" Pos", "NEGATIVE", "neu ", "neutral-uncertain", "mixed"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", M.sentiment_name(said).alias("sentiment"))


_RESPONSES = [
    ('{"sentiment": "Positive", "confidence": "0.9"} x', "positive", 0.9, "ok"), ('say {"a": "}", "sentiment": "NEGATIVE", "confidence": 3}', "negative", 1.0, "ok"), ("I cannot say", "neutral", 0.0, "ok"),
    ("rather positive than negative", "negative", 0.0, "ok"), ("???", None, 0.0, "error"), ('{"sentiment": "odd"} neutral', "neutral", 0.0, "ok"), ('{"sentiment": "neutral", "confidence": []}', "neutral", 0.0, "ok"),
]


@query(f"select doc_id, label, confidence::double confidence, status from documents join (values {', '.join(f'({i}, {repr(a) if a else "null"}, {b}, {s!r})' for i, (_, a, b, s) in enumerate(_RESPONSES))}) v(k, label, confidence, status) on k = doc_id % {len(_RESPONSES)}")
def m5_sentiment_responses(spark, sf):
    raw = F.element_at(F.array(*(F.lit(r) for r, *_ in _RESPONSES)), (F.col("doc_id") % len(_RESPONSES) + 1).cast("int"))
    return M.parsed_sentiments(table(spark, sf, "documents").select("doc_id", raw.alias("raw")), "raw").drop("raw")


# ---- annotation


@query("""with r as (select lang, doc_id, sha256('42:' || doc_id) h, row_number() over (partition by lang order by sha256('42:' || doc_id), doc_id) > 10 extra from documents), c as (select * from r order by extra, h, doc_id limit 60) select lang, doc_id, (row_number() over (order by sha256('43:' || doc_id), doc_id))::int sample_id from c""")
def e14_topped_up_sample(spark, sf):
    return E.topped_up_sample(table(spark, sf, "documents").select("lang", "doc_id"), "doc_id", "lang", 10, 60)


@query("""select s_suppkey id, unnest(case when s_suppkey <= 4 then ['ann', 'bob'] when s_suppkey % 2 = 1 then ['ann'] else ['bob'] end) rater from supplier""")
def e14_shared_assignment(spark, sf):
    return E.shared_assignment(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), "id", ["ann", "bob"], 4)


@query("""with j as (select n_regionkey, arg_max(n_nationkey % 2, n_nationkey) d, count(distinct n_nationkey % 2) n, arg_max(n_nationkey, n_nationkey) seen from nation where n_nationkey % 5 <> n_regionkey and n_nationkey % 2 = n_regionkey % 2 group by n_regionkey)
select n_nationkey, case when n = 1 then d end decision, coalesce(n > 1, false) conflict, coalesce(n = 1 and seen <> n_nationkey, false) stale from nation left join j using (n_regionkey)""")
def e18_expanded_judgements(spark, sf):
    n = table(spark, sf, "nation").withColumn("seen", F.col("n_nationkey"))
    said = n.where("n_nationkey % 5 <> n_regionkey and n_nationkey % 2 = n_regionkey % 2").select("n_regionkey", (F.col("n_nationkey") % 2).alias("decision"), "seen", F.col("n_nationkey").alias("updated"))
    return E.expanded_judgements(n, said, "n_regionkey", "seen").select("n_nationkey", "decision", "conflict", "stale")


@query("""select coalesce(a.doc_id, b.doc_id) doc_id, case when b.doc_id is null then 'new' when a.doc_id is null then 'gone' else 'changed' end problem from (select doc_id, quality, toxic from labels where doc_id % 10 <> 1) a full join (select doc_id, case when doc_id % 4 = 0 then 9 else quality end quality, toxic from labels where doc_id % 10 <> 2) b using (doc_id) where a.doc_id is null or b.doc_id is null or a.quality is distinct from b.quality""")
def e8_changed_rows(spark, sf):
    lab = table(spark, sf, "labels")
    then = lab.where("doc_id % 10 <> 2").withColumn("quality", F.when(F.col("doc_id") % 4 == 0, 9).otherwise(F.col("quality")))
    return E.changed_rows(lab.where("doc_id % 10 <> 1"), then, "doc_id", ["quality", "toxic"])


@query("""select c_nationkey, arg_min(c_custkey, {'r': case c_custkey % 3 when 0 then 99 when 1 then 1 else 0 end, 'k': c_custkey}) c_custkey from customer group by c_nationkey""")
def p5_one_geometry(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 3 == 1, "points").when(F.col("c_custkey") % 3 == 2, "polygons").otherwise("lines").alias("layer"))
    return A.one_geometry(c, "c_nationkey", "layer", "c_custkey").select("c_nationkey", "c_custkey")


@query("""with h as (select distinct o_custkey from orders) select 'input' kind, count(*) n from customer union all select 'assigned', count(*) from customer where c_custkey in (select o_custkey from h) union all select 'unassigned', count(*) from customer where c_custkey not in (select o_custkey from h)""")
def j15_audit(spark, sf):
    return A.assignment_audit(table(spark, sf, "customer"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")

