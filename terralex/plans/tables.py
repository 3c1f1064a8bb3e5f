"""Queries on result tables in their full forms: matrices, stacked figures, tracking, wide rankings, monthly shares; each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralex.functions import text as T
from terralex.operators import aggregates as A
from terralex.operators import segment as G
from terralex.plans.queries import FRAMES, _BAL, _EXTREMES, _FRAMED, _MORE, _REGIONS, _UNITS, _VOCAB, _WORDS, _frame_rows, _mentioned, _regions, framed, frames_of, query, rounded, table, units

_ORDER = ", ".join(f"('{f}', {i + 1})" for i, f in enumerate(FRAMES))


@query(f"with {_FRAMED}, {_REGIONS}, {_EXTREMES.format(tail=1)}, pair as (select * from ext where (select count(*) from ext) = 2), c as (select frame, count(*) filter (where role = 'low') low, count(*) filter (where role = 'high') high from framed join pair using (lang, source) group by frame), o(frame, position) as (values {_ORDER}), d as (select frame, position, coalesce(low, 0)::bigint low, coalesce(high, 0)::bigint high from o left join c using (frame)) select frame, position, low, high, round(coalesce(100.0 * low / nullif(sum(low) over (), 0), 0), 6) low_share, round(coalesce(100.0 * high / nullif(sum(high) over (), 0), 0), 6) high_share from d")
def a15_extreme_matrix(spark, sf):
    pair = A.extreme_pair(_regions(spark, sf), ["lang", "source"])
    return rounded(A.extreme_matrix(_mentioned(spark, sf), pair, ["lang", "source"], "frame", list(FRAMES)))


@query(f"with {_UNITS}, a as (select case when doc_id % 3 = 0 then lang else source end area, sentiment from units), b as (select area, {_BAL} from a group by area) select area, n_units, round(100.0 * n_pos / n_units - 100.0 * n_neg / n_units, 6) balance from b")
def a19_map_scores(spark, sf):
    """Regions by code where they have one, else by name."""
    return rounded(A.map_scores(units(spark, sf).withColumn("code", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(" ")), "code", "source"))


@query("with m as (select count(*) a, count(o_orderdate) b, min(year(o_orderdate)) c, max(year(o_orderdate)) d, count(distinct o_custkey) e from orders) select unnest(['articles', 'dated', 'first_year', 'last_year', 'newspapers']) metric, unnest([a, b, c, d, e])::varchar as value from m")
def a24_summary_metrics(spark, sf):
    year = F.year("o_orderdate")
    return A.stacked(table(spark, sf, "orders"), {"articles": F.count("*"), "dated": F.count("o_orderdate"), "first_year": F.min(year), "last_year": F.max(year), "newspapers": F.countDistinct("o_custkey")})


_LANGS = ["de", "en", "es", "fr"]
_STEPS = ["raw", "unique", "with text", "of length", "long", "labelled", "good", "civil", "sentences", "frames"]
_TRACKED = f"""flags as (select d.doc_id, d.lang, sha256(coalesce(d.text, '')) k, d.text, len(list_filter(string_split_regex(coalesce(d.text, ''), '\\s+'), lambda x: x <> '')) words, n_chars, quality, toxic, (select count(distinct frame) from words w join vocab using (w) where w.doc_id = d.doc_id) nf from documents d left join labels using (doc_id)),
w as (select lang, k, unnest({_STEPS}) as name, unnest(range(1, 11))::int step, unnest([1, 1, (trim(coalesce(text, '')) <> '')::int, (words between 20 and 499)::int, coalesce(n_chars > 1000, false)::int, (quality is not null)::int, coalesce(quality = 1, false)::int, coalesce(toxic = 0, false)::int, words, nf]) n from flags)"""
_CELLS = ", ".join(f"(sum(n) filter (where lang = '{g}'))::bigint {g}_rows, (count(distinct k) filter (where lang = '{g}' and n > 0))::bigint {g}_documents" for g in _LANGS)


@query(f"with {_WORDS}, {_VOCAB}, {_TRACKED} select step, name, " + ", ".join(f"coalesce({g}_rows, 0) {g}_rows, {g}_documents" for g in _LANGS) + f" from (select step, name, {_CELLS} from w group by all)")
def a25_tracking(spark, sf):
    """Ten steps by language: rows and distinct documents, in one pass."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left").withColumn("body_hash", F.sha2(T.or_empty(F.col("text")), 256))
    words = T.blank_words(F.col("text"))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    weights = [F.lit(1), F.lit(1), yes(F.trim(T.or_empty(F.col("text"))) != ""), yes((words >= 20) & (words < 500)), yes(F.col("n_chars") > 1000), yes(F.col("quality").isNotNull()), yes(F.col("quality") == 1), yes(F.col("toxic") == 0), words, F.size(frames_of(F.col("text")))]
    key = A.document_key(d, ["document_id", "body_hash"], ["source", "lang"])
    return A.tracked(d, key, "lang", _LANGS, dict(zip(_STEPS, weights, strict=True)))


@query("select count(*) n, round(avg(n_chars), 6) mean, round(median(n_chars), 6) as median, round(quantile_cont(n_chars, 0.9), 6) p90, round(quantile_cont(n_chars, 0.95), 6) p95, round(quantile_cont(n_chars, 0.99), 6) p99, max(n_chars) longest, round(greatest(20, quantile_cont(n_chars, 0.99)), 6) threshold from documents")
def a28_outlier_threshold(spark, sf):
    return rounded(A.outliers(table(spark, sf, "documents"), "doc_id", "n_chars")[0])


@query("select doc_id, n_chars from documents order by n_chars desc nulls last, doc_id limit 10")
def a28_longest_documents(spark, sf):
    return A.outliers(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars")[1]


@query("""with m as (select strftime(o_orderdate, '%Y-%m') as month, count(*) total from orders group by 1), p as (select *, 100.0 * total / sum(total) over () pct from m), s as (select *, count(*) over w c, avg(pct) over w a, sum(total) over (partition by month[1:4]) y from p window w as (order by month rows between 5 preceding and 4 following)) select month, total, round(pct, 6) pct, round(case when c = 10 then a end, 6) smooth, y::bigint year_total from s""")
def a31_monthly_shares(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("total"))
    return rounded(A.monthly(m, "month", "total")).select("month", "total", "pct", "smooth", "year_total")


@query(f"with {_FRAMED}, c as (select source, frame, count(*) n from framed group by all), r as (select *, row_number() over (partition by source order by n desc, frame) r from c) select source, max(frame) filter (where r = 1) rank_1, max(frame) filter (where r = 2) rank_2, max(frame) filter (where r = 3) rank_3 from r group by source")
def a34_top_frames_wide(spark, sf):
    top = A.top_per_group(A.mentions(framed(spark, sf), ["source"], "frames"), ["source"], [F.desc("mentions"), "frame"], 3)
    return A.ranked_wide(top, ["source"], "frame", 3)


_WIDE = ", ".join(f"max(label) filter (where r = {i}) rank_{i}" for i in range(1, 11))


@query(f"with {_WORDS}, {_VOCAB}, h as (select frame, w keyword, doc_id from words join vocab using (w)), n as (select frame, keyword, count(distinct doc_id) n from h group by all), t as (select frame, count(distinct doc_id) total from h group by frame), r as (select frame, keyword || ' (' || format('{{:.1f}}', round(100.0 * n / total, 1)) || '%)' as label, row_number() over (partition by frame order by n desc, keyword) r from n join t using (frame)) select frame, {_WIDE} from r group by frame")
def a35_keywords_wide(spark, sf):
    return A.keywords_wide(_frame_rows(spark, sf), "frame", "keyword", "doc_id")


@query(f"with {_UNITS}, {_REGIONS} select source, {_MORE} from (select source, {_BAL} from units where upper(case when sentiment = 'neutral' then 'no' else 'yes' end) = 'YES' group by source)")
def p3_labelled_only(spark, sf):
    rows = units(spark, sf).withColumn("answer", F.when(F.col("sentiment") == "neutral", "no").otherwise("yes")).where(F.upper("answer") == "YES")
    return rounded(A.balances(rows, ["source"]))


@query(r"""with s as (select doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+([A-ZÀ-ÖØ-Ý])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '') ss from documents where text is not null and doc_id % 3 <> 2)
select doc_id, i::int sentence_id, trim(ss[i]) sentence_text from (select doc_id, ss, unnest(range(1, len(ss)+1)) i from s)""")
def g12_placed_sentences(spark, sf):
    """Sentences of documents with a point or a polygon; a third has neither."""
    k = F.col("doc_id") % 3
    d = table(spark, sf, "documents").where("text is not null").withColumns({"point": F.when(k == 0, "POINT (1 2)").otherwise(" "), "polygon": F.when(k == 1, "POLYGON (())")})
    return G.placed_sentences(d, "text", ["doc_id"], "point", "polygon").select("doc_id", "sentence_id", "sentence_text")
