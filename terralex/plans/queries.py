"""Named queries over the driver's tables, each with SQL that gives the same rows.

Text units are documents; sentiment comes from labels (toxic: negative, good quality: positive, else
neutral), language is the country and source the region; frames are short lists of frequent words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.functions import text as T
from terralex.functions.geo import box
from terralex.operators import aggregates as A
from terralex.operators import countries as C
from terralex.operators import evaluation as E
from terralex.operators import memo as M
from terralex.operators import segment as G
from terralex.operators import spatial as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Units that a region needs here; the tables are too small for the default.
MIN_UNITS = 5
#: Frames by name, with frequent words of the tables' languages.
FRAMES = {
    "Operational risk": ["and", "und", "la"], "Technological (un)certainty": ["that", "ist", "est"], "Public acceptance": ["with", "die", "por"],
    "Permitting & policy": ["this", "nicht", "les"], "Costs": ["from", "auf", "para"], "Infrastructure": ["are", "von", "des"], "Sustainability": ["for", "den", "los"],
}
AREAS = {"north": [box(0, 50, 60, 100)], "south": [box(0, 0, 60, 50)], "ring": [box(60, 0, 100, 100), box(70, 20, 90, 80)], "corner": [[(0, 0), (30, 0), (0, 30), (0, 0)]]}
#: The unit rows in SQL, for the oracles.
_UNITS = "units as (select d.doc_id, lang, source, text, case when toxic = 1 then 'negative' when quality = 1 then 'positive' else 'neutral' end sentiment from documents d join labels l using (doc_id))"
_BAL = "sum((sentiment='negative')::int)::bigint n_neg, sum((sentiment='neutral')::int)::bigint n_neu, sum((sentiment='positive')::int)::bigint n_pos, count(*) n_units"
_MORE = "n_neg, n_neu, n_pos, n_units, round(100.0*n_neg/n_units, 6) pct_neg, round(100.0*n_pos/n_units, 6) pct_pos, round(100.0*n_pos/n_units - 100.0*n_neg/n_units, 6) balance"
_WORDS = "words as (select distinct doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+')) w from documents)"
_VOCAB = "vocab(frame, w) as (values " + ", ".join(f"('{f}', '{w}')" for f, ws in FRAMES.items() for w in ws) + ")"
_FRAMED = f"{_UNITS}, {_WORDS}, {_VOCAB}, framed as (select distinct u.doc_id, lang, source, sentiment, frame from units u join words using (doc_id) join vocab using (w))"
_REGIONS = f"regions as (select lang, source, {_BAL} from units group by all having count(*) >= {MIN_UNITS}), regions2 as (select lang, source, {_MORE} from regions)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentiment = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", "text", sentiment.alias("sentiment"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


#: For each word the numbers of the frames that hold it.
_FRAMES_OF = {w: [i for i, ws in enumerate(FRAMES.values()) if w in ws] for w in sorted({w for ws in FRAMES.values() for w in ws})}


def hits_of(c) -> F.Column:
    """The distinct vocabulary words of a text, from one pass over it."""
    return F.array_distinct(F.regexp_extract_all(F.lower(T.or_empty(c)), F.lit(T.any_word(list(_FRAMES_OF))), 1))


def frames_of(c) -> F.Column:
    """Frames of a text, in their order."""
    numbers = F.create_map(*(x for w, ns in _FRAMES_OF.items() for x in (F.lit(w), F.array(*(F.lit(n) for n in ns)))))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(hits_of(c), lambda w: numbers[w]))))
    return F.transform(found, lambda n: F.element_at(F.array(*(F.lit(f) for f in FRAMES)), n + 1))


def _frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, frame, keyword: each vocabulary word of a document once, with each of its frames."""
    pairs = F.create_map(*(x for w, ns in _FRAMES_OF.items() for x in (F.lit(w), F.array(*(F.lit(list(FRAMES)[n]) for n in ns)))))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(hits_of(F.col("text"))).alias("keyword"))
    return rows.select("doc_id", "source", F.explode(pairs[F.col("keyword")]).alias("frame"), "keyword")


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).withColumn("frames", frames_of(F.col("text")))


# ---- text


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text,''), '[ \t]+', ' ', 'g'), '\n{3,}', e'\n\n', 'g'), '^\s+|\s+$', '', 'g')) text from documents""")
def t1_normal_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normal_text(F.col("text")).alias("text"))


@query(r"""select doc_id, len(list_filter(string_split_regex(coalesce(text,''), '[\s]+'), lambda x: x <> ''))::int blank_words from documents where len(list_filter(string_split_regex(coalesce(text,''), '[\s]+'), lambda x: x <> '')) between 20 and 499""")
def p2_length_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.blank_words(F.col("text")).alias("blank_words")).where("blank_words >= 20 and blank_words < 500")


@query(r"""select doc_id, len(regexp_extract_all(coalesce(text,''), '[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*'))::int letter_words from documents""")
def g15_letter_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.letter_words(F.col("text")).alias("letter_words"))


@query("""select doc_id, len(regexp_extract_all(lower(text), 'th[a-z]+ing|er[a-z]+ion'))::int hits from documents""")
def t11_pattern_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.pattern_hits(F.lower("text"), ["th[a-z]+ing", "er[a-z]+ion"]).alias("hits"))


@query("""with r as (select *, case when doc_id % 11 <> 0 then date '2020-01-01' + (doc_id * 37 % 400)::int end published from documents where trim(coalesce(text, '')) <> '' and len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) >= 20), n as (select *, row_number() over (partition by text order by published is null, published, source, doc_id) r from r) select doc_id, sha256(text) body_hash from n where r = 1""")
def t12_exact_dedupe(spark, sf):
    """One article for each body: the earliest, undated ones last."""
    d = table(spark, sf, "documents").withColumn("published", F.when(F.col("doc_id") % 11 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") * 37 % 400).cast("int"))))
    d = d.select(F.col("text").alias("body"), T.blank_words(F.col("text")).alias("word_count"), "published", F.col("source").alias("path"), F.col("doc_id").alias("title"))
    return G.kept_articles(d, 20).select(F.col("title").alias("doc_id"), "body_hash")


_ARTICLE = """case doc_id % 4 when 0 then 'Title ' || doc_id || e'\\nDe Krant\\n5 mei 2020\\nCopyright 2020\\nSection: News; p. 3\\nLength: 12 words\\nBody\\n\\n' || lower(coalesce(text, '')) || e'\\nLoad-Date: May 6, 2020\\nrest' when 1 then 'Title ' || doc_id || e'\\nSubtitle\\nDie Zeitung\\nMontag, 7. März 2021 Ausgabe\\nHighlight: x\\nBody\\n' || lower(coalesce(text, '')) when 2 then 'Title ' || doc_id || e'\\nIl Giornale\\nBody\\n' || lower(coalesce(text, '')) else 'Title ' || doc_id || e'\\nDe Krant\\nsome Body: inner words\\nLoad-Date: x' end"""
_LINES = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[ \t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{3,}', e'\n\n', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"""with r as (select doc_id, {_LINES} t from documents), b as (select *, case when doc_id % 4 = 3 then 'inner words' else t end body from r)
select doc_id, 'Title ' || doc_id title, case doc_id % 4 when 0 then 'De Krant' when 1 then 'Die Zeitung' when 2 then 'Il Giornale' else 'De Krant' end newspaper, case doc_id % 4 when 0 then '5 May 2020' when 1 then '7 March 2021' else '' end as "date", case doc_id % 4 when 0 then 'News' else '' end section,
case when doc_id % 4 = 0 then 12 else len(list_filter(string_split_regex(body, '\\s+'), lambda x: x <> '')) end::int word_count, case doc_id % 4 when 0 then 'May 6, 2020' when 3 then 'x' else '' end load_date, body from b""")
def t4_articles(spark, sf):
    """Exports with texts of the documents (in lower case, as their words would be read as fields) as bodies."""
    d = table(spark, sf, "documents")
    k, t, body = F.col("doc_id") % 4, F.concat(F.lit("Title "), F.col("doc_id")), F.lower(T.or_empty(F.col("text")))
    one = F.concat(t, F.lit("\nDe Krant\n5 mei 2020\nCopyright 2020\nSection: News; p. 3\nLength: 12 words\nBody\n\n"), body, F.lit("\nLoad-Date: May 6, 2020\nrest"))
    two = F.concat(t, F.lit("\nSubtitle\nDie Zeitung\nMontag, 7. März 2021 Ausgabe\nHighlight: x\nBody\n"), body)
    three, four = F.concat(t, F.lit("\nIl Giornale\nBody\n"), body), F.concat(t, F.lit("\nDe Krant\nsome Body: inner words\nLoad-Date: x"))
    return G.articles(d.select("doc_id", F.when(k == 0, one).when(k == 1, two).when(k == 2, three).otherwise(four).alias("article")), "article", "doc_id")


@query("""select doc_id, case doc_id % 5 when 0 then e'First line here.\\nLast one, long enough to be no caption at all.' when 1 then 'A sentence that stays as it is.' when 2 then e'Text before.\\n\\nFull sentence after a mark.' when 3 then 'He said that we all must go home now, and left.' else e'l1 x.\\nl2 x.\\nl3 x.\\nl4 x.\\nl5 x.\\nl6 x.\\nBy Ann' end body, (doc_id % 5 in (0, 2))::int graphics, (doc_id % 5 = 1)::int documents, case doc_id % 5 when 0 then 1 when 1 then 1 else 0 end captions, case doc_id % 5 when 0 then 1 when 1 then 1 else 0 end bylines, (doc_id % 5 = 3)::int quotes from documents""")
def t9_cleaned_bodies(spark, sf):
    bodies = [
        "Door Jan Jansen\nFirst line here.\nGraphic\nA short label without an end\nLast one, long enough to be no caption at all.", "jo@example.org\nPhoto: a view\nhttps://example.org/a\nA sentence that stays as it is.",
        "Text before.\nFOTO :\n\nFull sentence after a mark.", '"We all must go home now"\nHe said that we all must go home now, and left.', "l1 x.\nl2 x.\nl3 x.\nl4 x.\nl5 x.\nl6 x.\nBy Ann",
    ]
    body = F.element_at(F.array(*(F.lit(b) for b in bodies)), (F.col("doc_id") % 5 + 1).cast("int"))
    return G.cleaned_bodies(table(spark, sf, "documents").select("doc_id", body.alias("body")), "body", "doc_id", "dutch")


@query("""with m(source, region) as (values ('src0','Centre'),('src1','North'),('src2','South')) select doc_id, coalesce(region, 'National') region from documents left join m using (source)""")
def t13_region_map(spark, sf):
    m = spark.createDataFrame([("src0", "Centre"), ("src1", "North"), ("src2", "South")], "key string, region string")
    return table(spark, sf, "documents").withColumn("key", T.normal_key(F.col("source"))).join(F.broadcast(m), "key", "left").select("doc_id", F.coalesce("region", F.lit("National")).alias("region"))


@query("""select count(*) n, count(distinct text) n_unique, (count(*) filter (where trim(coalesce(text,'')) = ''))::bigint n_empty from documents""")
def t14_counters(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_unique"), F.count(F.when(F.trim(T.or_empty(F.col("text"))) == "", 1)).alias("n_empty"))


@query(r"""with s as (select doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+([A-ZÀ-ÖØ-Ý])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '') ss from documents where text is not null)
select doc_id, i::int sentence_id, len(ss)::int sentence_count, trim(ss[i]) sentence_text from (select doc_id, ss, unnest(range(1, len(ss)+1)) i from s)""")
def g12_sentences(spark, sf):
    return G.sentences(table(spark, sf, "documents").where("text is not null"), "text", ["doc_id"])


@query("""select conv_id, turn, coalesce(lag(text) over w, '') previous, coalesce(lead(text) over w, '') following from conversations window w as (partition by conv_id order by turn)""")
def g13_neighbours(spark, sf):
    return G.neighbours(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "previous", "following")


def halves(segments: list[str]) -> list[list[float]]:
    """A stand-in for vectors of texts: their shares of letters before and after m."""
    return [[float(sum("a" <= c < "m" for c in x.lower())), float(sum("m" <= c <= "z" for c in x.lower()))] for x in segments]


@query()
def g1_paragraphs(spark, sf):
    return G.paragraphs(table(spark, sf, "documents"), "text", "doc_id", halves)


@query("""with v as (select vec_id, vec_id // 20 doc, embedding::double[] e, lag(embedding::double[]) over (partition by vec_id // 20 order by vec_id) p from embeddings) select vec_id, round(list_cosine_similarity(p, e), 6) similarity from v""")
def g6_neighbour_similarity(spark, sf):
    v = table(spark, sf, "embeddings").withColumns({"doc": F.expr("vec_id div 20"), "words": F.lit(30)})
    return G.content_shifts(v, "doc", "vec_id", "embedding", "words").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""with k as (select doc_id, sha256(lang || '||' || source || '||' || coalesce(text,'')) uid from documents) select doc_id, case when count(*) over (partition by uid) > 1 then uid || '__dup' || (row_number() over (partition by uid order by doc_id) - 1)::varchar else uid end row_key from k""")
def i1_row_keys(spark, sf):
    d = table(spark, sf, "documents").withColumn("uid", T.uid(F.col("lang"), F.col("source"), F.col("text"))).select("doc_id", "uid")
    from pyspark.sql.window import Window

    same = Window.partitionBy("uid")
    n = (F.row_number().over(same.orderBy("doc_id")) - 1).cast("string")
    return d.select("doc_id", F.when(F.count("*").over(same) > 1, F.concat("uid", F.lit("__dup"), n)).otherwise(F.col("uid")).alias("row_key"))


# ---- dictionaries and frames


@query(f"with {_WORDS} select distinct doc_id from words where w in ('and', 'und', 'von')")
def p1_keyword_filter(spark, sf):
    return table(spark, sf, "documents").where(T.has_any(F.col("text"), ["und", "and", "von"])).select("doc_id")


@query(f"with {_WORDS}, {_VOCAB}, f as (select doc_id, frame from words join vocab using (w) group by all) select doc_id, frame from f")
def p4_frame_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(frames_of(F.col("text"))).alias("frame"))


@query(f"with {_WORDS}, {_VOCAB} select d.doc_id from documents d where d.doc_id not in (select doc_id from words join vocab using (w))")
def p6_unmatched_documents(spark, sf):
    return table(spark, sf, "documents").where(F.size(frames_of(F.col("text"))) == 0).select("doc_id")


@query(f"with {_FRAMED}, k as (select u.doc_id, sentiment, frame, w keyword from units u join words using (doc_id) join vocab using (w)) select frame, keyword, sentiment, count(*) n from k group by all")
def a16_frame_keyword_sentiment(spark, sf):
    return _keyworded(spark, sf).groupBy("frame", "keyword", "sentiment").agg(F.count("*").alias("n"))


def _keyworded(spark, sf):
    """doc_id, sentiment, frame, keyword: each keyword of a frame once for each unit that holds it."""
    pairs = F.create_map(*(x for w, ns in _FRAMES_OF.items() for x in (F.lit(w), F.array(*(F.lit(list(FRAMES)[n]) for n in ns)))))
    rows = units(spark, sf).select("doc_id", "sentiment", F.explode(hits_of(F.col("text"))).alias("keyword"))
    return rows.select("doc_id", "sentiment", F.explode(pairs[F.col("keyword")]).alias("frame"), "keyword")


# ---- sentiment tables


@query(f"with {_UNITS}, {_REGIONS}, n as (select count(*) c from regions2), lo as (select *, row_number() over (order by balance, n_units desc, lang, source) r from regions2), low as (select * from lo where r <= least(3, ceil((select c from n)/2.0))), hi as (select *, row_number() over (order by balance desc, n_units desc, lang, source) r2 from lo where r not in (select r from low)) select lang, source, balance, n_units, 'low' as role, r::int as rank from low union all select lang, source, balance, n_units, 'high', r2::int from hi where r2 <= 3")
def province_sentiment_balance(spark, sf):
    regions = rounded(A.balances(units(spark, sf), ["lang", "source"]).where(F.col("n_units") >= MIN_UNITS))
    return A.extremes(regions, ["lang", "source"])


@query(f"with {_UNITS}, {_REGIONS}, c as (select lang, {_BAL} from units group by all) select lang, source, {_MORE}, 'region' as level from regions union all select lang, 'average', {_MORE}, 'country' from c")
def a2_region_table(spark, sf):
    return rounded(A.region_table(units(spark, sf), "lang", "source", MIN_UNITS)).select("lang", "source", "n_neg", "n_neu", "n_pos", "n_units", "pct_neg", "pct_pos", "balance", "level")


@query(f"with {_UNITS}, g as (select lang, source, {_BAL}, grouping(lang, source) g from units group by grouping sets ((), (lang), (lang, source)) having grouping(lang, source) > 0 or count(*) >= {MIN_UNITS}) select lang, source, {_MORE} from g")
def a3_province_summary(spark, sf):
    units(spark, sf).createOrReplaceTempView("terralex_units")
    n = ", ".join(f"sum(cast(sentiment = '{s}' as bigint)) n_{a}" for s, a in (("negative", "neg"), ("neutral", "neu"), ("positive", "pos")))
    g = spark.sql(f"select lang, source, {n}, count(*) n_units, grouping_id() g from terralex_units group by grouping sets ((), (lang), (lang, source))").where(f"g > 0 or n_units >= {MIN_UNITS}")
    g = g.withColumns({"pct_neg": A.share(F.col("n_neg"), F.col("n_units")), "pct_pos": A.share(F.col("n_pos"), F.col("n_units"))}).withColumn("balance", F.col("pct_pos") - F.col("pct_neg"))
    return rounded(g.drop("g"))


@query(f"with {_FRAMED}, f as (select frame, {_BAL} from framed group by all) select frame, {_MORE} from f")
def a4_frame_sentiment(spark, sf):
    return rounded(A.balances(framed(spark, sf).withColumn("frame", F.explode("frames")), ["frame"]))


@query(f"with {_FRAMED}, f as (select lang, frame, {_BAL} from framed group by all) select lang, frame, {_MORE} from f")
def a5_country_frame_balance(spark, sf):
    return rounded(A.balances(framed(spark, sf).withColumn("frame", F.explode("frames")), ["lang", "frame"]))


@query(f"with {_FRAMED}, c as (select source, frame, count(*) m from framed group by all), s as (select distinct source from c), fr as (select distinct frame from vocab), d as (select source, frame, coalesce(m, 0)::bigint mentions from s cross join fr left join c using (source, frame)) select source, frame, mentions, round(coalesce(100.0*mentions/nullif(sum(mentions) over (partition by source), 0), 0), 6) as share from d")
def a9_frame_shares(spark, sf):
    return rounded(A.dense_shares(A.mentions(framed(spark, sf), ["source"], "frames"), "source", "frame", list(FRAMES)))


@query(f"with {_FRAMED}, c as (select source, frame, count(*) mentions from framed group by all), r as (select *, row_number() over (partition by source order by mentions desc, frame) r from c) select source, frame, mentions, r::int as rank from r where r <= 2")
def a12_top_frames(spark, sf):
    return A.top_per_group(A.mentions(framed(spark, sf), ["source"], "frames"), ["source"], [F.desc("mentions"), "frame"], 2)


@query(f"with {_FRAMED}, k as (select source, w keyword, count(*) n from units join words using (doc_id) where w in (select w from vocab) group by all), r as (select *, row_number() over (partition by source order by n desc, keyword) r from k) select source, keyword, n, r::int as rank from r where r <= 5")
def a11_top_keywords(spark, sf):
    words = sorted({w for ws in FRAMES.values() for w in ws})
    hits = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(T.any_word(words)), 1))
    n = units(spark, sf).select("source", F.explode(hits).alias("keyword")).groupBy("source", "keyword").agg(F.count("*").alias("n"))
    return A.top_per_group(n, ["source"], [F.desc("n"), "keyword"], 5)


@query(f"with {_FRAMED} select source, sum((frame='Costs')::int)::bigint costs, sum((frame='Infrastructure')::int)::bigint infrastructure from framed group by all")
def a15_frame_matrix(spark, sf):
    m = A.mentions(framed(spark, sf), ["source"], "frames")
    p = m.groupBy("source").pivot("frame", ["Costs", "Infrastructure"]).agg(F.sum("mentions")).na.fill(0)
    return p.select("source", F.col("Costs").cast("long").alias("costs"), F.col("Infrastructure").cast("long").alias("infrastructure"))


_EXTREMES = """lo as (select *, row_number() over (order by balance, n_units desc, lang, source) lo, count(*) over () n from regions2),
ro as (select *, case when lo <= least({tail}, ceil(n / 2.0)) then 'low' end r0 from lo),
hi as (select *, row_number() over (partition by r0 is null order by balance desc, n_units desc, lang, source) hi from ro),
ext as (select lang, source, balance, n_units, coalesce(r0, 'high') role, (case when r0 = 'low' then lo else hi end)::int as rank from hi where r0 is not null or hi <= {tail})"""
_CHOSEN = f"with {_FRAMED}, {_REGIONS}, {_EXTREMES.format(tail=3)}"


def _regions(spark, sf):
    return rounded(A.balances(units(spark, sf), ["lang", "source"]).where(F.col("n_units") >= MIN_UNITS))


def _mentioned(spark, sf):
    return framed(spark, sf).withColumn("frame", F.explode("frames"))


@query(f"{_CHOSEN}, d as (select lang, source, frame from ext cross join (select distinct frame from vocab)), b as (select lang, source, frame, {_BAL} from framed group by all), m as (select lang, source, frame, {_MORE} from b) select d.lang, d.source, d.frame, coalesce(n_neg, 0)::bigint n_neg, coalesce(n_neu, 0)::bigint n_neu, coalesce(n_pos, 0)::bigint n_pos, coalesce(n_units, 0)::bigint n_units, pct_neg, pct_pos, balance from d left join m using (lang, source, frame)")
def a6_extreme_frame_balance(spark, sf):
    return rounded(A.dense_balances(_mentioned(spark, sf), A.extremes(_regions(spark, sf), ["lang", "source"]), ["lang", "source"], "frame", list(FRAMES)))


@query(f"{_CHOSEN} select distinct role, rank, lang, source, doc_id, sentiment from framed join ext using (lang, source)")
def a8_extreme_sentences(spark, sf):
    chosen = A.extremes(_regions(spark, sf), ["lang", "source"])
    return A.rows_of_extremes(framed(spark, sf).where("size(frames) > 0"), chosen, ["lang", "source"], "doc_id").select("role", "rank", "lang", "source", "doc_id", "sentiment")


@query(f"with {_FRAMED}, c as (select source, frame, count(*) m from framed group by all), d as (select source, frame, coalesce(m, 0)::bigint mentions from (select distinct source from c) cross join (values ('Costs'), ('Infrastructure')) v(frame) left join c using (source, frame)) select source, frame, mentions, coalesce(round(100.0 * mentions / nullif(sum(mentions) over (partition by source), 0), 6), 0) as share from d")
def a10_composition(spark, sf):
    """Shares renormalised to the frames shown."""
    return rounded(A.dense_shares(A.mentions(framed(spark, sf), ["source"], "frames"), "source", "frame", ["Costs", "Infrastructure"]))


@query(f"with {_FRAMED}, {_REGIONS} select lang, source, frame, count(*) mentions from framed semi join regions using (lang, source) group by all")
def a13_region_frames(spark, sf):
    eligible = _regions(spark, sf).select("lang", "source")
    return A.mentions(framed(spark, sf).join(eligible, ["lang", "source"], "left_semi"), ["lang", "source"], "frames")


@query(f"with {_UNITS}, {_REGIONS}, {_EXTREMES.format(tail=1)} select lang, source, balance, n_units, role from ext where (select count(*) from ext) = 2")
def a14_extreme_pair(spark, sf):
    return A.extreme_pair(_regions(spark, sf), ["lang", "source"])


@query(f"with {_FRAMED}, k as (select frame, w keyword, {_BAL} from units join words using (doc_id) join vocab using (w) group by all) select frame, keyword, n_neg, n_neu, n_pos, n_units total, (row_number() over (partition by frame order by n_units desc, n_pos desc, n_neu desc, n_neg desc, keyword))::int as index from k")
def a17_keyword_distribution(spark, sf):
    return A.keyword_distribution(_keyworded(spark, sf), ["frame", "keyword"])


@query(f"with {_FRAMED}, a as (select frame, sentiment from framed union all select 'All sentences', sentiment from units), b as (select frame, {_BAL} from a group by all) select frame, {_MORE} from b")
def a18_category_distribution(spark, sf):
    return rounded(A.with_overall(units(spark, sf), "frame", _mentioned(spark, sf)))


@query("select lang, source, count(*) n from documents group by all")
def a29_value_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("with t as (select conv_id, count(*) n from conversations group by all) select count(*) n_documents, sum(n)::bigint n_units, round(avg(n), 6) mean_units, round(100.0 * count(*) filter (where n > 1) / count(*), 6) pct_multiple from t")
def a30_units_per_document(spark, sf):
    return rounded(A.units_per_document(table(spark, sf, "conversations"), "conv_id"))


@query(f"with {_FRAMED}, k as (select w keyword, {_BAL} from units join words using (doc_id) where w in (select w from vocab) group by all having count(*) >= 5), m as (select keyword, {_MORE} from k), t as (select *, 'top' as \"end\", (row_number() over (order by 100.0*n_pos/n_units - 100.0*n_neg/n_units desc, n_units desc, keyword))::int as rank from m union all select *, 'bottom', (row_number() over (order by 100.0*n_pos/n_units - 100.0*n_neg/n_units, n_units desc, keyword))::int from m) select * from t where rank <= 15")
def a33_polar_keywords(spark, sf):
    return rounded(A.polar_items(_keyworded(spark, sf).select("doc_id", "sentiment", "keyword").distinct(), "keyword", least=5))


@query(f"with {_FRAMED}, n as (select frame, count(*) whole from framed group by all), k as (select frame, w keyword, count(distinct doc_id) n from words join units using (doc_id) join vocab using (w) group by all), r as (select frame, keyword, n, round(100.0 * n / whole, 6) as share, (row_number() over (partition by frame order by n desc, keyword))::int as rank from k join n using (frame)) select * from r where rank <= 10")
def a35_category_keywords(spark, sf):
    whole = A.mentions(framed(spark, sf), [], "frames").withColumnRenamed("mentions", "whole")
    n = _keyworded(spark, sf).groupBy("frame", "keyword").agg(F.countDistinct("doc_id").alias("n"))
    shares = n.join(F.broadcast(whole), "frame").select("frame", "keyword", "n", A.share(F.col("n"), F.col("whole")).alias("share"))  # a row per frame
    return rounded(A.top_per_group(shares, ["frame"], [F.desc("n"), "keyword"], 10))


@query(f"with {_UNITS}, s as (select source, {_BAL} from units group by all), m as (select source, {_MORE} from s) select source, coalesce(n_units, 0)::bigint n_units, coalesce(balance, 0) balance, coalesce(n_units, 0) >= 20 has_enough_data from (select distinct source from documents) left join m using (source)")
def a20_scored_areas(spark, sf):
    areas = table(spark, sf, "documents").select("source").distinct()
    return rounded(A.scored_areas(areas, A.balances(units(spark, sf), ["source"]), "source", min_units=20))


@query("with u as (select source, doc_id, lang, case lang when 'fr' then 0 when 'de' then 1 else 2 end part from documents where lang in ('fr', 'de', 'en')), r as (select *, row_number() over (partition by source order by part, doc_id) r from u) select source, doc_id, lang from r where r = 1")
def a27_first_candidates(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "lang")
    return A.first_wins([d.where(F.col("lang") == lang) for lang in ("fr", "de", "en")], ["source"], ["doc_id"])


@query("with l as (select l_returnflag || l_linestatus region, l_orderkey k from lineitem), r as (select region, 1 is_region, k from l union all select 'All', 0, k from l), n as (select region, is_region, count(*) n_units, count(distinct k) n_documents from r where region is not null group by all) select region, n_units, n_documents, round(n_units / n_documents, 6) units_per_document, (row_number() over (order by is_region, n_units desc, region))::int as position from n")
def a32_document_table(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("region"), "l_orderkey")
    return rounded(A.document_table(lines, "region", "l_orderkey"))


@query("select sha256(text) body_hash, case when min(source) = max(source) then min(source) when min(source) < max(source) then 'National' end source from documents where text is not null group by all")
def a37_unwrapped_sources(spark, sf):
    bodies = table(spark, sf, "documents").where("text is not null").select(F.sha2("text", 256).alias("body_hash"), "source")
    return A.unwrapped(bodies, ["body_hash"], "source", "National")


@query("""with g as (select doc_id, quality from labels union all select doc_id, 2 from labels where doc_id % 10 = 0 union all select -1, 0), m as (select doc_id from documents where lang <> 'fr'),
n as (select doc_id, count(*) n, bool_or(coalesce(quality not in (0, 1), true)) odd from g group by all), b as (select coalesce(n.doc_id, m.doc_id) doc_id, n, odd, m.doc_id is not null listed from n full join m on n.doc_id = m.doc_id)
select doc_id, 'repeated' problem from b where n > 1 union all select doc_id, 'unexpected' from b where not listed union all select doc_id, 'missing' from b where n is null union all select doc_id, 'label' from b where odd""")
def e8_gold_problems(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    extra = labels.where("doc_id % 10 = 0").withColumn("quality", F.lit(2)).union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(0)))
    return E.gold_problems(labels.union(extra), table(spark, sf, "documents").where("lang <> 'fr'"), "doc_id", "quality", [0, 1])


@query("""with q as (select c_custkey uid, case when c_acctbal > 0 then c_mktsegment end label, ['frame', 'sentiment'][c_custkey % 2 + 1] stage from customer where c_nationkey < 15), f as (select c_custkey uid from customer where c_nationkey >= 10),
k as (select * from q where label is not null or stage = 'sentiment')
select uid, label, stage, 'kept' state from k union all
select f.uid, null, 'frame', case when w.uid is null then 'added' else 'refreshed' end from f left join (select uid from q where label is null and stage = 'frame') w on f.uid = w.uid where f.uid not in (select uid from k)""")
def u5_refreshed_queue(spark, sf):
    """The queue's rows of one stage refreshed, those of the other left alone."""
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "uid")
    queue = c.where("c_nationkey < 15").select("uid", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("label"), F.when(F.col("uid") % 2 == 0, "frame").otherwise("sentiment").alias("stage"))
    return E.refreshed_queue(queue, c.where("c_nationkey >= 10").select("uid"), "uid", "label", ("stage", "frame")).select("uid", "label", "stage", "state")


@query("select year(o_orderdate)::int as year, count(*) n from orders group by all")
def a22_per_year(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("select source, count(*) n from documents where trim(source) <> '' group by all order by n desc, source limit 6")
def a23_top_newspapers(spark, sf):
    return table(spark, sf, "documents").where(F.trim("source") != "").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(6)


@query("select count(*) n_rows, count(text) n_texts, min(n_chars) min_chars, max(n_chars) max_chars, count(distinct source) n_sources from documents")
def a24_summary(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n_rows"), F.count("text").alias("n_texts"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.countDistinct("source").alias("n_sources"))


@query(f"with {_FRAMED} select 1 step, 'documents' as name, lang, count(*) n_rows, count(distinct doc_id) n_documents from documents group by lang union all select 2, 'labelled', lang, count(*), count(distinct doc_id) from units group by lang union all select 3, 'frames', lang, count(*), count(distinct doc_id) from framed group by lang")
def a25_funnel(spark, sf):
    steps = {"documents": table(spark, sf, "documents"), "labelled": units(spark, sf), "frames": framed(spark, sf).withColumn("frame", F.explode("frames"))}
    return A.funnel(steps, "doc_id", "lang")


@query("""with c as (select source, lang, count(*) n from documents group by all), b as (select source, sum(n)::bigint n, list(lang order by n desc, lang) ls from c group by source), t as (select distinct source, left(text, 180) t from documents where text is not null), r as (select *, row_number() over (partition by source order by t) r from t), x as (select source, string_agg(t, ' || ' order by r) examples from r where r <= 3 group by source) select source, n, ls[1] as mode, array_to_string(ls[1:3], '; ') modes, examples from b join x using (source)""")
def a26_unmatched_report(spark, sf):
    return A.unmatched_report(table(spark, sf, "documents").where("text is not null"), "source", "lang", "text")


@query("select lang, count(*) n, round(avg(n_chars), 6) mean, round(median(n_chars), 6) as median, round(quantile_cont(n_chars, 0.9), 6) p90, round(quantile_cont(n_chars, 0.99), 6) p99, max(n_chars) longest from documents group by lang")
def a28_distribution(spark, sf):
    p = lambda q: F.round(F.percentile("n_chars", q), 6)
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("n_chars").alias("longest"))


@query("""with m as (select strftime(ts, '%Y-%m') as month, round(sum(value), 4) total from events group by 1), s as (select *, count(*) over w c, avg(total) over w a from m window w as (order by month rows between 5 preceding and 4 following)) select month, total, round(case when c = 10 then a end, 3) smooth from s""")
def a31_monthly_smoothed(spark, sf):
    m = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.round(F.sum("value"), 4).alias("total"))
    return A.smoothed(m, "month", "total").withColumn("smooth", F.round("smooth", 3))


@query("""with r as (select l_returnflag flag, l_shipdate::date as day, l_linestatus status, l_orderkey from lineitem), c as (select flag, status, count(*) n from r group by all) select flag, max(case when status='F' then n end) f, max(case when status='O' then n end) o from c group by flag""")
def a34_pivot(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).pivot("l_linestatus", ["F", "O"]).count().select("flag", F.col("F").alias("f"), F.col("O").alias("o"))


@query("select sha256(text) body, min(doc_id) first_id, array_to_string(list_sort(list_distinct(list(source))), ';') sources from documents where text is not null group by text")
def a36_collapse(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("body"))
    return d.agg(F.min("doc_id").alias("first_id"), F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"))


# ---- joins and sets


@query(f"with {_UNITS} select d.doc_id, u.sentiment from documents d left join units u on u.doc_id = d.doc_id")
def r1_left_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(units(spark, sf).select("doc_id", "sentiment"), "doc_id", "left")


@query("select doc_id from documents where doc_id in (select doc_id from labels)")
def r4_semi_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_semi")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def r5_anti_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("select doc_id, 'labelled' as origin from labels union all select doc_id, 'long' from documents where n_chars > 3000")
def u1_union(spark, sf):
    a = table(spark, sf, "labels").select("doc_id", F.lit("labelled").alias("origin"))
    return a.unionByName(table(spark, sf, "documents").where("n_chars > 3000").select("doc_id", F.lit("long").alias("origin")))


@query("select doc_id from documents except select doc_id from labels")
def u3_difference(spark, sf):
    return table(spark, sf, "documents").select("doc_id").exceptAll(table(spark, sf, "labels").select("doc_id"))


@query("""select key, value from (select doc_id % 100 as key, source as value, row_number() over (partition by doc_id % 100 order by doc_id desc) r from documents) where r = 1""")
def s10_cache_last(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 100).alias("key"), F.col("source").alias("value"), F.col("doc_id").alias("seq"))
    return d.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


# ---- countries and places


_DOC = """rows as (select c_custkey, c_custkey // 3 as document, c_custkey row_order, case when c_custkey % 5 = 0 then c_mktsegment when c_custkey % 5 = 1 then 'Italy' else 'NONE' end as location, case when c_custkey % 5 = 0 then 'city' when c_custkey % 5 = 1 then 'country' else 'none' end as granularity from customer)"""


@query(f"""with {_DOC}, g as (select document, count(distinct location) filter (where granularity = 'city') ns, count(distinct location) filter (where granularity = 'country') nc, arg_min(location, row_order) filter (where granularity = 'city') s, arg_min(location, row_order) filter (where granularity = 'country') c from rows group by document),
j as (select r.*, ns, nc, s, c, case when granularity = 'city' then 'paragraph' when ns = 1 then 'document_single_location' when ns = 0 and nc = 1 then 'country_all_document_locations' else 'country_fallback' end location_source from rows r join g using (document))
select document::bigint as document, row_order, case location_source when 'paragraph' then location when 'document_single_location' then s when 'country_all_document_locations' then c else 'Italy' end as location, case location_source when 'paragraph' then granularity when 'document_single_location' then 'city' else 'country' end as granularity, location_source, location_source = 'country_fallback' needs_review, case when location_source = 'country_fallback' then case when ns > 1 then 'multiple_document_locations' else 'no_document_paragraph_locations' end || ';document_llm_no_location' end review_reason from j""")
def c8_document_fallback(spark, sf):
    k = F.col("c_custkey") % 5
    rows = table(spark, sf, "customer").select(
        F.expr("c_custkey div 3").alias("document"), F.col("c_custkey").alias("row_order"),
        F.when(k == 0, F.col("c_mktsegment")).when(k == 1, "Italy").otherwise("NONE").alias("location"), F.when(k == 0, "city").when(k == 1, "country").otherwise("none").alias("granularity"))
    return C.document_fallback(rows, ["Italy"])


def _points(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("point"), ((F.col("c_custkey") * 37 % 1000) / 10 + 0.013).alias("x"), ((F.col("c_custkey") * 91 % 1000) / 10 + 0.017).alias("y"))


_EDGES = "edges(area, x1, y1, x2, y2) as (values " + ", ".join(f"('{a}', {x1}::double, {y1}::double, {x2}::double, {y2}::double)" for a, rings in AREAS.items() for r in rings for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False)) + ")"
_POINTS = "points as (select c_custkey point, (c_custkey * 37 % 1000) / 10.0::double + 0.013 x, (c_custkey * 91 % 1000) / 10.0::double + 0.017 y from customer)"


@query(f"with {_EDGES}, {_POINTS} select point, area from points join edges on (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 group by all having count(*) % 2 = 1")
def j10_points_in_areas(spark, sf):
    return S.points_in_areas(_points(spark, sf), S.edge_table(spark, AREAS, cell=5.0), cell=5.0)


@query(f"with {_EDGES}, {_POINTS}, pip as (select point, area from points join edges on (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 group by all having count(*) % 2 = 1) select coalesce(area, 'unassigned') area, count(*) n from points left join pip using (point) group by all")
def j15_area_counts(spark, sf):
    p = _points(spark, sf)
    inside = S.points_in_areas(p, S.edge_table(spark, AREAS, cell=5.0), cell=5.0)
    return p.join(inside, "point", "left").groupBy(F.coalesce("area", F.lit("unassigned")).alias("area")).agg(F.count("*").alias("n"))


@query("""with e as (select p_partkey, lower(unnest([p_name, p_type])) k, p_size, p_retailprice from part), r as (select *, row_number() over (partition by k order by p_retailprice desc, p_partkey) r from (select distinct * from e)) select k as key, p_partkey as place_id from r where r = 1""")
def j7_gazetteer_names(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("place_id"), F.col("p_name").alias("name"), F.col("p_type").alias("alternates"), F.lit("P").alias("feature_class"), F.lit("PPL").alias("feature_code"), F.col("p_retailprice").alias("population"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    return S.gazetteer_names(p).select("key", "place_id")


@query("""with p as (select n_nationkey place_id, n_name as name, case when lower(n_name) = 'an' then 0 when lower(n_name) like 'an%' then 1 when lower(n_name) like '%an%' then 2 end as rank from nation) select place_id::bigint place_id, name, rank from p where rank is not null order by rank, name limit 20""")
def j18_place_search(spark, sf):
    p = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("place_id"), F.col("n_name").alias("name"), F.lit(1).alias("priority"), F.lit(0).alias("population"))
    return S.search_places(p, "An").select("place_id", "name", "rank")


@query()
def j17_fuzzy_suggestions(spark, sf):
    p = table(spark, sf, "part").select(F.lower("p_name").alias("name"))
    return S.fuzzy_suggestions(p, p)


# ---- evaluation


_PRED = "p as (select l.doc_id, source, quality gold, (n_chars > 1200)::int predicted, round((n_chars % 100) / 100.0, 2)::double confidence from documents d join labels l using (doc_id))"


def _predictions(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "source", F.col("quality").alias("gold"), (F.col("n_chars") > 1200).cast("int").alias("predicted"), F.round((F.col("n_chars") % 100) / 100, 2).alias("confidence"))


@query(f"""with {_PRED}, f as (select source, count(*) n, avg((gold = predicted)::int) accuracy, coalesce(2.0 * sum((gold=0 and predicted=0)::int) / nullif(sum((gold=0)::int) + sum((predicted=0)::int), 0), 0) f0, coalesce(2.0 * sum((gold=1 and predicted=1)::int) / nullif(sum((gold=1)::int) + sum((predicted=1)::int), 0), 0) f1 from p group by source) select source, n, round(accuracy, 6) accuracy, round((f0 + f1) / 2, 6) macro_f1 from f""")
def e1_scores(spark, sf):
    return rounded(E.scores(_predictions(spark, sf), ["source"], [0, 1]))


_CURVE = f"{_PRED}, t as (select distinct confidence threshold from p union select 0 union select 1), c as (select threshold, count(doc_id) n_accepted, count(doc_id) / (select count(*) from p)::double coverage, avg((gold = predicted)::int) accuracy from t left join p on confidence >= threshold group by threshold)"


@query(f"with {_CURVE} select threshold::double threshold, n_accepted, round(coverage, 6) coverage, round(accuracy, 6) accuracy from c")
def e2_threshold_curve(spark, sf):
    return rounded(E.threshold_curve(_predictions(spark, sf)))


@query(f"with {_CURVE} select threshold::double threshold, n_accepted, round(coverage, 6) coverage, round(accuracy, 6) accuracy from c where coverage >= 0.5 and accuracy is not null order by c.accuracy desc, c.coverage desc, threshold limit 1")
def e3_threshold_choice(spark, sf):
    return rounded(E.chosen_threshold(E.threshold_curve(_predictions(spark, sf)), 0.5))


@query("""with o as (select doc_id, source, 'old' as origin from documents), n as (select doc_id, source, 'new' as origin from documents where doc_id % 6 = 0) select * from n union all select * from o where doc_id not in (select doc_id from n)""")
def e6_report_merge(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return E.merge_report(d.withColumn("origin", F.lit("old")), d.where("doc_id % 6 = 0").withColumn("origin", F.lit("new")), ["doc_id"])


@query("""with d as (select distinct doc_id, sha256('42:' || doc_id::varchar) h from documents), r as (select doc_id, row_number() over (order by h, doc_id) r, count(*) over () n from d) select doc_id, case when r <= greatest(1, round_even(n * 0.3, 0)) then 'test' else 'train' end split from r""")
def e12_document_split(spark, sf):
    return E.document_split(table(spark, sf, "documents"), "doc_id")


@query("""select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by sha256('42:' || doc_id::varchar), doc_id) r from documents) where r <= 20""")
def e14_stratified_sample(spark, sf):
    return E.hash_sample(table(spark, sf, "documents").select("lang", "doc_id"), "doc_id", 20, strata=["lang"])


@query("""select n_nationkey, ['ann','bob','cleo'][ntile(3) over (order by n_nationkey)] rater from nation""")
def e15_assignment(spark, sf):
    return E.balanced_assignment(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey", ["ann", "bob", "cleo"])


@query("""select doc_id, case when c.v <> b.v and i.v <> b.v and c.v <> i.v then 'conflict' when i.v <> b.v then 'updated' when c.v <> b.v then 'kept' else 'unchanged' end state from (select doc_id, quality v from labels) b join (select doc_id, case when doc_id % 3 = 0 then 2 else quality end v from labels) c using (doc_id) join (select doc_id, case when doc_id % 4 = 0 then 3 else quality end v from labels) i using (doc_id)""")
def e16_three_way_merge(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("v"))
    ours = lab.withColumn("v", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(F.col("v")))
    theirs = lab.withColumn("v", F.when(F.col("doc_id") % 4 == 0, 3).otherwise(F.col("v")))
    return E.three_way_merge(lab, ours, theirs, "doc_id", "v").select("doc_id", "state")


@query("""select n_regionkey, count(*) n, arg_max(n_name, n_nationkey) decision, count(distinct n_name) > 1 conflict, true complete from nation group by all""")
def e18_judgements(spark, sf):
    return E.judgement_groups(table(spark, sf, "nation"), "n_regionkey", "n_name", "n_nationkey")


# ---- remembered classification


_RAW = "raw as (select doc_id, case when doc_id % 4 = 0 then '{\"topic\": \"yes\", \"confidence\": 1.7, \"evidence_short\": \"a b\"}' when doc_id % 4 = 1 then 'Sure: {\"topic\": \"NO\", \"confidence\": \"x\"} end' when doc_id % 4 = 2 then 'nothing' else '{\"topic\": \"perhaps\", \"confidence\": 0.4}' end raw from documents)"


@query("""select doc_id, case doc_id % 4 when 0 then 'YES' when 1 then 'NO' else 'MAYBE' end label, (case doc_id % 4 when 0 then 1.0 when 3 then 0.4 else 0.0 end)::double confidence, case doc_id % 4 when 0 then 'a b' when 2 then 'Invalid JSON.' else '' end evidence, case doc_id % 4 when 2 then 'error' else 'ok' end status from documents""")
def m4_parse_label(spark, sf):
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, '{"topic": "yes", "confidence": 1.7, "evidence_short": "a b"}').when(k == 1, 'Sure: {"topic": "NO", "confidence": "x"} end').when(k == 2, "nothing").otherwise('{"topic": "perhaps", "confidence": 0.4}')
    return table(spark, sf, "documents").select("doc_id", M.parsed_label(raw, "topic", ["YES", "NO", "MAYBE"], "MAYBE").alias("p")).select("doc_id", "p.*")


@query("""with k as (select doc_id, sha256('v1' || e'\n' || coalesce(text, '')) as key from documents), c as (select key, max(doc_id) seq from k where doc_id % 3 = 0 group by key) select doc_id, seq is not null cached from k left join c using (key)""")
def m1_cache_probe(spark, sf):
    k = table(spark, sf, "documents").select("doc_id", M.fingerprint(F.lit("v1"), F.col("text")).alias("key"))
    cache = k.where("doc_id % 3 = 0").select("key", F.lit("x").alias("value"), F.col("doc_id").alias("seq"))
    rows, _ = M.probe(k, cache)
    return rows.select("doc_id", F.col("value").isNotNull().alias("cached"))


@query("select doc_id, 'positive' label, 0.9::double confidence, 'ok' status from documents")
def m3_sentiment_parse(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit('{"sentiment": "Positive", "confidence": "0.9"} '), F.col("source")).alias("raw"))
    return M.parsed_sentiments(d, "raw").drop("raw")
