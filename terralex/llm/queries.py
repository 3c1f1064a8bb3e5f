"""The operators' registered queries over the whole tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terralex.llm.bpe import bpe_round_trip
from terralex.llm.embedding_dedup import embedding_dedup
from terralex.llm.minhash import minhash_dedup
from terralex.llm.packing import pack
from terralex.llm.pii import pii_spans
from terralex.llm.sharding import ring_shards
from terralex.llm.substring_dedup import substring_digests
from terralex.llm.token_counts import token_counts
from terralex.llm.toxicity import toxicity
from terralex.llm.winnow import edited_fingerprints

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *tables: str, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables), **options)

    return query


QUERIES: dict[str, Query] = {
    "op1_toxicity": _over(toxicity, "documents", "labels"),
    "op2_embedding_dedup": _over(embedding_dedup, "embeddings", cosine=0.95),
    "op3_packing": _over(pack, "documents"),
    "op4_substring_dedup": _over(substring_digests, "documents"),
    "op5_token_counts": _over(token_counts, "documents"),
    "op6_sharding": _over(ring_shards, "documents", shards=16),
    "op7_pii": _over(pii_spans, "documents"),
    "op8_bpe": _over(bpe_round_trip, "documents"),
    "op9_fingerprints": _over(edited_fingerprints, "documents"),
    "op10_minhash_dedup": _over(minhash_dedup, "documents", k=2, percent=80),
}

#: The components of edges(u, v), which hold each edge in both directions, over nodes(n).
_COMPONENTS = """
reach(n, m) as (select n, n from nodes union select r.n, e.v from reach r join edges e on e.u = r.m),
roots as (select n, min(m) root from reach group by n)"""

ORACLES: dict[str, str] = {
    "op2_embedding_dedup": f"""
with recursive v as (select vec_id, embedding::double[] e from embeddings),
good as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
nodes as (select vec_id n from v),
edges as (select a.vec_id u, b.vec_id v from good a join good b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
{_COMPONENTS}
select r.n vec_id, (select count(*) from edges where u = r.n)::bigint n_links, r.root component_id, r.n = r.root kept from roots r""",
    "op4_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
pos as (select doc_id, ws, unnest(range(1, len(ws) + 1)) i from w),
win as (select doc_id, i, ws[i] word, case when i + 19 <= len(ws) then array_to_string(ws[i:i + 19], ' ') end win from pos),
late as (select doc_id, i, word, win is not null and row_number() over (partition by win order by doc_id, i) > 1 again from win),
covered as (select doc_id, i, word, max(case when again then 1 else 0 end) over (partition by doc_id order by i rows between 19 preceding and current row) = 1 gone from late),
kept as (select doc_id, count(*) filter (where gone) n_removed, coalesce(string_agg(word, ' ' order by i) filter (where not gone), '') kept from covered group by doc_id)
select w.doc_id, len(ws)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join kept using (doc_id)""",
    "op10_minhash_dedup": rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
sets as (select doc_id, case when len(ws) < 2 then list_distinct([x for x in [array_to_string(ws, ' ')] if x <> '']) else list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) end s from w),
hashes as (select doc_id, len(s) n, unnest(s) h from sets),
nodes as (select doc_id n from sets),
common as (select a.doc_id u, b.doc_id v, a.n un, b.n vn, count(*) k from hashes a join hashes b on a.h = b.h and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
near as (select u, v from common where 100 * k >= 80 * (un + vn - k)),
edges as (select u, v from near union all select v, u from near),
{_COMPONENTS}
select doc_id, len(s)::bigint n_shingles, root component_id, doc_id = root kept from sets join roots on n = doc_id""",
}
