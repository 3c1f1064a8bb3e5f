"""Winnowing fingerprints by DataFrame functions only.

Grams are runs of K characters (code points). A gram's hash is the polynomial of its code points modulo a
prime, built up from those of its parts. Of each W consecutive grams the least hash is chosen, the rightmost
one on ties, with its place. So any run of W + K - 1 characters that two texts share leaves a common
fingerprint in both (the match guarantee), and no shared run of fewer than K does. A text of fewer than K
characters is one gram, an empty one has none.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terralex.llm.common import with_rank

K, W = 12, 12
#: Characters of the shortest text that has a whole window.
LEAST = W + K - 1
#: Windows of a block of `fingerprints`.
BLOCK = 128
PRIME = 2**31 - 1
BASE = 1_000_003


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once though used often or inside lambdas."""
    return F.transform(F.array(value), use)[0]


def runs(parts: Column, more: Column, shift: int, join: Callable[[Column, Column], Column]) -> Column:
    """join(parts[i], more[i + shift]) for each i that has both."""
    return F.transform(F.slice(more, shift + 1, F.size(more) - shift), lambda y, i: join(F.get(parts, i), y))


def fingerprint(text: Column) -> Column:
    """array<bigint> of chosen grams in order: hash * 2^32 + (2^32 - 1 - place), so that less is a lesser hash, then a greater place."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))

    def joined(parts: Column, more: Column, shift: int) -> Column:
        return runs(parts, more, shift, lambda x, y: (x * F.lit(pow(BASE, shift, PRIME)) + y) % F.lit(PRIME))

    def grams(c: Column) -> Column:
        four = let(joined(c, c, 1), lambda h: joined(h, h, 2))
        hashes = let(four, lambda h: let(joined(h, h, 4), lambda e: runs(e, h, 8, lambda x, y: (x * F.lit(pow(BASE, 4, PRIME)) + y) % F.lit(PRIME))))
        short = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: (a * F.lit(BASE) + x) % F.lit(PRIME))
        placed = lambda h, i: h * F.lit(2**32) + (F.lit(2**32 - 1) - i.cast("long"))
        return F.transform(F.when(F.size(c) >= K, hashes).otherwise(F.array(short)), placed)

    def chosen(g: Column) -> Column:
        eight = let(let(runs(g, g, 1, F.least), lambda m: runs(m, m, 2, F.least)), lambda m: runs(m, m, 4, F.least))
        return F.when(F.size(g) < W, F.array(F.array_min(g))).otherwise(F.array_distinct(let(eight, lambda m: runs(m, m, W - 8, F.least))))

    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(let(let(codes, grams), chosen))


def place(gram: Column) -> Column:
    return F.lit(2**32 - 1) - gram.bitwiseAND(F.lit(2**32 - 1))


def head_of(chosen: Column, chars: Column) -> Column:
    """Those of a text's chosen grams that windows within its first `chars` characters choose.

    A gram is first chosen by the window that it enters last in, or, if it is not less than the gram
    chosen before, by the window after that one's place.
    """

    def early(own: Column, n: Column, x: Column, i: Column) -> Column:
        last = F.get(own, i - 1)
        first = F.when(i == 0, F.lit(0)).when(F.shiftrightunsigned(x, 32) <= F.shiftrightunsigned(last, 32), place(x) - (W - 1)).otherwise(place(last) + 1)
        # that window starts at the gram's place at the latest, and only grams near the end need it
        return (place(x) + LEAST <= n) | ((place(x) + K <= n) & (first + LEAST <= n))

    # as variables of lambdas both are computed once, not for each gram
    return let(chosen, lambda own: let(chars, lambda n: F.filter(own, lambda x, i: early(own, n, x, i))))


def edited_fingerprint(edited: Column, chosen: Column, next_chosen: Column, own: Column) -> Column:
    """The fingerprint of a text whose first `own` characters are of one text and the others the first of another, from both texts' fingerprints.

    Only windows that meet both parts are hashed anew.
    """
    start = F.greatest(own - (LEAST - 1), F.lit(0))
    rest = F.length(edited) - own
    moved = lambda a, by: let(by, lambda n: F.transform(a, lambda x: x - n))
    both = F.when((own > 0) & (rest > 0), moved(fingerprint(F.substring(edited, start + 1, own - start + (LEAST - 1))), start)).otherwise(F.array().cast("array<bigint>"))
    whole = F.array_distinct(F.concat(head_of(chosen, own), both, moved(head_of(next_chosen, rest), own)))
    return F.when(F.length(edited) < LEAST, fingerprint(edited)).otherwise(whole)


def shown(chosen: Column) -> Column:
    """`hash:place` of the chosen grams, joined by spaces."""
    one = lambda x: F.concat(F.shiftrightunsigned(x, 32), F.lit(":"), place(x))
    return F.array_join(F.transform(chosen, one), " ")


def hashes(chosen: Column) -> Column:
    """The different hashes of a fingerprint."""
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftrightunsigned(x, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def fingerprints(docs: DataFrame, by: list[str]) -> DataFrame:
    """Columns `by` and text (string, not null) of docs and chosen (array<bigint>, see `fingerprint`).

    Texts are cut into blocks of BLOCK windows, a row each, whose grams and windows are columns: for these Spark
    compiles code, where it interprets lambdas over arrays. So wide a table isn't compiled into one method, which
    would be too long for the JVM (spark.sql.codegen.maxFields, 100). A document's blocks come together again
    where they are, if docs are partitioned by some of `by`.
    """
    ends = (F.length("text") - LEAST).alias("_end")  # the last place where a window starts; here, for to count characters for each block would take quadratic time
    rows = docs.select(*by, "text", ends, F.monotonically_increasing_id().alias("_row"), F.transform(F.split("text", ""), F.ascii).alias("_codes"))
    rows = rows.withColumn("_at", F.explode(F.sequence(F.lit(0), F.greatest("_end", F.lit(0)), F.lit(BLOCK))))
    keep, wide = [*by, "_row", "_at", "_last", "_text"], BLOCK + LEAST - 1
    first = F.when(F.col("_at") == 0, F.col("text"))
    rows = rows.select(*by, "_row", "_at", (F.col("_end") - F.col("_at")).alias("_last"), first.alias("_text"), F.slice("_codes", F.col("_at") + 1, F.lit(wide)).alias("_codes"))

    def columns(rows: DataFrame, wide: int, value: Callable[[int], str]) -> DataFrame:
        return rows.selectExpr(*(f"`{c}`" for c in keep), *(f"{value(i)} _{i}" for i in range(wide)))

    def joined(shift: int) -> Callable[[int], str]:
        return lambda i: f"(_{i} * {pow(BASE, shift, PRIME)}L + _{i + shift}) % {PRIME}L"

    rows = columns(rows, wide, lambda i: f"coalesce(bigint(get(_codes, {i})), 0L)")  # places after the end count in no window
    rows = columns(rows, wide := wide - 2, lambda i: f"((_{i} * {BASE}L + _{i + 1}) * {BASE}L + _{i + 2}) % {PRIME}L")  # less than 2^63
    rows = columns(rows, wide := wide - 3, joined(3))
    rows = columns(rows, wide := wide - 6, lambda i: f"{joined(6)(i)} * {2**32}L + ({2**32 - 1 - i}L - _at)")
    for shift in (1, 2, 4, W - 8):
        rows = columns(rows, wide := wide - shift, lambda i, by=shift: f"if(_{i} < _{i + by}, _{i}, _{i + by})")
    new = ["if(_last >= 0, _0, -1L)", *(f"if(_last < {i} or _{i} = _{i - 1}, -1L, _{i})" for i in range(1, wide))]
    rows = rows.select(*by, "_row", "_at", "_text", F.expr(f"array_remove(array({', '.join(new)}), -1L)").alias("_chosen"))
    # the text lies in the first block: an aggregate of its own would copy it for each block
    rows = rows.groupBy(*by, "_row").agg(F.sort_array(F.collect_list(F.struct("_at", "_chosen", "_text"))).alias("_blocks"))
    rows = rows.select(*by, F.get("_blocks", F.lit(0))["_text"].alias("text"), "_blocks")
    whole = F.array_distinct(F.flatten("_blocks._chosen"))
    return rows.select(*by, "text", F.when(F.length("text") < LEAST, fingerprint(F.col("text"))).otherwise(whole).alias("chosen"))


def edited_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text string): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars/2) code points replaced by the first as many (or all) of
    the next document's, in descending order of doc_id, the first following the last. Rows that repeat
    a doc_id follow each other by text, null doc_ids come last, a null text counts as an empty one.
    Other columns are ignored; an empty table gives no rows.

    Rows are dealt into `ranges` ranges of doc_id by quantiles (four to a shuffle partition), so that one exchange
    brings each row beside its next; the first row of each range, which the range before it needs, is fetched by its
    id. The driver holds a number for each range.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 20 * ranges))).first()[0]
    cuts = sorted(~c for c in set(cuts or []))  # ranges go down: ~x = -x - 1 turns the order round
    own = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.col("_below")).cast("int")
    ranged = with_rank(rows, "_below", F.bitwise_not("doc_id"), cuts).withColumn("part", own).drop("_below")
    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("head_id")).orderBy("part").collect()  # a row per range
    firsts = json.dumps([{"head_id": h["head_id"], "part": heads[i - 1]["part"]} for i, h in enumerate(heads)])
    firsts = spark.range(1).select(F.inline(F.from_json(F.lit(firsts), "array<struct<head_id: bigint, part: int>>")))
    first = rows.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("head_id")))  # a row for each range
    first = first.groupBy("part").agg(F.min("text").alias("head"))
    first = first.withColumn("head_chosen", fingerprint(F.col("head")))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    dealt = fingerprints(ranged.repartition("part"), ["part", "doc_id"])  # texts alone are shuffled
    dealt = dealt.withColumn("next", F.lead(F.struct("text", "chosen")).over(order)).join(first, "part", "left")
    dealt = dealt.withColumns({"next_text": F.coalesce("next.text", "head"), "next_chosen": F.coalesce("next.chosen", "head_chosen")})
    n = F.length("text")
    dealt = dealt.select("doc_id", n.cast("long").alias("n_chars"), "chosen", "next_chosen", F.expr("concat(left(text, length(text) - length(text) div 2), left(next_text, cast(length(text) div 2 as int)))").alias("edited"))
    dealt = dealt.withColumn("edited_chosen", edited_fingerprint(F.col("edited"), F.col("chosen"), F.col("next_chosen"), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")))
    dealt = dealt.withColumns({"own_hashes": hashes(F.col("chosen")), "next_hashes": hashes(F.col("next_chosen")), "edited_hashes": hashes(F.col("edited_chosen"))})
    return dealt.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown(F.col("chosen")).alias("fingerprint"), shown(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )
