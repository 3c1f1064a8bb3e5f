"""Consistent-hash ring with virtual nodes and bounded loads, by DataFrame functions only.

Each shard has a fixed number of virtual nodes at hashed points of a 64-bit ring, which don't depend on how many
shards there are. A row's key is its text: its hash is a point of the ring, and the next virtual node clockwise
owns it. So equal texts form a group with one place, whose rows lie in one shard, or, if that is full, in the next
ones clockwise. A shard's load is bounded by its share of all rows, shares being equal up to one row. Rows beyond a
full shard continue clockwise to the next arc whose shard has room. As the bounds add up to the number of rows,
every shard is filled exactly: the law is `rows`. One more shard takes the rows of its own arcs; besides those only
rows move that bounded loads put elsewhere than the arc's owner.

Which ranks of an arc's rows stay and which move on follows from the arcs' row counts alone, a
table of shards * virtual nodes rows; so the rows themselves are numbered in small cells of the
arcs (by a hash of doc_id, so that a hot text is spread as well). Rows that are equal in all that is
returned are one row with a count until they are numbered, so that repeated rows don't meet in one task.
"""

from __future__ import annotations

import json
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terralex.llm.common import Scratch, with_rank

#: Virtual nodes of a shard; rows of an arc are numbered in so many cells by a hash of doc_id.
VIRTUAL_NODES, SPREAD = 128, 64
#: Copies of one row that a task numbers at once.
COPIES = 10_000
SIGN = 1 << 63


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """Point (signed 64-bit) and shard of each virtual node, clockwise."""
    mask = (1 << 64) - 1

    def place(x: int) -> int:
        x = (x * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & mask
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return (x ^ x >> 31) - SIGN

    return sorted((place(s << 20 | v), s) for s in range(shards) for v in range(virtual_nodes))


def with_arc(rows: DataFrame, point: Column, points: list[int]) -> DataFrame:
    """Adds column arc: the number of the first of the sorted points at or clockwise of a row's."""
    return with_rank(rows, "arc", point, points).withColumn("arc", F.pmod("arc", F.lit(len(points))))


def dealt(counts: list[int], owner: list[int], shards: int) -> list[list[tuple[int, int]]]:
    """For each arc, runs (rows, shard) of its rows by rank: its owner first, then clockwise where there is room."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out: list[list[tuple[int, int]]] = []
    for n, s in zip(counts, owner, strict=True):
        stay = min(n, room[s])
        room[s] -= stay
        out.append([(stay, s)] if stay else [])
    for a, n in enumerate(counts):
        left = n - sum(k for k, _ in out[a])
        b = a
        while left:
            b = (b + 1) % len(owner)
            if k := min(left, room[owner[b]]):
                room[owner[b]] -= k
                left -= k
                out[a].append((k, owner[b]))
    return out


def ring_shards(docs: DataFrame, shards: int = 16, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """One row per row of docs (doc_id, text string): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 1. law is `rows`: shards' row counts are at most
    one apart. Groups are equal texts (a null one counts as empty): they have one place on the ring.
    slot: gapless from 0 in a shard. grown_shard is null under this law. A null doc_id is numbered like any
    other; repeated rows each get a slot. Other columns are ignored; an empty table gives no rows.
    """
    nodes = ring(shards, virtual_nodes)
    owner = [s for _, s in nodes]
    n = len(owner)
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = with_arc(rows, F.xxhash64("text"), [p for p, _ in nodes])
    rows = rows.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "arc", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int").alias("cell"))
    rows = scratch.cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")))  # texts are read once; this is narrow
    cells = Counter({(r["arc"], r["cell"]): r["n"] for r in rows.groupBy("arc", "cell").agg(F.sum("copies").alias("n")).collect()})  # n * SPREAD rows at most
    counts = [sum(cells[a, c] for c in range(SPREAD)) for a in range(n)]
    before = [[0, *accumulate(cells[a, c] for c in range(SPREAD))][:SPREAD] for a in range(n)]
    taken = [0] * shards
    plan = []
    for a, parts in enumerate(dealt(counts, owner, shards)):
        start, runs = 0, []
        for k, s in parts:
            runs.append({"until": start + k, "shard": s, "shift": taken[s] - start})
            start, taken[s] = start + k, taken[s] + k
        plan.append({"arc": a, "before": before[a], "runs": runs})
    kind = "array<struct<arc: int, before: array<bigint>, runs: array<struct<until: bigint, shard: int, shift: bigint>>>>"
    plan = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), kind)))
    earlier = F.sum("copies").over(Window.partitionBy("arc", "cell").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies")
    placed = rows.withColumn("earlier", earlier)
    often = placed.where(F.col("copies") > COPIES).withColumn("first", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)")))
    often = often.withColumns({"earlier": F.expr("earlier + first"), "copies": F.expr(f"least({COPIES}L, copies - first)")}).drop("first").repartition("arc", "cell", "doc_id", "earlier")
    placed = placed.where(F.col("copies") <= COPIES).unionByName(often)
    ranked = placed.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).join(F.broadcast(plan), "arc")  # as many rows as there are arcs
    ranked = ranked.withColumn("rank", F.expr("before[cell] + earlier + copy"))
    ranked = ranked.withColumn("run", F.expr("filter(runs, r -> rank < r.until)[0]"))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("run.shard").alias("shard"), (F.col("rank") + F.col("run.shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
