"""Embedding near-dedup by collision-counting projections.

1. Vectors of equal components are one class. Zero, null and non-finite vectors link with nothing.
2. Each vector is drawn as a sketch: its place on each of M sorted lines, orthonormal projections in
   steps of a byte. A window of +-w is centred on a query; a pair's count is the number of lines on which
   one lies in the other's window. The count that a pair must reach is calibrated so that a pair at the
   threshold falls short of it with a probability below SHORT (or never, where a bound shows it: as the
   projections are orthonormal, the squares of a pair's M differences sum to 2 - 2c at most).
3. Counting over the whole table would be quadratic: a window that a linked pair shares half of the time
   holds a tenth of all rows. So counting is done in cells, given by the sides of K other random
   projections on which a vector lies, in L independent layouts; a pair of cosine c lies on the same side
   with probability 1 - acos(c)/pi, and L follows from K so that a pair at the threshold meets in no
   layout with a probability below MISS. Only sketches are dealt to all layouts.
4. The count decides: rows without any partner that reaches it go no further. To the others' cells their
   vectors are joined, and the pairs that reach the count, and no other pairs, get a cosine in double
   precision. A pair is verified in the first layout in which it meets, so sums of links need no list of
   pairs; links leave a cell as a spanning forest.

Cells of many rows are dealt in pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from terralex.llm.common import Scratch, components, one_digest, sorted_groups

#: Probabilities that a pair of exactly the threshold meets in no cell, and that its count falls short.
MISS, SHORT = 1e-5, 1e-6
#: Rows a cell should hold, and rows of a block of a larger one.
CELL, BLOCK = 384, 768
#: Lines on which collisions are counted, and the half width of a window for cosine 0.95, where a line's unit is the spread of unrelated unit vectors.
COUNTED, HALF_WIDTH = 32, 0.8
#: Steps of a line to each unit; it is cut off at 4 units, which brings no two places further apart.
STEPS = 31.75


def layouts(rows: int, cosine: float) -> tuple[int, int]:
    """Bits of a cell and number of layouts."""
    bits = min(31, max(1, math.ceil(math.log2(max(rows, 2) / CELL))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - meet)))


def counting(dim: int, cosine: float) -> tuple[np.ndarray, int, int]:
    """Orthonormal projections scaled to steps, the windows' half width in steps, and the least count."""
    q, _ = np.linalg.qr(np.random.default_rng(77).standard_normal((dim, dim)))
    m = min(COUNTED, dim)
    apart = math.sqrt(2 - 2 * cosine)  # of a linked pair at most; on a line a normal deviate of this spread
    half = HALF_WIDTH * apart / math.sqrt(0.1)
    hit = math.erf(half / apart / math.sqrt(2))
    short, least = 0.0, 0
    while (short := short + math.comb(m, least) * hit**least * (1 - hit) ** (m - least)) <= SHORT:
        least += 1
    sure = m - math.floor(dim * apart**2 / half**2 + 1e-9)
    return q[:, :m] * (math.sqrt(dim) * STEPS), math.floor(half * STEPS) + 1, max(least, sure)


def _read(dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, digest = [], []
            for v in batch.column("embedding").to_pylist():
                x = np.array(v, dtype) if v and None not in v else np.empty(0)
                ok = len(x) > 0 and np.isfinite(x).all() and x.any()
                raw.append((x + dtype(0)).tobytes() if ok else None)
                digest.append(xxhash.xxh3_128_digest(raw[-1]) if ok else None)
            yield pa.record_batch([batch.column("vec_id"), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "digest", "raw"])

    return run


def unit(raw: list[bytes], dim: int, dtype=np.float64) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sketch(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each row's places on the lines."""
    return np.round(np.clip(x @ q, -127, 127)).astype(np.int8)


def _coded(bits: int, tables: int, cosine: float, dtype):
    def run(batches):
        planes: dict[int, tuple] = {}
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            codes: list = [None] * len(raw)
            lines: list = [None] * len(raw)
            dims = np.array([len(r) // dtype().itemsize for r in raw])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = np.random.default_rng(int(d)).standard_normal((d, bits * tables)), counting(int(d), cosine)[0]
                x = unit([raw[i] for i in at], d, dtype)
                signs = (x @ planes[d][0] >= 0).reshape(len(at), tables, bits)
                packed = (signs * (1 << np.arange(bits, dtype=np.int32))).sum(axis=2, dtype=np.int32)
                for i, c, line in zip(at, packed, sketch(x, planes[d][1]), strict=True):
                    codes[i], lines[i] = c, line.tobytes()
            yield pa.record_batch([batch.column("id"), batch.column("copies"), pa.array(dims, pa.int32()), batch.column("raw"), pa.array(codes, pa.list_(pa.int32())), pa.array(lines, pa.binary())], ["id", "copies", "dim", "raw", "codes", "line"])

    return run


def window_counts(queries: np.ndarray, rows: np.ndarray, half: int) -> np.ndarray:
    """For each query and row, on how many lines the row lies in the window centred on the query."""
    queries, rows = queries.astype(np.int16), rows.astype(np.int16)
    counts = np.zeros((len(queries), len(rows)), np.uint8)
    for j in range(queries.shape[1]):
        order = np.argsort(rows[:, j], kind="stable")
        line = rows[order, j]
        rank = np.empty(len(rows), np.uint16)
        rank[order] = np.arange(len(rows), dtype=np.uint16)
        low = np.searchsorted(line, queries[:, j] - half, "left").astype(np.uint16)
        span = np.searchsorted(line, queries[:, j] + half, "right").astype(np.uint16) - low
        counts += (rank[None, :] - low[:, None]) < span[:, None]  # unsigned: below the window wraps around
    return counts


def _labels(linked: np.ndarray) -> np.ndarray:
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


CELLS = ["layout", "cell", "dim", "i", "j"]


def _lines(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("line").to_pylist()), np.int8).reshape(t.num_rows, -1)


def _open(cosine: float):
    """The rows of a cell that have any partner whose count is reached."""

    def run(batches):
        ways: dict[int, tuple] = {}
        for (_, _, dim, i, j), t in sorted_groups(batches, CELLS):
            if t.num_rows < 2:
                continue
            if dim not in ways:
                ways[dim] = counting(int(dim), cosine)
            _, half, least = ways[dim]
            line, block = _lines(t), t.column("block").to_numpy()
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            reached = window_counts(line[left], line[right], half) >= least
            if i == j:
                np.fill_diagonal(reached, False)
            keep = np.zeros(t.num_rows, bool)
            keep[left[reached.any(axis=1)]] = True
            keep[right[reached.any(axis=0)]] = True
            yield from t.drop_columns(["line"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def linked_pairs(x: np.ndarray, line: np.ndarray, codes: np.ndarray, may: np.ndarray, half: int, least: int, cosine: float) -> tuple[np.ndarray, int]:
    """Which pairs of rows are linked, of those that may be, and how many got a cosine.

    Pairs are verified only if their count is reached and they have no code in common, which they would have met by.
    """
    ok = np.triu(window_counts(line, line, half) >= least, 1) & may
    verified = 0
    for a in np.flatnonzero(ok.any(axis=1)):
        rows = np.flatnonzero(ok[a])
        rows = rows[~(codes[rows] == codes[a]).any(axis=1)]
        verified += len(rows)
        ok[a] = False
        ok[a, rows[x[rows] @ x[a] >= cosine]] = True
    return ok | ok.T, verified


def _linked(cosine: float, dtype):
    def run(batches):
        ways: dict[int, tuple] = {}
        for (table, _, dim, i, j), t in sorted_groups(batches, CELLS):
            order = np.argsort(t.column("id").to_numpy(), kind="stable")
            ids, copies, block = (t.column(c).to_numpy()[order] for c in ("id", "copies", "block"))
            raw = t.column("raw").to_pylist()
            if dim not in ways:
                ways[dim] = counting(int(dim), cosine)
            q, half, least = ways[dim]
            x = unit([raw[o] for o in order], int(dim), dtype)
            codes = np.array(t.column("codes").to_pylist(), np.int32)[order, : int(table)]
            ok, _ = linked_pairs(x, sketch(x, q), codes, (block[:, None] != block[None, :]) | (i == j), half, least, cosine)
            links = ok @ copies
            some = np.flatnonzero(links)
            label = _labels(ok)
            joined = some[label[some] != some]
            yield pa.record_batch([pa.array(np.r_[ids[some], ids[joined]], pa.int64()), pa.array(np.r_[links[some], ids[label[joined]]], pa.int64()), pa.array(np.r_[np.zeros(len(some), bool), np.ones(len(joined), bool)])], ["a", "b", "edge"])

    return run


def embedding_dedup(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """One row per row of vectors (vec_id long, embedding array of float or double): vec_id, n_links, component_id, kept.

    Vectors are linked if their cosine in double precision is at least the given one (0.5 or more).
    n_links counts other rows linked directly; component_id is the smallest vec_id reachable, itself
    included. Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    as do vectors of different lengths. A null vec_id links with nothing, has a null component_id and is kept. Rows that
    repeat a vec_id with the same vector count as rows of their own; if their vectors differ, the one of
    the smallest digest is compared and counts once. Other columns, of whatever names, are ignored; an
    empty table gives no rows.
    """
    if not 0.5 <= cosine < 1:
        raise ValueError("cosine must be from 0.5 up to 1")
    scratch = Scratch(vectors.sparkSession, "embedding")
    dtype = np.float32 if isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), FloatType) else np.float64
    read = scratch.cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_read(dtype), "vec_id long, digest binary, raw binary"))
    read, own = one_digest(scratch, read, "vec_id")
    reps = scratch.cut(own.where("vec_id is not null").groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("raw").alias("raw")))
    bits, tables = layouts(reps.count(), cosine)
    coded = scratch.cut(reps.select("id", "copies", "raw").mapInArrow(_coded(bits, tables, cosine, dtype), "id long, copies long, dim int, raw binary, codes array<int>, line binary"))
    cells = coded.select("id", "dim", "line", F.posexplode("codes").alias("layout", "cell"))
    large = cells.groupBy("layout", "cell", "dim").agg(F.count("*").alias("n")).where(f"n > {BLOCK}")
    dealt = cells.join(large, ["layout", "cell", "dim"], "left").withColumn("blocks", F.expr(f"cast((coalesce(n, 1) + {BLOCK - 1}) div {BLOCK} as int)"))
    dealt = dealt.withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)")).withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("layout", "cell", "dim", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "line")
    reached = scratch.cut(dealt.repartition(*CELLS).sortWithinPartitions(*CELLS).mapInArrow(_open(cosine), "layout int, cell int, dim int, i int, j int, block int, id long"))
    paired = reached.join(coded.select("id", "copies", "raw", "codes"), "id").repartition(*CELLS).sortWithinPartitions(*CELLS)
    found = scratch.cut(paired.mapInArrow(_linked(cosine, dtype), "a long, b long, edge boolean"))
    roots = components(scratch, found.where("edge").select(F.col("a").alias("u"), F.col("b").alias("v")))
    links = found.where("not edge").groupBy("a").agg(F.sum("b").alias("links"))
    classes = reps.select("digest", "id", "copies").join(links, F.col("id") == F.col("a"), "left").join(roots, F.col("id") == F.col("node"), "left")
    classes = classes.select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "id").alias("root"))
    out = read.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(classes, "digest", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
