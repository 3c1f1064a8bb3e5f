"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation, components.

1. Each text becomes a set of word shingles (64-bit hashes); texts of equal sets are one class.
2. 96 multiply-shift universal hashes give a signature; 24 bands of 4 minima give bucket keys.
   A pair of similarity 0.8 shares no band with probability (1 - 0.8^4)^24 = 3e-6.
3. Each text is first compared with the smallest member of its buckets: one pair for each text. Pairs
   whose signatures agree in enough places are confirmed on the full sets.
4. Buckets whose members still lie in several components are searched in blocks of bounded size for
   pairs *between* components: twice for each member's best partner by signature, which joins what is
   left of large groups, and then for all that remain, which are tested on full sets inside the block.
   So no link is lost that would join two components, and no group of copies is expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import Scratch, WordHashes, components, fixed_width, gram_hashes, one_digest, released, slices, sorted_groups

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Rows of one block of a bucket that step 4 compares at once, and shingles that the block's sets hold on average at most.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000

_rng = np.random.default_rng(20240611)
MULTIPLIERS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingle_set(words: list[bytes], k: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; the whole sequence if it is shorter, empty without words."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(gram_hashes(memo.of(words), k))


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 512):
        h = shingles[i : i + 512, None] * MULTIPLIERS
        h += OFFSETS
        h >>= np.uint64(32)
        np.minimum(out, h.min(axis=0), out=out)
    return out.astype(np.uint32)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batches):
            sizes, digests, sigs = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(words_of(text), k, memo)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return released(run)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batches):
            sets = [shingle_set(words_of(t), k, memo).tobytes() for t in batch.column("text").to_pylist()]
            own = pa.array([xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)], pa.bool_())
            yield pa.record_batch([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"]).filter(own)

    return released(run)


def _agree(least: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (fixed_width(batch.column(c), np.uint32, HASHES) for c in ("sig_u", "sig_v"))
                keep = pa.array((a == b).mean(axis=1) >= least)
                batch = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(keep)
                yield batch

    return released(run)


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_u"), batch.column("set_v"), strict=True):
                keep.append(similar(*(np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b)), percent))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return released(run)


GROUP = "bucket long, i long, j long, id long, comp long, block long, band int, sig binary"


class Block:
    """Rows of one pair of blocks of a bucket: which of them may link rows of other components."""

    def __init__(self, t: pa.Table, i: int, j: int, least: float):
        self.ids, self.comp, block = (t.column(c).to_numpy() for c in ("id", "comp", "block"))
        self.sig = fixed_width(t.column("sig"), np.uint32, HASHES)
        self.left, self.right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        self.band, self.least, self.same = t.column("band")[0].as_py(), least, i == j

    def partners(self, a: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows, those of other components whose signatures agree with a's, and how much; a pair meets in its first common band."""
        rows = rows[self.comp[rows] != self.comp[a]]
        equal = self.sig[rows] == self.sig[a]
        agree = equal.mean(axis=1)
        ok = agree >= self.least
        ok[ok] = ~equal[ok, : self.band * ROWS].reshape(ok.sum(), self.band, ROWS).all(axis=2).any(axis=1)
        return rows[ok], agree[ok]

    def sides(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.left, self.right)] if self.same else [(self.left, self.right), (self.right, self.left)]


def _best(least: float):
    """Each row's best partner of another component."""

    def run(batches):
        for (_, i, j), t in sorted_groups(batches, ["bucket", "i", "j"]):
            b = Block(t, i, j, least)
            us, vs, how = [], [], []
            for rows, others in b.sides():
                for a in rows:
                    hit, agree = b.partners(a, others)
                    if len(hit):
                        us.append(b.ids[a])
                        vs.append(b.ids[hit[agree.argmax()]])
                        how.append(agree.max())
            yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(how, pa.float64())], ["u", "v", "agree"])

    return released(run)


def _open(least: float):
    """The rows that have any partner."""

    def run(batches):
        for (_, i, j), t in sorted_groups(batches, ["bucket", "i", "j"]):
            b = Block(t, i, j, least)
            keep = np.zeros(t.num_rows, bool)
            for rows, others in b.sides():
                for a in rows:
                    keep[a] = len(b.partners(a, others)[0]) > 0
            yield from t.filter(pa.array(keep)).combine_chunks().to_batches()

    return released(run)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least percent/100."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _tested(least: float, percent: int):
    """Links between components of one pair of blocks, found on full sets; those that components already joined here don't need are left out."""

    def run(batches):
        for (_, i, j), t in sorted_groups(batches, ["bucket", "i", "j"]):
            b = Block(t, i, j, least)
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while (p := parent.setdefault(c, c)) != c:
                    c = p
                return c

            us, vs = [], []
            for a in b.left:
                for o in b.partners(a, b.right)[0]:
                    x, y = root(b.comp[a]), root(b.comp[o])
                    if x != y and similar(sets[a], sets[o], percent):
                        parent[x] = y
                        us.append(b.ids[a])
                        vs.append(b.ids[o])
            yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return released(run)


def _full_sets(scratch: Scratch, docs: DataFrame, reps: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, shingles of the classes in ids."""
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(ids.distinct().join(reps.select("id", "digest"), "id"), "id")
    return scratch.cut(texts.mapInArrow(_sets(k), "id long, shingles binary").dropDuplicates(["id"]))


def _verified(scratch: Scratch, docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (u, v) of class representatives, those that signatures and then full sets confirm."""
    sig = reps.select("id", "sig")
    pairs = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = pairs.join(sig.select(F.col("id").alias("u"), F.col("sig").alias("sig_u")), "u").join(sig.select(F.col("id").alias("v"), F.col("sig").alias("sig_v")), "v")
    near = scratch.cut(pairs.mapInArrow(_agree(_margin(percent)), "u long, v long"))
    sets = _full_sets(scratch, docs, reps, near.select(F.col("u").alias("id")).union(near.select(F.col("v").alias("id"))), k)
    both = near.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("set_u")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("set_v")), "v")
    out = scratch.cut(both.mapInArrow(_confirmed(percent), "u long, v long"))
    scratch.drop(near, sets)
    return out


def _margin(percent: int) -> float:
    """The agreement that a pair of the given similarity misses with a probability of about 1e-5."""
    s = percent / 100
    return s - 4.3 * (s * (1 - s) / HASHES) ** 0.5


def minhash_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id long, text string): doc_id, n_shingles, component_id, kept.

    Links texts whose sets of k-word shingles have a Jaccard similarity of at least percent/100
    (percent >= 60). Words: runs of anything but ASCII white space, A-Z in lower case. A text of
    fewer than k words is one shingle; a null or empty text has an empty set and links with nothing.
    component_id is the smallest doc_id reachable by links. A row with a null doc_id is linked with
    nothing, has a null component_id and is kept. Rows that repeat a doc_id are one document and get one
    component_id; if their sets differ, the one of the smallest digest is compared. Other columns are
    ignored; an empty table gives no rows.
    """
    if percent < 60:
        raise ValueError("the bands are laid out for similarities of 0.6 or more")
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.cut(docs.mapInArrow(_signed(k), "doc_id long, n_shingles long, digest binary, sig binary"))
    signed, own = one_digest(scratch, signed, "doc_id")
    reps = scratch.cut(own.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size")))
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(sig, b * {4 * ROWS} + 1, {4 * ROWS})))")
    banded = reps.select("id", "size", F.posexplode(keys).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.min("id").alias("star")).where("n > 1")
    blocks = F.expr(f"greatest((n + {BLOCK - 1}) div {BLOCK}, (weight + {BLOCK_SHINGLES - 1}) div {BLOCK_SHINGLES})")
    buckets = scratch.cut(banded.join(shared.withColumn("blocks", blocks), "bucket").select("id", "band", "bucket", "star", "blocks"))
    stars = buckets.where("star <> id").groupBy(F.col("id").alias("v")).agg(F.min("star").alias("u"))
    links = _verified(scratch, docs, reps, stars, k, percent)
    found = components(scratch, links)
    group = ["bucket", "i", "j"]
    for step in ("best", "best", "all"):
        # buckets that hold several components: pairs between those
        placed = buckets.join(found.withColumnRenamed("node", "id"), "id", "left").select("bucket", "band", "id", "blocks", F.coalesce("root", "id").alias("comp"))
        split = placed.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("bucket")
        placed = placed.join(split, "bucket").withColumn("block", F.expr("pmod(xxhash64(id), blocks)")).withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
        placed = placed.select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "id", "comp", "block", "band").join(reps.select("id", "sig"), "id")
        placed = placed.select(*group, "id", "comp", "block", "band", "sig").repartition(*group).sortWithinPartitions(*group)
        if step == "best":
            best = placed.mapInArrow(_best(_margin(percent)), "u long, v long, agree double").groupBy("u").agg(F.max_by("v", F.struct("agree", -F.col("v"))).alias("v"))
            more = _verified(scratch, docs, reps, best, k, percent)
        else:
            left = scratch.cut(placed.mapInArrow(_open(_margin(percent)), GROUP))
            rows = left.join(_full_sets(scratch, docs, reps, left.select("id"), k), "id").repartition(*group).sortWithinPartitions(*group)
            more = scratch.cut(rows.mapInArrow(_tested(_margin(percent), percent), "u long, v long"))
        if not more.isEmpty():
            links = scratch.cut(links.union(more))
            found = components(scratch, links)
        scratch.release_shuffles()
    roots = reps.select("digest", F.col("id")).join(found.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("root", "id").alias("root"))
    out = signed.select("doc_id", "n_shingles", "digest").join(roots, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
