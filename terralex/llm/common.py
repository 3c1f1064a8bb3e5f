"""What several operators share: tables in shared storage, word hashing, sorted-group streams, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import sys
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct pre-tokens whose tokens, and words whose hashes, a Python worker keeps at once; a full memo is emptied, never refused.
MEMO_WORDS, MEMO_HASHES = 600_000, 150_000

#: Multiplier of the polynomial word hashes, and the odd constants of a 64-bit finaliser.
POLY = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Folders of sessions that have none in their settings, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where a session of one process has none (tests), one of its own is set. A cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="terralex-")
        _OWN[spark.sparkContext.applicationId] = root  # a running session's setting can't be changed
        atexit.register(_remove, spark, root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone when the interpreter ends  # noqa: BLE001
        pass


#: Lists of the folders that operators made within each open `owned`.
_OWNERS: list[list[str]] = []


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that operators called within wrote: write what is wanted of their results before."""
    _OWNERS.append([])
    try:
        yield
    finally:
        for root in _OWNERS.pop():
            _remove(spark, root)


class Scratch:
    """Parquet tables in shared storage that cut the lineage of one operator call.

    A lost executor costs at most the stage since the last cut. Tables that the result still reads stay
    until `owned` or the interpreter ends; `drop` removes the others at once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        if _OWNERS:
            _OWNERS[-1].append(self.root)
        atexit.register(_remove, spark, self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                _remove(self.spark, path)

    def release_shuffles(self) -> None:
        """Lets Spark's cleaner delete shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def released(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back when a partition ends: Spark keeps the worker for later tasks."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return go


class WordHashes(dict):
    """Memo from a word's bytes to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_HASHES:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= POLY
        h += words[j : j + n]
    return mixed(h)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores in front as it takes to clash with none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def with_rank(rows: DataFrame, name: str, value: Column, line: list[int]) -> DataFrame:
    """Adds how many numbers of a sorted line are less than a row's value, found by halving."""
    numbers = F.lit(line).cast("array<bigint>")
    rows = rows.withColumn("_value", value).withColumn(name, F.lit(0))
    step = 1 << len(line).bit_length() >> 1
    while step:  # one projection for each step: nested in one expression, each would hold the one before twice
        rows = rows.withColumn(name, F.when(F.get(numbers, F.col(name) + F.lit(step - 1)) < F.col("_value"), F.col(name) + F.lit(step)).otherwise(F.col(name)))
        step //= 2
    return rows.drop("_value")


def byte_of_char() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as printable characters: the others follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(keep)))}


#: Beyond this code point characters are looked at one by one.
PLAIN = re.compile("[\u0370-\U0010ffff]")


def unassigned(text: str, also: str = "") -> bool:
    """Whether a text holds characters on whose class libraries may differ, for they are new, or others given."""
    return bool(PLAIN.search(text)) and any(c in also or unicodedata.category(c) == "Cn" for c in set(text))


def sorted_groups(batches, keys: list[str]):
    """Tables of equal keys from a stream sorted by them; groups must be of bounded size."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if last is not None and key != last:
                yield last, pa.Table.from_batches(rest)
                rest = []
            last = key
            rest.append(batch.slice(a, b - a))
    if rest:
        yield last, pa.Table.from_batches(rest)


def fixed_width(column: pa.ChunkedArray | pa.Array, dtype, width: int) -> np.ndarray:
    """A matrix from a column of equally long binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def one_digest(scratch: Scratch, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose digest is the smallest of their key's, and those of them that hold it themselves.

    Ids are unique in a sound table; only if some aren't, the rows are joined with the clashing ids.
    """
    own = rows.where("digest is not null")
    clash = scratch.cut(own.groupBy(key).agg(F.min("digest").alias("d"), F.max("digest").alias("e")).where("d <> e").select(key, "d"))
    if clash.isEmpty():
        return rows, own
    own = own.join(clash, key, "left").where("digest = coalesce(d, digest)").drop("d")
    return rows.join(clash, key, "left").withColumn("digest", F.coalesce("d", "digest")).drop("d"), own


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star.

    links: columns u, v (long), in any direction, repeats and loops allowed.
    Returns node, root for each linked node that isn't the smallest of its component.
    A hot node's rows are met by an equi-join with one row per node, which adaptive
    execution can split; minima are pre-aggregated before they are shuffled.
    """
    edges = scratch.cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = scratch.cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.cut(down.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(small)
        scratch.drop(edges, large)
        edges = small
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
