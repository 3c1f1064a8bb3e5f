"""Lexical retrieval packing: documents that share rare tokens fill one another's windows.

1. Each text is tokenised and ends in an end id.
   Full windows of a long document are sequences of their own; what is left, its tail, is packed.
2. Token document frequencies over all tails give the weights of BM25. They are as many as the
   vocabulary has ids, however many documents there are.
3. Tails are range-partitioned by their heaviest tokens, so like tails lie near each other and a
   large group of copies is spread over ranges. Each run of SHARD tails is indexed (postings of
   token, tail, weight). A seed asks the index of its shard with its heaviest tokens; the unused
   neighbours returned fill its window greedily by score, and the best one left is cut to end it.
   A window that a shard leaves open is carried on to the next shard of the partition.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terralex.llm.common import Scratch, byte_of_char, unassigned

BYTE_BPE = "byte_bpe_50k.json"
WIDTH = 1024
#: Tails of one index, tokens of a query, and neighbours that it returns.
SHARD, QUERY, NEIGHBOURS = 2048, 12, 16
#: Parameters of BM25.
K1, B = 1.2, 0.75


class Encoder:
    """Ids of texts as 16-bit numbers, exactly as the tokenizer in a file gives them without special tokens added.

    As its ids are the order of its merges, the vocabulary also serves as ranks for a faster encoder. What
    the two might treat differently goes to the tokenizer itself: special strings, unassigned characters.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        of = byte_of_char()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if self.tokenizer.normalizer is not None or [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))) or self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the ids must be the order of the merges, of 16 bits, and nothing normalised")
        ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if i not in added}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if any(a in text for a in self.added) or unassigned(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tails(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            n, crcs, tails = [], [], []
            for text in batch.column("text").to_pylist():
                ids = np.array([*e.encode(text or ""), end], np.uint16)
                full = len(ids) // WIDTH
                n.append(len(ids))
                crcs.append([crc(ids[i * WIDTH : (i + 1) * WIDTH]) for i in range(full)])
                tails.append(ids[full * WIDTH :].tobytes())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())], ["doc_id", "doc_tokens", "full_crcs", "tail"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for tail in batch.column("tail"):
            n[np.unique(np.frombuffer(tail.as_buffer(), np.uint16))] += 1
    at = np.flatnonzero(n)
    yield pa.record_batch([pa.array(at, pa.int32()), pa.array(n[at])], ["token", "n"])


def _weights(ids: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of a tail and their BM25 weights."""
    tokens, tf = np.unique(ids, return_counts=True)
    return tokens, idf[tokens] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))


def _topics(idf: np.ndarray, mean: float):
    def run(batches):
        for batch in batches:
            first, second = [], []
            for tail in batch.column("tail"):
                ids = np.frombuffer(tail.as_buffer(), np.uint16)
                tokens, w = _weights(ids, idf, mean)
                top = tokens[np.argsort(-w, kind="stable")[:2]].tolist()
                first.append(top[0] if top else -1)
                second.append(top[1] if len(top) > 1 else -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32())], [*batch.schema.names, "topic", "second"])

    return run


class Index:
    """BM25 postings of one shard's tails."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        found = [_weights(t, idf, mean) for t in tails]
        token = np.concatenate([t for t, _ in found])
        weight = np.concatenate([w for _, w in found])
        tail = np.repeat(np.arange(len(tails)), [len(t) for t, _ in found])
        order = np.argsort(token, kind="stable")
        self.tail, self.weight = tail[order], weight[order]
        self.begin = np.searchsorted(token[order], np.arange((1 << 16) + 1))
        self.queries = [t[np.argsort(-w, kind="stable")[:QUERY]] for t, w in found]

    def neighbours(self, seed: int, unused: np.ndarray) -> list[int]:
        """The best unused tails for a seed, best first, ties by place."""
        score = np.zeros(len(unused))
        for t in self.queries[seed].tolist():
            a, b = self.begin[t], self.begin[t + 1]
            score[self.tail[a:b]] += self.weight[a:b]
        score *= unused
        top = np.argpartition(-score, NEIGHBOURS)[:NEIGHBOURS] if len(score) > NEIGHBOURS else np.arange(len(score))
        top = top[np.lexsort((top, -score[top]))]
        return top[score[top] > 0].tolist()


class Packer:
    """Fills windows one after another; places pieces as (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, partition: int, idf: np.ndarray, mean: float):
        self.sequence, self.idf, self.mean = partition << 40, idf, mean
        self.window: list[tuple] = []
        self.used = 0
        self.out: list[tuple] = []

    def full(self, doc_id, doc_tokens: int, crcs: list[int]) -> None:
        for i, c in enumerate(crcs):
            self.out.append((doc_id, i * WIDTH, WIDTH, c, doc_tokens, self.sequence, 0))
            self.sequence += 1

    def put(self, tail: tuple, a: int, b: int) -> None:
        """Part a to b of a tail (doc_id, doc_tokens, ids) goes to the open window, which must have room."""
        self.window.append((tail, a, b))
        self.used += b - a
        if self.used == WIDTH:
            self._close(self.window)
            self.window, self.used = [], 0

    def _close(self, parts: list[tuple]) -> None:
        offset = 0
        for (doc_id, doc_tokens, ids), a, b in parts:
            self.out.append((doc_id, doc_tokens - len(ids) + a, b - a, crc(ids[a:b]), doc_tokens, self.sequence, offset))
            offset += b - a
        self.sequence += 1

    def shard(self, tails: list[tuple]) -> None:
        index = Index([t[2] for t in tails], self.idf, self.mean)
        unused = np.ones(len(tails), bool)
        done = [0] * len(tails)

        def rest(i: int) -> int:
            return len(tails[i][2]) - done[i]

        def place(i: int) -> None:
            """As much of a tail as the window takes."""
            k = min(rest(i), WIDTH - self.used)
            done[i] += k
            if not rest(i):
                unused[i] = False
            self.put(tails[i], done[i] - k, done[i])

        at = 0
        cut = None
        while True:
            while at < len(tails) and not unused[at]:
                at += 1
            if at == len(tails):
                break
            seed = cut if cut is not None and unused[cut] else at
            place(seed)
            near = [seed]
            while self.used and near:  # ask again until the window is full or nothing unused scores
                near = [i for i in index.neighbours(seed, unused) if i != seed]
                for i in near:
                    if self.used and rest(i) < WIDTH - self.used:
                        place(i)
                left = [i for i in near if unused[i]]
                if self.used and left:
                    cut = left[0]
                    place(cut)

    def end(self) -> None:
        """The last window is cut into sequences whose lengths are powers of two, which need no padding."""
        parts, used = self.window, self.used
        while used:
            size = 1 << (used.bit_length() - 1)
            now, later, room = [], [], size
            for tail, a, b in parts:
                k = min(room, b - a)
                if k:
                    now.append((tail, a, a + k))
                if a + k < b:
                    later.append((tail, a + k, b))
                room -= k
            self._close(now)
            parts, used = later, used - size


def _packed(idf: np.ndarray, mean: float):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        packer = Packer(TaskContext.get().partitionId(), idf, mean)
        tails: list[tuple] = []
        kind = pa.int64()

        def emitted() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            return pa.record_batch([pa.array([r[i] for r in out], kind if i == 0 else pa.int64()) for i in range(7)], names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, n, crcs, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "full_crcs", "tail")), strict=True):
                packer.full(doc_id, n, crcs)
                if tail:
                    tails.append((doc_id, n, np.frombuffer(tail, np.uint16)))
                if len(tails) == SHARD:
                    packer.shard(tails)
                    tails = []
                    yield emitted()
        if tails:
            packer.shard(tails)
        packer.end()
        yield emitted()

    return run


def pack(docs: DataFrame, path: str | None = None, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Packs docs (doc_id, text string; null text: empty) into sequences of 1024 ids: a document is its ids
    and the id `end`. Each id lies in exactly one piece; all sequences are full but the last of each
    partition, which is dealt into powers of two. path: a tokenizers file readable on each executor.
    Rows that repeat a doc_id are documents of their own. Other columns are ignored; an empty table
    gives no rows.
    """
    path = path or public_tokenizers.path(BYTE_BPE)
    scratch = Scratch(docs.sparkSession, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    tokens = scratch.cut(rows.mapInArrow(_tails(path, end), f"doc_id {kind}, doc_tokens long, full_crcs array<long>, tail binary"))
    total = tokens.where("length(tail) > 0").agg(F.count("*").alias("n"), F.avg(F.length("tail") / 2).alias("mean")).first()
    counts = tokens.select("tail").mapInArrow(_frequencies, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # 65,536 rows at most
    df = np.zeros(1 << 16)
    for r in counts:
        df[r["token"]] = r["n"]
    idf = np.log1p((total["n"] - df + 0.5) / (df + 0.5))
    mean = total["mean"] or 1.0
    topics = scratch.cut(tokens.mapInArrow(_topics(idf, mean), f"doc_id {kind}, doc_tokens long, full_crcs array<long>, tail binary, topic int, second int"))
    scratch.drop(tokens)
    order = ["topic", "second", "doc_id", "doc_tokens"]
    spread = topics.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.cut(spread.mapInArrow(_packed(idf, mean), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
