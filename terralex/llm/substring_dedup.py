"""Repeated-phrase removal: recurring passages, sharded Aho-Corasick automata, every later occurrence located.

1. A window is 20 consecutive words. Its anchor is the least hash of its 6-word runs: equal windows
   have equal anchors. Consecutive windows of one anchor form a stretch (seven windows on average),
   and only one narrow row for each stretch is shuffled to find the anchors that recur.
2. Equal stretches are one: the first is kept, of all others every window occurred before. Where an
   anchor has different stretches, their words are dealt by anchor and sorted in reading order, so they
   lie together. Passages are confirmed word by word: what recurs is compiled into Aho-Corasick automata
   over word numbers, one for each run of stretches of bounded size (the automaton's shard), and the
   stretches are streamed through it. The first occurrence of a window stays, each later one is reported.
3. Reported word ranges go back to their documents, where covered words are removed.

A document never meets an automaton that can't match it, so work grows with the text and not with
text times shards. A group larger than a shard is streamed on; only its distinct windows are held, of HOT
stretches at most: where more share an anchor, their windows form groups of their own, by a hash of all
their words, and a window that more than HOT places hold is dealt to parts, each of which holds the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import Scratch, WordHashes, free_name, gram_hashes, released, slices

WINDOW, GRAM = 20, 6
#: Windows that one place of a 6-word run can anchor.
SPAN = WINDOW - GRAM + 1
#: Stretches of one automaton; its root has a branch for each first word, which are searched one by one.
SHARD = 500
#: Stretches or windows that one group holds at most.
HOT = 4096


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def stretches(words: list[bytes], memo: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch: anchor, hash of all its words, first window, number of windows, whether its document holds the anchor's run again."""
    if len(words) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    hashes = memo.of(words)
    grams = gram_hashes(hashes, GRAM)
    least = sliding_min(grams, SPAN)
    starts = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
    ns = np.diff(np.r_[starts, len(least)])
    line = np.sort(grams)
    same = line[1:] == line[:-1]
    again = np.isin(least[starts], line[1:][same]) if same.any() else np.zeros(len(starts), bool)
    raw = memoryview(hashes).cast("B")
    contents = [xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(starts.tolist(), (starts + ns + (WINDOW - 1)).tolist(), strict=True)]
    return least[starts], np.array(contents, np.uint64), starts, ns, again


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in slices(batches, 2048):
        if not batch.num_rows:
            continue
        found = [stretches((t or "").encode().split(), memo) for t in batch.column("text").to_pylist()]
        dids, ths = (np.repeat(batch.column(c).to_numpy(), [len(f[0]) for f in found]) for c in ("did", "th"))
        anchors, contents, starts, ns, again = (np.concatenate([f[i] for f in found]) for i in range(5))
        columns = [*(pa.array(x.view(np.int64)) for x in (anchors, contents)), pa.array(dids, pa.int64()), pa.array(ths, pa.int64()), pa.array(starts, pa.int32()), pa.array(ns, pa.int32()), pa.array(again, pa.bool_())]
        yield pa.record_batch(columns, ["anchor", "content", "did", "th", "start", "n", "again"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the marked stretches."""
    for batch in slices(batches):
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for did, th, text, marks in zip(*(batch.column(c).to_pylist() for c in ("did", "th", "text", "marks")), strict=True):
            words = (text or "").encode().split()
            for m in marks:
                s = m["start"]
                for column, x in zip(out, (m["key"], did, th, s, b" ".join(words[s : s + m["n"] + WINDOW - 1]), m["hot"]), strict=True):
                    column.append(x)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], ["anchor", "did", "th", "start", "words", "hot"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of stretches, by a hash of its words."""
    for batch in slices(batches):
        out: tuple[list, ...] = ([], [], [], [], [])
        for did, th, start, content in zip(*(batch.column(c).to_pylist() for c in ("did", "th", "start", "words")), strict=True):
            words = content.split(b" ")
            for i in range(len(words) - WINDOW + 1):
                window = b" ".join(words[i : i + WINDOW])
                for column, x in zip(out, (xxhash.xxh3_64_intdigest(window), did, th, start + i, window), strict=True):
                    column.append(x)
        keys = pa.array(np.array(out[0], np.uint64).view(np.int64))
        yield pa.record_batch([keys, *(pa.array(c, t) for c, t in zip(out[1:], (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True))], ["anchor", "did", "th", "start", "words"])


class Numbers(dict):
    """Words' numbers by order of appearance: the alphabet of a shard's automaton."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def windows(words: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    return [words[i : i + WINDOW] for i in range(len(words) - WINDOW + 1)]


def repeats(words: tuple[bytes, ...]) -> bool:
    """Whether a window of words occurs twice in them; with that, they hold WINDOW words less at least that differ."""
    return len(set(words)) <= len(words) - WINDOW and len(set(w := windows(words))) < len(w)


class Locator:
    """Finds the windows that occurred before, in rows (anchor, did, th, start, words) in order."""

    def __init__(self) -> None:
        self.anchor: int | None = None
        #: Of the group that the last shard ended in: the first occurrence of each window.
        self.first: dict[tuple[bytes, ...], tuple[int, int, int]] = {}

    def shard(self, rows: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        """Word ranges (did, th, from, to) of later occurrences in one shard's rows."""
        number = Numbers().__getitem__
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        phrases: list[tuple[bytes, ...]] = []
        split: dict[bytes, tuple[bytes, ...]] = {}

        def add(phrase: tuple[bytes, ...]) -> None:
            automaton.add_word(tuple(map(number, phrase)), len(phrases))
            phrases.append(phrase)

        active = []
        begin = 0
        carried_on = None
        for end in range(1, len(rows) + 1):
            if end < len(rows) and rows[end][0] == rows[begin][0]:
                continue
            anchor = rows[begin][0]
            whole = anchor != self.anchor and end < len(rows)  # the group neither began before nor goes on
            if whole and end - begin == 1 and not repeats(words := tuple(rows[begin][4].split(b" "))):
                begin = end
                continue
            active.append((begin, end))
            times: dict[bytes, int] = {}
            for r in rows[begin:end]:
                times[r[4]] = times.get(r[4], 0) + 1
            for c in times:
                split[c] = tuple(c.split(b" "))
            if whole and len(times) == 1 and not repeats(words := split[rows[begin][4]]):
                add(words)  # the whole passage recurs
            elif whole:
                seen: dict[tuple[bytes, ...], int] = {}
                for c, n in times.items():
                    for w in windows(split[c]):
                        seen[w] = seen.get(w, 0) + n
                for w, n in seen.items():
                    if n > 1:
                        add(w)
            else:
                for w in dict.fromkeys(w for c in times for w in windows(split[c])):
                    add(w)
                if end == len(rows):
                    carried_on = anchor
            begin = end
        if phrases:
            automaton.make_automaton()
        first = dict(self.first)
        hits: dict[bytes, list[tuple[int, tuple[bytes, ...]]]] = {}
        for begin, end in active:
            for _, did, th, start, content in rows[begin:end]:
                if content not in hits:
                    hits[content] = [(at + 1, phrases[p]) for at, p in automaton.iter(tuple(map(number, split[content])))] if phrases else []
                a = b = -1
                for at, phrase in hits[content]:
                    here = (did, th, start + at - len(phrase))
                    if first.setdefault(phrase, here) != here:
                        if b < 0:
                            a = here[2]
                        elif here[2] > b:
                            yield did, th, a, b
                            a = here[2]
                        b = start + at
                if b >= 0:
                    yield did, th, a, b
        own = set(self.first) if carried_on is not None and carried_on == self.anchor else set()
        if carried_on is not None:
            begin, end = active[-1]
            own.update(w for c in {r[4] for r in rows[begin:end]} for w in windows(split[c]))
        self.anchor, self.first = carried_on, {w: first[w] for w in own}


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    locator = Locator()
    rows: list[tuple] = []

    found: list[tuple[int, int, int, int]] = []

    def located() -> pa.RecordBatch:
        out = pa.record_batch([pa.array([f[i] for f in found], pa.int64() if i < 2 else pa.int32()) for i in range(4)], ["did", "th", "a", "b"])
        found.clear()
        return out

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "did", "th", "start", "words")), strict=True):
            if len(rows) >= SHARD:
                found += locator.shard(rows)
                rows = []
            rows.append(row)
        yield located()
    if rows:
        found += locator.shard(rows)
        yield located()


def repeated_ranges(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """did, th, ranges (array of struct a, b): words a to b-1 of the documents that hold later occurrences.

    docs: did long, th long (a hash of the text), text string; rows of equal did and th are one document.
    """
    place = F.struct("did", "th", "start")
    anchors = scratch.cut(docs.mapInArrow(released(_anchors), "anchor long, content long, did long, th long, start int, n int, again boolean"))
    recurring = anchors.groupBy("anchor").agg(F.count("*").alias("k"), F.max("again").alias("again")).where("k > 1 or again").select("anchor")
    marked = scratch.cut(anchors.join(recurring, "anchor"))
    scratch.drop(anchors)
    scratch.release_shuffles()
    # equal stretches once: the first stays for the automata, all windows of the others occurred before
    contents = scratch.cut(marked.groupBy("anchor", "content").agg(F.count("*").alias("k"), F.min(F.struct("did", "th", "start", "n")).alias("first"), F.max("again").alias("again")))
    copies = marked.join(contents.where("k > 1").select("anchor", "content", "first"), ["anchor", "content"]).where(place != F.struct("first.did", "first.th", "first.start"))
    copies = copies.select("did", "th", F.col("start").alias("a"), F.expr(f"start + n + {WINDOW - 1}").alias("b"))
    open_ = contents.groupBy("anchor").agg(F.count("*").alias("m"), F.max("again").alias("more")).where("m > 1 or more").select("anchor", (F.col("m") > HOT).alias("hot"))
    firsts = scratch.cut(contents.join(open_, "anchor").select(F.col("anchor").alias("key"), "first.*", "hot"))
    marks = firsts.groupBy("did", "th").agg(F.collect_set(F.struct("start", "n", "key", "hot")).alias("marks"))
    rows = "anchor long, did long, th long, start int, words binary"
    parts = docs.join(marks, ["did", "th"]).mapInArrow(released(_contents), f"{rows}, hot boolean")
    if not firsts.where("hot").isEmpty():
        # a run of words that very many different stretches hold: their windows one by one, and groups of equal windows in parts that each hold the first
        parts = scratch.cut(parts)
        windows = scratch.cut(parts.where("hot").mapInArrow(released(_windows), rows))
        first = windows.groupBy("anchor").agg(F.count("*").alias("k"), F.min(F.struct("did", "th", "start", "words")).alias("first")).where("k > 1").withColumn("parts", F.expr(f"(k + {HOT - 1}) div {HOT}"))
        later = windows.join(first, "anchor").where(place != F.struct("first.did", "first.th", "first.start"))
        later = later.select(F.xxhash64("anchor", F.expr("pmod(xxhash64(did, th, start), parts)")).alias("anchor"), "did", "th", "start", "words")
        earliest = first.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select(F.xxhash64("anchor", "part").alias("anchor"), "first.*")
        parts = parts.where("not hot").drop("hot").union(later).union(earliest)
    else:
        parts = parts.drop("hot")
    parts = parts.repartition("anchor").sortWithinPartitions("anchor", "did", "th", "start")
    found = scratch.cut(parts.mapInArrow(released(_located), "did long, th long, a int, b int").union(copies))
    scratch.release_shuffles()
    return found.groupBy("did", "th").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def kept_words(words: list[bytes], ranges: list[tuple[int, int]]) -> list[bytes]:
    keep = np.ones(len(words), bool)
    for a, b in ranges:
        keep[a:b] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def _with_ranges(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of ranges, and its name, which none of docs' columns has."""
    scratch = Scratch(docs.sparkSession, "substring")
    did, th, ranges = (free_name(docs, c) for c in ("did", "th", "ranges"))
    keyed = docs.withColumns({did: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), th: F.xxhash64(F.col("text"), F.col("doc_id").isNull())})
    own = keyed.select(F.col(did).alias("did"), F.col(th).alias("th"), F.col("text").cast("string").alias("text"))
    found = repeated_ranges(own, scratch).toDF(did, th, ranges)
    return keyed.join(found, [did, th], "left").drop(did, th), ranges


def _removed(batch: pa.RecordBatch, ranges: str) -> Iterator[tuple[list[bytes], list[bytes]]]:
    for text, own in zip(batch.column("text").to_pylist(), batch.column(ranges).to_pylist(), strict=True):
        words = (text or "").encode().split()
        yield words, kept_words(words, [(r["a"], r["b"]) for r in own]) if own else words


def substring_digests(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id long, text string): doc_id, n_words, n_removed, kept_sha256.

    Words are runs of anything but ASCII white space. Removes each word covered by a window of 20 words
    that also starts earlier: in a smaller doc_id, or earlier in the same document. Null doc_ids come
    first; rows that repeat a doc_id and text are one document and get equal results, texts that share
    a doc_id are ordered by a hash. A null or short text has nothing to remove. Other columns are
    ignored; an empty table gives no rows.
    """

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows, ranges = _with_ranges(docs.select("doc_id", F.col("text").cast("string").alias("text")))

    def run(batches):
        for batch in slices(batches):
            n, removed, sha = [], [], []
            for words, kept in _removed(batch, ranges):
                n.append(len(words))
                removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(released(run), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Rows and columns of docs; texts that hold repeated passages are their kept words, joined by one space.

    Repetition is that of `substring_digests`, also for null and repeated ids and texts of any length. Texts
    without any are returned unchanged, null ones too; an empty table stays empty. Other columns are handed
    through, whatever their names.
    """
    rows, ranges = _with_ranges(docs)
    names = docs.columns

    def run(batches):
        for batch in slices(batches):
            texts = [t if len(k) == len(w) else b" ".join(k).decode() for t, (w, k) in zip(batch.column("text").to_pylist(), _removed(batch, ranges), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return rows.mapInArrow(released(run), docs.schema)
