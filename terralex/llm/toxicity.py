"""Toxicity by weak supervision.

1. From a bounded sample of labelled documents, terms (words, and word beginnings of 4 to 6 letters) are
   mined that documents marked toxic hold, or hold densely (as a share of their words), far more often
   than chance allows.
2. The terms form lexicon voters, by strength and by a hash; pattern voters look at the number, the
   density and the repetition of hits. Terms that clean documents hold too, but far less than their share,
   form weak voters of their own. Each voter says toxic or clean, or abstains.
3. A generative label model estimates, by expectation-maximisation, each voter's accuracy on either
   class, anchored on the sample's share of toxic documents. Correlations that remain between two
   voters given the class are estimated too, and each voter counts the less the more it is correlated.
4. A linear classifier on terms and voters is trained on the posterior labels; it scores all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import Scratch, WordHashes, gram_hashes, mixed, released, slices

#: Labelled documents that the model is fitted on at most, and bytes of their words.
SAMPLE, SAMPLE_BYTES = 8_000, 48_000_000
#: Score of every text, at most, where the labels tell nothing: nobody is accused without evidence.
UNTOLD = 0.1
#: Terms at most, the least share of toxic documents of a term, and terms expected to pass by chance.
TERMS, PRECISION, CHANCE = 600, 0.75, 0.5
#: A weak term's share of toxic documents is so many times that of all documents at least.
LIFT = 4
#: A text holds a term densely if so many of its words do, at least twice; the term is then marked by DENSE as well.
SHARE, DENSE = 0.01, "%"
#: Voters of terms, and those of them that hold weak terms, which come last.
LEXICONS, WEAK = 12, 4
#: What a voter counts at least, however correlated it is.
LEAST_WEIGHT = 0.4
THRESHOLD = 0.3
HEAD = 4
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def dense(times: int, words: int) -> bool:
    return times >= 2 and times >= SHARE * words


def terms_of(words: list[str]) -> set[str]:
    """A text's words as they are, and their beginnings marked by a star; those it holds densely marked by DENSE as well."""
    times: Counter = Counter()
    for w, n in Counter(words).items():
        if len(w) >= HEAD - 1:
            times[w] += n
            for k in (4, 5, 6):
                if len(w) > k:
                    times[w[:k] + "*"] += n
    return {*times, *(t + DENSE for t, n in times.items() if dense(n, len(words)))}


def _h(x: str) -> int:
    return xxhash.xxh32_intdigest(x)


@dataclass
class Model:
    """Weights of the linear classifier: terms, then voters (toxic and clean votes), then the bias."""

    terms: dict[str, float]
    lexicon: dict[str, int]
    voters: list[tuple[float, float]]
    bias: float
    #: For the record: each voter's estimated chance to vote toxic on clean and on toxic documents.
    accuracies: list[tuple[float, float]]

    def __post_init__(self) -> None:
        self.heads = {t[:3] for t in self.lexicon}

    def hits(self, words: list[str]) -> tuple[set[str], int]:
        """Lexicon terms in a text, and how many of its words hold one that isn't weak."""
        held: list[list[str]] = []
        lexicon, heads = self.lexicon, self.heads
        for w in words:
            if w[:3] in heads:
                own = [t for t in (w, w[:4] + "*", w[:5] + "*", w[:6] + "*") if (t in lexicon or t + DENSE in lexicon) and (t == w or len(w) >= len(t))]
                if own:
                    held.append(own)
        times = Counter(t for own in held for t in own)
        found = {t for t in times if t in lexicon}
        found.update(t + DENSE for t, n in times.items() if t + DENSE in lexicon and dense(n, len(words)))
        strong = {t for t in found if lexicon[t] < LEXICONS - WEAK}
        return found, sum(any(t in strong or t + DENSE in strong for t in own) for own in held)

    def score(self, words: list[str]) -> float:
        found, n = self.hits(words)
        z = self.bias + sum(self.terms[t] for t in found)
        for v, (toxic, clean) in zip(votes(found, n, len(words), self.lexicon), self.voters, strict=True):
            z += toxic if v > 0 else clean if v < 0 else 0.0
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def votes(found: set[str], n: int, words: int, lexicon: dict[str, int]) -> list[int]:
    """1 toxic, -1 clean, 0 abstains: lexicon voters, then patterns."""
    in_list, strong = [0] * LEXICONS, 0
    for t in found:
        in_list[lexicon[t]] = 1
        strong += lexicon[t] < LEXICONS - WEAK
    out = [1 if x else (-1 if words else 0) for x in in_list]
    out.append(1 if n >= 2 else -1 if n == 0 else 0)  # several words
    out.append(1 if n and n / words >= 0.01 else -1 if n / max(words, 1) < 0.002 else 0)  # density
    out.append(1 if strong >= 2 else -1 if not strong else 0)  # variety
    out.append(-1 if words >= 5 and not n else 0)  # a text of some length without any
    return out


VOTERS = LEXICONS + 4


def copies(texts: list[str]) -> np.ndarray:
    """A group for each text (words joined by spaces): near copies, which share the least hash of their three-word runs in one of four orders."""
    memo, of, parent = WordHashes(), {}, list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, text in enumerate(texts):
        grams = gram_hashes(memo.of(text.encode().split()), 3)
        for k in range(4 if len(grams) else 0):
            a, b = root(i), root(of.setdefault((k, int(mixed(grams ^ np.uint64(k)).min())), i))
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(texts))], int)


def mine(texts: list[str], toxic: np.ndarray) -> dict[str, int]:
    """Terms with the voter each belongs to: strength in two classes and the weak ones, by a hash within them.

    Near copies count once. A term stands out if, of all terms in as many toxic texts or more, less
    than CHANCE are expected to be this unevenly spread (by the G-test's bound on the tail). Terms held
    densely are counted apart from terms held at all, and terms held by the same texts as one.
    """
    members: dict[int, list[int]] = {}
    for i, g in enumerate(copies(texts)):
        members.setdefault(g, []).append(i)
    marked = {g: any(toxic[i] for i in own) for g, own in members.items()}
    n1 = sum(marked.values())
    n0 = len(members) - n1
    if not n1 or not n0:
        return {}

    def terms(own: list[int]) -> set[str]:
        return set().union(*(terms_of(texts[i].split()) for i in own))

    in_toxic: Counter = Counter()
    holders: Counter = Counter()  # a sum of hashes tells by which toxic texts a term is held
    for g, own in members.items():
        if marked[g]:
            now = terms(own)
            in_toxic.update(now)
            h = xxhash.xxh64_intdigest(str(g))
            for t in now:
                holders[t] += h
    in_clean = {t: 0 for t, n in in_toxic.items() if n >= (2 if t.endswith(DENSE) else 3)}
    as_many = {}
    for kind in (True, False):
        spread = Counter(n for n, _ in {(in_toxic[t], holders[t]) for t in in_toxic if t.endswith(DENSE) == kind})
        total = 0
        for n in sorted(spread, reverse=True):
            total += spread[n]
            as_many[kind, n] = total
    for g, own in members.items():
        if not marked[g]:
            for t in terms(own):
                if t in in_clean:
                    in_clean[t] += 1
    scored, weak = [], []
    for term, b in in_clean.items():
        a = in_toxic[term]
        if a < min(PRECISION, LIFT * n1 / (n1 + n0)) * (a + b):
            continue
        e1, e0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
        g = 2 * (a * np.log(a / e1) + (b * np.log(b / e0) if b else 0))
        if as_many[term.endswith(DENSE), a] * np.exp(-g / 2) < CHANCE:
            (scored if a >= PRECISION * (a + b) else weak).append((-g, term))
    best = [t for _, t in sorted(scored)[:TERMS]]
    half = (LEXICONS - WEAK) // 2
    strong = {t: (0 if i < len(best) / 2 else half) + _h(t) % half for i, t in enumerate(best)}
    return strong | {t: LEXICONS - WEAK + _h(t) % WEAK for _, t in sorted(weak)[:TERMS]}


def label_model(votes_of: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of toxic for each row of votes, and each voter's chance to vote toxic on (clean, toxic)."""
    says, silent = votes_of > 0, votes_of == 0
    sure = np.delete(says, np.s_[LEXICONS - WEAK : LEXICONS], axis=1)
    post = np.where(sure.any(axis=1), 0.9, prior / 4)
    weight = np.ones(votes_of.shape[1])
    rates = np.full((2, votes_of.shape[1]), 0.5)
    for i in range(rounds):
        for c, w in enumerate((1 - post, post)):
            cast = (w[:, None] * ~silent).sum(axis=0)
            rates[c] = ((w[:, None] * says).sum(axis=0) + 0.5) / (cast + 1)
        if i >= 5:  # correlations given the class, from what the accuracies leave
            signed = np.where(silent, 0, np.where(says, 1.0, 0.0) - (np.outer(1 - post, rates[0]) + np.outer(post, rates[1])))
            cov = signed.T @ signed / len(signed)
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            rho = np.abs(cov / np.outer(scale, scale))
            np.fill_diagonal(rho, 0)
            weight = np.maximum(LEAST_WEIGHT, 1 / (1 + np.where(rho > 0.1, rho, 0).sum(axis=1)))
        up, down = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        z = (np.where(silent, 0, np.where(says, up, down)) * weight).sum(axis=1) + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post, rates.T


def train(texts: list[str], toxic: np.ndarray, documents: np.ndarray | None = None) -> Model:
    """A model from sampled texts (words joined by spaces), their labels, and how many documents have each text.

    Without a term that tells toxic from clean texts, every score is the share of toxic documents, UNTOLD at most.
    """
    documents = np.ones(len(toxic)) if documents is None else documents
    prior = float(((toxic * documents).sum() + 0.5) / (documents.sum() + 1))
    lexicon = mine(texts, toxic)
    if not lexicon:
        share = min(prior, UNTOLD)
        return Model({}, {}, [(0.0, 0.0)] * VOTERS, float(np.log(share / (1 - share))), [(0.5, 0.5)] * VOTERS)
    probe = Model({}, lexicon, [], 0.0, [])
    found = [probe.hits(t.split()) for t in texts]
    v = np.array([votes(f, n, t.count(" ") + bool(t), lexicon) for (f, n), t in zip(found, texts, strict=True)])
    post, rates = label_model(v, prior)
    names = sorted(lexicon)
    at = {t: i for i, t in enumerate(names)}
    x = np.zeros((len(texts), len(names) + 2 * VOTERS + 1), np.float32)
    for i, (f, _) in enumerate(found):
        x[i, [at[t] for t in f]] = 1
    x[:, len(names) : len(names) + VOTERS] = v > 0
    x[:, len(names) + VOTERS : -1] = v < 0
    x[:, -1] = 1
    # equal rows once, with their weight: most documents hold no term at all
    rows, same, n = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    target = np.bincount(same.ravel(), post) / n
    weight = n / n.sum()
    target, weight = target.astype(np.float32), weight.astype(np.float32)
    w, speed = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for _ in range(600):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (weight * (p - target)) + np.float32(1e-4) * w
        speed = 0.9 * speed - 0.5 * grad
        w += speed
    k = len(names)
    return Model(dict(zip(names, w[:k].tolist(), strict=True)), lexicon, list(zip(w[k : k + VOTERS].tolist(), w[k + VOTERS : -1].tolist(), strict=True)), float(w[-1]), [tuple(r) for r in rates.tolist()])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model on at most `sample` labelled documents outside the held-out fold, chosen by a hash of doc_id, and SAMPLE_BYTES of their words."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")  # `sample` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(words, pa.string())], ["id", "toxic", "words"])

    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = scratch.cut(rows.mapInArrow(released(run), "id long, toxic int, words string").groupBy("words").agg(F.max("toxic").alias("toxic"), F.min("id").alias("id"), F.count("*").alias("n")))
    # narrow rows, `sample` at most: texts in the sample's order as far as their bytes go
    sizes = sorted(texts.select("id", F.xxhash64("id").alias("h"), F.octet_length("words").alias("bytes")).collect(), key=lambda r: (r["h"], r["id"]))
    fits = [r["id"] for r, total in zip(sizes, accumulate(r["bytes"] for r in sizes), strict=True) if total <= SAMPLE_BYTES]
    got = sorted(texts.where(F.col("id").isin(fits)).collect() if len(fits) < len(sizes) else texts.collect(), key=lambda r: r["id"])
    scratch.drop(texts)
    return train([r["words"] for r in got], np.array([r["toxic"] > 0 for r in got], bool), np.array([r["n"] for r in got], float))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Columns of docs, and two of the given names (other than theirs): the score, and 1 if it reaches the threshold, else 0."""
    if taken := set(names) & set(docs.columns):
        raise ValueError(f"docs have columns {taken} of their own: give other names")
    schema = docs.select("*", F.lit(0.0).alias(names[0])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = pa.array([model.score(words_of(t)) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, names[0]])

    return docs.mapInArrow(released(run), schema).withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs whose text scores below the threshold, with all their columns, whatever these are called.

    Null and empty texts score by the model's bias; rows that repeat stay or go together; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([model.score(words_of(t)) < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text string): doc_id, held_out, score, predicted.

    labels: doc_id, toxic (0 or 1); those of rows with crc32(doc_id as text) mod 4 = 2 are never read
    for the model, and no label, language, source or id is an input of a score. Whole texts are scored,
    null ones as empty. Where no labels are usable (none, or of one class), or no word tells the classes
    apart, each score is the share of toxic documents among the labelled, 0.1 at most, and predicted is 0.
    Other columns are ignored, repeated rows stay, and an empty table gives no rows.
    """
    model = fit(docs, labels)
    rows = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
