"""Token counts by the whole-token shortcut.

For a BPE whose pre-tokens end in a word mark, most pre-tokens are vocabulary strings of their own.
Which of these the merges really leave as one token is proved once per worker by encoding every such
string alone. A text is normalised and split as the tokenizer does it; proven pre-tokens count one
each, and only the rest go through the merges (each distinct one once, in a bounded memo).
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terralex.llm.common import MEMO_WORDS, byte_of_char, unassigned

WORD_BPE = "word_bpe_49k.json"

def special(text: str) -> bool:
    """Whether Python's tables and the library's may differ: unassigned characters, and the context-dependent sigma."""
    return unassigned(text, "Σ")


class Counter:
    """Counts the tokens of texts exactly as the tokenizer in a file would, without special tokens added."""

    def __init__(self, path: str):
        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [a["content"] for a in spec["added_tokens"]]
        mark = spec["model"]["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or not mark:
            raise ValueError("the shortcut knows vocabularies of lower-case words with a word-end mark")
        self.split = regex.compile(pattern).findall
        self.whole = self._prove([x.removesuffix(mark) for x in spec["model"]["vocab"] if x.endswith(mark) and x != mark])
        self.counts = dict.fromkeys(self.whole, 1)

    def _prove(self, mapped: list[str]) -> set[str]:
        """The vocabulary strings that as a pre-token give one token, as text."""
        of = byte_of_char()
        texts = []
        for x in mapped:
            try:
                text = bytes(of[c] for c in x).decode()
            except (UnicodeDecodeError, KeyError):
                continue
            if not special(text) and self.split(unicodedata.normalize("NFC", text).lower()) == [text]:
                texts.append(text)
        return {t for t, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1}

    def count(self, text: str) -> int:
        if any(s in text for s in self.added) or special(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        counts, n, rest = self.counts, 0, []
        for token in self.split(unicodedata.normalize("NFC", text).lower()):
            if token in counts:
                n += counts[token]
            else:
                rest.append(token)
        if rest:
            new = list(set(rest))
            if len(counts) + len(new) > MEMO_WORDS + len(self.whole):
                self.counts = counts = dict.fromkeys(self.whole, 1)
            merged = {t: len(e.ids) for t, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True)}
            counts.update(merged)
            n += sum(map(merged.__getitem__, rest))
        return n


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """One row per row of docs (doc_id, text string): doc_id, n_bytes, n_tokens, over_limit.

    path: a tokenizers file of a lower-case BPE with word ends, readable on each executor. A null text
    counts as an empty one. Special strings in a text count as the tokenizer's default has it. Other
    columns are ignored, repeated rows stay, and an empty table gives no rows.
    """
    path = path or public_tokenizers.path(WORD_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([c.count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
