"""Byte-level BPE by a sentencepiece model that is serialised from a rank file, nothing trained.

Each byte is mapped to a printable character, each vocabulary entry to the string of its bytes'
characters, with the negative rank as its score; the model's merges then are those of the ranks.
Normalisation is the identity and no prefix is added. Pre-tokens are encoded one by one (each
distinct one once, in a bounded memo); decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import MEMO_WORDS

RANKS = "byte_bpe_multi_50k.tiktoken"
#: The character of byte b; none of them is white space or means anything to sentencepiece.
BYTE_CHARS = [chr(0x4E00 + b) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces (1), trainer_spec (2), normalizer_spec (3)."""
    normal, unknown, bpe = 1, 2, 2
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))) or sum(len(t) == 1 for t in by_rank) != 256:
        raise ValueError("ranks must be 0 to n-1 and hold all single bytes")
    pieces = [_field(1, _field(1, "".join(BYTE_CHARS[b] for b in t).encode()) + _field(2, -float(i)) + _field(3, normal)) for i, t in enumerate(by_rank)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    minus_one = (1 << 64) - 1
    trainer = _field(3, bpe) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + _field(41, minus_one) + _field(42, minus_one) + _field(43, minus_one)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        ranks = read_ranks(path)
        self.whole = {t: i for t, i in ranks.items()}
        self.bytes_of = sorted(ranks, key=ranks.__getitem__)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(ranks))
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def _merge(self, pieces: list[str]) -> None:
        mapped = ["".join([BYTE_CHARS[b] for b in p.encode()]) for p in pieces]
        for p, ids in zip(pieces, self.model.encode(mapped, out_type=int, num_threads=1), strict=True):
            one = self.whole.get(p.encode())  # an entry is a token of its own, reachable by merges or not
            self.memo[p] = tuple(ids) if one is None else (one,)

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        if new := list(set(pieces).difference(self.memo)):
            if len(self.memo) + len(new) > MEMO_WORDS:
                self.memo.clear()
                new = list(set(pieces))
            self._merge(new)
        return list(chain.from_iterable(map(self.memo.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Columns of docs and ids (array<int>): the tokens of column text, a null text as an empty one.

    path: a rank file readable on each executor. An existing column ids is replaced.
    """
    path = path or public_tokenizers.path(RANKS)
    docs = docs.drop("ids")
    schema = docs.select("*", F.lit(None).cast("array<int>").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = pa.array([c.encode(t or "") for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Columns of encoded and decoded (binary): the bytes of column ids, none for null."""
    path = path or public_tokenizers.path(RANKS)
    encoded = encoded.drop("decoded")
    schema = encoded.select("*", F.lit(None).cast("binary").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out = pa.array([c.decode(i or []) for i in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text string): doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes the whole text (null: empty) and decodes the ids again in one pass. ids_sha256 is of the
    decimal ids joined by commas, decoded_sha256 of the decoded bytes. Other columns are ignored,
    repeated rows stay, and an empty table gives no rows.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        decimal = [str(i) for i in range(len(c.bytes_of))]
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = c.encode(text or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
