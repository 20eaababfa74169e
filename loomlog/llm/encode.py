"""Problem 8: encode a corpus with a public byte-level BPE vocabulary.

A SentencePiece BPE model is serialised straight from the vocabulary's ranks: every byte is written as one
printable character, a piece is the byte-mapped token, its score is the negative rank and its id the rank, and
the normaliser is the identity.  SentencePiece then merges, within each pre-token, the adjacent pair of the
lowest rank first, which is what the byte-level BPE does.  Decoding is the inverse byte mapping.

Defined cases: a null or empty text gives an empty list; marker-like strings are ordinary text; repeated rows
are encoded each; extra columns are kept or dropped by the caller's choice of ``keep``.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-token cache of one Python worker, in entries; emptied when full, which bounds its memory.
CACHE_ENTRIES = 150_000
#: Pre-tokens longer than this are encoded but not cached.
CACHE_LENGTH = 64


def default_vocabulary() -> str:
    """Path of the public 50k byte-level vocabulary installed beside the tokenizer libraries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank, from a file of base64 token and rank per line."""
    pairs = []
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                pairs.append((int(rank), base64.b64decode(token)))
    pairs.sort()
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in pairs]


def byte_alphabet() -> list[str]:
    """One printable character for each byte: printable Latin-1 bytes stand for themselves, the others are
    moved past U+00FF in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = itertools.count(0x100)
    return [chr(b) if b in printable else chr(next(moved)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes | int) -> bytes:
    """One protobuf field: a varint for an int, length-delimited for bytes."""
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """Serialised SentencePiece model whose piece ids are the ranks of ``tokens``.

    Fields of the public schema: model 1 pieces, 2 trainer_spec, 3 normalizer_spec; piece 1 text, 2 score,
    3 type (2 unknown); trainer 3 model_type (2 BPE), 40 to 43 ids of unk, bos, eos, pad; normaliser 1 name,
    3 dummy prefix, 4 extra white space, 5 escaped white space.  The unknown piece, which SentencePiece requires,
    takes the id after the last rank and can't occur, since every byte has a piece.
    """
    alphabet = byte_alphabet()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(alphabet[b] for b in token).encode()
        out += _field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2))
    absent = (1 << 64) - 1  # -1 as protobuf writes it
    trainer = _field(3, 2) + _field(40, len(tokens)) + b"".join(_field(n, absent) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class PieceEncoder:
    """Text to ids and back with a serialised model; holds a bounded cache of pre-tokens."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.to_char = dict(enumerate(byte_alphabet()))
        self.to_byte = {c: b for b, c in self.to_char.items()}
        self.cache: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words = self.split(text)
        cache = self.cache
        missing = [w for w in set(words) if w not in cache]
        local = cache
        if missing:
            mapped = [w.encode().decode("latin-1").translate(self.to_char) for w in missing]
            found = dict(zip(missing, self.pieces.encode(mapped, num_threads=1)))
            if len(cache) + len(found) > CACHE_ENTRIES:
                kept = {w: cache[w] for w in set(words) if w in cache}
                cache.clear()
                cache.update(kept)
            if all(len(w) <= CACHE_LENGTH for w in missing):
                cache.update(found)
            else:
                cache.update((w, ids) for w, ids in found.items() if len(w) <= CACHE_LENGTH)
                local = {w: found[w] if w in found else cache[w] for w in set(words)}
        return list(itertools.chain.from_iterable(map(local.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        pieces = "".join(self.pieces.id_to_piece(list(map(int, ids)))) if len(ids) else ""
        return bytes(self.to_byte[c] for c in pieces).decode("utf-8", "replace")


_ENCODERS: dict[int, PieceEncoder] = {}


def worker_encoder(broadcast) -> PieceEncoder:
    """The encoder of this Python worker for a broadcast (model, pattern); made once."""
    key = broadcast.value[2]
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(*broadcast.value[:2])
    return _ENCODERS[key]


def broadcast_model(spark, vocabulary: str | None = None, pattern: str | None = None):
    """Broadcast of (model, pattern, key): about a megabyte, set by the vocabulary and not by the data."""
    import public_tokenizers

    path = vocabulary or default_vocabulary()
    model = sentencepiece_model(read_ranks(path))
    pattern = pattern or public_tokenizers.PATTERN
    return spark.sparkContext.broadcast((model, pattern, hash((model, pattern))))


def encode_corpus(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep`` columns and the token ids of ``text``; no shuffle, Arrow batches in and out."""
    model = broadcast_model(df.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(model).encode
        for batch in batches:
            lists = [encode(t) for t in batch.column(0).to_pylist()]
            offsets = list(itertools.accumulate(map(len, lists), initial=0))
            flat = pa.array(list(itertools.chain.from_iterable(lists)), pa.int32())
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], column], names=[*keep, ids])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.select(F.col(text).alias("__text"), *keep).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), n_tokens: str = "n_tokens", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep`` columns and the number of tokens of ``text`` (0 for null and empty texts)."""
    model = broadcast_model(df.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(model).encode
        for batch in batches:
            counts = pa.array([len(encode(t)) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], counts], names=[*keep, n_tokens])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(n_tokens, T.LongType())])
    return df.select(F.col(text).alias("__text"), *keep).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """The inverse of :func:`encode_corpus`; a null list gives a null text."""
    model = broadcast_model(df.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = worker_encoder(model).decode
        for batch in batches:
            texts = pa.array([None if x is None else decode(x) for x in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], names=[*keep, text])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())])
    return df.select(F.col(ids).alias("__ids"), *keep).mapInArrow(run, schema)
