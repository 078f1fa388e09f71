"""Byte-level BPE encoding and decoding through a sentencepiece model made from the rank file.

The vocabulary's byte strings are written with one printable character per byte and become the
pieces of a BPE model, piece i having score -i, with identity normalisation. The model is
serialised here, from the rank file alone; nothing is trained. Each pre-token of the split pattern is encoded by
itself: one that is a piece as a whole takes that id, any other goes through sentencepiece, which
merges the pair of the best score, leftmost first. Decoding maps ids back to byte strings.
"""

from __future__ import annotations

import base64
import functools
import itertools

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftgrove.llm.common import map_text, utf8

#: Pre-tokens whose ids a worker remembers; it starts anew when there are more.
CACHE = 300_000


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where that is one, else from U+0100 upward."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (chr(256 + n) for n in itertools.count())
    return [chr(b) if b in own else next(rest) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank; ranks must run from 0 without a gap."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol buffer: bytes by length, int as varint, float as 32 bits."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose id i is ``tokens[i]``; the id after the last is unknown."""
    alphabet = byte_alphabet()
    pieces = [_field(1, "".join(alphabet[b] for b in token).encode()) + _field(2, -float(rank)) for rank, token in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(40, len(tokens))  # model type BPE, id of <unk>
    trainer += b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))  # bos, eos, pad: -1
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))  # no dummy prefix, white space as it is
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.find = regex.compile(pattern).findall
        self.table = {b: c for b, c in enumerate(byte_alphabet())}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        if len(self.whole) != len(self.tokens) or any(bytes([b]) not in self.whole for b in range(256)):
            raise ValueError("the vocabulary needs distinct entries and all single bytes")
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, pretokens: set[str]) -> None:
        """Adds the ids of ``pretokens`` to what is known."""
        if len(self.known) + len(pretokens) > CACHE:
            self.known = {}
        rest = []
        for p in pretokens:
            b = p.encode("utf-8", "surrogatepass")
            if (i := self.whole.get(b)) is not None:
                self.known[p] = (i,)
            else:
                rest.append((p, b.decode("latin-1").translate(self.table)))
        for (p, _), ids in zip(rest, self.model.encode([m for _, m in rest], num_threads=1), strict=True):
            self.known[p] = tuple(ids)

    def encode(self, text: str) -> list[int]:
        pretokens = self.find(text)
        if new := set(pretokens).difference(self.known):
            if len(self.known) + len(new) > CACHE:
                new = set(pretokens)
            self.learn(new)
        return list(itertools.chain.from_iterable(map(self.known.__getitem__, pretokens)))

    def decode(self, ids: list[int]) -> bytes:
        if ids and min(ids) < 0:
            raise IndexError("an id must not be negative")
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    """Made once in each worker."""
    return ByteBpe(path, pattern)


IDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
BACK = [T.StructField("decoded", T.BinaryType())]


def _lists(ids: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """``keep`` (default: all columns) with n_tokens and ids; on request also ``decoded``, the bytes that the ids give.

    A null text counts as empty and has no ids. Whole texts are encoded, without special tokens.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        bpe = coder(path, pattern)
        ids = [bpe.encode(t or "") for t in texts.to_pylist()]
        out = [pa.array(list(map(len, ids)), pa.int64()), _lists(ids)]
        return out + ([pa.array([bpe.decode(x) for x in ids], pa.binary())] if decoded else [])

    return map_text(docs, run, IDS + BACK * decoded, text, keep)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) with ``decoded``, the bytes of the ids; null ids give no bytes. An id that the vocabulary lacks, negative ones too, is an error."""
    keep = [c for c in (keep or rows.columns) if c != "decoded"]
    src = rows.select(*keep, rows[ids].alias("__ids"))
    schema = T.StructType([src.schema[c] for c in keep] + BACK)

    def run(batches):
        bpe = coder(path, pattern)
        for b in batches:
            back = pa.array([bpe.decode(x or []) for x in b.column(len(keep)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [back], names=schema.names)

    return src.mapInArrow(run, schema)


__all__ = ["ByteBpe", "coder", "decode", "encode", "model_proto", "read_ranks", "utf8"]
