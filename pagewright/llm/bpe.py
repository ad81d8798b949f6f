"""Byte-level BPE through a sentencepiece model made from the vocabulary.

Nothing is trained: the vocabulary's byte strings, written with one printable
character a byte, become the pieces of a sentencepiece BPE model whose scores
are the negative ranks, so the library's best-score merging is merging by
rank. The model normalises nothing. Texts are cut into pre-tokens first and
each different pre-token is encoded once in a while per worker.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import _text as t

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a worker remembers before it starts afresh.
REMEMBER = 300_000


def byte_characters() -> list[str]:
    """A printable character for each byte; printable Latin-1 stands for itself."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Byte strings in the order of rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(piece) for piece, rank in (line.split() for line in lines if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: a varint, a 32-bit float or a byte string."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def serialise(vocabulary: list[bytes]) -> bytes:
    """The sentencepiece model: ids are ranks, and one unused unknown piece comes last."""
    chars = byte_characters()
    pieces = [_field(1, _field(1, "".join(chars[b] for b in piece).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, piece in enumerate(vocabulary)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(vocabulary) + 1) + _field(40, len(vocabulary)) + b"".join(_field(i, (1 << 64) - 1) for i in (41, 42, 43)) + _field(45, b"<unk>")
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes texts with one model."""

    def __init__(self, model: bytes, pattern: str = PATTERN) -> None:
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = self.processor.unk_id()
        self.chars = dict(enumerate(byte_characters()))
        back = {c: b for b, c in self.chars.items()}
        self.bytes = [bytes(back[c] for c in self.processor.id_to_piece(i)) if i != self.unknown else b"" for i in range(self.processor.get_piece_size())]
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        words = self.split(text)
        new = list({w for w in words if w not in self.known})
        if new:
            if len(self.known) > REMEMBER:
                self.known.clear()
                new = list(set(words))
            mapped = [w.encode().decode("latin-1").translate(self.chars) for w in new]
            for w, ids in zip(new, self.processor.encode(mapped, out_type=int, num_threads=1), strict=True):
                self.known[w] = array("i", ids).tobytes()
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; what isn't UTF-8 (parts of a text) becomes replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(model: bytes, pattern: str = PATTERN) -> Codec:
    """One codec a worker and model, kept from task to task."""
    return Codec(model, pattern)


def tokenise(docs: DataFrame, path: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",), check: bool = True) -> DataFrame:
    """The columns ``keep``, then ``n_tokens, tokens`` and, with ``check``, ``round_trip``.

    Every token of every whole text; ``round_trip`` says whether decoding the
    tokens gives the text back. An empty text has no tokens and round-trips; a
    null text has null tokens, ``n_tokens`` 0 and a null ``round_trip``.
    Strings that look like special tokens are ordinary text. Repeated rows
    come out repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(serialise(read_vocabulary(path)))
    names = [*dict.fromkeys(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            for part in t.slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids = [own.encode(x) if x else np.zeros(0, np.int32) for x in texts]
                sizes = np.array([len(x) for x in ids])
                null = np.array([x is None for x in texts])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.concatenate([null, [False]]))
                columns = [part.column(c) for c in names] + [pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))]
                if check:
                    columns.append(pa.array([None if x is None else own.decode(i) == x for x, i in zip(texts, ids, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_tokens", "tokens", "round_trip"][: len(columns)])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, *(["text"] if "text" not in names else [])).mapInArrow(run, f"{schema}, n_tokens int, tokens array<int>" + ", round_trip boolean" * check)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, with the check that they decode to the text."""
    return tokenise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
