"""Operator 10: byte-level BPE encoding and decoding through a sentencepiece model.

A rank file (token bytes in base64, rank) becomes a sentencepiece BPE model by
serialising its protobuf message directly: each token is a piece of byte-mapped
characters whose score is the negative rank, the normaliser is the identity, and
no white space is added, removed or escaped.  The highest score then is the
lowest rank, so that merging by score gives what merging by rank gives.  A text
is split by the pre-token pattern, each pre-token is mapped byte by byte to
printable characters and encoded; decoding maps ids back to bytes.

One pass over the documents, no shuffle.  A worker holds the model and a bounded
memo of pre-tokens.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rosterlake.llm.support import text_of

#: Bytes of pre-tokens and their ids that a worker remembers before it starts its memo anew, and those that an entry takes by itself.
MEMO, ENTRY = 48 << 20, 200
#: Characters up to which a text is split at once, and pre-tokens of a longer one that are looked up at a time.
AT_ONCE, PART = 1 << 20, 1 << 16


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(data: bytes) -> list[bytes]:
    """The token of each rank; the ranks must be 0, 1, 2 and so on."""
    ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, data.splitlines())}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i is token i, and one unknown piece follows.

    Field numbers are those of the public sentencepiece_model.proto: pieces 1
    (piece 1, score 2, type 3), trainer_spec 2 (model_type 3, vocab_size 4,
    byte_fallback 35, unk/bos/eos/pad ids 40 to 43), normalizer_spec 3 (name 1,
    add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5).
    """
    to_char = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(to_char[b] for b in token).encode()
        score = _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
        out += _bytes_field(1, _bytes_field(1, piece) + score + _int_field(3, 1))
    unknown = _bytes_field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int_field(3, 2)
    out += _bytes_field(1, unknown)
    trainer = _int_field(3, 2) + _int_field(4, len(tokens) + 1) + _int_field(35, 0)
    trainer += _int_field(40, len(tokens)) + b"".join(_int_field(k, -1) for k in (41, 42, 43))
    out += _bytes_field(2, trainer)
    normaliser = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    out += _bytes_field(3, normaliser)
    return bytes(out)


class Codec:
    """Encodes and decodes with one vocabulary; built once in each worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.pattern = regex.compile(pattern)
        self.to_char = byte_characters()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def learn(self, pre_tokens: set[str]) -> None:
        if self.held > MEMO:
            self.memo.clear()
            self.held = 0
        new = [p for p in pre_tokens if p not in self.memo]
        mapped = ["".join(map(self.to_char.__getitem__, p.encode())) for p in new]
        for p, ids in zip(new, self.model.encode(mapped, num_threads=1)):
            self.memo[p] = packed = struct.pack(f"<{len(ids)}I", *ids)
            self.held += ENTRY + 2 * len(p) + len(packed)

    def parts(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text in order, those of a long one in lists of at most PART."""
        if len(text) <= AT_ONCE:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while part := [m[0] for m in islice(found, PART)]:
            yield part

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for pre_tokens in self.parts(text):
            try:
                out.append(b"".join(map(self.memo.__getitem__, pre_tokens)))
            except KeyError:
                self.learn(set(pre_tokens))
                out.append(b"".join(map(self.memo.__getitem__, pre_tokens)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")])


_codecs: dict[tuple[str, str], Codec] = {}


def encode_decode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode each whole text and decode the ids again.

    vocabulary: path of a rank file, which every worker's installation has.
    Returns doc_id, token_ids (binary, little-endian unsigned 32-bit integers, the
    usual token shard layout), decoded (binary).  A null text counts as empty and
    has no tokens; repeated rows are each encoded; an empty table gives an empty
    result; other columns of docs are ignored.  A very long text is split in parts, so
    that a worker holds its ids and a bounded number of its pre-tokens; what is
    remembered of pre-tokens is bounded in bytes.
    """
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("token_ids", T.BinaryType()),
            T.StructField("decoded", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs.get((vocabulary, pattern))
        if codec is None:
            with open(vocabulary, "rb") as f:
                codec = _codecs[vocabulary, pattern] = Codec(read_ranks(f.read()), pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start, size = 0, 0
            for i, x in enumerate(texts):
                size += len(x.as_buffer()) if x.is_valid else 0
                if size > 4_000_000 or i == len(texts) - 1:
                    packed = [codec.encode(t) for t in texts.slice(start, i + 1 - start).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(start, i + 1 - start),
                            pa.array(packed, pa.binary()),
                            pa.array([codec.decode(p) for p in packed], pa.binary()),
                        ],
                        names=["doc_id", "token_ids", "decoded"],
                    )
                    start, size = i + 1, 0

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """What the contract asks for: token count and digests of ids and decoded bytes."""
    return encoded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
