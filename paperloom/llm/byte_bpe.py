"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

The model is serialised here, field by field, from the ranks alone: each token's bytes are mapped one to
one to visible characters, the piece's score is its negative rank, and the normaliser is the identity.
Nothing is trained. sentencepiece then merges the best-scored (lowest-ranked) neighbours first, which is
the merge order of byte-level BPE. Each match of the pre-token pattern is encoded by itself; ids are
ranks. Decoding maps each id back to its bytes.

Defined results: null text counts as empty and gives no tokens; repeated rows are encoded again; texts of any
length are encoded whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Distinct pre-tokens that a task remembers; the table is emptied when full, which changes no result.
CACHE = 300_000
#: Texts whose tokens a task holds at once.
ROWS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


#: Byte b is written as the character 256 + b: letters only, never white space.
BYTE_CHARS = {b: chr(256 + b) for b in range(256)}


def as_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(BYTE_CHARS)


def from_piece(piece: str) -> bytes:
    """The inverse of as_piece()."""
    return bytes(ord(c) - 256 for c in piece)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is the unknown piece, piece r + 1 has rank r."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ... without a gap")
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, as_piece(t).encode()) + _field(2, -float(ranks[t])) + _field(3, 1) for t in tokens]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0)  # BPE; size; id of <unk>
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))  # no begin, end or pad piece
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        import sentencepiece

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise_model(ranks))
        #: bytes of each id, from the model's own pieces (piece 0 is the unknown one)
        self.tokens = [from_piece(self.model.IdToPiece(i + 1)) for i in range(len(ranks))]
        self.numbers = [str(i) for i in range(len(self.tokens))]
        self.known: dict[str, tuple[int, ...]] = {}

    def encode_pre_token(self, pre: str) -> tuple[int, ...]:
        raw = pre.encode()
        rank = self.ranks.get(raw)
        return (rank,) if rank is not None else tuple(i - 1 for i in self.model.EncodeAsIds(as_piece(raw)))

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        for pre in self.split(text):
            got = known.get(pre)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                got = self.encode_pre_token(pre)
                if len(pre) < 100:
                    known[pre] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[str, str]:
        joined = " ".join(map(self.numbers.__getitem__, ids))
        return hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, if asked for, token_ids array<int>.

    vocabulary is the path of a rank file that every executor can read. A map without a shuffle.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("token_ids", pa.list_(pa.int32()))]
    fields = fields[: 4 if ids else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBPE(read_ranks(vocabulary), pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                part = whole.slice(start, ROWS)
                rows = []
                for text in part.column("text"):
                    got = coder.encode(text.as_py() or "")
                    rows.append((len(got), *coder.digests(got), got))
                columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *(name for name, _ in fields)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text_bytes binary) from (doc_id, token_ids); null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBPE(read_ranks(vocabulary), "")
        for batch in batches:
            raw = [coder.decode(ids or ()) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "text_bytes"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text_bytes binary")


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), *public_vocabulary(), ids=False)
