"""Byte-level BPE encoding and decoding through a sentencepiece model that is serialised from the vocabulary.

A rank file lists the byte strings of a vocabulary with their ranks. Each byte is mapped to one character, each byte string
becomes a piece with the negative rank as its score, and pieces, the merge type and the identity normalisation are written
as a sentencepiece model. Merging by best score is then merging by lowest rank, leftmost first. Texts are cut into
pre-tokens by a pattern; each pre-token is encoded alone, one that is a byte string of the vocabulary as a whole is its own
token. Decoding maps ids back to byte strings.

A worker remembers the encoding of pre-tokens, bounded, and encodes all new ones of a slice of texts in one call. The model
has the size of the vocabulary, whatever the corpus. Nothing is shuffled.

Defined results: null counts as the empty text, which has no ids and decodes to no bytes; bytes that are no UTF-8 are read
as U+FFFD; repeated rows give equal rows; an empty table gives an empty table; other columns do not reach the operator."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import MEMORY, per_text

#: Byte b is written as the character FIRST + b; all 256 are letters, so nothing else in the library has a use for them.
FIRST = 0x100
TO_CHARS = {b: FIRST + b for b in range(256)}


def mapped(raw: bytes) -> str:
    """The bytes as one character each."""
    return raw.decode("latin-1").translate(TO_CHARS)


# --- the model ------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer: whole numbers as varints, floats as 32 bits, bytes with their length."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


# Field numbers and codes of the public model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, MERGE_TYPE, VOCAB_SIZE = 3, 2, 4
NAME, CHARSMAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 1, 2, 3, 4, 5


@dataclass(frozen=True)
class Vocabulary:
    """Byte strings with their ranks, and the pattern of the pre-tokens."""

    ranks: dict[bytes, int]
    pattern: str

    def __post_init__(self):
        if not all(bytes([b]) in self.ranks for b in range(256)):
            raise ValueError("a vocabulary with all 256 single bytes is needed")
        if len(set(self.ranks.values())) != len(self.ranks) or max(self.ranks.values()) >= 1 << 24:
            raise ValueError("ranks must differ and be below 2**24, the whole numbers that a score can hold")

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """Read a rank file (base64 and rank on each line) on the driver."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}, pattern)

    def model(self) -> bytes:
        """The vocabulary as a sentencepiece model: the unknown piece, then the byte strings by rank."""
        pieces = [_field(PIECE, b"<unk>") + _field(SCORE, 0.0) + _field(KIND, UNKNOWN)]
        pieces += [_field(PIECE, mapped(raw).encode()) + _field(SCORE, -float(self.ranks[raw])) + _field(KIND, NORMAL)
                   for raw in sorted(self.ranks, key=self.ranks.__getitem__)]
        trainer = _field(MODEL_TYPE, MERGE_TYPE) + _field(VOCAB_SIZE, len(pieces))
        normal = _field(NAME, b"identity") + _field(CHARSMAP, b"")
        normal += b"".join(_field(n, 0) for n in (DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES))
        return b"".join(_field(PIECES, p) for p in pieces) + _field(TRAINER, trainer) + _field(NORMALIZER, normal)


class Coder:
    """Encoding and decoding by one vocabulary and its serialised model."""

    def __init__(self, vocabulary: Vocabulary, model: bytes | None = None):
        import sentencepiece

        self.ranks, self.split = vocabulary.ranks, regex.compile(vocabulary.pattern).findall
        self.by_piece = [-1, *sorted(self.ranks.values())]  # the model numbers its pieces by rank, after the unknown one
        self.raw = {rank: raw for raw, rank in self.ranks.items()}
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model or vocabulary.model())

    def encode_parts(self, parts: Iterable[str]) -> list[list[int]]:
        """Ids of each pre-token."""
        raws = [p.encode("utf-8", "replace") for p in parts]
        out: list = [None if (rank := self.ranks.get(raw)) is None else [rank] for raw in raws]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.pieces.encode([mapped(raws[i]) for i in rest], num_threads=1) if rest else ()):
            out[i] = [self.by_piece[k] for k in ids]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_parts(self.split(text)) for i in ids]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.raw[i] for i in ids])


class Memory:
    """What make(parts) gives for each part. Two generations of about `most` parts: what the older one still serves moves on,
    the rest is forgotten when the newer one is full. Long parts are remembered for one slice only."""

    def __init__(self, make, most: int = MEMORY):
        self.make, self.most, self.known, self.older, self.long = make, most, {}, {}, []

    def of(self, parts: Iterable[list[str]]) -> dict:
        """A dictionary that has all the parts of a slice."""
        for part in self.long:
            del self.known[part]
        wanted = set().union(*parts)
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        wanted, older = wanted.difference(self.known), self.older
        self.known.update({p: older[p] for p in wanted if p in older})
        new = list(wanted.difference(self.known))
        self.known.update(zip(new, self.make(new)))
        self.long = [p for p in new if len(p) > 64]
        return self.known


def encoded(docs: DataFrame, vocabulary: Vocabulary, keep: dict[str, Column] | None = None, kinds: str = "doc_id long",
            with_ids: bool = False) -> DataFrame:
    """Per row: number of ids, digests of the ids and of the decoded bytes; with_ids adds `ids` and `decoded` (bytes).

    keep names further columns to carry (with their types in kinds)."""
    keep = keep or {"doc_id": F.col("doc_id").cast("long")}
    more = ", ids array<int>, decoded binary" if with_ids else ""
    carried, model = list(keep), vocabulary.model()

    def start():
        coder = Coder(vocabulary, model)
        memory = Memory(lambda parts: [(" ".join(map(str, ids)), coder.decode(ids)) for ids in coder.encode_parts(parts)])

        def work(rows, texts):
            out = {c: rows.column(c) for c in carried}
            split = [coder.split(raw.decode("utf-8", "replace")) if raw else [] for raw in texts]
            known = memory.of(split)
            counts, id_hashes, text_hashes, all_ids, all_texts = [], [], [], [], []
            for parts in split:
                found = [known[p] for p in parts]
                ids, decoded = " ".join([f[0] for f in found]), b"".join([f[1] for f in found])
                counts.append(ids.count(" ") + 1 if ids else 0)
                id_hashes.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hashes.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append([int(i) for i in ids.split()])
                    all_texts.append(decoded)
            out |= {"n_tokens": counts, "ids_sha256": id_hashes, "decoded_sha256": text_hashes}
            yield out | ({"ids": all_ids, "decoded": all_texts} if with_ids else {})

        return work

    return per_text(docs, "text", keep, start, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
