"""Merge-type (BPE) SentencePiece encoding by a prefix table, and decoding.

For every prefix of a text there is exactly one last token. An Aho-Corasick automaton lists the pieces that end at a place;
the last token there is the one piece that merging leaves whole and that is compatible with the last token of the prefix
before it, where two tokens are compatible if merging their joined text gives them back. Walking the table backwards from
the end recovers the ids. This equals the library's merging (best score first, leftmost first), because no merge of a final
encoding crosses a border between its tokens. Characters outside the vocabulary become byte pieces.

The table is linear in the text. Where no piece spans a border (before a run of spaces, around a line break), texts are cut,
and a worker remembers the encoding of the parts, so that frequent words are encoded once.

Defined results: null counts as the empty text, which has no ids and decodes to the empty text; repeated rows give equal
rows; an empty table gives an empty table; other columns do not reach the operator."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import Remembering, per_text

SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores, the ids of byte pieces, whether a space is put before a text, each id's text, and the pieces that
    merging can reach (the others are never a token)."""

    pieces: dict[str, tuple[int, float]]
    bytes_: tuple[int, ...]
    prefix: bool
    texts: tuple[str, ...]
    whole: frozenset[str]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read the model on the driver; only plain merge models with byte fallback and no text rewriting are accepted."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kinds = ["byte" if sp.is_byte(i) else "special" if sp.is_control(i) or sp.is_unknown(i) else
                 "unused" if sp.is_unused(i) else "plain" for i in range(n)]
        byte_ids = tuple(i for i in range(n) if kinds[i] == "byte")
        if len(byte_ids) != 256 or "unused" in kinds:
            raise ValueError("a vocabulary with 256 byte pieces and no unused pieces is needed")
        probe = "ﬁ Á  b "
        normal = sp.normalize(probe)
        if normal.lstrip(SPACE) != probe.replace(" ", SPACE):
            raise ValueError("the model rewrites texts")
        pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if kinds[i] == "plain"}
        texts = tuple(sp.id_to_piece(i) if kinds[i] == "plain" else "" for i in range(n))
        return cls(pieces, byte_ids, normal.startswith(SPACE), texts,
                   frozenset(p for p in pieces if merge(p, pieces) == [p]))


def merge(text: str, pieces: dict[str, tuple[int, float]]) -> list[str]:
    """Encoding by merging neighbours, best score first and leftmost among equals; used on pairs of tokens only."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            found = pieces.get(parts[i] + parts[i + 1])
            if found is not None and (best is None or found[1] > best):
                best, at = found[1], i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """The prefix table over one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece in vocabulary.whole:
            self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.make_automaton()
        self.pairs = Remembering(lambda pair: merge("".join(pair), vocabulary.pieces) == [*pair])
        spans = any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in vocabulary.pieces)
        self.cuts = None if spans else re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.decimal = {piece: str(i) for piece, (i, _) in vocabulary.pieces.items()}

    def tokens(self, text: str) -> list[str]:
        """The encoding as pieces (or single characters outside the vocabulary)."""
        n = len(text)
        last: list[str | None] = [None] * n  # by the place of the token's last character
        fits = self.pairs  # (left, right): whether merging leaves the two tokens as they are
        for end, (size, token) in self.automaton.iter(text):  # ends ascend; at an end any order, one token fits
            if last[end] is None:
                before = end - size
                if before >= 0:
                    left = last[before]
                    if left is None:
                        left = last[before] = text[before]
                    if not fits[left, token]:
                        continue
                last[end] = token
        out, at = [], n
        while at:
            token = last[at - 1] or text[at - 1]
            out.append(token)
            at -= len(token)
        return out[::-1]

    def ids(self, text: str) -> list[int]:
        return self.numbers(self.tokens(text))

    def numbers(self, tokens: list[str]) -> list[int]:
        out: list[int] = []
        for token in tokens:
            found = self.v.pieces.get(token)
            out += [found[0]] if found else [self.v.bytes_[b] for b in token.encode("utf-8", "replace")]
        return out

    def joined(self, part: str, odd: dict[str, str]) -> str:
        """Decimal ids of a part, joined by commas; its decoded text goes to `odd` if it is another. Pieces alone give the part."""
        tokens = self.tokens(part)
        try:
            return ",".join([self.decimal[t] for t in tokens])
        except KeyError:
            ids = self.numbers(tokens)
        text = self.pieces_text(ids)
        if text != part.replace(SPACE, " "):
            odd[part] = text
        return ",".join(map(str, ids))

    def prepare(self, text: str) -> str:
        """The text that is encoded: spaces are escaped, one is put before."""
        return (SPACE if self.v.prefix and text else "") + text.replace(" ", SPACE)

    def parts(self, prepared: str) -> list[str]:
        return self.cuts.findall(prepared) if self.cuts else [prepared]

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(self.prepare(text)) for i in self.ids(part)]

    def pieces_text(self, ids: list[int]) -> str:
        """Text of ids with the space that was put before: runs of byte pieces are UTF-8, a bad byte is U+FFFD."""
        first, texts = self.v.bytes_[0], self.v.texts
        text = "".join([texts[i] for i in ids])
        if all(texts[i] for i in ids):
            return text.replace(SPACE, " ")
        out, run = [], bytearray()
        for i in ids:
            if first <= i < first + 256:
                run.append(i - first)
                continue
            out += [_utf8(bytes(run)), texts[i].replace(SPACE, " ")]
            run.clear()
        return "".join(out) + _utf8(bytes(run))

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_text(ids)
        return text[1:] if self.v.prefix and text.startswith(" ") else text


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n = 1
                out.append("�")
            at += n
        return "".join(out)


def encoded(docs: DataFrame, vocabulary: Vocabulary, keep: dict[str, Column] | None = None, kinds: str = "doc_id long",
            with_ids: bool = False) -> DataFrame:
    """Per row: number of ids, digests of the ids and of the decoded text; with_ids adds `ids` and `decoded`.

    keep names further columns to carry (with their types in kinds)."""
    keep = keep or {"doc_id": F.col("doc_id").cast("long")}
    more = ", ids array<int>, decoded string" if with_ids else ""
    carried = list(keep)

    def start():
        encoder = Encoder(vocabulary)
        odd: dict[str, str] = {}  # decoded text of the parts of one text that do not decode to themselves
        memory = Remembering(lambda part: encoder.joined(part, odd))

        def work(rows, texts):
            out = {c: rows.column(c) for c in carried}
            counts, id_hashes, text_hashes, all_ids, all_texts = [], [], [], [], []
            for raw in texts:
                prepared = encoder.prepare(raw.decode("utf-8", "replace") if raw else "")
                parts = encoder.parts(prepared)
                ids = ",".join(map(memory.__getitem__, parts))
                text = prepared.replace(SPACE, " ")
                if odd:
                    text = "".join([odd[p] if p in odd else p.replace(SPACE, " ") for p in parts])
                text = text[1:] if vocabulary.prefix and text.startswith(" ") else text
                counts.append(ids.count(",") + 1 if ids else 0)
                id_hashes.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hashes.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    all_ids.append([int(i) for i in ids.split(",")] if ids else [])
                    all_texts.append(text)
            out |= {"n_tokens": counts, "ids_sha256": id_hashes, "decoded_sha256": text_hashes}
            yield out | ({"ids": all_ids, "decoded": all_texts} if with_ids else {})

        return work

    return per_text(docs, "text", keep, start, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
