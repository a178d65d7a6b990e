"""Token counts of a unigram tokenizer without building the tokens.

An Aho-Corasick automaton lists the vocabulary pieces ending at each place of a text; dynamic programming carries the best
score and the number of pieces. Tie rules are the tokenizer's: the candidate that starts first (the longest) stays unless
another is strictly better; a character without a piece of its own may also be unknown, at the lowest score minus 10, and is
the last candidate. Neighbouring unknown characters are one token, or as many byte pieces as they have bytes where the
vocabulary has all 256.

A text is cut before runs of spaces if no piece spans such a place and every score is a whole number, so that sums are exact
and cutting changes neither ties nor counts. A worker remembers the parts.

Defined results: null and empty texts have 0 tokens and score 0; repeated rows give equal rows; an empty table gives an
empty table; other columns do not reach the operator."""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import Remembering, per_text

SPACE = "▁"
#: Score of an unknown character below the lowest score of the vocabulary (fixed by the tokenizer).
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Unigram:
    """Vocabulary in id order with its scores; unk is the id of the unknown token."""

    pieces: tuple[tuple[str, float], ...]
    unk: int = 0
    prefix: bool = True

    @classmethod
    def from_sentencepiece(cls, path: str) -> Unigram:
        """The pieces and scores of a SentencePiece file, read as a unigram vocabulary."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls(tuple((sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())), sp.unk_id())


class Counter:
    def __init__(self, vocabulary: Unigram):
        scores = dict(vocabulary.pieces)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.by_bytes = all(f"<0x{i:02X}>" in scores for i in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        exact = all(s.is_integer() for s in scores.values()) and SPACE in scores
        spans = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in scores)
        self.cuts = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if exact and not spans else None
        if self.cuts and self.by_bytes and not any("\n" in p for p in scores):
            self.cuts = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.prefix = vocabulary.prefix

    def best(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path through one part."""
        n = len(text)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, single, found = 0, True, None  # the end being filled, whether a piece of one character ends there, its start

        def close(end: int) -> None:
            nonlocal found
            if not single:
                alone = self.unknown + score[end - 1]
                if found is None or alone > score[end]:
                    score[end], unknown[end] = alone, True
                    found = end - 1
            if unknown[end]:
                more = len(text[end - 1].encode("utf-8", "replace")) if self.by_bytes else int(not unknown[end - 1])
            else:
                more = 1
            count[end] = count[found] + more

        for last, (size, value) in self.automaton.iter(text):
            end = last + 1
            if end != at:
                if at:
                    close(at)
                for gap in range(at + 1, end):
                    single, found = False, None
                    close(gap)
                at, single, found = end, False, None
            candidate = value + score[end - size]
            if found is None or candidate > score[end]:
                score[end], found = candidate, end - size
            single = single or size == 1
        if at:
            close(at)
        for gap in range(at + 1, n + 1):
            single, found = False, None
            close(gap)
        return count[n], score[n]

    def prepare(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def parts(self, prepared: str) -> list[str]:
        return self.cuts.findall(prepared) if self.cuts else [prepared]


def token_counts(docs: DataFrame, vocabulary: Unigram) -> DataFrame:
    """Per document: number of tokens and the score of the best segmentation of the whole text."""

    def start():
        counter = Counter(vocabulary)
        memory = Remembering(counter.best)

        def work(rows, texts):
            counts, scores = [], []
            for raw in texts:
                parts = counter.parts(counter.prepare(raw.decode("utf-8", "replace") if raw else ""))
                found = list(map(memory.__getitem__, parts))
                counts.append(sum([a for a, _ in found]))
                scores.append(float(sum([b for _, b in found])))
            yield {"doc_id": rows.column("doc_id"), "n_tokens": counts, "score": scores}

        return work

    return per_text(docs, "text", {"doc_id": F.col("doc_id").cast("long")}, start, "doc_id long, n_tokens long, score double")
