"""Quality rules on repetition: the share of characters inside repeated word n-grams and repeated lines of a text.

Every text is judged alone, so the work is one pass without a shuffle. Each n-gram length uses a rolling hash in numpy over
all texts of a slice at once, with the text's number mixed in, so that only repeats inside one text count.

Defined results: null and empty texts have no words and fail the length rule; ties do not exist (all rules are thresholds);
repeated rows are judged alike; an empty table gives an empty table; other columns are ignored by `repetition` and kept by
`keep_good`."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import WordHashes, Windows, Words, mix, per_text, slices

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Largest allowed shares; n-gram lengths (from 3) with the share of word bytes inside n-grams that repeat an earlier one."""

    min_words: int = 50
    repeat_word_percent: int = 50
    ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20})
    line_share: float = 0.50
    line_chars: float = 0.40


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Places inside at least one of the windows of n words."""
    edge = np.zeros(total + 1, np.int32)
    edge[starts] += 1
    edge[starts + n] -= 1
    return np.cumsum(edge[:total]) > 0


def _equal(keys: np.ndarray) -> np.ndarray:
    """Numbers of the keys that occur more than once: a plain sort finds the values, a bit table most of their places."""
    ranked = np.sort(keys)
    values = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(values):
        return np.zeros(0, np.int64)
    table = np.zeros(1 << 20, bool)
    table[values >> np.uint64(44)] = True
    at = np.flatnonzero(table[keys >> np.uint64(44)])
    return at[values[np.minimum(np.searchsorted(values, keys[at]), len(values) - 1)] == keys[at]]


def _marks(words: Words, windows: Windows, lengths: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length, shortest first: starts of windows that occur twice or more in their text, and those with an earlier equal.

    A longer window can only repeat where the shorter one does, so each length looks at what the last one left."""
    out, at = {}, None
    for n in sorted(lengths):
        key, inside = windows.of(n), words.inside(n)
        at = np.flatnonzero(inside) if at is None else at[at < len(inside)]
        at = at[inside[at]]
        own = key[at] ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1))
        twice = _equal(own)
        at, own = at[twice], own[twice]
        order = np.argsort(own, kind="stable")
        later = np.zeros(len(at), bool)
        later[order[1:][own[order][1:] == own[order][:-1]]] = True
        out[n] = at, at[later]
    return out


def _lines(text: bytes) -> tuple[int, int, int, int]:
    """Lines with a word, those equal to an earlier line, and the code points of either."""
    seen: set[bytes] = set()
    n = dup = chars = dup_chars = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            n += 1
            size = len(line) if line.isascii() else len(line.decode("utf-8", "replace"))
            chars += size
            if line in seen:
                dup += 1
                dup_chars += size
            else:
                seen.add(line)
    return n, dup, chars, dup_chars


def _measure(limits: Limits):
    def start():
        memory = WordHashes()

        def work(rows, texts):
            words = Words(texts, memory)
            windows, total = Windows(words.hashes), len(words.flat)
            sizes = np.fromiter(map(len, words.flat), np.int64, total)
            tails = [0 if t is None or t.isascii() else len(t) - len(t.decode("utf-8", "replace")) for t in texts]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            # white space is ASCII, so the bytes beyond one per code point all lie in words
            word_bytes = ends[words.ends] - ends[words.starts]
            word_chars = word_bytes - np.asarray(tails, np.int64)

            def per(flags, weights=None):
                run = np.concatenate(([0], np.cumsum(flags if weights is None else np.where(flags, weights, 0))))
                return run[words.ends] - run[words.starts]

            marks = _marks(words, windows, [3, *limits.ngrams])
            repeat = per(_covered(marks[3][0], 3, total))
            worst = np.zeros(len(texts))
            for n, most in limits.ngrams.items():
                share = per(_covered(marks[n][1], n, total), sizes) / np.maximum(1, word_bytes)
                worst = np.maximum(worst, share / most)
            lines = np.asarray([_lines(t or b"") for t in texts], np.int64).reshape(-1, 4)
            line_share = lines[:, 1] / np.maximum(1, lines[:, 0])
            line_chars = lines[:, 3] / np.maximum(1, lines[:, 2])
            failed = (words.counts < limits.min_words) | (100 * repeat > limits.repeat_word_percent * words.counts)
            good = ~failed & (worst <= 1) & (line_share <= limits.line_share) & (line_chars <= limits.line_chars)
            yield {
                **{c: rows.column(c) for c in rows.schema.names if c != "__text"}, "n_words": words.counts,
                "word_chars": word_chars, "n_symbols": [sum(t.count(c) for c in map(bytes, zip(SYMBOLS))) if t else 0
                                                        for t in texts],
                "n_dup_lines": lines[:, 1], "n_repeat_words": repeat, "base_failed": failed, "kept": good,
                "worst_ngram": worst, "dup_line_share": line_share, "dup_line_chars": line_chars,
            }

        return work

    return start


MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
            "kept boolean, worst_ngram double, dup_line_share double, dup_line_chars double")


def repetition(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document: counts, shares and the verdict.

    `worst_ngram` is the largest share of a text's word bytes inside n-grams that repeat an earlier one, over the limit of
    its length; above 1 the text fails. Line shares count lines with a word that equal an earlier line."""
    return per_text(docs, "text", {"doc_id": F.col("doc_id").cast("long")}, _measure(limits), f"doc_id long, {MEASURES}")


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with all their columns; one pass, the verdict is not joined back."""
    at, measure = docs.columns.index("text"), _measure(limits)

    def run(batches):
        work = measure()
        for batch in batches:
            for rows, texts in slices(batch, batch.schema.names[at]):
                for out in work(rows.select([]), texts):
                    yield rows.filter(pa.array(out["kept"]))

    return docs.mapInArrow(run, docs.schema)
