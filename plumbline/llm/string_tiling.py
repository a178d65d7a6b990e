"""Benchmark decontamination by greedy string tiling.

Texts and items become words: A-Z in lower case, ASCII punctuation as white space. Runs of `least` words (fewer if the item is
shorter) that a document shares with an item are seeds. For documents whose seeds could cover enough of an item, tiling with
running Karp-Rabin follows: windows of a falling length s are matched by hash, extended, and the longest matches of words not
yet used are marked as tiles until no match of `least` words is left. Tiles may lie in any order, so reordered passages count.
A document is contaminated by an item if the tiles cover at least `coverage` of the item's words.

Items are taken in blocks of bounded size; every block is sent to the tasks and compared with all documents in one pass
without a shuffle. Equal matches are taken in the order of the item, then of the document.

Defined results: null and empty texts and items without words match nothing; repeated documents give repeated rows; an empty
benchmark keeps every document; other columns are kept by `clean` and do not matter to `contamination`."""

from __future__ import annotations

import string
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import WordHashes, Windows, Words, per_text, slices

#: Bytes of benchmark text that are held by a task at once; larger benchmarks take more passes.
BLOCK_BYTES = 8 << 20
SPACED = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


@dataclass(frozen=True)
class Tiling:
    least: int = 5
    coverage: float = 0.5
    first: int = 20


def plain(text: bytes | None) -> bytes:
    return text.lower().translate(SPACED) if text else b""


def tiles(pattern: list[int], text: list[int], least: int, first: int = 20) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in pattern, start in text, length), longest first; None in a list is never matched."""
    used_p, used_t = [x is None for x in pattern], [x is None for x in text]
    out: list[tuple[int, int, int]] = []
    size = max(least, first)
    while True:
        found = _matches(pattern, text, used_p, used_t, size)
        longest = max((k for k, _, _ in found), default=0)
        if longest > 2 * size:  # start again at the length that was met, so that the longest come first
            size = longest
            continue
        _mark(found, used_p, used_t, size, out)
        if size > 2 * least:
            size //= 2
        elif size > least:
            size = least
        else:
            return out


def _matches(pattern, text, used_p, used_t, size) -> list[tuple[int, int, int]]:
    """Maximal matches (length, pattern start, text start) of unused words with at least `size` words."""
    starts = defaultdict(list)
    for p in _free(used_p, size):
        starts[hash(tuple(pattern[p : p + size]))].append(p)
    found = []
    for t in _free(used_t, size):
        for p in starts.get(hash(tuple(text[t : t + size])), ()):
            if p and t and not used_p[p - 1] and not used_t[t - 1] and pattern[p - 1] == text[t - 1]:
                continue  # the match that starts one word before covers this one
            k = 0
            while (p + k < len(pattern) and t + k < len(text) and not used_p[p + k] and not used_t[t + k]
                   and pattern[p + k] == text[t + k]):
                k += 1
            if k >= size:
                found.append((k, p, t))
    return found


def _free(used: list[bool], size: int):
    run = 0
    for i, taken in enumerate(used):
        run = 0 if taken else run + 1
        if run >= size:
            yield i - size + 1


def _mark(found, used_p, used_t, size, out) -> None:
    """Mark the matches, longest first; what earlier tiles leave of a match goes back if it is long enough."""
    by_length = defaultdict(list)
    for k, p, t in found:
        by_length[k].append((p, t))
    for k in range(max(by_length, default=0), size - 1, -1):
        for p, t in sorted(by_length.pop(k, ())):
            start = None
            pieces = []
            for i in range(k + 1):
                free = i < k and not used_p[p + i] and not used_t[t + i]
                if free and start is None:
                    start = i
                elif not free and start is not None:
                    pieces.append((start, i - start))
                    start = None
            if pieces == [(0, k)]:
                used_p[p : p + k] = [True] * k
                used_t[t : t + k] = [True] * k
                out.append((p, t, k))
            else:
                for i, n in pieces:
                    if n >= size:
                        by_length[n].append((p + i, t + i))


class Items:
    """The items of a block with their seeds."""

    def __init__(self, items: list[tuple[int, bytes]], how: Tiling):
        self.how, self.ids = how, [i for i, _ in items]
        words = Words([plain(t) for _, t in items], WordHashes())
        windows = Windows(words.hashes)
        self.words = [words.hashes[a:b].tolist() for a, b in zip(words.starts, words.ends)]
        self.least = [min(how.least, len(w)) for w in self.words]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[tuple[int, int]]]]] = {}
        for n in sorted(set(self.least) - {0}):
            hashes, where = windows.of(n), defaultdict(list)
            for item, (start, end) in enumerate(zip(words.starts.tolist(), words.ends.tolist())):
                if self.least[item] == n:
                    for p in range(end - start - n + 1):
                        where[int(hashes[start + p])].append((item, p))
            values = np.sort(np.fromiter(where, np.uint64, len(where)))
            table = np.zeros(1 << 20, bool)
            table[values >> np.uint64(44)] = True
            self.seeds[n] = values, table, where

    def search(self, texts: list[bytes | None], memory: WordHashes):
        """(document, item, words covered, tiles, longest tile) of the pairs that reach the coverage."""
        words = Words([plain(t) for t in texts], memory)
        windows = Windows(words.hashes)
        hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for n, (values, table, where) in self.seeds.items():
            hashes = windows.of(n)
            at = np.flatnonzero(table[hashes >> np.uint64(44)] & words.inside(n))
            at = at[values[np.minimum(np.searchsorted(values, hashes[at]), len(values) - 1)] == hashes[at]]
            for place, doc, value in zip(at.tolist(), words.doc[at].tolist(), hashes[at].tolist()):
                for item, p in where[value]:
                    hits[doc, item].append((place, p))
        for (doc, item), seeds in hits.items():
            n, pattern = self.least[item], self.words[item]
            covered = np.zeros(len(pattern) + 1, np.int64)
            for p in {p for _, p in seeds}:
                covered[p] += 1
                covered[p + n] -= 1
            if np.count_nonzero(np.cumsum(covered[:-1])) < self.how.coverage * len(pattern):
                continue
            text, last = [], None  # the document's words under seeds; gaps stay gaps
            for place in sorted({place for place, _ in seeds}):
                begin = place if last is None or place >= last else last
                if last is not None and place > last:
                    text.append(None)
                text += words.hashes[begin : place + n].tolist()
                last = place + n
            found = tiles(pattern, text, n, self.how.first)
            total = sum(k for _, _, k in found)
            if total >= self.how.coverage * len(pattern):
                yield doc, item, total, len(found), max(k for _, _, k in found)


def blocks(benchmark: DataFrame) -> list[list[tuple[int, bytes]]]:
    """The items in blocks of about BLOCK_BYTES; each block is one bounded read to the driver."""
    items = benchmark.where(F.col("text").isNotNull()).select(
        F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // BLOCK_BYTES + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [[(r[0], bytes(r[1])) for r in items.where(block == b).orderBy("item_id", "text").collect()] for b in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, how: Tiling = Tiling()) -> DataFrame:
    """(doc_id, item_id, coverage, n_words of the item, n_tiles, longest) of every contaminated pair."""
    out = None
    for block in blocks(benchmark):
        def start(block=block):
            items, memory = Items(block, how), WordHashes()

            def work(rows, texts):
                ids = rows.column("doc_id").to_pylist()
                found = list(items.search(texts, memory))
                sizes = [len(items.words[i]) for _, i, _, _, _ in found]
                yield {"doc_id": [ids[d] for d, *_ in found], "item_id": [items.ids[i] for _, i, *_ in found],
                       "coverage": [t / n for (_, _, t, _, _), n in zip(found, sizes)], "n_words": sizes,
                       "n_tiles": [k for _, _, _, k, _ in found], "longest": [m for *_, m in found]}

            return work

        part = per_text(docs, "text", {"doc_id": F.col("doc_id").cast("long")}, start,
                        "doc_id long, item_id long, coverage double, n_words long, n_tiles long, longest long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, how: Tiling = Tiling()) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    at, schema = docs.columns.index("text"), docs.schema
    for block in blocks(benchmark):
        def run(batches, block=block):
            items, memory = Items(block, how), WordHashes()
            for batch in batches:
                for rows, texts in slices(batch, batch.schema.names[at]):
                    bad = {d for d, *_ in items.search(texts, memory)}
                    yield rows.filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
