"""Alignment of the tokens of two tokenizers over the same bytes, by pointer jumping.

Both tokenizers cut the same bytes (a space and the text) into tokens. Every token points to the farthest-right token of the
other side that overlaps it, or to itself if none reaches farther; successors are doubled on whole arrays until nothing
moves, in as many rounds as the logarithm of the longest chain. Every token of a connected group then points to the group's
terminal token, which labels it. Groups are thus cut where tokens of both sides end.

All pairs of a token of one side and a token of the other in one group are links. How many documents hold a pair of ids
linked is counted over the corpus:

1. Tasks tokenize slices of texts (bounded in bytes) and write per document its statistics and its distinct pairs as places
   in the slice's list of pairs, and with the slice that list with the number of its documents that hold each pair.
2. The lists are summed by pair, and the highest count of each id of the first side is found; the table of the highest counts
   has at most as many rows as the vocabulary and is broadcast.
3. The lists are joined with the counts by pair. A slice lists a pair once, so the most frequent pair is no larger in that
   join than the number of slices. The counted list then meets its slice's documents by slice.

Within a group of many tokens equal ids are collapsed first and pairs are expanded in blocks, so memory stays linear in the
text. Texts are tokenized once; what is written is Parquet in the shared folder.

Defined results: null and empty texts and texts whose tokens do not give back the bytes (such as those with U+2581, which one
side reads as a space) have no tokens: zeros and '' for the digest; they count for no pair. Repeated rows count each. A null
doc_id is carried. An empty table gives an empty table; other columns do not matter."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm import byte_bpe, sentencepiece_bpe
from plumbline.llm.text import per_text, staged

#: Pairs that are expanded at once, and the size from which a group's equal ids are collapsed first.
BLOCK, LARGE = 1 << 20, 256
#: Characters of text whose ids are held as lists at once.
AT_ONCE = 1 << 18
STRETCH_BORDER = re.compile("[^ ](?= )")
SPACE = sentencepiece_bpe.SPACE


# --- tokenizers -----------------------------------------------------------------


def shown_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies show bytes: printable Latin-1 stays, the rest follows from U+0100."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(stay)]
    return {chr(b): b for b in stay} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(path: str, pattern: str) -> byte_bpe.Vocabulary:
    """The vocabulary of a byte-level BPE tokenizer file whose ids are in the order of its merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, special = spec["model"], {t["content"] for t in spec["added_tokens"]}
    as_byte = shown_bytes()
    ranks = {bytes(map(as_byte.__getitem__, token)): i for token, i in model["vocab"].items() if token not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    vocabulary = byte_bpe.Vocabulary(ranks, pattern)
    coder = byte_bpe.Coder(vocabulary)
    tokens = sorted(ranks, key=ranks.__getitem__)
    alone = coder.pieces.encode([byte_bpe.mapped(raw) for raw in tokens], num_threads=1)
    if (spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or made != sorted(made)
            or any([coder.by_piece[k] for k in ids] != [ranks[raw]] for raw, ids in zip(tokens, alone))):
        raise ValueError("a byte-level BPE is needed that rewrites no text, numbers tokens by their merges and can reach them all")
    return vocabulary


class ByteSide:
    """Ids of a byte-level vocabulary by the tiktoken library."""

    def __init__(self, vocabulary: byte_bpe.Vocabulary):
        import tiktoken

        self.raw = {rank: raw for raw, rank in vocabulary.ranks.items()}
        self.library = tiktoken.Encoding("left", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.library.encode_ordinary(t) for t in texts]


class PieceSide:
    """Ids of a sentencepiece model by its library, which puts a space before what it is given. A long text is given in
    stretches that begin with a space after another character, where no piece spans the border."""

    def __init__(self, vocabulary: sentencepiece_bpe.Vocabulary, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        if not vocabulary.prefix or sentencepiece_bpe.Encoder(vocabulary).cuts is None:
            raise ValueError("a model that puts a space before and has no pieces across spaces or line breaks is needed")
        self.raw = {i: t.replace(SPACE, " ").encode() for i, t in enumerate(vocabulary.texts) if t}
        self.raw |= {i: bytes([b]) for b, i in enumerate(vocabulary.bytes_)}

    @staticmethod
    def stretches(text: str) -> list[str]:
        """Parts of a text that begins with a space, without the space that each begins with."""
        out, begin = [], 0
        while len(text) - begin > AT_ONCE:
            border = STRETCH_BORDER.search(text, begin + AT_ONCE // 2)
            if border is None or border.end() + 1 == len(text):  # the library makes nothing of an empty text
                break
            out.append(text[begin + 1 : border.end()])
            begin = border.end()
        return [*out, text[begin + 1 :]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        if all(0 < len(t) <= AT_ONCE for t in texts):
            return self.library.encode([t[1:] for t in texts], num_threads=1)
        return [[i for part in self.library.encode(self.stretches(t), num_threads=1) for i in part] if t else [] for t in texts]


class Tokens:
    """Ids of whole texts as arrays."""

    def __init__(self, side):
        self.side = side
        self.raw = [side.raw.get(i, b"") for i in range(max(side.raw) + 1)]
        self.sizes = np.array([len(raw) for raw in self.raw], np.int64)

    def of(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text as 32-bit numbers; None if their bytes are not those of the text. Few texts at a time are held
        as lists."""
        out: list[bytes | None] = []
        at = 0
        while at < len(texts):
            begin, size = at, 0
            while at < len(texts) and (size == 0 or size + len(texts[at]) <= AT_ONCE):
                size, at = size + max(1, len(texts[at])), at + 1
            own = texts[begin:at]
            for text, ids in zip(own, self.side.encode(own)):
                same = b"".join(map(self.raw.__getitem__, ids)) == text.encode()
                out.append(array("i", ids).tobytes() if same else None)
        return out


# --- groups ---------------------------------------------------------------------


def terminals(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token of either side the terminal token of its group (a place in `right`), from the ends of the tokens.

    Both sides cover the same bytes. Successors are doubled until every token points to a token that points to itself."""
    n = len(left)
    over = np.searchsorted(left, right)  # the token of the left side that holds the last byte of each token of the right
    own = n + np.arange(len(right))
    succ = np.concatenate((n + np.searchsorted(right, left), np.where(left[over] > right, over, own)))
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ[:n] - n, succ[n:] - n
        succ = further


def expanded(ga, a, wa, gb, b, wb):
    """(group, a, b, weight) of all pairs within groups, in blocks; groups ascend on both sides and occur on both."""
    first, size = np.searchsorted(gb, ga), np.searchsorted(gb, ga, "right")
    size -= first
    total = np.cumsum(size)
    at = 0
    while at < len(ga):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK, "right")))
        n = size[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.repeat(first[at:to] - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield ga[i], a[i], b[j], wa[i] * wb[j]
        at = to


def collapsed(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) with how often each occurs."""
    keys, n = np.unique(group * (1 << 24) + ids, return_counts=True)
    return keys >> 24, keys & ((1 << 24) - 1), n


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their sums."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


@dataclass
class Aligned:
    """Tokens of some texts, group by group; arrays per token have the group, arrays per text the numbers of tokens."""

    a: np.ndarray
    b: np.ndarray
    ga: np.ndarray
    gb: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    doc: np.ndarray  # of each group

    @classmethod
    def of(cls, a: list[bytes], b: list[bytes], sizes_a: np.ndarray, sizes_b: np.ndarray) -> Aligned:
        n_a, n_b = (np.fromiter((len(x) // 4 for x in side), np.int64, len(side)) for side in (a, b))
        ids_a, ids_b = (np.frombuffer(b"".join(side), np.int32).astype(np.int64) for side in (a, b))
        ta, tb = terminals(np.cumsum(sizes_a[ids_a]), np.cumsum(sizes_b[ids_b]))
        ends = tb == np.arange(len(tb))
        number = np.cumsum(ends) - 1
        return cls(ids_a, ids_b, number[ta], number[tb], n_a, n_b, np.repeat(np.arange(len(b)), n_b)[ends])

    def groups(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.n_a))

    def links(self) -> np.ndarray:
        """Links of each text."""
        n = np.bincount(self.ga) * np.bincount(self.gb)
        sums = np.concatenate(([0], np.cumsum(n)))
        ends = np.cumsum(self.groups())
        return sums[ends] - sums[ends - self.groups()]

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair = a * width + b, links) of the distinct pairs of each text, in order."""
        span = width * (int(self.a.max(initial=0)) + 1)
        large = (np.bincount(self.ga) * np.bincount(self.gb) > LARGE) if len(self.ga) else np.zeros(0, bool)
        keys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for big in (False, True):
            in_a, in_b = large[self.ga] == big, large[self.gb] == big
            if big:
                sides = (*collapsed(self.ga[in_a], self.a[in_a]), *collapsed(self.gb[in_b], self.b[in_b]))
            else:
                sides = (self.ga[in_a], self.a[in_a], np.ones(in_a.sum(), np.int64),
                         self.gb[in_b], self.b[in_b], np.ones(in_b.sum(), np.int64))
            for group, a, b, w in expanded(*sides):
                own, m = summed(self.doc[group] * span + a * width + b, w)
                keys.append(own)
                n.append(m)
        keys, n = summed(np.concatenate(keys), np.concatenate(n))
        return keys // span, keys % span, n

    def texts(self, names: np.ndarray, offset: int) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each text. names: per kind of token and separator the decimal id (see `names_of`)."""
        last_a = np.append(self.ga[1:] != self.ga[:-1], True)[: len(self.ga)]
        last_b = np.append(self.gb[1:] != self.gb[:-1], True)[: len(self.gb)]
        before_b = np.searchsorted(self.gb, self.ga)
        through_a = np.searchsorted(self.ga, self.gb, "right")
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + before_b] = self.a + offset * last_a
        codes[np.arange(len(self.b)) + through_a] = self.b + offset * (2 + last_b)
        ends = np.cumsum(self.n_a + self.n_b)
        return [names[codes[begin:end]].tobytes().translate(None, b"\0")[:-1]
                for begin, end in zip(ends - self.n_a - self.n_b, ends)]


def names_of(offset: int) -> np.ndarray:
    """Decimal ids below offset with the separators: , and | after ids of the first side, , and ; after those of the second."""
    return np.array([f"{i}{mark}".encode() for mark in ",|,;" for i in range(offset)])


# --- the corpus -----------------------------------------------------------------


@dataclass(frozen=True)
class Tokenizers:
    """A byte-level vocabulary and a sentencepiece model, read on the driver; both have the size of a vocabulary."""

    left: byte_bpe.Vocabulary
    right: sentencepiece_bpe.Vocabulary
    right_model: bytes

    @classmethod
    def load(cls, byte_level_path: str, pattern: str, piece_path: str) -> Tokenizers:
        left = byte_level(byte_level_path, pattern)
        with open(piece_path, "rb") as file:
            return cls(left, sentencepiece_bpe.Vocabulary.load(piece_path), file.read())

    def sides(self) -> tuple[Tokens, Tokens]:
        return Tokens(ByteSide(self.left)), Tokens(PieceSide(self.right, self.right_model))

    @property
    def width(self) -> int:
        return len(self.right.texts)


STATS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def tokenized(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Per document its statistics and its distinct pairs: `places` in the slice's list (differences) and `times`; the first
    row of a slice has the list: `pairs` and the number of the slice's documents that hold each."""
    width, offset = tokenizers.width, max(max(tokenizers.left.ranks.values()) + 1, tokenizers.width)

    def start():
        left, right = tokenizers.sides()
        names = names_of(offset)
        number = [TaskContext.get().partitionId() << 32]

        def work(rows, texts):
            n = len(texts)
            whole = [" " + raw.decode("utf-8", "replace") if raw else "" for raw in texts]
            a, b = left.of(whole), right.of(whole)
            good = np.flatnonzero([bool(x) and bool(y) for x, y in zip(a, b)])
            out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
            digests, places, times, lists, holders = [""] * n, [None] * n, [None] * n, [None] * n, [None] * n
            if len(good):
                own = Aligned.of([a[i] for i in good], [b[i] for i in good], left.sizes, right.sizes)
                for name, values in (("n_a", own.n_a), ("n_b", own.n_b), ("n_groups", own.groups()), ("n_links", own.links())):
                    out[name][good] = values
                for i, text in zip(good, own.texts(names, offset)):
                    digests[i] = hashlib.sha256(text).hexdigest()
                doc, pair, links = own.pairs(width)
                listed, place, held = np.unique(pair, return_inverse=True, return_counts=True)
                ends = np.searchsorted(doc, np.arange(len(good)), "right")
                for i, begin, end in zip(good, np.concatenate(([0], ends[:-1])), ends):
                    places[i] = np.diff(place[begin:end], prepend=0).astype(np.int32).tobytes()
                    times[i] = links[begin:end].tobytes()
                lists[0], holders[0] = listed, held
            yield {"doc_id": rows.column("doc_id"), "slice": np.full(n, number[0]), **out, "groups_sha256": digests,
                   "places": places, "times": times, "pairs": lists, "holders": holders}
            number[0] += 1

        return work

    return per_text(docs, "text", {"doc_id": F.col("doc_id").cast("long")}, start,
                    f"doc_id long, slice long, {STATS}, places binary, times binary, pairs array<long>, holders array<long>")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): how many documents hold the pair linked, and whether no pair of the same first id has more."""
    counts = staged(rows.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {width}")))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most one row for each id of the vocabulary
    return counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    rows = staged(tokenized(docs, tokenizers))
    listed = rows.where("pairs is not null").select("slice", F.explode(F.arrays_zip("pairs", "holders")).alias("x")).select(
        "slice", F.col("x.pairs").alias("pair"), F.col("x.holders").alias("n"))
    counted = listed.drop("n").join(pair_counts(listed, tokenizers.width), "pair")
    struct = T.StructType.fromDDL(f"doc_id long, {STATS}, n_best long, count_sum long")
    schema = to_arrow_schema(struct)

    def judge(own: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts.column("pair").to_numpy())
        n = counts.column("n").to_numpy()[order]
        best = counts.column("best").to_numpy(zero_copy_only=False)[order]
        n_best, count_sum = [], []
        for places, times in zip(own.column("places").to_pylist(), own.column("times").to_pylist()):
            at, links = np.cumsum(np.frombuffer(places or b"", np.int32)), np.frombuffer(times or b"", np.int64)
            n_best.append(int(links[best[at]].sum()))
            count_sum.append(int((links * n[at]).sum()))
        same = [own.column(f.name) for f in schema if f.name not in ("n_best", "count_sum")]
        return pa.Table.from_arrays([*same, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], schema=schema)

    slim = rows.drop("pairs", "holders").withColumnRenamed("slice", "own_slice")
    out = slim.groupBy("own_slice").cogroup(counted.groupBy("slice")).applyInArrow(judge, struct)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
