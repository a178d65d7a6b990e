"""Byte-level BPE, importance resampling and token alignment against the libraries and brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from plumbline.llm import alignment, byte_bpe, importance

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def odd_texts():
    rng = random.Random(5)
    kinds = (lambda: rng.randrange(32, 127), lambda: rng.randrange(0x80, 0x800), lambda: rng.randrange(0x4E00, 0x9FFF),
             lambda: rng.randrange(0x1F300, 0x1F700), lambda: rng.choice((32, 32, 10, 9, 0, 0xA0, 0x85, 0x1C, 0x200B, 0x3000)))
    out = ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(60))) for _ in range(400)]
    out += ["".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(200))) for _ in range(100)]
    return out + ["x" * 5000, "ab" * 3000, "<|endoftext|> <s>", " " * 700, "é" * 900, "I'll don't  \n\n x", "a ▁b", "0" * 99, "日本語" * 300]


# --- byte-level BPE -------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.load(RANKS, PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_ids_equal_the_library(vocabulary, library):
    coder = byte_bpe.Coder(vocabulary)
    for text in odd_texts():
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_whole_tokens_that_no_merge_reaches(library):
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"bc": 299, b"zzzz": 400, b"ab": 298, b" q": 7000}
    small = byte_bpe.Vocabulary(ranks, PATTERN)
    other = tiktoken.Encoding("small", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = byte_bpe.Coder(small)
    for text in ("abc", "abcabc", "zzzz", "zzzzz", " q qabc", "aabcc zzzz"):
        assert coder.encode(text) == other.encode_ordinary(text)


def test_vocabularies_that_do_not_fit():
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({b"a": 0}, PATTERN)
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({bytes([b]): 0 for b in range(256)}, PATTERN)


def test_encoded(messy, messy_rows, none, vocabulary, library):
    want = []
    for i, t in messy_rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode_bytes(ids))))
    assert rows_of(byte_bpe.encoded(messy, vocabulary)) == sorted(want, key=str)
    full = byte_bpe.encoded(messy, vocabulary, with_ids=True).where("doc_id = 59").first()
    assert full["ids"] == library.encode_ordinary(dict(messy_rows)[59]) and bytes(full["decoded"]).decode() == dict(messy_rows)[59]
    assert byte_bpe.encoded(none, vocabulary).count() == 0


def test_bytes_that_are_no_text(spark, vocabulary, library):
    df = spark.sql("select 1L doc_id, cast(x'61ff62' as string) text")
    assert byte_bpe.encoded(df, vocabulary).first()["n_tokens"] == len(library.encode_ordinary("a�b"))


def test_memory_is_bounded():
    made = []
    memory = byte_bpe.Memory(lambda parts: made.extend(parts) or [p.upper() for p in parts], most=4)
    for at in range(50):
        parts = [[f"p{at}", f"p{at + 1}", "often"], ["y" * 100]]
        known = memory.of(parts)
        assert all(known[p] == p.upper() for own in parts for p in own) and len(known) <= 12 and len(memory.older) <= 12
    assert collections.Counter(made)["y" * 100] == 50 and collections.Counter(made)["often"] == 1


# --- importance resampling ------------------------------------------------------


def brute_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_features(text, longest):
    w = brute_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_draw(docs, target, how):
    own = [brute_features(t, how.longest) for _, t in docs]
    s = collections.Counter(f % how.buckets for fs in own for f in fs)
    t = collections.Counter(f % how.buckets for text in target for f in brute_features(text, how.longest))
    total, wanted = sum(s.values()), sum(t.values())
    rows = []
    for (i, text), fs in zip(docs, own):
        gains = [math.floor(1000 * math.log((t[f % how.buckets] + 1) * (total + how.buckets)
                                            / ((s[f % how.buckets] + 1) * (wanted + how.buckets)))) for f in fs]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(sha(f"{how.seed}:{'' if i is None else i}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(fs), weight, score, None, len(brute_words(text)) >= how.least_words])
    fit = sorted((r for r in rows if r[-1]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(fit[: how.percent * len(fit) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("how", [importance.Draw(), importance.Draw(percent=60, longest=3, buckets=257, seed="x"),
                                 importance.Draw(least_words=0, percent=100)])
def test_draw(spark, messy, messy_rows, how):
    target = [messy_rows[3][1], None, "", "W1 w2,w3 é日本 ÀB"]
    docs = [*messy_rows, (80, messy_rows[5][1]), (80, messy_rows[5][1]), (81, "Ünï-cödé A_b9 " * 30)]
    n = len(messy.columns) - 2
    df = messy.unionByName(spark.createDataFrame([(i, t, *[None] * n) for i, t in docs[len(messy_rows) :]], messy.schema))
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.draw(df, benchmark, how).select("doc_id", "n_features", "weight", "score", "rank")
    assert rows_of(got) == brute_draw(docs, target, how)


def test_draw_from_nothing(spark, messy, none):
    target = none.select("text")
    assert importance.draw(none, target).count() == 0
    assert importance.draw(none, messy).count() == 0
    rows = importance.draw(messy, target).collect()
    assert len(rows) == messy.count() and sum(r["rank"] is not None for r in rows) > 0
    assert importance.draw(messy, target, importance.Draw(percent=0)).where("rank is not null").count() == 0


def test_ranks_over_many_ranges(spark):
    """All scores equal but for the ids: ranks are whole over many partitions."""
    rows = spark.range(5000).repartition(16).selectExpr("id % 2500 doc_id", "1L n_features", "0L weight", "5L score")
    got = importance.ranked(rows, ["score", "doc_id"]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))
    assert all((r["rank"] - 1) // 2 == r["doc_id"] for r in got)


# --- alignment ------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers.load(
        public_tokenizers.path("byte_bpe_50k.json"), PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


class Brute:
    """Both libraries on whole texts, groups by sets of ends, links by nested loops."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in stay} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in stay)}
        self.back = {i: bytes(back[c] for c in t) for t, i in self.a.get_vocab().items() if t != "<|endoftext|>"}

    def groups(self, text):
        if not text:
            return None
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
                 for p in map(self.b.id_to_piece, b)]
        whole = (" " + text).encode()
        if b"".join(self.back[i] for i in a) != whole or b"".join(raw_b) != whole:
            return None
        ends_a = np.cumsum([len(self.back[i]) for i in a])
        ends_b = np.cumsum([len(x) for x in raw_b])
        both, out, x, y = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        for end in both:
            p, q = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            out.append((a[x:p], b[y:q]))
            x, y = p, q
        return out

    def rows(self, docs):
        own = [self.groups(t) for _, t in docs]
        counts = collections.Counter()
        for groups in own:
            counts.update({(x, y) for a, b in groups or () for x in a for y in b})
        most = collections.Counter()
        for (x, _), n in counts.items():
            most[x] = max(most[x], n)
        out = []
        for (i, _), groups in zip(docs, own):
            links = [(x, y) for a, b in groups or () for x in a for y in b]
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups or ())
            out.append((i, sum(len(a) for a, _ in groups or ()), sum(len(b) for _, b in groups or ()), len(groups or ()), len(links),
                        sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), sha(text) if groups else ""))
        return sorted(out, key=str)


def test_alignment(messy, messy_rows, none, tokenizers):
    assert rows_of(alignment.alignment(messy, tokenizers)) == Brute().rows(messy_rows)
    assert alignment.alignment(none, tokenizers).count() == 0
    nulls = alignment.alignment(messy.where("text is null"), tokenizers).collect()
    assert [tuple(r)[1:] for r in nulls] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_alignment_of_odd_texts(spark, tokenizers):
    docs = list(enumerate(odd_texts())) + [(i, "same words here, over and over\n") for i in range(900, 960)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert rows_of(alignment.alignment(df, tokenizers)) == Brute().rows(docs)


def test_long_texts_in_stretches(monkeypatch, tokenizers):
    right = tokenizers.sides()[1].side
    whole = right.encode([" " + t for t in odd_texts()])
    monkeypatch.setattr(alignment, "AT_ONCE", 12)
    assert right.encode([" " + t for t in odd_texts()]) == whole and right.encode(["", " a"])[0] == []


def test_groups_by_pointers():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        left, right = (np.append(np.sort(rng.choice(np.arange(1, n), rng.integers(0, n), replace=False)), n) for _ in "ab")
        ta, tb = alignment.terminals(left, right)
        both = np.intersect1d(left, right)
        assert np.array_equal(right[ta], both[np.searchsorted(both, left)])
        assert np.array_equal(right[tb], both[np.searchsorted(both, right)])


def test_long_chains_take_few_rounds():
    left, right = np.arange(2, 200_002, 2), np.append(np.arange(1, 200_000, 2), 200_000)
    ta, tb = alignment.terminals(left, right)
    assert set(ta) == set(tb) == {len(right) - 1}


def test_large_groups_are_collapsed(monkeypatch):
    """Many tokens in one group: the same pairs whether ids are collapsed or not, and in small blocks."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 5, 400), rng.integers(0, 4, 300)
    own = alignment.Aligned(a, b, np.zeros(400, np.int64), np.zeros(300, np.int64), np.array([400]), np.array([300]), np.zeros(1, np.int64))
    want = collections.Counter((x * 10 + y) for x in a for y in b)
    for large, block in ((256, 1 << 20), (1 << 40, 1 << 20), (1 << 40, 64), (256, 3)):
        monkeypatch.setattr(alignment, "LARGE", large)
        monkeypatch.setattr(alignment, "BLOCK", block)
        doc, pair, n = own.pairs(10)
        assert dict(zip(pair.tolist(), n.tolist())) == want and not doc.any()
