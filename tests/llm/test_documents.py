"""Operators on documents against brute force, on a table with every odd case."""

import collections
import hashlib
import math
import random
import textwrap
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer, models

from plumbline.llm import (
    context_mixing, debruijn, licences, order_minhash, quality_rules, sentencepiece_bpe, string_tiling, unigram_counts,
)

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def split(text):
    return (text or "").encode().split()


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


# --- quality rules --------------------------------------------------------------


def brute_quality(doc_id, text):
    w, text = [x.decode() for x in split(text)], text or ""
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    seen, dup, dup_chars = set(), 0, 0
    for x in lines:
        dup, dup_chars = dup + (x in seen), dup_chars + (len(x) if x in seen else 0)
        seen.add(x)
    size = sum(len(x.encode()) for x in w)
    limits, good = quality_rules.Limits(), True
    for n, most in limits.ngrams.items():
        earlier, covered = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            covered |= set(range(i, i + n)) if g in earlier else set()
            earlier.add(g)
        good &= sum(len(w[i].encode()) for i in covered) / max(1, size) <= most
    good &= dup <= limits.line_share * max(1, len(lines)) and dup_chars <= limits.line_chars * max(1, sum(map(len, lines)))
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return (doc_id, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), failed, good and not failed)


def test_repetition(messy, messy_rows):
    got = quality_rules.repetition(messy).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert rows_of(got) == sorted((brute_quality(i, t) for i, t in messy_rows), key=str)


def test_keep_good(messy, messy_rows, none):
    want = sorted(((i, t) for i, t in messy_rows if brute_quality(i, t)[-1]), key=str)
    kept = quality_rules.keep_good(messy)
    assert kept.columns == messy.columns and rows_of(kept.select("doc_id", "text")) == want
    assert quality_rules.keep_good(none).count() == quality_rules.repetition(none).count() == 0


# --- near-duplicates ------------------------------------------------------------


def brute_classes(rows, threshold=0.8):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []

    s = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and min(len(s[a]), len(s[b])) >= threshold * max(len(s[a]), len(s[b])):
                prev = [0] * (len(s[b]) + 1)
                if len(collections.Counter(s[a]) & collections.Counter(s[b])) == 0:
                    continue
                for x in s[a]:
                    now = [0]
                    for j, y in enumerate(s[b]):
                        now.append(prev[j] + 1 if x == y else max(prev[j + 1], now[j]))
                    prev = now
                if prev[-1] >= threshold * (len(s[a]) + len(s[b]) - prev[-1]):
                    root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return list(groups.values())


def test_classes(messy, messy_rows, none):
    small = [(i, t) for i, t in messy_rows if t is None or len(t) < 10_000]
    want = []
    for group in brute_classes(small):
        ids = [small[i][0] for i in group]
        want += [(i, min((x for x in ids if x is not None), default=None)) for i in ids]
    got = order_minhash.classes(messy.where("text is null or length(text) < 10000")).select("doc_id", "class_id")
    assert rows_of(got) == sorted(want, key=str)
    assert order_minhash.classes(none).count() == 0


def test_keep_one(messy, messy_rows, none):
    kept = order_minhash.keep_one(messy)
    assert kept.columns == messy.columns
    texts = [r["text"] for r in kept.select("text").collect()]
    small = [(i, t) for i, t in messy_rows if t is None or len(t) < 10_000]
    assert len(texts) == len(brute_classes(small)) + 1
    assert order_minhash.keep_one(none).count() == 0


def test_alignment_is_exact():
    rng = random.Random(2)
    for _ in range(400):
        a = [rng.randrange(rng.choice((3, 50))) for _ in range(rng.randint(1, 40))]
        b = a[:]
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = [rng.randrange(50)] * rng.randint(0, 2)
        b = b or [1]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        m = best[-1][-1]
        got = order_minhash.aligned(np.asarray(a, np.uint64), np.asarray(b, np.uint64), 0.8)
        assert got == (m >= 0.8 * (len(a) + len(b) - m) - 1e-9)


def test_large_groups_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"v{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(300):
        w = base[:]
        w[rng.randrange(150)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(5000)}" for _ in range(80))) for i in range(100)]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(300)} == {0}
    assert all(got[1000 + i] == 1000 + i for i in range(100))


@pytest.mark.parametrize("block", [512, 40])
def test_star_of_near_copies(spark, monkeypatch, block):
    """Copies like their base only, not like each other."""
    monkeypatch.setattr(order_minhash, "BLOCK", block, raising=False)
    rng = random.Random(8)
    base = [f"v{rng.randrange(5000)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 301):
        w = base[:]
        for at in rng.sample(range(200), 4):
            w[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(w)))
    got = order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["class_id"] for r in got} == {0}


def test_largest_component_meets_the_others_only(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 10)
    keys = [b"%03d" % i for i in range(200)]
    rarest = spark.createDataFrame([(7, k) for k in keys] + [(8, k) for k in keys[:8]], "gram long, key binary")
    found = spark.createDataFrame([(k, keys[0]) for k in keys[1:185]], "node binary, root binary")
    met = collections.defaultdict(list)
    for r in order_minhash._meetings(rarest, found).collect():
        assert r["gram"] == 7
        met[r["i"], r["j"]].append(r)
    pairs = {frozenset((bytes(a["key"]), bytes(b["key"]))) for (i, j), rows in met.items() for a in rows for b in rows
             if a["root"] != b["root"] and (i == j or a["block"] != b["block"])}
    assert pairs == {frozenset((a, b)) for a in keys for b in keys[185:] if a != b}
    assert sum(map(len, met.values())) <= 2 * 185 + 15 * (2 + 19)  # 4,000 if each block met each


@pytest.mark.parametrize("marks", [64, 3])
def test_texts_with_many_common_shingles_meet_once(spark, monkeypatch, marks):
    """Near copies in components of their own share almost all rare shingles; each pair comes from one of them."""
    monkeypatch.setattr(order_minhash, "MARKS", marks, raising=False)
    rng = random.Random(5)
    rows = []
    for _ in range(24):
        w = [f"v{j}" for j in range(120)]
        w[rng.randrange(120)] = f"e{rng.random()}"
        rows.append(" ".join(w).encode())
    hashes = [order_minhash.shingles(order_minhash.Words([t], order_minhash.WordHashes()), 5)[0] for t in rows]
    grams = [order_minhash.labelled(h).view(np.int64).tolist() for h in hashes]
    rarest = order_minhash._rarest(
        spark.createDataFrame([(b"%02d" % i, g) for i, g in enumerate(grams)], "key binary, grams array<long>"), 0.8)
    kept = collections.defaultdict(list)
    for r in rarest.collect():
        kept[r["gram"]].append(int(bytes(r["key"])))
    common = sum(len(k) * (len(k) - 1) // 2 for k in kept.values())
    profiles = [np.bincount((h % np.uint64(order_minhash.BINS)).astype(np.int64), minlength=order_minhash.BINS).astype(np.uint16) for h in hashes]
    own = collections.defaultdict(list)
    for g, members in kept.items():
        for i in members:
            own[i].append(g)
    members = [{"gram": g, "i": 0, "j": 0, "key": b"%02d" % i, "root": b"%02d" % i, "block": 0, "profile": profiles[i].tobytes(),
                "size": len(grams[i]), "sketches": [1], "marks": sorted(own[i])[:marks]} for g in sorted(kept) for i in kept[g]]
    batches = pa.Table.from_pylist(members).to_batches(max_chunksize=50)
    found = [(r["a"], r["b"]) for b in order_minhash._compare(True, 0.8)(batches) for r in b.to_pylist()]
    want = {(b"%02d" % i, b"%02d" % j) for k in kept.values() for i in k for j in k if i < j}
    assert set(found) == want and common > 10 * len(want)
    assert len(found) == len(want) if marks == 64 else len(found) < common / 2


def test_like_texts_share_a_rare_shingle(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        w = [f"v{j % 90}" for j in range(100)]
        for at in rng.sample(range(100), rng.randint(0, 5)):
            w[at : at + rng.randint(0, 2)] = [f"e{rng.randrange(9)}"]
        rows.append(" ".join(w).encode())
    hashes = [order_minhash.shingles(order_minhash.Words([t], order_minhash.WordHashes()), 5)[0] for t in rows]
    grams = spark.createDataFrame(
        [(b"%d" % i, order_minhash.labelled(h).view(np.int64).tolist()) for i, h in enumerate(hashes)], "key binary, grams array<long>")
    kept = collections.defaultdict(set)
    for r in order_minhash._rarest(grams, 0.8).collect():
        kept[int(bytes(r["key"]))].add(r["gram"])
    linked = [(i, j) for i in range(60) for j in range(i) if order_minhash.aligned(hashes[i], hashes[j], 0.8)]
    assert len(linked) > 100 and all(kept[i] & kept[j] for i, j in linked)
    assert max(map(len, kept.values())) <= 30


# --- repeated passages ----------------------------------------------------------


def brute_passages(rows, n):
    w = [split(t) for _, t in rows]
    count = collections.Counter(tuple(x[i : i + n]) for x in w for i in range(len(x) - n + 1))
    out = []
    for (doc_id, _), x in zip(rows, w):
        gone = {i + j for i in range(len(x) - n + 1) if count[tuple(x[i : i + n])] > 1 for j in range(n)}
        kept = b" ".join(y for i, y in enumerate(x) if i not in gone)
        out.append((doc_id, len(x), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_passages(messy, messy_rows, none):
    assert rows_of(debruijn.removal(messy)) == brute_passages(messy_rows, 35)
    assert debruijn.removal(none).count() == debruijn.cut(none).count() == 0


@pytest.mark.parametrize("length, s", [(11, 2), (9, 2), (35, 4)])
def test_passages_random(spark, length, s):
    rng = random.Random(length)
    parts = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 60))] for _ in range(8)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(parts)
            at = rng.randrange(len(p))
            w += p if rng.random() < 0.4 else p[at : at + rng.randint(1, 50)] if rng.random() < 0.6 else [
                rng.choice("abcxyz") for _ in range(rng.randint(1, 40))]
        rows.append((i, " ".join(w)))
    got = debruijn.removal(spark.createDataFrame(rows, "doc_id long, text string"), debruijn.Passages(length, s))
    assert rows_of(got) == brute_passages(rows, length)


def test_cut(messy, messy_rows):
    got = debruijn.cut(messy)
    assert got.columns == messy.columns
    want = {i: (n, gone) for i, n, gone, _ in brute_passages(messy_rows, 35) if i is not None}
    texts = dict(messy_rows)
    for r in got.where("doc_id is not null").select("doc_id", "text").collect():
        n, gone = want[r["doc_id"]]
        assert len(split(r["text"])) == n - gone
        assert gone or r["text"] == texts[r["doc_id"]]


# --- benchmark ------------------------------------------------------------------


def brute_tiles(p, t, least):
    used_p, used_t, total = [False] * len(p), [False] * len(t), 0
    while True:
        best, found = 0, []
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not used_p[i + k] and not used_t[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best:
                    found.append((i, j))
        if best < least or not best:
            return total
        for i, j in found:
            if not any(used_p[i : i + best]) and not any(used_t[j : j + best]):
                used_p[i : i + best] = used_t[j : j + best] = [True] * best
                total += best


def test_tiles_random():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.choice((2, 3, 8))
        p = [rng.randrange(n) for _ in range(rng.randint(0, 25))]
        t = [rng.randrange(n) for _ in range(rng.randint(0, 30))] + p[10:] + p[:10]
        got = string_tiling.tiles(p, t, 3, rng.choice((3, 5, 20)))
        assert sum(k for _, _, k in got) == brute_tiles(p, t, 3)


def test_contamination(spark, messy, messy_rows, none):
    texts = dict(messy_rows)
    long = texts[7].split()
    parts = [" ".join(long[i : i + 12]) for i in range(0, len(long), 12)]
    items = [(1, texts[7]), (2, " ".join(reversed(parts))), (3, "never seen words at all in any text here"), (4, None), (5, ""),
             (6, "One."), (7, texts[8].upper().replace(" ", ", "))]
    benchmark = spark.createDataFrame([(i, t, None) for i, t in items], "item_id long, text string, doc_id string")

    def plain(t):
        return string_tiling.plain(t.encode() if t else None).split()

    want = set()
    for i, t in messy_rows:
        for item, text in items:
            p, w = plain(text), plain(t)
            shared = set(zip(*[p[k:] for k in range(min(5, len(p)))])) & set(zip(*[w[k:] for k in range(min(5, len(p)))])) if p else ()
            if shared and (n := brute_tiles(p, w if len(w) < 1000 else [], min(5, len(p)))) >= 0.5 * len(p):
                want.add((i, item, n / len(p)))
    got = string_tiling.contamination(messy, benchmark)
    assert {tuple(r) for r in got.select("doc_id", "item_id", "coverage").collect()} == want
    assert any(i == 7 and item == 2 for i, item, _ in want)
    dirty = {i for i, _, _ in want}
    clean = string_tiling.clean(messy, benchmark)
    assert clean.columns == messy.columns
    assert rows_of(clean.select("doc_id")) == sorted(((i,) for i, _ in messy_rows if i not in dirty), key=str)
    assert string_tiling.clean(messy, benchmark.limit(0)).count() == len(messy_rows)
    assert string_tiling.contamination(none, benchmark).count() == 0


def test_benchmark_in_blocks(spark, messy, messy_rows, monkeypatch):
    texts = dict(messy_rows)
    benchmark = spark.createDataFrame([(i, texts[i]) for i in (3, 5, 7, 9)], "item_id long, text string")
    whole = rows_of(string_tiling.contamination(messy, benchmark))
    monkeypatch.setattr(string_tiling, "BLOCK_BYTES", 300)
    assert len(string_tiling.blocks(benchmark)) > 1
    assert rows_of(string_tiling.contamination(messy, benchmark)) == whole


# --- tokenizers -----------------------------------------------------------------


def test_sentencepiece(messy, messy_rows, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    vocabulary = sentencepiece_bpe.Vocabulary.load(MODEL)
    want = []
    for i, t in messy_rows:
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert rows_of(sentencepiece_bpe.encoded(messy, vocabulary)) == sorted(want, key=str)
    assert sentencepiece_bpe.encoded(none, vocabulary).count() == 0
    full = sentencepiece_bpe.encoded(messy.where("doc_id = 59"), vocabulary, with_ids=True).first()
    assert full["ids"] == sp.encode(dict(messy_rows)[59]) and full["decoded"] == sp.decode(full["ids"])


def test_sentencepiece_random_texts():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = sentencepiece_bpe.Encoder(sentencepiece_bpe.Vocabulary.load(MODEL))
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("aabehlostnrdiuc  \n\t.,▁éß中0🙂") for _ in range(rng.randint(0, 60)))
        ids = encoder.encode(text)
        assert ids == sp.encode(text) and encoder.decode(ids) == sp.decode(ids)
    for _ in range(100):
        ids = [rng.choice((*range(3, 400), 29871, 13)) for _ in range(20)]
        assert encoder.decode(ids) == sp.decode(ids)


def test_parts_of_pieces_alone_are_not_decoded(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder, decoded, odd = sentencepiece_bpe.Encoder(sentencepiece_bpe.Vocabulary.load(MODEL)), [], {}
    monkeypatch.setattr(encoder, "pieces_text", lambda ids: decoded.append(ids) or "?")
    for text, times in (("hello", 0), ("The 12 cats", 0), ("x.", 0), ("a\U0001f9ff", 1)):
        part = encoder.prepare(text)
        assert encoder.joined(part, odd) == ",".join(map(str, library.encode(text)))
        assert len(decoded) == times
    assert odd == {part: "?"}


def test_unigram_counts(messy, messy_rows, none):
    vocabulary = unigram_counts.Unigram.from_sentencepiece(MODEL)
    library = Tokenizer(models.Unigram([tuple(p) for p in vocabulary.pieces], vocabulary.unk, True))
    counter = unigram_counts.Counter(vocabulary)
    want = sorted(((i, len(library.encode(counter.prepare(t or "")).ids)) for i, t in messy_rows), key=str)
    assert rows_of(unigram_counts.token_counts(messy, vocabulary).select("doc_id", "n_tokens")) == want
    assert unigram_counts.token_counts(none, vocabulary).count() == 0


def test_unigram_ties():
    rng = random.Random(1)
    for _ in range(200):
        pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(8)})
        vocabulary = unigram_counts.Unigram((("<unk>", 0.0), *((p, float(-rng.randint(1, 4))) for p in pieces)), 0, False)
        library = Tokenizer(models.Unigram([tuple(p) for p in vocabulary.pieces], 0, False))
        text = "".join(rng.choice("abcd") for _ in range(30))
        assert unigram_counts.Counter(vocabulary).best(text)[0] == len(library.encode(text).ids)


# --- language model -------------------------------------------------------------


def test_scores(messy, messy_rows, none):
    rows = context_mixing.scores(messy, context_mixing.Mixing(least_blocks=3, chunk_bytes=5000, frequent_words=20)).collect()
    held = {i for i, _ in messy_rows if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    count, ends = collections.Counter(), 0
    for i, t in messy_rows:
        if i not in held:
            count.update((t or "").encode().lower().split())
            ends += 1
    total, kinds = sum(count.values()) + ends, len(count) + 1
    want = []
    for i, t in messy_rows:
        w = (t or "").encode().lower().split()
        base = sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w) + math.log10((ends + 1) / (total + kinds + 1))
        want.append((i, i in held, len(w) + 1, sum(count[x] > 0 for x in w) + 1, total, round(base, 6)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert context_mixing.scores(none).count() == 0


def small_talk(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("alpha", "beta", "gamma delta")) for _ in range(60)) for _ in range(200)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_probabilities_sum_to_one_and_learn(spark):
    _, docs = small_talk(spark)
    how = context_mixing.Mixing(least_blocks=2)
    packed = context_mixing.staged(context_mixing.chunks(docs, context_mixing.is_held_out, how))
    blocks, _, _ = context_mixing.counted(packed, how)
    mixer = context_mixing.train(blocks, how)
    rows = blocks.collect()
    windows = np.concatenate([context_mixing._windows(r["windows"]) for r in rows])
    n = np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in rows])
    for context in (b" gamma", b"beta a", b"qqqqqq"):
        every = np.arange(256, dtype=np.uint64) + np.uint64(int.from_bytes(context, "big") << 8)
        both, counts = context_mixing._merged([(windows, n), (every, np.zeros(256, np.int64))])
        block = mixer.block(both, counts)
        assert abs((10 ** mixer.log10(block)[np.isin(both, every)]).sum() - 1) < 1e-9
    held = [r for r in context_mixing.scores(docs, how).collect() if r["held_out"]]
    assert held and sum(r["bits_per_byte"] for r in held) / len(held) < 0.6
    assert all(r["score"] > r["base_score"] for r in held)


def test_counters_against_brute_force(spark):
    texts, docs = small_talk(spark)
    how = context_mixing.Mixing(least_blocks=3, chunk_bytes=4000)
    packed = context_mixing.staged(context_mixing.chunks(docs, context_mixing.is_held_out, how))
    blocks, number, _ = context_mixing.counted(packed, how)
    first = context_mixing.first_counts(blocks)
    want = collections.Counter()
    seen = set()
    for i, t in enumerate(texts):
        raw = b"\xff" * 6 + t.encode() + b"\xff"
        for at in range(6, len(raw)):
            seen.add(raw[at - 6 : at + 1])
            if zlib.crc32(str(i).encode()) % 7 != 2:
                for order in how.orders:
                    for bits in range(9):
                        want[raw[at - order : at], bits, raw[at] >> (8 - bits)] += 1
    found = set()
    for r in blocks.collect():
        block = context_mixing.Block(how, first, context_mixing._windows(r["windows"]), np.frombuffer(zlib.decompress(r["counts"]), np.int64))
        assert (context_mixing.block_of(block.windows, number) == r["block"]).all()
        for j, w in enumerate(block.windows.tolist()):
            raw = w.to_bytes(7, "big")
            found.add(raw)
            for c, order in enumerate(how.orders):
                for bits in range(9):
                    assert block.counts[c, bits, j] == want[raw[6 - order : 6], bits, raw[6] >> (8 - bits)]
    assert found == seen


def test_distinct_windows_of_a_chunk(monkeypatch):
    """Against brute force, sorted at once or in parts, in a few times the bytes of the texts."""
    rng = random.Random(9)
    texts = [None, b"", b"A", *(" ".join(rng.choice(("so", "it", "goes")) for _ in range(rng.randint(1, 90))).encode() for _ in range(80))]
    held = [rng.random() < 0.3 for _ in texts]
    want = collections.Counter()
    for t, out in zip(texts, held):
        raw = b"\xff" * 6 + (t or b"").lower() + b"\xff"
        for at in range(6, len(raw)):
            want[int.from_bytes(raw[at - 6 : at + 1], "big")] += not out
    for gathered, piece in ((1 << 20, 1 << 20), (1500, 700)):
        monkeypatch.setattr(context_mixing, "GATHERED", gathered)
        monkeypatch.setattr(context_mixing, "PIECE", piece)
        windows, n = context_mixing.distinct_windows(texts, held, context_mixing.Mixing())
        assert dict(zip(windows.tolist(), n.tolist())) == dict(want) and (np.diff(windows.astype(np.int64)) > 0).all()
    monkeypatch.undo()
    large = [rng.randbytes(1 << 19).hex().encode() for _ in range(4)]
    tracemalloc.start()
    context_mixing.distinct_windows(large, [False] * 4, context_mixing.Mixing())
    assert tracemalloc.get_traced_memory()[1] < 45 * sum(map(len, large))
    tracemalloc.stop()


def test_each_block_is_worked_on_once_per_pass(spark):
    _, docs = small_talk(spark)
    how = context_mixing.Mixing(least_blocks=3)
    blocks, _, _ = context_mixing.counted(context_mixing.staged(context_mixing.chunks(docs, context_mixing.is_held_out, how)), how)
    mixer = context_mixing.Mixer(how, context_mixing.first_counts(blocks))
    calls = spark.sparkContext.accumulator(0)

    def fn(own, block):
        calls.add(1)
        return np.ones(2)

    sums, _ = context_mixing._gathered(blocks, mixer, fn)
    assert sums.tolist() == [blocks.count()] * 2 and calls.value == blocks.count()


def test_scores_do_not_depend_on_partitioning(spark, messy, monkeypatch):
    def scored(docs, **more):
        rows = context_mixing.scores(docs, context_mixing.Mixing(least_blocks=3, **more)).collect()
        return sorted((str(r["doc_id"]), round(r["score"], 9), round(r["bits_per_byte"], 9)) for r in rows)

    want = scored(messy)
    monkeypatch.setattr(context_mixing, "FAN_IN", 2)
    monkeypatch.setattr(context_mixing, "PIECE", 1000)
    assert scored(messy.repartition(7), chunk_bytes=3000) == want


# --- licences -------------------------------------------------------------------


def test_licences(spark, messy, none):
    assert rows_of(licences.scan(messy)) == [(62, "apache-2.0-line", 1.0, 1)]
    assert licences.scan(none).count() == 0
    mit = licences.TEMPLATES["mit"]
    wrapped = "My program\n\n" + "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70)) + "\n\nThe end"
    rows = [(1, wrapped), (1, wrapped), (2, "x " + licences.TEMPLATES["mit-line"].upper()), (3, "License")]
    got = rows_of(licences.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(r[0], r[1], r[3]) for r in got] == [(1, "mit", 2), (2, "mit-line", 1)]


LAYOUTS = {
    "mit": ("following conditions:", "portions of the Software."),
    "apache-2.0-notice": ("with the License.", "at", "LICENSE-2.0"),
    "gpl-3.0-notice": ("any later version.", "PARTICULAR PURPOSE."),
    "isc": ("appear in all copies.",),
}
ISC_END = ("FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
           "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
           "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")


def test_licences_of_several_paragraphs(spark):
    rows, want = [], []
    for i, (name, ends) in enumerate(LAYOUTS.items()):
        body = licences.TEMPLATES[name]
        if name == "isc":
            body = body[: body.index("FITNESS.")] + ISC_END
        for end in ends:
            body = body.replace(f" {end} ", f" {end}\n\n")
        lines = "\n\n".join("\n".join(textwrap.wrap(p, 70)) for p in body.split("\n\n"))
        rows.append((i, "My program does things\n\nCopyright 2020 Somebody\n\n" + lines + "\n\nThe end of this file"))
        want.append((i, name, 1))
    twice = rows[0][1] + "\n\nMore prose stands here in between.\n\n" + rows[0][1]
    inside = "We wrote some prose on this line first. " + licences.TEMPLATES["gpl-3.0-line"] + " And some more prose follows it."
    rows += [(10, twice), (11, inside), (11, inside), (12, "The software is free. In no event shall it be sold.")]
    want += [(10, "mit", 2), (11, "gpl-3.0-line", 2)]
    got = [(r[0], r[1], r[3]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert set(want) <= set(got)
    assert {r[1] for r in got if r[0] not in (1,)} == {"mit", "gpl-3.0-notice", "isc", "gpl-3.0-line"}
