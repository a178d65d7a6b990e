"""Near-duplicates by Order MinHash with verification by banded alignment.

Shingles are runs of five words (lower-cased A-Z); a text with fewer words is one shingle. A sketch labels each shingle with
its occurrence number, takes the l labelled shingles with the least hash and keeps them in the order of the text, so that
equal sketches need common shingles in a common order. Texts that share one of m sketches are candidates.

Texts with the same words are collapsed first. In every bucket each text is compared with the bucket's least and greatest
text, which is all pairs for buckets of up to three. The texts of larger buckets that still hold several components are then
finished exactly by their rarest shingles: the shingles of each (repeats told apart) are ordered by the number of these texts
that have them, and of A shingles the first A - ceil(threshold * A) + 1 are kept; texts that reach the threshold have one of
these in common, so no link is lost. Texts whose rarest shingles nobody else has are done. Where texts of several components
share one, those outside its largest component meet each other and that component, in blocks of bounded size; texts of the
largest component do not meet each other. All pairs of different components with a common sketch whose sizes allow the
threshold are looked at there, and those whose profiles allow it become candidates. A profile counts the shingles by hash in
BINS bins; the sum of the lesser counts is never below the number of common shingles. The first pass takes of each two blocks
only a forest of candidates, so that groups of near copies join with few comparisons; the second takes all that are left, each
at the least shingle that both texts have, as far as the MARKS least rare shingles that each text carries along tell.

A candidate pair is linked if its alignment matches M shingles with M / (A + B - M) >= threshold, A
and B being the numbers of shingles; an alignment with that many matches stays within a band of A + B - 2M places, so
nothing outside the band is looked at and the test is exact.

At the threshold 0.8 a sketch agrees with probability about 0.8**l; with l = 3 and m = 20 a pair is missed by all sketches
with probability below 1e-6.

Defined results: null and empty texts (no words) are alone in their class; repeated rows and exact copies share a class; the
class id is the least doc_id of the class (null only if all are null); an empty table gives an empty table; other columns
are kept by `keep_one` and do not matter to `classes`."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.components import components
from plumbline.llm.text import BASE, WordHashes, Windows, Words, mix, per_text, slices, staged, unused


@dataclass(frozen=True)
class Sketching:
    k: int = 5
    length: int = 3
    sketches: int = 20
    threshold: float = 0.8


#: Bins of a profile, members of a block, and rare shingles that a text carries along.
BINS = 512
BLOCK = 512
MARKS = 64


def shingles(words: Words, k: int) -> list[np.ndarray]:
    """Hashes of the runs of k words of each text, in order; one hash of all words if there are fewer."""
    windows = Windows(words.hashes)
    full = windows.of(k)
    short = {n: windows.of(n) for n in set(words.counts[words.counts < k].tolist()) if n}
    out = []
    for start, n in zip(words.starts.tolist(), words.counts.tolist()):
        out.append(full[start : start + n - k + 1] if n >= k else short[n][start : start + 1] if n else full[:0])
    return out


def labelled(hashes: np.ndarray) -> np.ndarray:
    """The hashes with their occurrence number mixed in, so that each value stands once."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return hashes
    at = np.arange(len(ranked))
    occurrence = np.empty(len(ranked), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(hashes + occurrence * np.uint64(BASE))


def sketch(hashes: np.ndarray, how: Sketching, factors: np.ndarray) -> np.ndarray:
    """The m sketches of a text: per random order, its least l labelled shingles in text order, hashed with the order's number."""
    marked = labelled(hashes)
    take = min(how.length, len(marked))
    out = np.empty(how.sketches, np.uint64)
    step = max(1, (1 << 19) // len(marked))
    for i in range(0, how.sketches, step):
        ranks = marked[None, :] * factors[i : i + step, None]
        if take < len(marked):
            least = np.sort(np.argpartition(ranks, take - 1, axis=1)[:, :take], axis=1)
        else:
            least = np.tile(np.arange(take), (len(ranks), 1))
        value = factors[i : i + step].copy()
        for c in range(take):
            value = mix(value * np.uint64(BASE) + hashes[least[:, c]])
        out[i : i + step] = value
    return out


def _sketches(how: Sketching):
    def start():
        memory = WordHashes()
        factors = mix(np.arange(1, how.sketches + 1, dtype=np.uint64)) | np.uint64(1)

        def work(rows, texts):
            words = Words([t.lower() if t else None for t in texts], memory)
            keys, sizes, all_sketches = [], [], []
            for own, hashes in zip(words.lists, shingles(words, how.k)):
                keys.append(xxhash.xxh3_128_digest(b" ".join(own)) if own else None)
                sizes.append(len(hashes))
                all_sketches.append(sketch(hashes, how, factors).view(np.int64) if len(hashes) else None)
            yield {"doc_id": rows.column("doc_id"), "raw": rows.column("raw"), "key": keys, "size": sizes,
                   "sketches": all_sketches}

        return work

    return start


def sketched(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """(doc_id, raw digest, key of the words, number of shingles, sketches)."""
    keep = {"doc_id": F.col("doc_id").cast("long"), "raw": F.md5(F.col("text").cast("binary"))}
    return per_text(docs, "text", keep, _sketches(how),
                    "doc_id long, raw string, key binary, size int, sketches array<long>")


def needed(total, threshold: float):
    """Least M with M / (total - M) >= threshold."""
    return np.ceil(threshold * total / (1 + threshold) - 1e-9)


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the best alignment matches enough shingles; only matches inside the band are looked at."""
    total = len(a) + len(b)
    need = int(needed(total, threshold))
    if min(len(a), len(b)) < need:
        return False
    _, at_a, at_b = np.intersect1d(labelled(a), labelled(b), assume_unique=True, return_indices=True)
    if len(at_a) < need:
        return False
    if np.all(np.diff(at_b[np.argsort(at_a)]) > 0):
        return True
    band = total - 2 * need
    places: dict[int, int] = {}
    for j, value in enumerate(b.tolist()):
        places[value] = places.get(value, 0) | (1 << j)
    ones = (1 << len(b)) - 1
    state, stripe = ones, (1 << (2 * band + 1)) - 1
    for i, value in enumerate(a.tolist()):
        match = places.get(value, 0)
        if match:
            low = i - band
            match &= stripe << low if low >= 0 else stripe >> -low
            met = state & match
            state = ((state + met) | (state - met)) & ones
    return len(b) - state.bit_count() >= need


def _verify(how: Sketching):
    """Rows (a, b, text_a, text_b) -> the linked (a, b)."""
    def run(batches):
        memory = WordHashes()
        for batch in batches:
            for rows, second in slices(batch, "text_b"):
                keys_a, keys_b = rows.column("a").to_pylist(), rows.column("b").to_pylist()
                first, last = rows.column("text_a"), None
                linked = []
                for i, text in enumerate(second):
                    if keys_a[i] != last:
                        last = keys_a[i]
                        left = shingles(Words([first[i].as_py().lower()], memory), how.k)[0]
                    right = shingles(Words([text.lower()], memory), how.k)[0]
                    linked.append(aligned(left, right, how.threshold))
                keep = pa.array(linked, pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("a").filter(keep), rows.column("b").filter(keep)], names=["u", "v"])

    return run


def _texts(docs: DataFrame, nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of the nodes that have any candidate; the one join that moves texts of all documents."""
    wanted = keys.distinct().join(nodes.select("key", "rep"), "key").select(
        "key", F.col("rep.doc_id").alias("d"), F.col("rep.raw").alias("r"))
    texts = docs.select(F.col("doc_id").cast("long").alias("d0"), F.md5(F.col("text").cast("binary")).alias("r0"),
                        F.col("text").cast("binary").alias("text"))
    found = texts.join(wanted, F.col("d0").eqNullSafe(F.col("d")) & (F.col("r0") == F.col("r")))
    return staged(found.select("key", "text").dropDuplicates(["key"]))


def links(pairs: DataFrame, texts: DataFrame, how: Sketching) -> DataFrame:
    """The candidate pairs (a, b) of keys whose alignment is good enough."""
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return staged(both.mapInArrow(_verify(how), T.StructType.fromDDL("u binary, v binary")))


def _candidates(members: DataFrame, how: Sketching) -> DataFrame:
    """Members paired with the ends low and high of their bucket, if the sizes allow the threshold."""
    pairs = None
    for end in ("low", "high"):
        one = members.select(F.least("key", f"{end}.key").alias("a"), F.greatest("key", f"{end}.key").alias("b"),
                             F.col("size").alias("s"), F.col(f"{end}.size").alias("t"))
        pairs = one if pairs is None else pairs.unionByName(one)
    fits = F.least("s", "t") >= F.lit(how.threshold) * F.greatest("s", "t")
    return pairs.where((F.col("a") != F.col("b")) & fits).select("a", "b").distinct()


def _ends(members: DataFrame) -> DataFrame:
    node = F.struct("key", "size")
    return members.groupBy("bucket").agg(F.min(node).alias("low"), F.max(node).alias("high"))


def _profiles(how: Sketching):
    def start():
        memory = WordHashes()

        def work(rows, texts):
            out, grams = [], []
            for hashes in shingles(Words([t.lower() for t in texts], memory), how.k):
                counts = np.bincount((hashes % np.uint64(BINS)).astype(np.int64), minlength=BINS)
                out.append(counts.astype(np.uint16 if counts.max() < 1 << 16 else np.uint32).tobytes())
                grams.append(labelled(hashes).view(np.int64))
            yield {"key": rows.column("key"), "profile": out, "grams": grams}

        return work

    return start


def _rarest(profiles: DataFrame, threshold: float) -> DataFrame:
    """(gram, key): of each text its rarest shingles that another text has too, one of which any text like it has."""
    grams = profiles.select("key", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    own = Window.partitionBy("key")
    shared = grams.join(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "gram").select(
        "gram", "key", "size", F.count("*").over(own).alias("common"), F.row_number().over(own.orderBy("n", "gram")).alias("place"))
    return shared.where(F.col("place") <= F.col("common") + 1 - F.ceil(F.col("size") * threshold - 1e-6)).select("gram", "key")


def _compared(group: dict[str, list], full: bool, threshold: float):
    """Candidates (a, b) of the members of two blocks of a shingle (or of one): all, or a forest over their components.

    All are without those that have a lesser shingle among the marks of both and meet there."""
    numbers: dict[bytes, int] = {}
    root = np.asarray([numbers.setdefault(r, len(numbers)) for r in group["root"]])
    if len(numbers) < 2:
        return
    above = list(range(len(numbers)))

    def find(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    keys, size, block = group["key"], np.asarray(group["size"], np.int64), np.asarray(group["block"])
    gram = group["gram"][0]
    lesser = [{m for m in marks if m < gram} for marks in group["marks"]] if full else None
    sketches, two = np.asarray(group["sketches"], np.int64), group["i"][0] != group["j"][0]
    profiles = np.stack([np.frombuffer(p, np.uint16 if len(p) == 2 * BINS else np.uint32) for p in group["profile"]])
    for x in range(len(keys) - 1):
        may = (root[x + 1 :] != root[x]) & (
            np.minimum(size[x + 1 :], size[x]) >= threshold * np.maximum(size[x + 1 :], size[x]) - 1e-9)
        if two:
            may &= block[x + 1 :] != block[x]
        at = np.flatnonzero(may) + x + 1
        if len(at):
            at = at[(sketches[at] == sketches[x]).any(axis=1)]
        if len(at):
            common = np.minimum(profiles[at], profiles[x]).sum(axis=1, dtype=np.int64)
            at = at[common >= needed(size[at] + size[x], threshold)]
        for y in at.tolist():
            if full and not lesser[x].isdisjoint(lesser[y]):
                continue
            one, other = find(root[x]), find(root[y])
            if full or one != other:
                above[one] = other
                yield min(keys[x], keys[y]), max(keys[x], keys[y])


def _compare(full: bool, threshold: float):
    """Rows sorted by (gram, i, j) -> candidates."""
    def run(batches):
        group, last = None, None

        def emit(found):
            return pa.RecordBatch.from_arrays([pa.array([p[n] for p in found], pa.binary()) for n in (0, 1)], names=["a", "b"])

        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("gram", "i", "j"))))
            at, found = 0, []
            while at < len(marks):
                to = at + 1
                while to < len(marks) and marks[to] == marks[at]:
                    to += 1
                part = batch.slice(at, to - at).to_pydict()
                if group is not None and marks[at] == last:
                    for c in part:
                        group[c] += part[c]
                else:
                    if group is not None:
                        found += _compared(group, full, threshold)
                    group, last = part, marks[at]
                at = to
            yield emit(found)
        if group is not None:
            yield emit(list(_compared(group, full, threshold)))

    return run


def _details(profiles: DataFrame, rarest: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, profile, size, sketches, marks) of the texts with rare shingles; marks are the least of these."""
    marks = rarest.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("gram")), 1, MARKS).alias("marks"))
    return profiles.select("key", "profile").join(nodes.select("key", "size", "sketches"), "key").join(marks, "key")


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """The keys in buckets of more than three members that hold several components."""
    placed = members.join(found, members["key"] == found["node"], "left").select(
        "bucket", "key", F.coalesce("root", "key").alias("root"))
    mixed = placed.groupBy("bucket").agg(
        F.min("root").alias("one"), F.max("root").alias("other"), F.count("*").alias("n")).where("one <> other and n > 3")
    return placed.join(mixed.select("bucket"), "bucket").select("key").distinct()


def _meetings(rarest: DataFrame, found: DataFrame) -> DataFrame:
    """(gram, i, j, key, root, block): the texts of several components that share a shingle, block against block.

    Blocks of the largest component follow those of the others and meet only these."""
    placed = rarest.join(found, rarest["key"] == found["node"], "left").select(
        "gram", "key", F.coalesce("root", "key").alias("root"))
    sizes = placed.groupBy("gram", "root").agg(F.count("*").alias("k")).groupBy("gram").agg(
        F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("most")).where("most.k < n")
    few = F.col("n") <= BLOCK
    others = F.when(few, 1).otherwise(F.ceil((F.col("n") - F.col("most.k")) / BLOCK)).cast("int")
    largest = F.when(few, 0).otherwise(F.ceil(F.col("most.k") / BLOCK)).cast("int")
    inside = ~few & (F.col("root") == F.col("most.root"))
    dealt = placed.join(sizes, "gram").select(
        "gram", "key", "root", F.when(inside, others).otherwise(0).alias("first"), F.when(inside, largest).otherwise(others).alias("own"),
        F.when(inside, others).otherwise(others + largest).alias("met"))
    met = dealt.withColumn("block", (F.col("first") + F.pmod(F.xxhash64("key"), F.col("own"))).cast("int")).select(
        "gram", "key", "root", "block", F.explode(F.sequence(F.lit(0), F.col("met") - 1)).alias("x"))
    return met.select("gram", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "key", "root", "block")


def _block_pairs(rarest: DataFrame, found: DataFrame, details: DataFrame, full: bool, how: Sketching) -> DataFrame:
    """The candidates among the texts of open buckets that share one of their rarest shingles."""
    rows = _meetings(rarest, found).join(details, "key").repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
    return rows.mapInArrow(_compare(full, how.threshold), T.StructType.fromDDL("a binary, b binary")).distinct()


def classes(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """(doc_id, raw, class_id, rep): one row per input row; rep is the representative (doc_id, raw digest) of its class."""
    rows = staged(sketched(docs, how))
    rep = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "raw")
    nodes = staged(rows.where("key is not null").groupBy("key").agg(
        F.min(rep).alias("rep"), F.first("size").alias("size"), F.first("sketches").alias("sketches")))
    buckets = nodes.select("key", "size", F.explode("sketches").alias("bucket"))
    shared = staged(buckets.join(_ends(buckets).where("low.key <> high.key"), "bucket"))
    texts = _texts(docs, nodes, shared.select("key"))
    seen = staged(_candidates(shared, how))
    edges = links(seen, texts, how)
    found = components(edges)
    keys = _open(shared.select("bucket", "key"), found)
    profiles = staged(per_text(texts.join(keys, "key", "left_semi"), "text", {"key": F.col("key")}, _profiles(how),
                               "key binary, profile binary, grams array<long>"))
    rarest = staged(_rarest(profiles, how.threshold))
    details = staged(_details(profiles, rarest, nodes))
    for full in (False, True):
        wanted = staged(_block_pairs(rarest, found, details, full, how))
        if wanted.isEmpty():
            break
        more = staged(wanted.join(seen, ["a", "b"], "left_anti"))
        if more.isEmpty():
            continue
        new = links(more, texts, how)
        seen, edges = seen.unionByName(more), edges.unionByName(new)
        if not new.isEmpty():
            found = components(edges)
    roots = nodes.join(found, nodes["key"] == found["node"], "left").select(
        "key", "rep", F.coalesce("root", "key").alias("root"))
    named = roots.join(roots.groupBy("root").agg(F.min("rep").alias("best")), "root").select("key", "best")
    out = rows.select("doc_id", "raw", "key").join(named, "key", "left")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "raw")
    return out.select("doc_id", "raw", F.coalesce("best", own).alias("rep")).select(
        "doc_id", "raw", F.col("rep.doc_id").alias("class_id"), "rep")


def keep_one(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """The documents without near-duplicates: of each class the representative stays, with all its columns.

    Of repeated rows one stays; rows without words all stay."""
    own_id, own_raw, d, r = unused(docs, "__id", "__raw", "__d", "__r")
    wanted = classes(docs, how).select("rep.doc_id", "rep.raw").distinct().toDF(d, r)
    marked = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_raw: F.md5(F.col("text").cast("binary"))})
    kept = marked.where(F.col("text").isNotNull()).join(
        wanted, F.col(own_id).eqNullSafe(F.col(d)) & (F.col(own_raw) == F.col(r)), "left_semi")
    return kept.dropDuplicates([own_id, own_raw]).unionByName(marked.where(F.col("text").isNull())).drop(own_id, own_raw)
