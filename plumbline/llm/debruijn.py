"""Removal of long passages that occur more than once, by compaction of a sparse De Bruijn graph of word k-mers.

A window is `length` consecutive words; every word covered by a window that occurs again anywhere is removed.

1. Nodes are the k-mers of a text that are closed syncmers (the least s-mer stands first or last). The choice depends on the
   k-mer alone and every window has at least one, so equal windows hold equal nodes at equal places. Edges join consecutive
   nodes of a text; an edge's label is a hash of all words from its first to its last.
2. Nodes are counted. A node seen once rules out every window around it. An edge is solid if all occurrences of its first
   node leave by it and all of its last node arrive by it; nothing branches or stops there.
3. Joining the counts to the occurrences compacts runs of solid edges into paths. Every occurrence of a path has the same
   words from end to end, so a path of at least `length` words is repeated as a whole.
4. The windows that hold repeated nodes only but reach beyond their path are the open ones. They are hashed at their source
   coordinates (128 bits) and counted; equal windows are open in all their occurrences or in none.
5. Covered words are cut from the texts that have any.

Counts are combined per task; node and window joins are between occurrences and one row per value, so a frequent passage can
be split over tasks; lists are gathered per document only, bounded by its length.

Defined results: null and empty texts have no words; repeated rows count as occurrences of each other; shorter texts than a
window stay whole; an empty table gives an empty table; `cut` keeps other columns."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.text import WordHashes, Windows, Words, mix, per_text, staged, unused


#: Documents with repeated nodes whose ids are sent to all tasks; with more of them all texts go through the join.
BROADCAST_ROWS = 1 << 20


@dataclass(frozen=True)
class Passages:
    """length = 2 * k - s - 1, which makes sure that every window has a node."""

    length: int = 35
    s: int = 4

    @property
    def k(self) -> int:
        if (self.length + self.s + 1) % 2 or self.length <= self.s:
            raise ValueError("length + s must be odd")
        return (self.length + self.s + 1) // 2


def row_id() -> Column:
    """Names a row by its doc_id and text; equal rows share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("binary"))


def syncmers(words: Words, windows: Windows, how: Passages) -> np.ndarray:
    """Places of the nodes of all texts of a slice."""
    small, span = windows.of(how.s), how.k - how.s + 1
    m = len(small) - span + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    least, width = small, 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[:m], least[span - width : span - width + m])
    chosen = (small[:m] == least) | (small[span - 1 : span - 1 + m] == least)
    return np.flatnonzero(chosen & words.inside(how.k))


def _nodes(how: Passages):
    def start():
        memory = WordHashes()

        def work(rows, texts):
            words = Words(texts, memory)
            windows = Windows(words.hashes)
            at, full = syncmers(words, windows, how), windows.of(how.k)
            doc = words.doc[at]
            to = np.append(at[1:], 0) + how.k
            has_next = np.append(doc[1:] == doc[:-1], False) if len(at) else np.zeros(0, bool)
            to = np.where(has_next, to, at)
            label = mix((windows.sums[to] - windows.sums[at]) * windows.up[at] + (to - at).astype(np.uint64)) if len(at) else full[:0]
            bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
            places, keys, outs, digests = [], [], [], []
            node = full[at].view(np.int64)
            label = label.view(np.int64)
            for d, own in enumerate(words.lists):
                a, b = bounds[d], bounds[d + 1]
                places.append((at[a:b] - words.starts[d]).astype(np.int32))
                keys.append(node[a:b])
                outs.append(label[a:b])
                digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
            yield {"doc_id": rows.column("doc_id"), "rid": rows.column("rid"), "n_words": words.counts, "sha": digests,
                   "at": places, "node": keys, "label": outs}

        return work

    return start


def _open_windows(how: Passages, paths: list[dict], nodes: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the windows that hold repeated nodes only but do not lie inside one path; nodes are all of the document's."""
    parts, once = [], np.ones(len(nodes), bool)
    for p in paths:
        begin, end = p["begin"], p["end"]
        once &= (nodes < begin) | (nodes > end - how.k)
        starts = np.arange(max(0, begin + how.k - how.length), min(n_words - how.length, end - how.k) + 1)
        parts.append(starts[(starts < begin) | (starts + how.length > end)])
    at, once = np.unique(np.concatenate(parts)), nodes[once]
    return at[np.searchsorted(once, at + how.length - how.k, "right") == np.searchsorted(once, at, "left")]


def _emit_open(how: Passages):
    def start():
        memory = WordHashes()

        def work(rows, texts):
            words = Words(texts, memory)
            one, two = Windows(words.hashes), Windows(mix(words.hashes + np.uint64(0x632BE59BD9B4E019)))
            first, second = one.of(how.length), two.of(how.length)
            nodes = syncmers(words, one, how)
            bounds = np.searchsorted(words.doc[nodes], np.arange(len(texts) + 1))
            rids, copies = rows.column("rid").to_pylist(), rows.column("copies").to_pylist()
            out = {"rid": [], "at": [], "copies": [], "h1": [], "h2": []}
            for d, paths in enumerate(rows.column("paths").to_pylist()):
                own = nodes[bounds[d] : bounds[d + 1]] - words.starts[d]
                at = _open_windows(how, paths, own, int(words.counts[d]))
                out["rid"].append(np.full(len(at), rids[d], np.int64))
                out["at"].append(at.astype(np.int32))
                out["copies"].append(np.full(len(at), copies[d], np.int64))
                out["h1"].append(first[at + words.starts[d]].view(np.int64))
                out["h2"].append(second[at + words.starts[d]].view(np.int64))
            yield {c: np.concatenate(v) for c, v in out.items()}

        return work

    return start


def _cut(how: Passages):
    def start():
        def work(rows, texts):
            out = {"rid": rows.column("rid"), "n_removed": [], "sha": [], "kept": []}
            windows = rows.column("windows").to_pylist()
            for text, paths, starts in zip(texts, rows.column("paths").to_pylist(), windows):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int32)
                for p in paths:
                    if p["end"] - p["begin"] >= how.length:
                        edge[p["begin"]] += 1
                        edge[p["end"]] -= 1
                at = np.asarray(starts or [], np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + how.length, -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
                out["n_removed"].append(int(len(words) - keep.sum()))
                out["sha"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
            yield out

        return work

    return start


def repeats(docs: DataFrame, how: Passages = Passages()) -> tuple[DataFrame, DataFrame]:
    """(per row: doc_id, rid, n_words, sha; per document with repeated words: rid, n_removed, sha, kept text)."""
    keep = {"doc_id": F.col("doc_id").cast("long"), "rid": row_id()}
    table = staged(per_text(docs, "text", keep, _nodes(how), "doc_id long, rid long, n_words long, sha string, "
                            "at array<int>, node array<long>, label array<long>"))
    n = F.size("node")
    outs = F.transform(F.col("label"), lambda x, i: F.when(i < n - 1, x))
    ins = F.concat(F.array(F.lit(None).cast("long")), F.slice("label", F.lit(1), n - 1))
    seen = table.where(n > 0).withColumns({"out": outs, "into": ins}).select(
        "rid", F.inline(F.arrays_zip("at", "node", "out", "into")))

    def unique(c):
        return (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))

    nodes = seen.groupBy("node").agg(F.count("*").alias("n"), unique("out").alias("leaves"), unique("into").alias("arrives"))
    nodes = nodes.where("n > 1").select("node", F.coalesce("leaves", F.lit(False)).alias("leaves"),
                                        F.coalesce("arrives", F.lit(False)).alias("arrives"))
    found = seen.select("rid", "at", "node").join(nodes, "node").select("rid", "at", "leaves", "arrives")
    walk = Window.partitionBy("rid").orderBy("at")
    before = F.lag("at").over(walk)
    goes_on = (before == F.col("at")) | (F.lag("leaves").over(walk) & F.col("arrives"))
    steps = found.withColumn("fresh", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    runs = steps.withColumn("path", F.sum("fresh").over(walk.rowsBetween(Window.unboundedPreceding, 0)))
    paths = runs.groupBy("rid", "path").agg(F.min("at").alias("begin"), (F.max("at") + how.k).alias("end"))
    paths = staged(paths.groupBy("rid").agg(F.collect_list(F.struct("begin", "end")).alias("paths")))
    texts = docs.select(row_id().alias("rid"), F.col("text").cast("binary").alias("text"))
    if paths.count() <= BROADCAST_ROWS:  # texts without repeated nodes then stay where they are
        texts = texts.join(F.broadcast(paths.select("rid")), "rid", "left_semi")
    touched = staged(texts.join(paths, "rid").groupBy("rid").agg(
        F.first("text").alias("text"), F.first("paths").alias("paths"), F.count("*").alias("copies")))
    windows = staged(per_text(touched, "text", {c: F.col(c) for c in ("rid", "paths", "copies")}, _emit_open(how),
                              "rid long, at int, copies long, h1 long, h2 long"))
    again = windows.groupBy("h1", "h2").agg(F.sum("copies").alias("n")).where("n > 1").select("h1", "h2")
    starts = windows.join(again, ["h1", "h2"]).groupBy("rid").agg(F.collect_list("at").alias("windows"))
    once = touched.join(starts, "rid", "left")
    carry = {c: F.col(c) for c in ("rid", "paths", "windows")}
    cuts = per_text(once, "text", carry, _cut(how), "rid long, n_removed long, sha string, kept binary")
    return table.select("doc_id", "rid", "n_words", "sha"), cuts.where("n_removed > 0")


def removal(docs: DataFrame, how: Passages = Passages()) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the digest of the kept words joined by one space."""
    rows, cuts = repeats(docs, how)
    cuts = cuts.select("rid", "n_removed", F.col("sha").alias("cut_sha"))
    return rows.join(cuts, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("cut_sha", "sha").alias("kept_sha256"))


def cut(docs: DataFrame, how: Passages = Passages()) -> DataFrame:
    """The documents without their repeated passages; texts without any stay as they are."""
    own, rid, new = unused(docs, "__row", "__rid", "__kept")
    _, cuts = repeats(docs, how)
    cuts = staged(cuts.select("rid", F.col("kept").cast("string")).toDF(rid, new))
    joined = docs.withColumn(own, row_id()).join(cuts, F.col(own) == F.col(rid), "left")
    changes = {"text": F.coalesce(new, "text")}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.col(new).isNotNull(), F.length(new)).otherwise(F.col("n_chars")).cast(
            docs.schema["n_chars"].dataType)
    return joined.withColumns(changes).select(*docs.columns)
