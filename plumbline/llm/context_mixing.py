"""Language-model scores by logistic context mixing over hashed bit predictors.

Texts (A-Z in lower case, UTF-8, closed by one end byte) are predicted bit by bit. For each order k the last k bytes and the
bits of the current byte so far name a counter; its counts of zeros and ones are one predictor. The predictors' log odds are
added with weights, and a gate (the longest order met before, the place in the word, the bit's place) selects the weights.
The mix is refined by an adaptive map from (bits so far, mixed log odds) to the frequency met. The product of the bit
probabilities is the probability of the text, so its log over the bytes gives bits per byte.

Counters are a distributed table that grows with the corpus; there are as many as the training texts have contexts, without
collisions. Documents are packed into chunks of bounded size, and each chunk counts its distinct windows (context and byte).
Windows are dealt by a hash of their last bytes of context to blocks whose number follows from the number of distinct windows,
so that all counters of the orders above one stand in the block of the window; order one has at most 65,536 counters, which
every task gets. Counts of a block are merged as a tree with bounded fan-in. The weights are learned online, in small batches
within a block, from the mean of the blocks' weights of the round before; each occurrence is predicted from the counts without
itself. Blocks score their distinct windows once, chunks get the scores of their own windows back, and no task holds more than
one block or one chunk. Blocks depend on the windows alone, so a score depends neither on partitioning nor on other scored texts.

The base model is a word unigram with add-one smoothing over the training tokens; the most frequent words (a fixed number)
are sent to all tasks, all other words are looked up by a join.

Defined results: null counts as the empty text (one end token); a null doc_id is a training document; repeated rows are
scored each and count each in training; without training documents all counts are 0; other columns do not matter."""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.text import mix, slices, staged
from plumbline.session import shared_dir

END = 0xFF  # no UTF-8 text has this byte
#: Bytes of context whose hash deals a window to its block; every order but the first is at least as long.
DEALT = 3
#: Bytes looked at at once; events sorted at once; one of so many windows is noted to estimate their number; rows merged by one task.
PIECE, GATHERED, NOTED, FAN_IN = 1 << 17, 6 << 20, 1024, 256
ZSTD = pa.Codec("zstd", compression_level=6)


@dataclass(frozen=True)
class Mixing:
    orders: tuple[int, ...] = (1, 3, 4, 5, 6)
    rounds: int = 2
    rate: float = 0.1
    batch: int = 4096
    buckets: int = 33
    chunk_bytes: int = 8 << 20
    block_windows: int = 1 << 18
    least_blocks: int = 16
    frequent_words: int = 1 << 17

    @property
    def width(self) -> int:
        return max(self.orders)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


# --- windows ------------------------------------------------------------------


def _runs(data: np.ndarray, k: int) -> np.ndarray:
    """The k bytes from each place as one number, put together from runs of 1, 2, 4 ... bytes."""
    run, size, out, done = data.astype(np.uint64), 1, np.zeros(len(data), np.uint64), 0
    while True:
        if k & size:
            out = (out[: len(data) - done - size + 1] << np.uint64(8 * size)) | run[done:]
            done += size
        if done == k:
            return out
        run = (run[:-size] << np.uint64(8 * size)) | run[size:]
        size *= 2


def stream(texts: list[bytes | None], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows of `width` context bytes and the byte that follows, as numbers; text of each), piece by piece.

    A text of n bytes has n + 1 events, the last being its end."""
    pad = bytes([END]) * width
    raw = np.frombuffer(pad + b"".join([(t or b"").lower() + pad for t in texts]), np.uint8)
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(lengths + width - 1) - (lengths + width - 1)
    for begin in range(0, len(raw) - width, PIECE):
        own = raw[begin : begin + PIECE + width]
        packed = _runs(own, width + 1)
        first = int(np.searchsorted(starts, begin, "right")) - 1
        last = int(np.searchsorted(starts, begin + len(packed), "left"))
        text = np.repeat(np.arange(first, last), np.diff(np.append(starts[first:last], begin + len(packed))))
        text = text[begin - starts[first] :][: len(packed)]
        event = begin + np.arange(len(packed)) - starts[text] < lengths[text]
        yield packed[event], text[event]


def _counted(values: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, n = values[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(values))) if n is None else np.add.reduceat(n, first) if len(first) else n
    return values[first], counts


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _counted(*(np.concatenate(x) for x in zip(*parts))) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _marked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows and how many of each have no mark in their last bit; sorts the values in place."""
    values.sort()
    new, marks = np.ones(len(values), bool), np.empty(len(values), np.uint8)
    for begin in range(0, len(values), PIECE):
        own = values[begin : begin + PIECE]
        marks[begin : begin + PIECE] = own & np.uint64(1)
        before = values[max(0, begin - 1) : begin + len(own) - 1]
        new[max(1, begin) : begin + len(own)] = (own[len(own) - len(before) :] ^ before) > np.uint64(1)
    first = np.flatnonzero(new)
    n = np.diff(first, append=len(values))
    if len(first):
        n -= np.add.reduceat(marks, first, dtype=np.int64)
    return values[first] >> np.uint64(1), n


def distinct_windows(texts: list[bytes | None], held: list[bool], how: Mixing) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of the texts, ascending, and how often each stands in those not held out."""
    flags = np.asarray(held).astype(np.uint64)
    events = sum(len(t or b"") + 1 for t in texts)
    values, used, parts = np.empty(min(events, max(GATHERED, PIECE)), np.uint64), 0, []
    for windows, text in stream(texts, how.width):
        if used + len(windows) > len(values):
            parts, used = [_merged([*parts, _marked(values[:used])])], 0
        np.bitwise_or(windows << np.uint64(1), flags[text], out=values[used : used + len(windows)])
        used += len(windows)
    parts.append(_marked(values[:used]))
    del values
    return _merged(parts) if len(parts) > 1 else parts[0]


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def _unpacked(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _shrunk(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + ZSTD.compress(data, asbytes=True)


def _restored(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return ZSTD.decompress(data[8:], size, asbytes=True) if size else b""


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on, which shrinks better."""
    return _shrunk(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _values(data: bytes, kind=np.uint64) -> np.ndarray:
    bytes_ = np.frombuffer(_restored(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(bytes_.T).view(kind).ravel()


def _steps(windows: np.ndarray) -> bytes:
    """Ascending windows as their differences."""
    return _planes(np.diff(windows, prepend=np.uint64(0)))


def _windows(data: bytes) -> np.ndarray:
    steps = _values(data)
    return np.cumsum(steps, out=steps)


CHUNK = ("chunk long, doc_ids array<long>, held array<boolean>, lengths binary, texts binary, windows binary, counts binary, "
         "noted array<long>")


def chunks(docs: DataFrame, held_out, how: Mixing) -> DataFrame:
    """Documents packed into rows of bounded size (or one document) with the distinct windows and their training counts."""
    struct = T.StructType.fromDDL(CHUNK)
    schema = to_arrow_schema(struct)

    def packed(number, ids, held, texts):
        windows, n = distinct_windows(texts, held, how)
        lengths = np.fromiter((-1 if t is None else len(t) for t in texts), np.int64, len(texts))
        return pa.RecordBatch.from_pylist([{
            "chunk": number, "doc_ids": ids, "held": held, "lengths": _packed(lengths),
            "texts": _shrunk(b"".join([t.lower() for t in texts if t])), "windows": _steps(windows),
            "counts": _planes(n), "noted": windows[mix(windows) % np.uint64(NOTED) == 0].astype(np.int64).tolist()}], schema)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for rows, own in slices(batch, "text"):
                more = sum(len(t or b"") for t in own)
                if texts and size + more > how.chunk_bytes:
                    yield packed(number, ids, held, texts)
                    number, ids, held, texts, size = number + 1, [], [], [], 0
                ids += rows.column("doc_id").to_pylist()
                held += rows.column("held").to_pylist()
                texts += own
                size += more
        if texts:
            yield packed(number, ids, held, texts)
        pa.default_memory_pool().release_unused()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"),
                       F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, struct)


# --- blocks -------------------------------------------------------------------


def block_of(windows: np.ndarray, blocks: int) -> np.ndarray:
    context = (windows >> np.uint64(8)) & np.uint64((1 << 8 * DEALT) - 1)
    return (mix(context + np.uint64(1)) % np.uint64(blocks)).astype(np.int64)


def _split(windows: np.ndarray, blocks: int) -> list[np.ndarray]:
    """Places of the windows of each block, in the order of the windows."""
    block = np.empty(len(windows), np.uint16 if blocks <= 1 << 16 else np.int64)
    for begin in range(0, len(windows), PIECE):
        block[begin : begin + PIECE] = block_of(windows[begin : begin + PIECE], blocks)
    return np.split(np.argsort(block, kind="stable"), np.cumsum(np.bincount(block, minlength=blocks))[:-1])


def parts(packed: DataFrame, blocks: int) -> DataFrame:
    """(block, chunk, windows, counts): what each chunk has of each block."""
    struct = T.StructType.fromDDL("block int, chunk long, windows binary, counts binary")
    schema = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            for chunk, data, counts in zip(*batch.columns):
                windows, n = _windows(data.as_py()), _values(counts.as_py(), np.int64)
                yield pa.RecordBatch.from_pylist([
                    {"block": b, "chunk": chunk.as_py(), "windows": _steps(windows[at]), "counts": _planes(n[at])}
                    for b, at in enumerate(_split(windows, blocks)) if len(at)], schema)

    return packed.select("chunk", "windows", "counts").mapInArrow(run, struct)


def merged(own: DataFrame, salts: int) -> DataFrame:
    """(block, windows, counts): one row per block, merged as a tree."""
    struct = T.StructType.fromDDL("block int, chunk long, windows binary, counts binary")
    schema = to_arrow_schema(struct)

    def add(table: pa.Table, last: bool) -> pa.Table:
        sums, waiting = [], 0
        for w, n in zip(table.column("windows"), table.column("counts")):
            sums.append((_windows(w.as_py()), _values(n.as_py(), np.int64)))
            waiting += len(sums[-1][0])
            if waiting > 1 << 21:
                sums, waiting = [_merged(sums)], 0
        windows, n = _merged(sums)
        return pa.Table.from_pylist([{"block": table.column("block")[0].as_py(), "chunk": table.column("chunk")[0].as_py(),
                                      "windows": _steps(windows), "counts": _packed(n) if last else _planes(n)}], schema)

    def added(last: bool):
        return lambda table: add(table, last)

    while True:
        own = own.withColumn("salt", F.pmod(F.xxhash64("chunk", F.lit(salts)), F.lit(salts))).groupBy("block", "salt").applyInArrow(
            added(salts == 1), struct)
        if salts == 1:
            return own.select("block", "windows", "counts")
        salts = -(-salts // FAN_IN)


def _nodes(byte: np.ndarray, i: int) -> np.ndarray:
    """The first i bits of the byte with a leading one."""
    return (np.int64(1) << i) | (byte >> (8 - i))


def first_counts(blocks: DataFrame) -> np.ndarray:
    """Counts of (last byte, bits of the next byte so far with a leading one)."""
    struct = T.StructType.fromDDL("k int, n long")
    schema = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = _counted(_windows(row["windows"]) & np.uint64(0xFFFF), _unpacked(row["counts"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(n, pa.int64())], schema=schema)

    out = np.zeros((256, 512))
    rows = blocks.select("windows", "counts").mapInArrow(run, struct).groupBy("k").agg(F.sum("n").alias("n")).collect()
    for row in rows:  # at most 65,536
        for i in range(9):
            out[row["k"] >> 8, (1 << i) | ((row["k"] & 0xFF) >> (8 - i))] += row["n"]
    return out


class Block:
    """Distinct windows with, per order, how often the context was followed by the first 0 to 8 bits of the byte."""

    def __init__(self, how: Mixing, first: np.ndarray, windows: np.ndarray, n: np.ndarray):
        self.windows, self.n = windows, n.astype(np.float64)
        self.byte = (windows & np.uint64(0xFF)).astype(np.int64)
        self.counts = np.empty((len(how.orders), 9, len(windows)), np.float32)
        for c, order in enumerate(how.orders):
            if order == 1:
                last = ((windows >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)
                for i in range(9):
                    self.counts[c, i] = first[last, _nodes(self.byte, i)]
                continue
            key = windows & np.uint64((1 << 8 * (order + 1)) - 1)
            at = np.argsort(key, kind="stable")
            key, sums = key[at], np.concatenate(([0], np.cumsum(n[at])))
            for i in range(9):
                prefix = key >> np.uint64(8 - i)
                begin = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
                ends = np.append(begin[1:], len(key))
                self.counts[c, i, at] = np.repeat(sums[ends] - sums[begin], ends - begin)
        self.place = np.zeros(len(windows), np.int64)
        inside = np.ones(len(windows), bool)
        for j in range(1, how.width + 1):
            b = (windows >> np.uint64(8 * j)) & np.uint64(0xFF)
            inside &= (b != 0x20) & (b != END) & ((b < 9) | (b > 13))
            self.place += inside


# --- mixing -------------------------------------------------------------------


class Mixer:
    """Counts of order one, weights by gate and the final map; weights start equal, the map starts as the identity."""

    def __init__(self, how: Mixing, first: np.ndarray):
        self.how, self.first = how, first
        self.gates = (len(how.orders) + 1) * (how.width + 1) * 8
        self.weights = np.full((self.gates, len(how.orders)), 0.4)
        centre = 1 / (1 + np.exp(-np.linspace(-12, 12, how.buckets)))
        self.map = np.stack([np.tile(20 * (1 - centre), (256, 1)), np.tile(20 * centre, (256, 1))])

    def block(self, windows: np.ndarray, n: np.ndarray) -> Block:
        return Block(self.how, self.first, windows, n)

    def inputs(self, block: Block, at, i: int, without: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log odds by order that bit i of the windows is what it is, and the gate; `without` leaves out one occurrence."""
        all_, same = block.counts[:, i, at] - np.float32(without), block.counts[:, i + 1, at] - np.float32(without)
        odds = np.log((same + np.float32(0.05)) / (all_ - same + np.float32(0.05))).astype(np.float64)
        longest = ((all_ > 0) * np.arange(1, len(all_) + 1)[:, None]).max(axis=0)
        return odds, (longest * (self.how.width + 1) + block.place[at]) * 8 + i

    def mixed(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((odds * self.weights[gate].T).sum(axis=0), -12, 12)

    def refined(self, mixed: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a one: the mean of the mix and of its neighbours in the map."""
        at = (mixed + 12) / 24 * (self.how.buckets - 1)
        low = np.minimum(at.astype(np.int64), self.how.buckets - 2)
        rate = self.map[1] / self.map.sum(axis=0)
        share = at - low
        p = (1 - share) * rate[node, low] + share * rate[node, low + 1]
        return np.clip(0.5 * p + 0.5 / (1 + np.exp(-mixed)), 1e-6, 1 - 1e-6)

    def log10(self, block: Block) -> np.ndarray:
        """log10 probability of the last byte of each window."""
        total = np.zeros(len(block.windows))
        for begin in range(0, len(total), 1 << 16):
            at = slice(begin, begin + (1 << 16))
            for i in range(8):
                one = (block.byte[at] >> (7 - i)) & 1 == 1
                mixed = self.mixed(*self.inputs(block, at, i, False))
                p = self.refined(np.where(one, mixed, -mixed), _nodes(block.byte[at], i))
                total[at] += np.log10(np.where(one, p, 1 - p))
        return total

    def learn(self, block: Block) -> None:
        """One online pass: small batches in hashed order, each predicted before the weights move."""
        known = np.flatnonzero(block.n > 0)
        known = known[np.argsort(mix(block.windows[known]), kind="stable")]
        for begin in range(0, len(known), self.how.batch):
            at = known[begin : begin + self.how.batch]
            n = block.n[at]
            for i in range(8):
                odds, gate = self.inputs(block, at, i, True)
                error = (1 - 1 / (1 + np.exp(-self.mixed(odds, gate)))) * n
                mass = np.bincount(gate, n, self.gates)
                step = np.stack([np.bincount(gate, error * o, self.gates) for o in odds], axis=1)
                self.weights += self.how.rate * step / np.maximum(mass, 1e-9)[:, None]

    def met(self, block: Block) -> np.ndarray:
        """Counts for the map."""
        out = np.zeros(self.map.shape)
        known = np.flatnonzero(block.n > 0)
        for begin in range(0, len(known), 1 << 16):
            at = known[begin : begin + (1 << 16)]
            for i in range(8):
                one = (block.byte[at] >> (7 - i)) & 1 == 1
                mixed = self.mixed(*self.inputs(block, at, i, True))
                place = np.rint((np.where(one, mixed, -mixed) + 12) / 24 * (self.how.buckets - 1)).astype(np.int64)
                flat = _nodes(block.byte[at], i) * self.how.buckets + place
                for b in (0, 1):
                    out[b] += np.bincount(flat, block.n[at] * (one == b), 256 * self.how.buckets).reshape(256, -1)
        return out


def _on_blocks(blocks: DataFrame, mixer: Mixer, fn, schema: str) -> DataFrame:
    """fn(mixer, Block) -> columns of the block's row."""
    struct = T.StructType.fromDDL(f"block int, {schema}")
    arrow = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = Mixer(mixer.how, mixer.first)
                own.weights, own.map = mixer.weights.copy(), mixer.map
                block = own.block(_windows(row["windows"]), _unpacked(row["counts"], np.int64))
                yield pa.RecordBatch.from_pylist([{"block": row["block"], **fn(own, block)}], arrow)

    return blocks.mapInArrow(run, struct)


def _gathered(blocks: DataFrame, mixer: Mixer, fn) -> tuple[np.ndarray, float]:
    """Sum of fn over the blocks in their order, added a group of blocks at a time, and the training events.

    The rows are staged, as sorting looks at its input twice."""
    def result(own, block):
        return {"values": fn(own, block).ravel().tolist(), "n": float(block.n.sum())}

    rows = staged(_on_blocks(blocks, mixer, result, "values array<double>, n double"))
    sums, total = np.zeros(1), 0.0
    for row in rows.orderBy("block").toLocalIterator():
        sums, total = sums + np.asarray(row["values"]), total + row["n"]
    return sums, total


def _learned(mixer: Mixer, block: Block) -> np.ndarray:
    mixer.learn(block)
    return mixer.weights * block.n.sum()


def counted(packed: DataFrame, how: Mixing) -> tuple[DataFrame, int, int]:
    """(windows with counts by block, number of blocks, number of salts) of staged chunks."""
    chunk_count = packed.count()
    kinds = packed.select(F.explode("noted").alias("w")).distinct().count() * NOTED
    blocks, salts = max(how.least_blocks, -(-kinds // how.block_windows)), max(1, -(-chunk_count // FAN_IN))
    return staged(merged(parts(packed, blocks), salts).repartition(blocks, "block")), blocks, salts


def train(blocks: DataFrame, how: Mixing = Mixing()) -> Mixer:
    """The mixer of counted blocks."""
    mixer = Mixer(how, first_counts(blocks))
    for _ in range(how.rounds):
        sums, total = _gathered(blocks, mixer, _learned)
        if total:
            mixer.weights = (sums / total).reshape(mixer.weights.shape)
    met, total = _gathered(blocks, mixer, lambda own, block: own.met(block))
    if total:
        mixer.map = mixer.map + met.reshape(mixer.map.shape)
    return mixer


def window_scores(packed: DataFrame, blocks: DataFrame, number: int, salts: int, mixer: Mixer) -> DataFrame:
    """(chunk, block, scores): log10 probabilities of the chunk's windows of the block, in the order of the windows."""
    def result(own, block):
        return {"windows": _steps(block.windows), "scores": _planes(own.log10(block).astype(np.float32))}

    scored = staged(_on_blocks(blocks, mixer, result, "windows binary, scores binary")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = parts(packed, number).select(
        "block", F.pmod(F.xxhash64("chunk", F.lit(salts)), F.lit(salts)).cast("int").alias("salt"), "chunk", "windows")
    struct = T.StructType.fromDDL("chunk long, block int, scores binary")
    schema = to_arrow_schema(struct)

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if len(left):
            windows, scores = _windows(right.column("windows")[0].as_py()), _values(right.column("scores")[0].as_py(), np.float32)
            block = right.column("block")[0].as_py()
            for chunk, data in zip(left.column("chunk").to_pylist(), left.column("windows")):
                rows.append({"chunk": chunk, "block": block,
                             "scores": _planes(scores[np.searchsorted(windows, _windows(data.as_py()))])})
        return pa.Table.from_pylist(rows, schema)

    return own.groupBy("block", "salt").cogroup(scored.groupBy("block", "salt")).applyInArrow(look, struct)


class Lookup:
    """Scores by window: a hashed place each, a search for those whose place another window took."""

    def __init__(self, windows: np.ndarray, scores: np.ndarray):
        self.windows, self.scores = windows, scores
        bits = max(1, int(len(windows) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.places = np.zeros(1 << bits, np.int32)
        for begin in range(0, len(windows), PIECE):
            own = windows[begin : begin + PIECE]
            self.places[self.hashed(own)] = np.arange(begin, begin + len(own), dtype=np.int32)

    def hashed(self, windows: np.ndarray) -> np.ndarray:
        return ((windows * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, windows: np.ndarray) -> np.ndarray:
        at = self.places[self.hashed(windows)]
        other = np.flatnonzero(self.windows[at] != windows)
        at[other] = np.searchsorted(self.windows, windows[other])
        return self.scores[at]


def text_scores(texts: list[bytes], windows: np.ndarray, found: Iterable[tuple[int, bytes]], number: int, how: Mixing) -> np.ndarray:
    """Sum of the windows' scores over the events of each text; found has the scores of each block's windows."""
    values, places = np.empty(len(windows), np.float32), _split(windows, number)
    for block, data in found:
        values[places[block]] = _values(data, np.float32)
    del places
    lookup, model = Lookup(windows, values), np.zeros(len(texts))
    for events, text in stream(texts, how.width):
        low = int(text[0]) if len(text) else 0
        sums = np.bincount(text - low, lookup.of(events))
        model[low : low + len(sums)] += sums
    return model


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# --- base model and scores ----------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the documents' words; counted per task before the shuffle."""
    struct = T.StructType.fromDDL("word binary, n long")
    schema = to_arrow_schema(struct)

    def run(batches):
        counts: Counter = Counter()

        def out():
            words = list(counts)
            for i in range(0, len(words), 1 << 17):
                own = words[i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.binary()), pa.array([counts[w] for w in own], pa.int64())], schema=schema)
            counts.clear()

        for batch in batches:
            for _, texts in slices(batch, "text"):
                for t in texts:
                    if t:
                        counts.update(t.lower().split())
                if len(counts) > 1 << 18:
                    yield from out()
        yield from out()

    slim = docs.select(F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, struct).groupBy("word").agg(F.sum("n").alias("c"))


def scores(docs: DataFrame, how: Mixing = Mixing(), held_out=is_held_out) -> DataFrame:
    """Per row: held_out, tokens, known tokens, training tokens, base score and the model's score with its bits per byte."""
    spark = docs.sparkSession
    training = docs.where(~held_out(F.col("doc_id")))
    ends = training.count()
    words = staged(word_counts(training))
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = total + ends, kinds + (ends > 0)
    often = {bytes(r["word"]): r["c"] for r in words.orderBy(F.desc("c"), "word").limit(how.frequent_words).collect()}
    place = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    chunks(docs, held_out, how).write.parquet(place)
    packed = spark.read.schema(CHUNK).parquet(place)
    blocks, number, salts = counted(packed, how)
    mixer = train(blocks, how)
    found = window_scores(packed, blocks, number, salts, mixer)
    words_sent = spark.sparkContext.broadcast({w: math.log10(c + 1) for w, c in often.items()})
    end = math.log10(ends + 1)
    lost = math.log10(total + kinds + 1)
    struct = T.StructType.fromDDL(
        "doc_id long, held_out boolean, n_tokens long, n_often long, often_sum double, rest array<struct<word: binary, k: long>>, "
        "score double, bits_per_byte double")
    schema = to_arrow_schema(struct)

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        known = words_sent.value
        row = left.slice(0, 1).to_pylist()[0]
        lengths, raw = _unpacked(row["lengths"], np.int64), _restored(row.pop("texts"))
        ends_at = np.cumsum(np.maximum(lengths, 0))
        texts = [raw[e - max(0, n) : e] for n, e in zip(lengths.tolist(), ends_at.tolist())]
        del raw
        found_here = zip(right.column("block").to_pylist(), (d.as_py() for d in right.column("scores")))
        model = text_scores(texts, _windows(row.pop("windows")), found_here, number, how)
        sizes, n_tokens, n_often, often_sum, rest, times = [0], [], [], [], [], []
        for t in texts:
            n, s, m = 1, end, 1 if ends else 0
            for w, k in Counter(t.split()).items():
                n += k
                value = known.get(w)
                if value is None:
                    rest.append(w)
                    times.append(k)
                else:
                    s += k * value
                    m += k
            sizes.append(len(rest))
            n_tokens.append(n)
            n_often.append(m)
            often_sum.append(s)
        pairs = pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(times, pa.int64())], names=["word", "k"])
        bits = -model / np.maximum(1, lengths) / math.log10(2)
        columns = [row["doc_ids"], row["held"], n_tokens, n_often, often_sum,
                   pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs), model, bits]
        return pa.Table.from_arrays(
            [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    texts = packed.select("chunk", "doc_ids", "held", "lengths", "texts", "windows")
    rows = texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(judged, struct)
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()))
    _delete(spark, place)  # all that follows needs only the staged rows and words
    rare = rows.select("row", F.inline("rest")).join(words, "word").groupBy("row").agg(
        F.sum("k").alias("n_rare"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("rare_sum"))
    return rows.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_often") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("often_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(lost)).alias("base_score"),
        "score", "bits_per_byte")
