"""Words, hashes of words and rolling hashes of word windows, for whole texts in bounded batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.session import shared_dir

#: Bytes of text that a task holds as arrays at once; one text may be longer and then stands alone.
SLICE_BYTES = 4 << 20
#: Entries of either generation of a worker's memory.
MEMORY = 1 << 17
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Remembering(dict):
    """Values computed once while they are remembered. Two bounded generations: what the older one still serves moves on,
    the rest is forgotten when the newer one is full. Long keys are not kept."""

    def __init__(self, make: Callable, most: int = MEMORY):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = self.copy()
                self.clear()
            self[key] = value
        return value


class WordHashes(Remembering):
    """64-bit hash of each word (bytes)."""

    def __init__(self):
        super().__init__(xxhash.xxh3_64_intdigest)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Windows:
    """Rolling hashes over one array of word hashes: every window of n words in O(1) from one running sum."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
        if n:
            up[0] = down[0] = 1
        self.up, self.sums = np.cumprod(up, dtype=np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * np.cumprod(down, dtype=np.uint64), dtype=np.uint64, out=self.sums[1:])

    def of(self, n: int) -> np.ndarray:
        """Scrambled hash of the window of n words that starts at each place."""
        m = max(0, len(self.up) - n + 1)
        return mix((self.sums[n : n + m] - self.sums[:m]) * self.up[:m] + np.uint64(n))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts, one after the other; null counts as empty."""

    def __init__(self, texts: list[bytes | None], hashes: WordHashes | None = None):
        self.lists = [t.split() if t else [] for t in texts]
        self.counts = np.fromiter(map(len, self.lists), np.int64, len(texts))
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.flat = [w for ws in self.lists for w in ws]
        if hashes is not None:
            self.hashes = np.fromiter(map(hashes.__getitem__, self.flat), np.uint64, len(self.flat))
            self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def inside(self, n: int) -> np.ndarray:
        """Whether the window of n words that starts at each place stays inside its text."""
        m = max(0, len(self.doc) - n + 1)
        return self.doc[:m] == self.doc[len(self.doc) - m :]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Runs of rows whose texts together have at most so many bytes (or one row), with the texts as bytes."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    if not pa.types.is_binary(texts.type) and not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64))
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at).to_pylist()
        at = to


def per_text(df: DataFrame, text: str | Column, keep: dict[str, Column], fn: Callable, schema: str,
             slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Apply fn(rows, texts) -> iterable of column dicts to slices of rows in Arrow, without a shuffle.

    rows has the columns of keep; texts are the whole texts as bytes (None: null). Other columns never reach Python."""
    column = df[text] if isinstance(text, str) else text
    slim = df.select(*[c.alias(name) for name, c in keep.items()], column.cast("binary").alias("__text"))
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in batches:
            for rows, texts in slices(batch, "__text", slice_bytes):
                for out in work(rows, texts):
                    yield pa.RecordBatch.from_arrays(
                        [_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return slim.mapInArrow(run, struct)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def staged(df: DataFrame) -> DataFrame:
    """The rows written as Parquet below the shared folder and read again: later passes read only the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the table does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
