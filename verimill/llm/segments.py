"""Segments: documents packed into rows of a few megabytes, so that array code works on many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Bytes of text in a segment, unless one document has more.
SEGMENT_BYTES = 2_000_000
SCHEMA = pa.schema([("seg", pa.int64()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("data", pa.binary())])
SQL = "seg long, ids array<long>, ends array<long>, data binary"


@dataclass
class Segment:
    """data: the bytes of all texts in turn; text i ends at ends[i]."""

    seg: int
    ids: list
    ends: np.ndarray
    data: bytes

    @property
    def starts(self) -> np.ndarray:
        return np.r_[0, self.ends[:-1]].astype(np.int64)


def pack(seg: int, ids: list, texts: list[bytes]) -> tuple:
    import zstandard

    return seg, ids, np.cumsum([len(x) for x in texts]).tolist(), zstandard.compress(b"".join(texts), 3)


def unpack(batch: pa.RecordBatch) -> Iterator[Segment]:
    """Segments of a batch that has the columns of SQL, one at a time."""
    import zstandard

    at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    for i in range(batch.num_rows):
        yield Segment(at["seg"][i].as_py(), at["ids"][i].as_py(), np.asarray(at["ends"][i].as_py(), dtype=np.int64), zstandard.decompress(at["data"][i].as_py()))


def segments(docs: DataFrame, most: int = SEGMENT_BYTES, first: int = 0) -> DataFrame:
    """Rows of SQL: each partition's documents (doc_id, text) in their order, a null text as an empty one.

    A segment's number is `first`, its partition's, times 2^24, and its place there; rows that follow each other with one doc_id, which isn't
    null, stay together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seg = first + (TaskContext.get().partitionId() << 24)
        ids, texts, n = [], [], 0
        for batch in batches:
            for piece in slices(batch, "text", most):
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    data = (text or "").encode()
                    if ids and n + len(data) > most and (doc_id is None or doc_id != ids[-1]):
                        yield one(pack(seg, ids, texts))
                        seg, ids, texts, n = seg + 1, [], [], 0
                    ids.append(doc_id)
                    texts.append(data)
                    n += len(data)
        if ids:
            yield one(pack(seg, ids, texts))

    return docs.select("doc_id", "text").mapInArrow(run, SQL)


def one(row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, SCHEMA, strict=True)], schema=SCHEMA)


#: Odd multipliers and seeds of the rolling hashes.
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1 modulo 2^64, and their inverses; kept by the worker."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(size, np.uint64(base & 0xFFFFFFFFFFFFFFFF))
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit values, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[j] * BASE^j over j < i, for i from 0; (s[b] - s[a]) * BASE^-a is a hash of values[a:b]."""
    up, _ = powers(len(values))
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * up, out=out[1:])
    return out


def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, dtype=np.uint64)
