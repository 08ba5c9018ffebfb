"""Vectorised helpers that the text operators share: Arrow batches in, numpy arrays out.

Everything works on bounded slices of a batch (`slices`), so that a worker's memory depends on
`SLICE_BYTES` and on the longest single text, never on the number of rows in a partition.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sphera.operators import lineage

__all__ = ["as_long", "collect_garbage", "cut_lineage", "fresh", "hash_sums", "id_crc", "mix", "range_hash", "shingles", "slices", "table", "text_bytes", "words"]

SLICE_BYTES = 1 << 20

U64 = np.uint64
_MIX_A, _MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def collect_garbage(spark: SparkSession) -> None:
    """What the driver no longer holds keeps its shuffle files and checkpoints on disk until it collects its garbage; what went just before goes with the second collection only."""
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.3)  # for the thread that deletes


def cut_lineage(df: DataFrame) -> DataFrame:
    """lineage.cut_lineage; first the driver collects its garbage."""
    collect_garbage(df.sparkSession)
    return lineage.cut_lineage(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words, so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x *= _MIX_A
    x ^= x >> U64(27)
    x *= _MIX_B
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, U64)
        have[1:] = U64(base)
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of about `limit` text bytes (a longer text stands alone) with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def hash_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which `range_hash` gets the hash of any byte range."""
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUE[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end); equal bytes give equal hashes wherever they stand."""
    raw = (sums[end] - sums[start]) * powers(_BASE_INV, len(sums))[start]
    return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D: their starts, ends, hashes and first word index of each row (n+1)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U64), np.zeros(len(offsets), np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~_WHITE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    hashes = range_hash(hash_sums(data), start, end)
    return start, end, hashes, np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles (a shorter row with words: its whole sequence as one) and each one's row."""
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    total = np.zeros(len(hashes), U64)
    for i in range(k):
        part = mix(hashes + U64((0xA24BAED4963EE407 * (i + 1)) & (2**64 - 1)))
        total[: len(hashes) - i] += part[i:]
    at = np.arange(len(hashes)) - first[:-1][row]
    ok = at + k <= count[row]
    short = np.flatnonzero((count > 0) & (count < k))
    if not len(short):
        return mix(total[ok]), row[ok]
    extra = np.zeros(len(short), U64)
    for i in range(k - 1):
        has = count[short] > i
        extra[has] += mix(hashes[first[short[has]] + i] + U64((0xA24BAED4963EE407 * (i + 1)) & (2**64 - 1)))
    extra = mix(extra ^ (count[short].astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
    rows = np.concatenate([row[ok], short])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([mix(total[ok]), extra])[order], rows[order]


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def id_crc(doc_id: Column | str) -> Column:
    """crc32 of the id as decimal text."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"))


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
