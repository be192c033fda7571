"""What the operators share: tables, the shared work folder, and hashing of words straight from Arrow buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import small, work_dir
from ..sources.shared import written as kept

__all__ = [
    "PUNCTUATED",
    "WORD",
    "crc_mod",
    "kept",
    "mix",
    "partitions",
    "row_of",
    "sliced",
    "small",
    "table",
    "tidy",
    "text_buffer",
    "word_hashes",
    "word_spans",
    "work_dir",
]

#: Words of the contracts: what lies between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """run, for mapInArrow; what a task has freed goes back to the system when it ends, as Python workers live on between tasks."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
            if trim:
                trim(0)

    return tidied


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % n, F.lit(0))


# ---------------------------------------------------------------- words as 64-bit hashes

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C13)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII other than digits and letters.
PUNCTUATED = np.zeros(256, bool)
PUNCTUATED[:128] = True
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    PUNCTUATED[_c] = False
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_STEP, _BACK)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row; a null is empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, offsets, data = arr.buffers()
    if offsets is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def sliced(batch: pa.RecordBatch, text: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of the text column of that place, or of one row: memory follows neither the rows of a
    batch nor their lengths."""
    ends = np.cumsum(np.diff(text_buffer(batch.column(text))[1]) + 1)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the index of its first word (one more entry than rows)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~breaks[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    cuts = offs[:-1]
    before[cuts[cuts < n]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[cuts[(cuts > 0)] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z as a-z if lower) and the index of each row's first word.

    Rows are hashed in slices of about 1 MB, so memory does not follow the batch.
    """
    out, firsts, done, i = [], [np.zeros(1, np.int64)], 0, 0
    values = _BYTE_LOWER if lower else _BYTE
    while i < len(offs) - 1:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + 1_000_000, "right")) - 1)
        part, own = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, first = word_spans(part, own)
        if len(starts):
            up, down = _power_tables(len(part) + 1)
            total = np.empty(len(part) + 1, np.uint64)
            total[0] = 0
            np.cumsum(values[part] * up[: len(part)], out=total[1:])
            out.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        firsts.append(first[1:] + done)
        done += len(starts)
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(firsts)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
