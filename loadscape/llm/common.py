"""Helpers shared by the text operators: words, word hashes, and tables kept in the shared folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session may leave it unset and gets a new local one; a cluster may not."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lost executors cost a reread, not a rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def giving_back(run: Callable) -> Callable:
    """run, for mapInArrow: at a task's end its worker, which serves others, gives back what run has freed."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_BASES = (_BASE, np.uint64(0xD1B54A32D192ED03))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
#: Longer words are hashed whole, as polynomials over many bytes have structured collisions.
_LONG_WORD = 256


def _powers(which: int, up: bool, n: int) -> np.ndarray:
    have = _POWERS.get((which, up), ())
    if len(have) < n:
        have = np.full(1 << max(10, (n - 1).bit_length()), (_BASES if up else _INVERSES)[which], np.uint64)
        have[0] = 1
        _POWERS[which, up] = have = np.multiply.accumulate(have)
    return have[:n]


def _word_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([True], _SEPARATOR[raw], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _hashes_of(data: bytes, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(which, True, len(raw)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _powers(which, False, len(raw))[starts]
    value = mix(value ^ mix((ends - starts + (which << 40)).astype(np.uint64)))
    for i in np.flatnonzero(ends - starts > _LONG_WORD).tolist():
        value[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], which)
    return value


def word_hashes(data: bytes, which: int = 0) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 text: a polynomial over the bytes of each, mixed with its length; which: one of two functions."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends = _word_edges(raw)
    return _hashes_of(data, raw, starts, ends, which) if len(starts) else np.zeros(0, np.uint64)


def word_hash_pair(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of every word: 128 bits that do not depend on each other."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends = _word_edges(raw)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _hashes_of(data, raw, starts, ends, 0), _hashes_of(data, raw, starts, ends, 1)


def run_hashes(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hashes of all runs of k words, from the words' hashes; base (odd) selects the function."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b, out, done = np.uint64(base), None, 0
    block, size = words, 1  # block: hashes of runs of `size` words, doubled while it fits
    while True:
        if k & size:
            part = block[done : done + n]
            out = part if out is None else out * _power(b, size) + part
            done += size
        if size * 2 > k:
            return mix(out)
        block = block[:-size] * _power(b, size) + block[size:]
        size *= 2


def _power(b: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(b), n, 1 << 64))


def lowered(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else."""
    return text.encode().translate(_LOWER)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_starts_and_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 text start, and their hashes."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends = _word_edges(raw)
    return starts, _hashes_of(data, raw, starts, ends, 0) if len(starts) else np.zeros(0, np.uint64)
