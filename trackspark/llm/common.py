"""Shared pieces: durable intermediate tables, size-checked joins, word hashing on Arrow buffers."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side of a join up to which it may be broadcast, and those of a row of an id and a few numbers.
BROADCAST_BYTES = 64_000_000
ROW_BYTES = 64
#: Text bytes that one vectorised step works on; a longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    made = f"{base.rstrip('/')}/trackspark-{uuid.uuid4().hex}"
    _made.append(made)
    return made


#: Folders of this process that have not been deleted, and the folder of each frame that materialize has returned.
_made: list[str] = []
_folder_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    df.write.parquet(f"{folder}/{name}")
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    _folder_of[out] = folder
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # type: ignore[union-attr]
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made.remove(folder)


def discard(*frames: DataFrame) -> None:
    """Delete what materialize has written for frames from which everything has been computed."""
    for df in frames:
        if (folder := _folder_of.pop(df, None)) in _made:
            _delete(df.sparkSession, folder)


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; call it once results are written."""
    for folder in list(_made):
        _delete(spark, folder)


def narrow(df: DataFrame, rows: int | None = None, width: Column | int = ROW_BYTES) -> DataFrame:
    """df marked for broadcast if its rows, width bytes each, have at most BROADCAST_BYTES; else unmarked (a shuffle join)."""
    if isinstance(width, int):
        size = (df.count() if rows is None else rows) * width
    else:
        size = df.agg(F.sum(width.cast("long"))).first()[0] or 0  # type: ignore[index]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as make it differ from all columns, in either case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_column(column: pa.Array) -> pa.Array:
    """Strings with nulls as empty texts, in one array with its offset removed."""
    return column.cast(pa.large_string()).fill_null("")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each (one more than texts)."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch of at most size text bytes each (one document at least)."""
    if not batch.num_rows:
        return
    pa.set_memory_pool(pa.system_memory_pool())  # gives freed buffers back, unlike the default one
    _, at = text_bytes(text_column(batch.column(text)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that separate words when marks are no part of them: all of ASCII but letters and digits.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes that fit two numbers beside their count; longer words are digested.
_SHORT = 15


def words(texts: pa.Array, fold: bool, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts: two columns of 64-bit digests, first byte and end of each, and each text's first word.

    A word of up to 15 bytes is a pair of numbers itself, a longer one BLAKE2b's digest;
    both are mixed, so no structure of a text makes different words equal.
    fold lower-cases A-Z.  marks makes ASCII marks separators too and folds Latin-1
    capitals as well.
    """
    raw, at = text_bytes(texts)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros((0, 2), np.uint64), none, none, np.zeros(len(at), np.int64)
    if marks:
        raw = raw.copy()
        capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        raw[1:][capital] += 0x20
    space = (MARKS if marks else SPACE)[raw]
    full = at[:-1] < at[1:]
    before = np.empty(len(raw), bool)
    before[0], before[1:] = True, space[:-1]
    before[at[:-1][full]] = True
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = True, space[1:]
    after[at[1:][full] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    first = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros((0, 2), np.uint64), starts, ends, first
    if fold:
        raw = _FOLD[raw]
    size = ends - starts
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(padded) - 7, np.uint64, padded, strides=(1,))  # the eight bytes from each byte on
    low = eight[starts] & _FIRST[np.minimum(size, 8)]
    high = eight[starts + 8] & _FIRST[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    for i in np.flatnonzero(size > _SHORT).tolist():
        low[i], high[i] = np.frombuffer(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), np.uint64)
    return np.column_stack([_joined(low, high), _joined(high ^ _GOLDEN, low)]), starts, ends, first


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order, elementwise; a bijection of either while the other is fixed."""
    return mix(mix(a + _GOLDEN) ^ b)


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size consecutive elements; callers drop runs that cross texts.

    Runs are hashed as binary trees, by doubling, so that no algebra relates the hashes
    of different runs as it would with polynomials.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, length, done, out = np.ascontiguousarray(hashes), 1, 0, np.full(n, size, np.uint64)
    while True:
        if size & length:
            out = _joined(out, run[done : done + n])
            done += length
        if 2 * length > size:
            return out
        run = _joined(run[:-length], run[length:])
        length *= 2


def run_owner(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts whose words begin at first: the word at which each whole run of size words starts, and its text."""
    n = np.maximum(0, np.diff(first) - size + 1)
    owner = np.repeat(np.arange(len(n)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[:-1][owner]
    return start, owner


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Limit the session's Arrow batches to rows, for an application whose rows hold whole texts; operators leave the session alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
