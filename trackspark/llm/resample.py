"""Importance resampling towards a target: hashed n-gram weights, and the exact top draw from sorted runs merged by tournament trees."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _FOLD, MARKS, chunks, materialize, text_bytes, text_column

BUCKETS = 10_000
#: Rows of a sorted run, and of a range of scores that one task merges (more only where a single score has more).
RUN_ROWS = 1 << 20
RANGE_ROWS = 1 << 17
#: Words of up to so many bytes are hashed in columns, longer ones one by one.
_LONG = 64


def _byte_table() -> np.ndarray:
    """What the register of CRC-32 becomes for each value of its low byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1)
    return c


def _next(state: np.ndarray, byte: np.ndarray | np.uint8 | int) -> np.ndarray:
    return _BYTE[(state ^ byte) & 255] ^ (state >> np.uint32(8))


def _zero_tables() -> np.ndarray:
    """For each length, what that many zero bytes make of each byte of the register: [length, byte's place, byte]."""
    out = np.empty((_LONG + 1, 4, 256), np.uint32)
    out[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for n in range(_LONG):
        out[n + 1] = _next(out[n], 0)
    return out


_BYTE = _byte_table()
_ZEROS = _zero_tables()


def _past(state: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The register after sizes zero bytes; CRC-32 is linear, so this and the word's own register add up to the whole."""
    a, b, c, d = ((state >> np.uint32(8 * k)) & 255 for k in range(4))
    return _ZEROS[sizes, 0, a] ^ _ZEROS[sizes, 1, b] ^ _ZEROS[sizes, 2, c] ^ _ZEROS[sizes, 3, d]


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with A-Z in lower case, begin and end of each word (ASCII letters and digits, all beyond ASCII), and each text's first word."""
    raw, at = text_bytes(texts)
    raw = _FOLD[raw]
    inside = ~MARKS[raw]
    joins = np.zeros(len(raw) + 1, bool)
    joins[1:-1] = inside[:-1]  # whether the byte before belongs to the same word
    joins[at] = False
    starts = np.flatnonzero(inside & ~joins[:-1])
    follows = np.append(inside[1:], False)
    follows[at[1:][at[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~follows) + 1
    return raw, starts, ends, np.searchsorted(starts, at)


def feature_buckets(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word, and of each word with the next (of any text); CRC-32 of UTF-8 bytes modulo BUCKETS."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
    order = order[np.searchsorted(-size[order], -_LONG) :] if len(order) else order  # without the long ones
    sorted_sizes, own = -size[order], np.zeros(len(order), np.uint32)
    for j in range(int(size[order[0]]) if len(order) else 0):
        n = int(np.searchsorted(sorted_sizes, -j))  # words of more than j bytes
        own[:n] = _next(own[:n], raw[starts[order[:n]] + j])
    state = np.zeros(len(size), np.uint32)
    state[order] = own
    short = np.minimum(size, _LONG)
    full = np.uint32(0xFFFFFFFF)
    whole = state ^ _past(np.full(len(size), full), short)
    long = np.flatnonzero(size > _LONG)
    for i in long.tolist():
        whole[i] = full ^ np.uint32(zlib.crc32(raw[starts[i] : ends[i]].tobytes()))
    pairs = _past(_next(whole[:-1], 0x20), short[1:]) ^ state[1:]
    for i in long[long > 0].tolist():
        pairs[i - 1] = full ^ np.uint32(zlib.crc32(raw[starts[i] : ends[i]].tobytes(), int(full ^ _next(whole[i - 1 : i], 0x20)[0])))
    return ((whole ^ full) % np.uint32(BUCKETS)).astype(np.int64), ((pairs ^ full) % np.uint32(BUCKETS)).astype(np.int64)


def _inner_pairs(first: np.ndarray, n: int) -> np.ndarray:
    """Which of the n - 1 pairs of neighbours lie in one text."""
    inside = np.ones(max(0, n - 1), bool)
    cuts = first[(first > 0) & (first < n)] - 1
    inside[cuts] = False
    return inside


def bucket_counts(df: DataFrame) -> np.ndarray:
    """Features of all texts in each bucket; what leaves a task are at most BUCKETS sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for chunk in chunks(batch):
                raw, starts, ends, first = word_spans(text_column(chunk.column("text")))
                ones, twos = feature_buckets(raw, starts, ends)
                total += np.bincount(ones, minlength=BUCKETS) + np.bincount(twos[_inner_pairs(first, len(ones))], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in df.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's thousandfold log ratio of target to source, smoothed by one in each bucket, floored."""
    all_s, all_t = int(source.sum()), int(target.sum())
    ratio = ((t + 1) * float(all_s + BUCKETS) / ((s + 1) * float(all_t + BUCKETS)) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandfold Gumbel noise of an id, from the first 32 bits of a digest; a null id is an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def score(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row; the array of gains is all that a task needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                raw, starts, ends, first = word_spans(text_column(chunk.column("text")))
                ones, twos = feature_buckets(raw, starts, ends)
                value = gain[ones]
                value[1:] += np.where(_inner_pairs(first, len(ones)), gain[twos], 0)  # a pair counts with its second word
                sums = np.diff(np.append(0, np.cumsum(value))[first])
                words = np.diff(first)
                features = words + np.maximum(0, words - 1)
                weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
                ids = chunk.column("doc_id")
                total = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.record_batch([ids, *(pa.array(c, pa.int64()) for c in (words, features, weight, total))], [c.split()[0] for c in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def tournament(runs: list[list]) -> Iterator[int]:
    """Numbers of the runs from which the items of all sorted runs come in their order; ties go to the run of the smaller number.

    A tree of losers: after the winner's next item enters, only the matches on its path
    are played again.  An item is a tuple; equal items of one run keep their order.
    """
    over = (math.inf,)
    leaves = 1 << max(0, len(runs) - 1).bit_length()
    heads = [(*r[0], i) if r else over for i, r in enumerate(runs)] + [over] * (leaves - len(runs))
    at, losers, winners = [0] * len(runs), [0] * leaves, [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        a, b = winners[2 * node : 2 * node + 2]
        winners[node], losers[node] = (a, b) if heads[a] <= heads[b] else (b, a)
    best = winners[1] if leaves > 1 else 0
    while runs and heads[best] is not over:
        yield best
        at[best] += 1
        heads[best] = (*runs[best][at[best]], best) if at[best] < len(runs[best]) else over
        node = (leaves + best) // 2
        while node:
            if heads[losers[node]] < heads[best]:
                losers[node], best = best, losers[node]
            node //= 2


_PARTS = ("doc_id", "n_features", "weight", "score")


def sorted_runs(scored: DataFrame, lows: list[int], rows: int = RUN_ROWS) -> DataFrame:
    """Runs of at most rows rows, each sorted by falling score and rising id (nulls first) and cut at the ranges' lower ends (falling)."""
    edges = -np.array(lows, np.int64)

    def cut(table: pa.Table) -> Iterator[pa.RecordBatch]:
        held = table.sort_by([("score", "descending"), ("known", "ascending"), ("doc_id", "ascending")])
        columns = [held.column(c).combine_chunks() for c in _PARTS]
        place = np.searchsorted(edges, -columns[3].to_numpy(), "left")
        used, begin = np.unique(place, return_index=True)
        offsets = pa.array(np.append(begin, len(place)), pa.int32())
        yield pa.record_batch([pa.array(used, pa.int32()), *(pa.ListArray.from_arrays(offsets, c) for c in columns)], ["part", *_PARTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield from cut(pa.Table.from_batches(held))
                held = []
        if sum(b.num_rows for b in held):
            yield from cut(pa.Table.from_batches(held))

    return scored.select(*_PARTS, F.col("doc_id").isNotNull().cast("int").alias("known")).mapInArrow(run, "part int, doc_id array<long>, n_features array<long>, weight array<long>, score array<long>")


RESULT = "doc_id long, n_features long, weight long, score long, rank long"


def _merger(ranges: list[tuple[int, int, int]]) -> Callable[[pa.Table], pa.Table]:
    """Merges a range's pieces of runs; ranks begin after the rows above it and end with its share of the draw."""

    def merge(pieces: pa.Table) -> pa.Table:
        _, above, take = ranges[pieces.column("part")[0].as_py()]
        lists = {c: pieces.column(c).to_pylist() for c in _PARTS}
        runs = [[(-s, i is not None, i or 0) for s, i in zip(scores, ids)] for scores, ids in zip(lists["score"], lists["doc_id"])]
        at = [0] * len(runs)
        rows: list[tuple] = []
        for run in tournament(runs):
            if len(rows) == take:
                break
            rows.append((*(lists[c][run][at[run]] for c in _PARTS), above + len(rows) + 1))
            at[run] += 1
        for run, done in enumerate(at):  # what the draw leaves
            rows += [(*values, None) for values in zip(*(lists[c][run][done:] for c in _PARTS))]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], [*_PARTS, "rank"])

    return merge


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs; rank counts the drawn percent of those with least_words words, else null.

    Words are ASCII letters and digits (A-Z in lower case) and all characters beyond
    ASCII; features are words and pairs of neighbours, hashed to BUCKETS counts of docs
    and of target.  A row's score is the floored mean gain of its features and noise of
    its id, so the highest scores are a draw without replacement (Gumbel top-k) towards
    target's distribution (data selection by importance resampling).

    The scores are written, and counted by value: scores are whole numbers within about
    -40,000 to 60,000 whatever the corpus, so that table is bounded.  From it follow the
    ranges of range_rows rows that hold the draw, each with its exact share.  Each task
    sorts its rows in runs cut at the ranges, and each range's pieces are merged by a
    tournament tree that stops after its share.  No task holds more than a run or a
    range, unless one score alone has more rows.

    Nulls: a null text has no features, weight 0; a null id is noised as an empty one and
    comes before others in ties.  Repeated rows are drawn each for itself, in any order
    among equals.  Empty tables: no documents give no rows; without target all buckets
    count as smoothed.  Other columns are ignored, whatever their names.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must be from 0 to 100")
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = materialize(score(docs, gain, seed), "scored")
    able = F.col("n_words") >= least_words
    counts = scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the range of scores
    draw, above, n, ranges = sum(r["n"] for r in counts) * percent // 100, 0, 0, []
    for r in sorted(counts, key=lambda r: -r["score"]):
        n += r["n"]
        if above < draw and (n >= range_rows or above + n >= draw):
            ranges.append((r["score"], above, min(n, draw - above)))
            above, n = above + n, 0
    plain = scored.select(*_PARTS, F.lit(None).cast("long").alias("rank"), able.alias("able"))
    if not ranges:
        return plain.drop("able")
    held = F.col("able") & (F.col("score") >= ranges[-1][0])
    runs = sorted_runs(scored.filter(able & (F.col("score") >= ranges[-1][0])), [r[0] for r in ranges])
    return plain.filter(~held).drop("able").unionAll(runs.groupBy("part").applyInArrow(_merger(ranges), RESULT))
