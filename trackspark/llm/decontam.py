"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

An item of n words leaks where a local alignment scores S = 2 n THRESHOLD or more (and
of a short item, that of five words).  An alignment that scores 2 n SURE holds at
least 2 n SURE - n - 1 pairs of neighbouring words that match as neighbours.  So of each
item's n - 1 pairs a share of that number, the most frequent ones in the corpus, can be
left out, and the rare rest are seeds: every passage with enough seed hits within
3 n - S words is aligned.  No passage that could reach SURE is missed; of those between
THRESHOLD and SURE, the ones with fewer neighbouring words than that are.

A benchmark is cut into blocks of bounded bytes; each block is sent to all tasks
and takes two passes over the texts, one that counts in how many documents each pair
occurs and one that seeds and aligns.  Nothing is shuffled but counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, rolling, run_owner, text_column, words

SEED_WORDS = 2
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least alignment score as a share of the item's perfect one.
THRESHOLD = 0.5
#: Score, as such a share, from which no alignment is missed.
SURE = 0.6
#: Share of the pairs that an alignment must hold that are left out of the seeds, the most frequent first.
COMMON_SHARE = 1 / 3
#: Items of fewer words leak nowhere; longer ones than PASSAGE words are compared passage by passage.
LEAST_WORDS, PASSAGE = 3, 256
#: Words that match are at least so many, or the whole item.
LEAST_MATCHES = 5
#: Bytes of items that are sent at once; a longer benchmark is searched block by block.
BLOCK_BYTES = 8 << 20
#: Cells of one row of alignments that are computed together.
CELLS = 1 << 20
#: Entries of the bitmap that rules out most pairs of words before they are looked up.
_BITS = 1 << 22


def least_score(n: int, threshold: float = THRESHOLD) -> int:
    """The score from which an alignment with an item of n words is a leak."""
    return max(int(np.ceil(round(MATCH * n * threshold, 6))), MATCH * min(n, LEAST_MATCHES))


def alignment_scores(items: list[np.ndarray], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair of word sequences, and the place in the part where it first ends."""
    n, m = max(map(len, items)), max(map(len, parts))
    a = np.zeros((len(items), n), np.uint64)
    b = np.ones((len(items), m), np.uint64)  # 0 and 1 stand for no word
    for i, (x, y) in enumerate(zip(items, parts)):
        a[i, : len(x)], b[i, : len(y)] = x | np.uint64(2), y | np.uint64(2)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    row = np.zeros((len(items), m + 1), np.int32)
    steps = np.arange(m + 1, dtype=np.int32) * -GAP
    for i in range(n):
        score = np.where(a[:, i : i + 1] == b, MATCH, MISMATCH).astype(np.int32)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(np.maximum(row[:, :-1] + score, row[:, 1:] + GAP), 0)
        new = np.maximum.accumulate(new + steps, axis=1) - steps  # gaps along the part
        row = new
        top = row.argmax(axis=1)
        value = row[np.arange(len(row)), top]
        better = (value > best) | ((value == best) & (top < end))
        best[better], end[better] = value[better], top[better]
    return best, end


class Items:
    """A bounded block of benchmark items: the words of their passages, and their pairs of words with their places."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float = THRESHOLD):
        hashes, _, _, first = words(text_column(pa.array(texts, pa.string())), fold=True, marks=True)
        self.ids: list = []
        self.words: list[np.ndarray] = []
        for key, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist()):
            if b - a >= LEAST_WORDS:
                for part in np.array_split(hashes[a:b, 0], -(-(b - a) // PASSAGE)):
                    self.ids.append(key)
                    self.words.append(part)
        size = np.array([len(w) for w in self.words], np.int64)
        self.least = np.array([least_score(n, threshold) for n in size.tolist()], np.int64)
        sure = np.maximum(self.least, np.ceil(np.round(MATCH * size * SURE, 6))).astype(np.int64)
        must = np.maximum(1, sure - size - 1)
        self.left_out = np.floor(must * COMMON_SHARE).astype(np.int64)
        self.need = must - self.left_out
        self.span = 3 * size - self.least
        bounds = np.cumsum([0, *size.tolist()])
        start, owner = run_owner(bounds, SEED_WORDS)
        self.grams = rolling(np.concatenate([*self.words, np.zeros(0, np.uint64)]), SEED_WORDS)[start] if len(start) else np.zeros(0, np.uint64)
        self.item, self.place = owner, start - bounds[owner]
        self.kinds = np.unique(self.grams)

    def seeds(self, counts: np.ndarray) -> None:
        """Leave out of each passage its most frequent pairs, ties by their place; counts go with kinds."""
        count = counts[np.searchsorted(self.kinds, self.grams)]
        order = np.lexsort((self.place, -count, self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[rank >= self.left_out[item]]
        pairs = np.unique(np.column_stack([self.grams[kept], self.item[kept].astype(np.uint64)]), axis=0)  # once, wherever it stands
        self.seed, self.seed_item = pairs[:, 0].copy(), pairs[:, 1].astype(np.int64)
        self.known = np.zeros(_BITS, bool)
        self.known[self.seed & np.uint64(_BITS - 1)] = True

    def regions(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text, passage and word range of all parts of the texts with enough seed hits, long parts in overlapping pieces."""
        start, owner = run_owner(first, SEED_WORDS)
        if not len(start) or not len(self.seed):
            return
        grams = rolling(hashes, SEED_WORDS)[start]
        maybe = np.flatnonzero(self.known[grams & np.uint64(_BITS - 1)])
        lo, hi = np.searchsorted(self.seed, grams[maybe]), np.searchsorted(self.seed, grams[maybe], "right")
        n = hi - lo
        which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text, item, at = np.repeat(owner[maybe], n), self.seed_item[which], np.repeat(start[maybe], n)
        order = np.lexsort((at, item, text))
        text, item, at = text[order], item[order], at[order]
        # the hit from which on there are enough, if they are of one text and passage and near enough
        last = np.arange(len(at)) + self.need[item] - 1
        inside = np.flatnonzero(last < len(at))
        last = last[inside]
        good = (text[last] == text[inside]) & (item[last] == item[inside]) & (at[last] - at[inside] <= self.span[item[inside]] - SEED_WORDS)
        inside, last = inside[good], last[good]
        if not len(inside):
            return
        text, item = text[inside], item[inside]
        begin = np.maximum(first[:-1][text], at[last] + SEED_WORDS - self.span[item])
        end = np.minimum(first[1:][text], at[inside] + self.span[item])
        fresh = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])])
        a = np.flatnonzero(fresh)
        b = np.concatenate([a[1:], [len(fresh)]]) - 1
        for t, i, x, y in zip(text[a].tolist(), item[a].tolist(), begin[a].tolist(), end[b].tolist()):
            span = int(self.span[i])
            while y - x > 4 * span:
                yield t, i, x, x + 4 * span
                x += 3 * span
            yield t, i, x, y

    def find(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """Text, passage, score and word range of every part of the texts that aligns well enough, the best of each text and item, the first of equals."""
        regions = sorted(self.regions(hashes, first), key=lambda r: (len(self.words[r[1]]), r[3] - r[2]))
        best: dict[tuple[int, object], tuple[float, int, int, int]] = {}
        k = 0
        while k < len(regions):
            n = 1
            while k + n < len(regions) and (n + 1) * (regions[k + n][3] - regions[k + n][2]) <= CELLS and n < 4096:
                n += 1
            group = regions[k : k + n]
            k += n
            score, end = alignment_scores([self.words[i] for _, i, _, _ in group], [hashes[x:y] for _, _, x, y in group])
            for (t, i, x, _), s, e in zip(group, score.tolist(), end.tolist()):
                if s >= self.least[i]:
                    size = len(self.words[i])
                    stop = int(x + e - first[t])
                    mine = (-s / (MATCH * size), stop, max(0, stop - size), i)
                    at = (t, self.ids[i])
                    best[at] = min(best.get(at, mine), mine)
        for (t, _), (share, stop, begin, i) in sorted(best.items(), key=lambda x: (x[0][0], x[1][3])):
            yield t, i, -share, begin, stop


LEAKS = "doc_id long, version long, item_id long, score double, first_word long, end_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and benchmark item that it holds a copy of, edited or not: score from threshold to 1 and the word range.

    Words are runs of letters and digits, whatever their case.  version is a hash of the
    text, so that rows that repeat an id are told apart.  The range ends where the
    best alignment ends and is as long as the item; of equal scores the first counts.
    Null texts and items, and items of fewer than LEAST_WORDS words, leak nowhere; an
    item of more than PASSAGE words leaks where one of its even passages does.
    Repeated rows of documents give repeated rows; an id that several items share
    gives one row for each document, that of the best.
    """
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).cast("string").alias("text"))
    bench = benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text IS NOT NULL")
    total = bench.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0  # type: ignore[index]
    parts = max(1, -(-total // block_bytes))
    found = []
    for part in range(parts):
        rows = bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).distinct().collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        found.append(_block(base, Items([r["item_id"] for r in rows], [r["text"] for r in rows], threshold)))
    return reduce(DataFrame.unionAll, found)


def _block(base: DataFrame, items: Items) -> DataFrame:
    spark = base.sparkSession
    kinds = spark.sparkContext.broadcast(items.kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kinds.value
        bits = np.zeros(_BITS, bool)
        bits[known & np.uint64(_BITS - 1)] = True
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for part in chunks(batch):
                hashes, _, _, first = words(text_column(part.column("text")), fold=True, marks=True)
                start, owner = run_owner(first, SEED_WORDS)
                if not len(start) or not len(known):
                    continue
                grams = rolling(hashes[:, 0], SEED_WORDS)[start]
                maybe = np.flatnonzero(bits[grams & np.uint64(_BITS - 1)])
                at = np.minimum(np.searchsorted(known, grams[maybe]), len(known) - 1)
                hit = known[at] == grams[maybe]
                pairs = np.unique(owner[maybe][hit] * len(known) + at[hit])  # a document counts once
                total += np.bincount(pairs % len(known), minlength=len(known))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["gram", "n"])

    counts = np.zeros(len(items.kinds), np.int64)
    for row in base.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # a row for each pair of the block at most
        counts[row["gram"]] = row["n"]
    items.seeds(counts)
    send = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = send.value
        for batch in batches:
            for part in chunks(batch):
                hashes, _, _, first = words(text_column(part.column("text")), fold=True, marks=True)
                got = list(known.find(np.ascontiguousarray(hashes[:, 0]), first))
                if got:
                    text, item, score, begin, end = zip(*got)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text)), part.column("version").take(pa.array(text)), pa.array([known.ids[i] for i in item], pa.int64()), pa.array(score, pa.float64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=[c.split()[0] for c in LEAKS.split(", ")])

    return base.mapInArrow(run, LEAKS)
