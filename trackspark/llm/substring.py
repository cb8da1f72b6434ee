"""Exact repeated passages by fixed-block anchors.

A passage of 2 * BLOCK words or more that two texts share holds, in either text,
a whole block that starts at a multiple of BLOCK.  So the non-overlapping blocks
of all texts are the index and every rolling window of BLOCK words is a probe; a
block that a probe of another text hits is an anchor.  Around anchors, windows of
the asked length are compared over all texts, which extends hits to the maximal
exact repeats without forming pairs of documents.

Probes are most of the traffic, so each task sends its distinct ones as sorted,
delta-coded, compressed arrays, one for each hash shard.  Shards grow in number
with the text; a task deals to FAN of them at most, and beyond that to groups of
shards, which are dealt on level by level, so that rows stay large.  A task sends a
key once however many of its documents hold it, so neither a hot passage nor a
large group of copies fills a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, narrow, rolling, run_owner, text_column, words

WINDOW = 50
#: Text bytes for each hash shard; what one shard's task holds is in proportion.
SHARD_BYTES = 6_000_000
#: Windows around anchors for each shard that they are compared in.
SHARD_WINDOWS = 800_000
#: Windows that a task collects before it sends them.
HELD = 1_000_000
#: Shards that a task sends to at most; more are reached by way of groups of shards, level by level.
FAN = 4096


def squeeze(*arrays: np.ndarray) -> bytes:
    """64-bit arrays as one compressed string, byte plane by byte plane."""
    head = np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays), 1)


def expand(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    sizes = raw[8 : 8 + 8 * n].view(np.int64)
    at, out = 8 + 8 * n, []
    for size in sizes.tolist():
        out.append(np.ascontiguousarray(raw[at : at + 8 * size].reshape(8, size).T).view(np.uint64).ravel() if size else np.zeros(0, np.uint64))
        at += 8 * size
    return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys & np.uint64(0xFFFFFFFF)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate([*values, np.zeros(0, np.int64)]), kind))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins in sorted arrays."""
    edge = np.ones(len(keys[0]), bool)
    if len(edge):
        edge[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return edge


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _parts(where: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The shards in sorted where, and each one's part of the arrays."""
    first = np.flatnonzero(_runs(where))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(where)]):
        yield int(where[a]), tuple(x[a:b] for x in arrays)


def levels(shards: int) -> list[int]:
    """Numbers of groups to deal to, one after the other, the last being shards."""
    steps = 1
    while FAN**steps < shards:
        steps += 1
    return [round(shards ** (i / steps)) for i in range(1, steps)] + [shards]


def deal(sent: DataFrame, counts: list[int], again: Callable, schema: str) -> DataFrame:
    """Rows of groups dealt on to the groups of each next level."""
    for n in counts[1:]:
        sent = sent.repartition("shard").mapInArrow(again(n), schema)
    return sent


ANCHORS = "shard int, probes binary, blocks binary, doc_id long, anchors array<long>"


def _probe_rows(parts: Iterable[tuple[int, np.ndarray, tuple[np.ndarray, np.ndarray] | None]]) -> pa.RecordBatch:
    """A row for each shard: sorted probe keys by differences; block keys and their documents."""
    rows = [(s, squeeze(np.diff(p, prepend=np.uint64(0))), squeeze(b[0], b[1].view(np.uint64)) if b else None) for s, p, b in parts]
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=_names(ANCHORS))


def _read_probes(row: tuple[bytes, bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, docs = expand(row[1]) if row[1] is not None else np.zeros((2, 0), np.uint64)
    return np.cumsum(expand(row[0])[0], dtype=np.uint64), keys, docs.view(np.int64)


def resend_probes(shards: int):
    """Rows of send_probes for groups of shards to rows for shards; anchors pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pc.is_valid(batch.column("doc_id"))
            yield batch.filter(own)
            rest = batch.filter(pc.invert(own))
            for row in zip(rest.column("probes").to_pylist(), rest.column("blocks").to_pylist()):
                probes, keys, docs = _read_probes(row)
                where, at = shard_of(probes, shards), shard_of(keys, shards)
                order, block_order = np.argsort(where, kind="stable"), np.argsort(at, kind="stable")
                blocks = dict(_parts(at[block_order], keys[block_order], docs[block_order]))
                yield _probe_rows((s, p, blocks.get(s)) for s, (p,) in _parts(where[order], probes[order]))

    return run


def send_probes(block: int, shards: int):
    """Documents to one row for each shard (distinct probe keys; block keys and their documents) and rows of anchors found in the task itself."""

    def emit(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, docs, aligned = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys, docs, aligned = keys[order], docs[order], aligned[order]
        edge = _runs(keys)
        run = np.cumsum(edge) - 1
        starts = np.flatnonzero(edge)
        several = (np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts))[run]
        probes, where = keys[starts], shard_of(keys[starts], shards)
        order = np.argsort(where, kind="stable")  # keys stay sorted within a shard
        probes, where = probes[order], where[order]
        alone = aligned & ~several
        block_keys, block_docs, block_where = keys[alone], docs[alone], shard_of(keys[alone], shards)
        order = np.argsort(block_where, kind="stable")
        block_keys, block_docs, block_where = block_keys[order], block_docs[order], block_where[order]
        blocks = dict(_parts(block_where, block_keys, block_docs))
        yield _probe_rows((s, p, blocks.get(s)) for s, (p,) in _parts(where, probes))
        names = _names(ANCHORS)
        found = aligned & several
        if found.any():
            keys, docs = keys[found], docs[found]
            order = np.argsort(docs, kind="stable")
            keys, docs = keys[order], docs[order]
            first = np.flatnonzero(_runs(docs))
            mine = np.split(keys.view(np.int64), first[1:])
            yield pa.RecordBatch.from_arrays([pa.array(docs[first] % shards, pa.int32()), pa.nulls(len(first), pa.binary()), pa.nulls(len(first), pa.binary()), pa.array(docs[first]), _lists(mine, pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in chunks(batch):
                hashes, _, _, first = words(text_column(part.column("text")), fold=False)
                start, owner = run_owner(first, block)
                if not len(start):
                    continue
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((rolling(hashes[:, 0], block)[start], ids[owner], (start - first[owner]) % block == 0))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from emit(held)
                    held = []
        if held:
            yield from emit(held)

    return run


def meet_probes(table: pa.Table) -> pa.Table:
    """One shard: the block keys that two tasks' texts hold, by document, and the anchors that tasks have found themselves."""
    rows = [_read_probes(r) for r in zip(table.column("probes").to_pylist(), table.column("blocks").to_pylist()) if r[0] is not None]
    own = table.filter(pc.is_valid(table.column("doc_id"))).select(["doc_id", "anchors"])
    if not rows:
        return own
    probes, keys, docs = (np.concatenate(x) for x in zip(*rows))
    del rows
    probes.sort()
    twice = np.unique(probes[1:][probes[1:] == probes[:-1]])  # a task sends a key once
    at = np.minimum(np.searchsorted(twice, keys), max(0, len(twice) - 1))
    hit = twice[at] == keys if len(twice) else np.zeros(len(keys), bool)
    keys, docs = keys[hit], docs[hit]
    order = np.argsort(docs, kind="stable")
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(_runs(docs))
    mine = np.split(keys.view(np.int64), first[1:]) if len(first) else []
    return pa.concat_tables([own, pa.table({"doc_id": pa.array(docs[first], pa.int64()), "anchors": _lists(mine, pa.int64())})])


WINDOWS = "shard int, keys binary, doc_id long, version long, places array<int>"


def _window_rows(arrays: list[np.ndarray], shards: int) -> pa.RecordBatch:
    """A row for each shard of the windows: key, check, document, version and place."""
    where = shard_of(arrays[0], shards)
    order = np.argsort(where, kind="stable")
    rows = [(s, squeeze(*x)) for s, x in _parts(where[order], *(x[order].view(np.uint64) for x in arrays))]
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32()))], names=_names(WINDOWS))


def resend_windows(shards: int):
    """Rows of send_windows for groups of shards to rows for shards; removed places pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pc.is_valid(batch.column("doc_id"))
            yield batch.filter(own)
            for data in batch.filter(pc.invert(own)).column("keys").to_pylist():
                yield _window_rows(expand(data), shards)

    return run


def send_windows(block: int, window: int, shards: int):
    """Documents with anchors to their windows around anchors: each task's first document of a window to the window's shard, the others as removed."""

    def emit(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, check, docs, versions, places = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((docs, check, key))
        key, check, docs, versions, places = (x[order] for x in (key, check, docs, versions, places))
        edge = _runs(key, check)
        least = docs[np.flatnonzero(edge)][np.cumsum(edge) - 1]
        first = docs == least
        yield _window_rows([x[first] for x in (key, check, docs, versions, places)], shards)
        if not first.all():
            got = _by_document(docs[~first], versions[~first], places[~first])
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(got[0]) % shards, pa.int32()), pa.nulls(len(got[0]), pa.binary()), *got], names=_names(WINDOWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for part in chunks(batch):
                texts = text_column(part.column("text"))
                hashes, _, _, first = words(texts, fold=False)
                start, owner = run_owner(first, block)
                if not len(start):
                    continue
                keys = rolling(hashes[:, 0], block)[start]
                anchors = part.column("anchors")
                hit = np.zeros(len(hashes) + 1, np.int64)
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    a, b = bounds[i], bounds[i + 1]
                    mine = np.unique(np.concatenate([np.asarray(x, np.int64) for x in anchors[i].as_py()])).view(np.uint64)
                    hit[start[a:b]] = np.isin(keys[a:b], mine)
                start, owner = run_owner(first, window)
                if not len(start):
                    continue
                seen = np.concatenate([[0], np.cumsum(hit)])
                near = seen[start + window - block + 1] > seen[start]
                start, owner = start[near], owner[near]
                ids, versions = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "version"))
                held.append((rolling(hashes[:, 0], window)[start], rolling(hashes[:, 1], window)[start], ids[owner], versions[owner], start - first[owner]))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from emit(held)
                    held = []
        if held:
            yield from emit(held)

    return run


def _by_document(docs: np.ndarray, versions: np.ndarray, places: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    order = np.lexsort((places, versions, docs))
    docs, versions, places = docs[order], versions[order], places[order]
    first = np.flatnonzero(_runs(docs, versions))
    return pa.array(docs[first], pa.int64()), pa.array(versions[first], pa.int64()), _lists(np.split(places, first[1:]) if len(first) else [], pa.int32())


def meet_windows(table: pa.Table) -> pa.Table:
    """One shard: starts of windows that a smaller document holds as well, by document."""
    own = table.filter(pc.is_valid(table.column("doc_id"))).select(["doc_id", "version", "places"])
    got = [expand(x) for x in table.column("keys").to_pylist() if x is not None]
    if not got:
        return own
    key, check, docs, versions, places = (np.concatenate(x) for x in zip(*got))
    docs, versions, places = docs.view(np.int64), versions.view(np.int64), places.view(np.int64)
    order = np.lexsort((docs, check, key))
    key, check, docs, versions, places = (x[order] for x in (key, check, docs, versions, places))
    edge = _runs(key, check)
    later = docs != docs[np.flatnonzero(edge)][np.cumsum(edge) - 1]
    return pa.concat_tables([own, pa.table(list(_by_document(docs[later], versions[later], places[later])), names=["doc_id", "version", "places"])])


def removed_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """doc_id, version, copy, spans: the word spans (start, end, ...) of each text that a smaller document's passages cover.

    version is a hash of the text, so that rows that repeat an id are judged each by
    its own text.  copy marks texts that a smaller id has as a whole: all their words
    are covered if they have a window at all.  Null ids and texts take no part.
    """
    block = window // 2
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id IS NOT NULL").withColumn("version", F.xxhash64("text"))
    base = base.filter(F.octet_length("text") >= 2 * window - 1)  # fewer bytes hold no window
    keys = base.select("doc_id", "version", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size"))
    least = keys.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("most > least").select("digest", "least")
    least = materialize(least, "least")  # apart from the join, so that it is one of plain exchanges, which AQE may split
    copies = materialize(keys.join(least, "digest").filter("doc_id > least").select("doc_id", "version").distinct(), "copies")
    total = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    counts = levels(max(1, -(-total // SHARD_BYTES)))
    rest = base.join(narrow(copies), ["doc_id", "version"], "left_anti")
    sent = rest.select("doc_id", "text").mapInArrow(send_probes(block, counts[0]), ANCHORS)
    sent = deal(sent, counts, resend_probes, ANCHORS)
    met = sent.groupBy("shard").applyInArrow(meet_probes, "doc_id long, anchors array<long>")
    anchors = materialize(met.groupBy("doc_id").agg(F.collect_list("anchors").alias("anchors")), "anchors")
    wanted = rest.join(narrow(anchors.select("doc_id")), "doc_id", "left_semi").join(anchors, "doc_id")
    # at most block + 1 windows hold an anchor, so this many shards hold SHARD_WINDOWS each
    hits = anchors.agg(F.sum(F.aggregate("anchors", F.lit(0).cast("long"), lambda a, x: a + F.size(x)))).first()[0] or 0
    counts = levels(max(1, -(-hits * (block + 1) // SHARD_WINDOWS)))
    sent = wanted.select("doc_id", "version", "text", "anchors").mapInArrow(send_windows(block, window, counts[0]), WINDOWS)
    sent = deal(sent, counts, resend_windows, WINDOWS)
    met = sent.groupBy("shard").applyInArrow(meet_windows, "doc_id long, version long, places array<int>")
    starts = met.groupBy("doc_id", "version").agg(F.collect_list("places").alias("places"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for lists in batch.column("places").to_pylist():
                at = np.unique(np.concatenate([np.asarray(x, np.int64) for x in lists]))
                new = np.concatenate([[True], at[1:] > at[:-1] + window])
                last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])
                spans.append(np.column_stack([at[new], at[last] + window]).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), _lists(spans, pa.int32())], names=["doc_id", "version", "spans"])

    spans = starts.mapInArrow(merge, "doc_id long, version long, spans array<int>").withColumn("copy", F.lit(False))
    return materialize(spans.select("doc_id", "version", "copy", "spans").unionAll(copies.select("doc_id", "version", F.lit(True), F.array().cast("array<int>"))), "spans")


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words as text, one blank between them.

    Words are ``[^\\x20\\x09-\\x0D]+``.  Null texts have none.  The smallest id of a
    passage keeps it, also where it repeats within that document; rows that repeat
    an id are judged each by its own text; rows with a null id stay as they are.
    """
    spans = removed_spans(docs, text, key, window)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    rows = rows.join(narrow(spans, width=F.lit(64) + 4 * F.size("spans")), ["doc_id", "version"], "left").select("doc_id", "text", "copy", "spans")
    names = [c.split()[0] for c in KEPT.split(", ")] + ["kept_text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                out: list[tuple] = []
                for doc, text_, copy, gone in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "copy", "spans"))):
                    found = (text_ or "").encode("utf-8", "surrogatepass").split()
                    n = len(found)
                    if copy and n >= window:
                        found = []
                    elif gone:
                        at = [0, *gone, n]
                        found = [w for a, b in zip(at[::2], at[1::2]) for w in found[a:b]]
                    kept = b" ".join(found)
                    out.append((doc, n, n - len(found), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] if with_text else ())))
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return rows.mapInArrow(run, KEPT + ", kept_text string" * with_text)
