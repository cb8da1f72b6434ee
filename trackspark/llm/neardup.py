"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen, Thorup 2017): ``coordinates`` bins; in round r every
element falls into one hashed bin with value (r, hash), and in rounds from
``coordinates`` on into bin r - coordinates, so every bin is filled after at most
twice ``coordinates`` rounds and each coordinate agrees with probability J.

Cost and scale: signatures are made in one pass over the texts and written once;
equal sets collapse to one node first, so copies never meet in a band.
Within a band bucket, members are compared with the bucket's most central member
only; pairs across components that are still apart are then found by an exact
prefix filter, so a bucket of copies costs its size and not its square.  No link
between classes is lost to this: a pair that shares a bucket is in one component
already, or verified, or excluded by the filter's bound.  Banding itself misses a
pair with J = 0.85 with probability (1 - 0.85**5)**32, below 1e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, discard, materialize, mix, narrow, rolling, run_owner, text_column, unused, words, unused
from .components import components

SHINGLE = 5
COORDINATES = 160
BANDS = 32
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[list[np.ndarray], list[bytes]]:
    """The sorted distinct 64-bit shingle hashes of each text, of the whole sequence if it has fewer words, and a strong digest of the set."""
    hashes, _, _, first = words(texts, fold=True)
    start, owner = run_owner(first, size)
    run, other = (rolling(hashes[:, k], size)[start] for k in (0, 1)) if len(start) else np.zeros((2, 0), np.uint64)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    sets, digests = [], []
    for i in range(len(texts)):
        n = int(first[i + 1] - first[i])
        if n >= size:
            mine, place = np.unique(run[at[i] : at[i + 1]], return_index=True)
            check = other[at[i] : at[i + 1]][place]
        else:
            mine, check = (rolling(hashes[first[i] : first[i + 1], k], n)[: min(n, 1)] for k in (0, 1)) if n else np.zeros((2, 0), np.uint64)
        sets.append(mine)
        digests.append(hashlib.blake2b(mine.tobytes() + check.tobytes(), digest_size=16).digest())
    return sets, digests


def sketch(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches, one row for each set; empty sets keep the filler value."""
    t = coordinates
    out = np.full(len(sets) * t, _LAST)
    hashes = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for r in range(2 * t):
        if not len(hashes):
            break
        x = mix(hashes + np.uint64((r + 1) * int(_GOLDEN) % 2**64))
        place = (x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32) if r < t else np.full(len(x), r - t, np.uint64)
        np.minimum.at(out, owner * t + place.astype(np.int64), (x & np.uint64(0xFFFFFFFF)) | np.uint64(r << 32))
        open_ = (out.reshape(-1, t) == _LAST).any(axis=1)[owner]
        hashes, owner = hashes[open_], owner[open_]
    return out.reshape(-1, t)


def band_keys(sketches: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each sketch; keys of different bands differ."""
    n, t = sketches.shape
    rows = t // bands
    odd = mix(np.arange(1, t + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
    return mix((mix(sketches) * odd).reshape(n, bands, rows).sum(axis=2, dtype=np.uint64) + mix(np.arange(bands, dtype=np.uint64) + np.uint64(977)))


def _entities(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, version (a hash of the text, so that rows that repeat an id are told apart) and text."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).cast("string").alias("text"))


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, coordinates: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """doc_id, version, n_shingles, a strong digest of the set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets, digests = shingle_sets(text_column(part.column("text")), size)
                keys = band_keys(sketch(sets, coordinates), bands).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("version"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.ravel())),
                    ],
                    names=["doc_id", "version", "n_shingles", "digest", "bands"],
                )

    return _entities(docs, text, key).mapInArrow(run, "doc_id long, version long, n_shingles long, digest binary, bands array<long>")


def full_sets(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """node and its whole shingle set as sorted longs, of rows (node, text); a task gives each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in chunks(batch):
                nodes = part.column("node").to_pylist()
                new = [i for i, n in enumerate(nodes) if n not in seen and not seen.add(n)]  # type: ignore[func-returns-value]
                if not new:
                    continue
                part = part.take(pa.array(new))
                sets = [s.view(np.int64) for s in shingle_sets(text_column(part.column("text")), size)[0]]
                at = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets)))], names=["node", "items"])

    return rows.select("node", "text").mapInArrow(run, "node long, items array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("i", shared).filter(F.col("i") * (100 + percent) >= percent * (F.size("x") + F.size("y"))).select("a", "b")


def _rows_and_winners(docs: DataFrame, text: str, key: str, percent: int, size: int, coordinates: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """Each row's doc_id, version, n_shingles and digest, and of each digest its class's smallest (doc_id, version), null ids last."""
    made = materialize(signatures(docs, text, key, size, coordinates, bands), "signatures")
    # equal sets are one node; their bands are equal too
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "version"))
    nodes = made.filter("n_shingles > 0").groupBy("digest").agg(least.alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = _links(docs, nodes, text, key, percent, size)
    classes = components(edges).select(F.col("id").alias("node"), "component")
    of_class = nodes.select("node", "least").join(classes, "node").groupBy("component").agg(F.min("least").alias("first"))
    named = classes.join(of_class, "component").select("node", "first")
    named = nodes.select("node", "digest", "least").join(named, "node", "left").select("digest", F.coalesce("first", "least").alias("w"))
    named = materialize(named.select("digest", F.col("w.doc_id").alias("component_id"), F.col("w.version").alias("component_version")), "classes")
    discard(nodes, edges)
    return made.select("doc_id", "version", "n_shingles", "digest"), named


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 80, size: int = SHINGLE, coordinates: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, kept: classes of documents whose shingle sets have Jaccard >= percent / 100.

    Each row is judged by its own text, also where an id repeats.  component_id is the
    smallest id of the class; where all its ids are null it is null and its rows are
    kept.  Null, empty and wordless texts have an empty set, are linked with
    nothing and are classes of their own.  Repeated rows (one id, one text) give
    repeated rows of one class.  Other columns are ignored.
    """
    rows, named = _rows_and_winners(docs, text, key, percent, size, coordinates, bands)
    out = rows.join(named.drop("component_version"), "digest", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id").eqNullSafe(F.col("component_id")), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """docs with one row of each class of near duplicates: of its smallest id, and where rows repeat that id and text, the smallest.

    A class whose ids are all null keeps one row too.  Texts without a word are kept.
    The columns of docs must be orderable; their names may be any.
    """
    rows, named = _rows_and_winners(docs, text, key, percent, size, COORDINATES, BANDS)
    judged = rows.filter("n_shingles > 0").join(named, "digest").withColumn("wins", F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("version") == F.col("component_version")))
    entities = judged.groupBy("doc_id", "version").agg(F.max("wins").alias("wins"), F.count(F.lit(1)).alias("n"))
    gone, version, version_of = unused(docs.columns, "gone", "version", "version_of")
    marks = materialize(entities.filter("NOT wins OR n > 1").select(F.col("doc_id").alias(gone), F.col("version").alias(version), "wins"), "gone")
    keyed = docs.withColumn(version_of, F.xxhash64(F.col(text)))
    same = F.col(key).cast("long").eqNullSafe(F.col(gone)) & (F.col(version_of) == F.col(version))
    out = keyed.join(narrow(marks.drop("wins")), same, "left_anti").drop(version_of)
    repeated = marks.filter("wins").drop("wins")
    if repeated.isEmpty():
        return out
    again = keyed.join(narrow(repeated), same).groupBy(gone, version).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return out.unionAll(again.select("row.*"))


def _links(docs: DataFrame, nodes: DataFrame, text: str, key: str, percent: int, size: int) -> DataFrame:
    """Verified links between nodes (equal sets) that join all classes."""
    reps = nodes.select(F.col("node").alias("id"), "n_shingles", F.explode("bands").alias("band"))
    sizes = reps.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sizes = materialize(sizes, "sizes")  # apart from the join, so that it is one of plain exchanges, which AQE may split
    # members of buckets with two nodes or more
    shared = materialize(reps.join(sizes, "band"), "shared")
    # each with the bucket's most central node, the one that meets most others: the original is that of its edited copies
    degrees = shared.groupBy("id").agg(F.sum("size").alias("degree"))
    pivots = shared.select("band", "id").join(degrees, "id").groupBy("band").agg(F.max(F.struct("degree", (-F.col("id")).alias("less"))).alias("p"))
    pivots = materialize(pivots.select("band", (-F.col("p.less")).alias("pivot")), "pivots")
    stars = shared.join(pivots, "band").filter("id <> pivot").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b"))
    stars = materialize(stars.distinct(), "stars")
    wanted = materialize(nodes.join(shared.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("node", F.col("least.doc_id").alias("want_id"), F.col("least.version").alias("want_version")), "wanted")
    texts = _entities(docs, text, key).join(narrow(wanted), F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("version") == F.col("want_version"))).select("node", "text")
    sets = materialize(full_sets(texts, size), "sets")
    if sets.count() > wanted.count():  # rows that repeat, met by several tasks
        sets = materialize(sets.groupBy("node").agg(F.first("items").alias("items")), "sets")
    edges = materialize(verified(stars, sets, percent), "links")
    label = components(edges).withColumnRenamed("component", "c")
    labelled = materialize(shared.join(narrow(label), "id", "left").select("id", "n_shingles", "band", F.coalesce("c", "id").alias("c")), "labelled")
    apart = labelled.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("band")
    rest = materialize(labelled.join(apart, "band", "left_semi").select("id", "n_shingles", "c").distinct(), "apart")
    more = _across(rest, sets, percent).join(stars, ["a", "b"], "left_anti")
    out = materialize(edges.unionAll(verified(more, sets, percent)), "edges")
    discard(sizes, pivots, shared, stars, wanted, sets, edges, labelled, rest)
    return out


def _across(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that can still be linked, by an exact prefix and position filter.

    Shingles are ordered by how many nodes of rest hold them.  Two sets that are
    similar enough share one of the first n - ceil(percent * n / 100) + 1 of either, and at
    the first that they share, what is left of both must suffice for the overlap
    needed; of the smaller set that leaves an even shorter prefix.  Shingles of one
    node or of one component only can't be that one.
    """
    rows = rest.count()
    items = materialize(sets.withColumnRenamed("node", "id").join(narrow(rest, rows), "id").select("id", "c", "n_shingles", F.explode("items").alias("item")).distinct(), "items")
    held = items.groupBy("item").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    order = Window.partitionBy("id").orderBy("df", "item")
    prefix = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    first = items.join(held, "item").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= prefix).filter("lo < hi")
    first = materialize(first.select("item", "id", "c", "n_shingles", (F.col("n_shingles") - F.col("at") + 1).alias("left")), "prefixes")
    discard(items)
    x = first.filter(F.col("left") * (100 + percent) >= percent * 2 * F.col("n_shingles")).select("item", *(F.col(k).alias(f"{k}_x") for k in ("id", "c", "n_shingles", "left")))
    y = first.select(F.col("item").alias("item_y"), *(F.col(k).alias(f"{k}_y") for k in ("id", "c", "n_shingles", "left")))
    smaller = (F.col("n_shingles_x") < F.col("n_shingles_y")) | ((F.col("n_shingles_x") == F.col("n_shingles_y")) & (F.col("id_x") < F.col("id_y")))
    fits = F.least("left_x", "left_y") * (100 + percent) >= percent * (F.col("n_shingles_x") + F.col("n_shingles_y"))
    pairs = x.join(y, (F.col("item") == F.col("item_y")) & smaller & (F.col("c_x") != F.col("c_y")) & fits)
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()
