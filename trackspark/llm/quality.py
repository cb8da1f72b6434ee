"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Terms are trigrams of byte classes (letter case, digits, blanks, each punctuation
mark, bytes beyond ASCII) and counts of repeated words: a document's style, not
its topic or language.  Square roots of term shares, weighted by rarity, are
projected on the leading singular vectors of a bounded sample of labelled rows.
Every document is then compared with all of that sample's vectors by exact cosine
products, block by block, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_bytes, text_column, words

#: Labelled rows of each label that are fitted on at most; what is broadcast is bounded by it.
SAMPLE_PER_LABEL = 2048
DIMENSIONS = 48
NEIGHBOURS = 15
#: Cosines that differ by less tie.
TIE = 1e-5
BLOCK = 512
#: Further vectors and rounds of the subspace iteration.
SPARE, ITERATIONS = 16, 6

_CLASSES = 40


def _class_table() -> np.ndarray:
    table = np.full(256, 39, np.int64)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[128:], table[[9, 11, 12, 13, 32]], table[10] = 3, 4, 5
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    table[marks] = 6 + np.arange(len(marks)) % 33
    return table


_CLASS = _class_table()
_LAGS = 8
TERMS = _CLASSES**3 + _LAGS + 2


def term_counts(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Term numbers and square roots of their shares, for each text."""
    raw, at = text_bytes(texts)
    kinds = _CLASS[raw]
    code = (kinds[:-2] * _CLASSES + kinds[1:-1]) * _CLASSES + kinds[2:] if len(raw) > 2 else np.zeros(0, np.int64)
    code = code.astype(np.uint16)
    hashes, _, _, first = words(texts, fold=False)
    out = []
    for i in range(len(texts)):
        mine = code[at[i] : max(at[i], at[i + 1] - 2)]
        mine = np.sort(mine, kind="stable")  # 16 bits: a radix sort
        edge = np.flatnonzero(np.concatenate([mine[1:] != mine[:-1], [True]])) if len(mine) else np.zeros(0, np.int64)
        terms, share = mine[edge].astype(np.int64), np.diff(edge, prepend=-1) / max(1, len(mine))
        w = hashes[first[i] : first[i + 1], 0]
        extra = np.zeros(_LAGS + 2)
        if len(w) > 1:
            for lag in range(1, min(_LAGS, len(w) - 1) + 1):
                extra[lag - 1] = (w[lag:] == w[:-lag]).mean()
        if len(w):
            extra[_LAGS] = 1 - len(np.unique(w)) / len(w)
        extra[_LAGS + 1] = 1 / (1 + len(w))
        here = np.flatnonzero(extra)
        out.append((np.concatenate([terms, _CLASSES**3 + here]), np.sqrt(np.concatenate([share, extra[here]]))))
    return out


class Model:
    """Singular vectors, labelled vectors and vote weights; its size depends on the parameters only."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS):
        self.prior, self.neighbours = prior, neighbours
        self.ready = len(rows) > 0 and len(np.unique(labels)) == 2
        if not self.ready:
            return
        seen = np.bincount(np.concatenate([t for t, _ in rows]), minlength=TERMS)
        used = np.flatnonzero(seen)  # every term of the sample
        self.column = np.full(TERMS, -1, np.int64)
        self.column[used] = np.arange(len(used))
        self.weight = np.log(1 + len(rows) / (1 + seen[used]))
        self.basis = self.singular_vectors(rows, dimensions)
        self.mean = self.products(rows, self.basis).mean(axis=0)
        self.vectors, self.labels = self.project(rows), labels.astype(float)

    def weighted(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns and weighted values of all rows one after the other, and where each row begins; terms that the sample lacks go."""
        columns, values = self.column[np.concatenate([t for t, _ in rows])], np.concatenate([v for _, v in rows])
        known = columns >= 0
        begins = np.concatenate([[0], np.cumsum(known)])[np.cumsum([0, *(len(t) for t, _ in rows)])]
        columns = columns[known]
        return columns, (values[known] * self.weight[columns]).astype(np.float32), begins

    def products(self, rows: list[tuple[np.ndarray, np.ndarray]], right: np.ndarray) -> np.ndarray:
        """The sparse matrix of rows times right, block by block."""
        out = np.zeros((len(rows), right.shape[1]), np.float32)
        for i in range(0, len(rows), BLOCK):
            columns, values, begins = self.weighted(rows[i : i + BLOCK])
            full = np.flatnonzero(begins[1:] > begins[:-1])
            if len(full):
                out[i + full] = np.add.reduceat(right[columns] * values[:, None], begins[:-1][full], axis=0)
        return out

    def singular_vectors(self, rows: list[tuple[np.ndarray, np.ndarray]], dimensions: int) -> np.ndarray:
        """Leading right singular vectors of the centred rows, by subspace iteration from a fixed start; only blocks are ever dense."""
        terms, wide = len(self.weight), min(dimensions + SPARE, len(self.weight), len(rows))
        basis = np.linalg.qr(np.random.default_rng(11).standard_normal((terms, wide)))[0].astype(np.float32)
        for _ in range(ITERATIONS):
            left = self.products(rows, basis)
            left -= left.mean(axis=0)
            back = np.zeros((terms, wide), np.float32)
            for i in range(0, len(rows), BLOCK):
                columns, values, begins = self.weighted(rows[i : i + BLOCK])
                owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins)) + i
                order = np.argsort(columns, kind="stable")
                columns, values, owner = columns[order], values[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], columns[1:] != columns[:-1]])) if len(columns) else np.zeros(0, np.int64)
                if len(first):
                    back[columns[first]] += np.add.reduceat(left[owner] * values[:, None], first, axis=0)
            basis, _ = np.linalg.qr(back)
        left = self.products(rows, basis)
        left -= left.mean(axis=0)
        _, _, turn = np.linalg.svd(left.astype(np.float64), full_matrices=False)
        return np.ascontiguousarray((basis @ turn.T)[:, :dimensions]).astype(np.float32)

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        z = (self.products(rows, self.basis) - self.mean).astype(float)  # cosines in double precision do not depend on the batch
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Share of label 1 in the similarity-weighted vote, corrected to the labels' prior."""
        if not self.ready:
            return np.full(len(rows), self.prior)
        out = np.empty(len(rows))
        for i in range(0, len(rows), BLOCK):
            near = self.project(rows[i : i + BLOCK]) @ self.vectors.T
            k = min(self.neighbours, near.shape[1])
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            votes = np.where(near >= least[:, None] - TIE, np.exp(8 * (near - 1)), 0)  # all that tie with the last vote too
            share = (votes @ self.labels + 1e-6) / (votes.sum(axis=1) + 2e-6)
            odds1, odds0 = share * self.prior / self.labels.mean(), (1 - share) * (1 - self.prior) / (1 - self.labels.mean())
            out[i : i + BLOCK] = np.round(odds1 / (odds1 + odds0), 9)
        return out


def fit(docs: DataFrame, labels: DataFrame, train: str, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE_PER_LABEL) -> Model:
    """A model from at most sample labelled rows of each label that fulfil the SQL condition train, chosen by a hash of the id.

    An id with several labels counts with the smallest, one with several texts with
    that of the smallest digest; null ids and labels are ignored.  Terms are made on the executors; the driver gets the sample's sparse
    rows only, whose number is bounded.
    """
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(train)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not total:
        return Model([], np.zeros(0), 0.5)
    taken = [known.filter(F.col("label") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for x in (0, 1)]
    taken = F.broadcast(taken[0].unionAll(taken[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = term_counts(text_column(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), part.column("version"), pa.array([t.astype(np.int32) for t, _ in rows], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in rows], pa.list_(pa.float32()))], names=["doc_id", "label", "version", "terms", "shares"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(taken, "doc_id").select("doc_id", "label", "text", F.sha2("text", 256).alias("version"))
    made = rows.mapInArrow(run, "doc_id long, label int, version string, terms array<int>, shares array<float>")
    got = made.groupBy("doc_id").agg(*(F.min_by(c, F.coalesce("version", F.lit(""))).alias(c) for c in ("label", "terms", "shares"))).toPandas().sort_values("doc_id")
    terms = [(np.asarray(t, np.int64), np.asarray(v, np.float64)) for t, v in zip(got["terms"], got["shares"])]
    return Model(terms, got["label"].to_numpy(), total.get(1, 0) / sum(total.values()))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text and with a score from 0 to 1 added; a column of that name is replaced.

    Null, empty and very long texts are scored like any other, as a whole; equal texts
    get equal scores.  Without labelled rows of both labels the score is the prior.
    """
    others = [c for c in docs.columns if c not in (text, "score")]
    send = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = send.value
        for batch in batches:
            for part in chunks(batch, text):
                made = known.scores(term_counts(text_column(part.column(text))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(made, pa.float64())], names=[*others, "score"])

    return docs.select(*others, F.col(text)).mapInArrow(run, docs.select(*others, F.lit(0.0).alias("score")).schema)
