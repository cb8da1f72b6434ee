"""Language identification by rank-order n-gram profiles (Cavnar & Trenkle 1994)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, materialize, narrow

#: Grams of one to MAX_GRAM letters; the ranks of the PROFILE most frequent are compared.
MAX_GRAM = 3
PROFILE = 400
#: Labelled documents, about, from which each language's profile is learned at most.
SAMPLE_PER_LANGUAGE = 4000
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Code point to its lower-case letter, and to 0 where it is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in [*range(0xD800), *range(0xE000, 0x110000)]:
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def grams(text: str, longest: int = MAX_GRAM) -> np.ndarray:
    """Packed n-grams of a text's words, each word between single blanks; runs of other characters count as one blank."""
    points = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate([[0], points, [0]]).astype(np.uint64)
    points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
    out = [points[points != 0]]
    code = points
    for n in range(2, longest + 1):
        if len(points) < n:
            break
        code = code[:-1] << np.uint64(21) | points[n - 1 :]
        inner = np.ones(len(code), bool)
        for k in range(1, n - 1):  # a blank stands only at an end
            inner &= points[k : len(points) - n + 1 + k] != 0
        if n == 2:
            inner &= (points[:-1] != 0) | (points[1:] != 0)
        out.append((code | np.uint64(1 << 63) if n == longest else code)[inner])
    return np.concatenate(out)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The size most frequent codes, most frequent first, ties to the smaller code."""
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    """Rank tables of all languages, small enough to be sent with a task."""

    def __init__(self, langs: list[str], tops: list[np.ndarray], size: int):
        self.langs, self.size = langs, size
        self.tables = []
        for top in tops:
            order = np.argsort(top)
            self.tables.append((top[order], order.astype(np.int64)))

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's ranking to each language, from 0 to 1; absent grams count as far as can be."""
        rank = np.arange(len(top))
        out = []
        for codes, places in self.tables:
            if not len(codes):
                out.append(1.0)
                continue
            at = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
            away = np.where(codes[at] == top, np.abs(places[at] - rank), self.size)
            out.append(np.minimum(away, self.size).sum() / (self.size * len(top)))
        return np.array(out)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, ties to the first by name, and how clearly it is nearest (0.5 for a tie to 1)."""
        codes, counts = np.unique(grams(text or ""), return_counts=True)
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        away = self.distances(ranked(codes, counts, self.size))
        best = int(np.argmin(away))
        if len(away) == 1:
            return self.langs[best], float(1 - away[best])
        second = float(np.min(np.delete(away, best)))
        return self.langs[best], second / (second + float(away[best])) if second > 0 else 0.5


def learn(docs: DataFrame, train: str, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE, size: int = PROFILE) -> Profiles:
    """Profiles from rows that fulfil the SQL condition train and have a language.

    Rows are taken by a hash of their id, so that each language gives about sample
    documents, or all it has; grams are counted on the executors, merged by key,
    and only each language's top ranks reach the driver.
    """
    labelled = docs.filter(train).filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    labelled = labelled.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    per = labelled.groupBy("lang").count().withColumn("share", F.lit(float(sample)) / F.col("count")).select("lang", "share")
    taken = labelled.join(narrow(per), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    found.setdefault(lang, []).append(grams(text))
                for lang, codes in found.items():
                    kinds, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    totals = taken.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = materialize(totals, "grams").withColumn("place", place).filter(F.col("place") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for row in best.select("lang", "code", "n").collect():
        found.setdefault(row["lang"], []).append((row["code"], row["n"]))
    langs = sorted(found)
    tops = [ranked(np.array([c for c, _ in found[x]], np.int64).view(np.uint64), np.array([n for _, n in found[x]], np.int64), size) for x in langs]
    return Profiles(langs, tops, size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs, without the text unless it is kept, with lang_pred and score added; columns of those names are replaced.

    Null, empty and letterless texts get lang_pred ``und`` and score 0; texts of any
    length are ranked whole; equal texts get equal results.
    """
    others = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != text)]
    send = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = send.value
        for batch in batches:
            for part in chunks(batch, text):
                got = [known.predict(x) for x in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array([x for x, _ in got], pa.string()), pa.array([float(s) for _, s in got], pa.float64())], names=[*others, "lang_pred", "score"])

    schema = docs.select(*others, F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.select(*others, *([] if keep_text else [text])).mapInArrow(run, schema)
