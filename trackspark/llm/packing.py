"""Packing of token streams into fixed windows by order-preserving dynamic programming.

Documents keep their order.  A window may be cut after a document, after a
sentence, or, where a sentence leaves no other choice, after ``HARD_STEP`` tokens
within it.  The programme minimises padding plus a penalty for each cut within a
document; the best predecessor of each cut comes from a monotone queue, so time is
linear in the number of cuts.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, chunks, text_bytes, text_column

WINDOW = 2048
END = 1
#: Text bytes that are tokenised at once.
CHUNK = 2 << 20
#: Padding tokens that a cut is worth within a document after a sentence, and within a sentence.
SENTENCE_PENALTY = 16
HARD_PENALTY = 48
#: Tokens after which a cut within a sentence may stand; the window, where that is shorter.
HARD_STEP = 128
#: Tokens that one run of the programme takes at once; what its last open window holds goes on to the next run.
BLOCK_TOKENS = 1_000_000
#: Distinct units of text whose ids a worker remembers.
CACHE_UNITS = 300_000
#: First bytes of characters that are surely no white space.
VISIBLE = ~SPACE
VISIBLE[:32] = False
VISIBLE[[0xC2, 0xE1, 0xE2, 0xE3]] = False
#: 1 blank, 2 other ASCII white space, 3 ASCII letter, 4 ASCII mark, 0 all else.
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 4
KIND[48:58] = 0
KIND[65:91] = KIND[97:123] = 3
KIND[SPACE] = 2
KIND[32] = 1


class UnitCache(dict):
    """Ids of text units as little-endian 32-bit bytes, made on demand."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        ids = array("I", self.encode(unit)).tobytes()
        if len(self) < CACHE_UNITS:
            self[unit] = ids
        return ids


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the vocabulary's tokenizers file, where there is one."""
    try:
        with open(path, encoding="utf-8") as lines:
            return {t["content"]: t["id"] for t in json.load(lines)["added_tokens"]}
    except FileNotFoundError:
        return {}


class Encoder:
    """Byte-level BPE of a public vocabulary file.

    The pre-tokeniser always starts a word at a blank that a visible character
    follows, and between a letter and a mark, so texts are split there, every
    distinct unit of a chunk is encoded once, and ids are gathered by array operations.
    """

    def __init__(self, file: str = "byte_bpe_50k.tiktoken", folder: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        path = f"{folder}/{file}" if folder else public_tokenizers.path(file)
        self.special = added_tokens(path.removesuffix(".tiktoken") + ".json")
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=lambda t: (-len(t), t)))) + ")") if self.special else None
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache = UnitCache(bpe.encode_ordinary)
        ends = re.compile(rb"[.!?\n][\"')\]]*\s*$")
        self.sentence_end = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, bool)
        self.sentence_end[[*(i for t, i in ranks.items() if ends.search(t)), *self.special.values()]] = True

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; added tokens that stand in a text are one id, and what is between them is encoded by itself."""
        if self.split is None:
            return self.plain(texts)
        held = pc.match_substring_regex(texts, "|".join(map(re.escape, self.special))).to_numpy(zero_copy_only=False)
        if not held.any():
            return self.plain(texts)
        pieces = [self.split.split(t) if h else [t] for t, h in zip(texts.to_pylist(), held.tolist())]
        flat = self.plain(pa.array([p for some in pieces for p in some[::2]], pa.large_string()))
        out, at = [], 0
        for some in pieces:
            ids = [flat[at]]
            for k, token in enumerate(some[1::2], 1):
                ids += [np.array([self.special[token]], np.uint32), flat[at + k]]
            at += len(ids) // 2 + 1
            out.append(np.concatenate(ids))
        return out

    def plain(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, without regard to added tokens."""
        raw, at = text_bytes(texts)
        if not len(raw):
            return [np.zeros(0, np.uint32)] * len(texts)
        begins = np.zeros(len(raw), bool)
        kind, shown = KIND[raw], VISIBLE[raw[1:]]
        inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
        shown[inner - 1] = False  # what follows is another text
        begins[:-1] = (kind[:-1] == 1) & shown  # before a blank and what follows it
        begins[1:] |= (kind[:-1] == 2) & shown  # between a line end or tab and what follows it
        begins[:-1] |= (kind[:-1] == 2) & shown
        begins[1:] |= (kind[:-1] == 3) & (kind[1:] == 4)  # between a letter and a mark
        begins[at[:-1][at[:-1] < at[1:]]] = True
        begins = np.append(np.flatnonzero(begins), len(raw))
        units = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
        made = [self.cache[u] for u in units.dictionary.to_pylist()]
        size = np.array([len(x) for x in made], np.int64) // 4
        pool, where = np.frombuffer(b"".join(made), "<u4"), np.cumsum(size) - size
        codes = units.indices.to_numpy()
        n = size[codes]
        ends = np.cumsum(n)
        ids = pool[np.arange(ends[-1]) + np.repeat(where[codes] - (ends - n), n)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(begins, at)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def ids(self, text: str) -> np.ndarray:
        return self.batch(text_column(pa.array([text])))[0]


_encoders: dict[tuple, Encoder] = {}


def encoder(*key: str | None) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def cut_windows(places: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For cuts at increasing places (the first is 0): least cost of a packing that ends at each, and its previous cut.

    The cost of a window of n tokens is window - n plus the penalty of the cut at its
    end.  Neighbouring cuts are at most window apart.
    """
    at, extra = places.tolist(), penalties.tolist()
    cost, back = [0.0] * len(at), [0] * len(at)
    queue = deque([(0, 0.0, 0)])  # place, cost + place and number of the cuts in reach; the first two increase
    for j in range(1, len(at)):
        here = at[j]
        reach = here - window
        while queue[0][0] < reach:
            queue.popleft()
        _, least, back[j] = queue[0]
        cost[j] = total = least + window - here + extra[j]
        total += here
        while queue and queue[-1][1] >= total:
            queue.pop()
        queue.append((here, total, j))
    return np.array(cost), np.array(back)


class Packer:
    """Collects documents' ids and gives back pieces, block by block, in order."""

    def __init__(self, sentence_end: np.ndarray, window: int, base: int):
        self.sentence_end, self.window, self.sequence = sentence_end, window, base
        self.docs: list[tuple[object, np.ndarray, int]] = []  # id, its ids, tokens of it that are packed
        self.held = 0

    def add(self, doc: object, ids: np.ndarray) -> None:
        self.docs.append((doc, np.append(ids, np.uint32(END)).astype("<u4"), 0))
        self.held += len(ids) + 1

    def flush(self, last: bool) -> Iterator[tuple]:
        """Pieces of all windows but the last one, which more documents may fill; of all if last."""
        if not self.held:
            return
        lengths = np.array([len(ids) - done for _, ids, done in self.docs])
        ends = np.cumsum(lengths)
        marks = [np.zeros(1, np.int64), ends]
        cost = [np.zeros(1), np.zeros(len(ends))]
        begin = ends - lengths
        for (_, ids, done), b in zip(self.docs, begin):
            inner = np.flatnonzero(self.sentence_end[np.minimum(ids[done:-1], len(self.sentence_end) - 1)]) + 1 + b
            marks.append(inner)
            cost.append(np.full(len(inner), float(SENTENCE_PENALTY)))
        places = np.concatenate(marks)
        penalties = np.concatenate(cost)
        order = np.lexsort((penalties, places))
        places, penalties = places[order], penalties[order]
        first = np.concatenate([[True], places[1:] != places[:-1]])
        places, penalties = places[first], penalties[first]
        step = min(HARD_STEP, self.window)
        wide = np.flatnonzero(np.diff(places) > step)
        if len(wide):
            hard = np.concatenate([np.arange(places[i] + step, places[i + 1], step) for i in wide])
            places, penalties = np.concatenate([places, hard]), np.concatenate([penalties, np.full(len(hard), float(HARD_PENALTY))])
            order = np.argsort(places, kind="stable")
            places, penalties = places[order], penalties[order]
        _, back = cut_windows(places, penalties, self.window)
        cuts = []
        j = len(places) - 1
        while j:
            cuts.append(int(places[j]))
            j = int(back[j])
        cuts.reverse()
        if not last:
            cuts = cuts[:-1]
        i = 0
        done = [d for _, _, d in self.docs]
        start = 0
        for cut in cuts:
            offset = 0
            while start < cut:
                doc, ids, _ = self.docs[i]
                take = min(cut - start, len(ids) - done[i])
                piece = ids[done[i] : done[i] + take]
                yield doc, done[i], take, zlib.crc32(piece.tobytes()), len(ids), self.sequence, offset
                done[i] += take
                start += take
                offset += take
                if done[i] == len(ids):
                    i += 1
            self.sequence += 1
        self.docs = [(doc, ids, d) for (doc, ids, _), d in zip(self.docs[i:], done[i:])]
        self.held -= start


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each input partition is packed in its own order without a shuffle; a
    sequence_id is its partition's number times 2**33 plus a count.  A null or empty
    text is the end token alone; a text longer than the window spans sequences;
    repeated rows and rows with null ids are packed as often as they occur; an empty
    table gives no pieces.  The programme is optimal over each run of BLOCK_TOKENS
    tokens and what its predecessor left open, not over the whole stream.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = encoder(tokenizer, folder)
        packer = Packer(made.sentence_end, window, TaskContext.get().partitionId() << 33)

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            got = list(packer.flush(last))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got)], names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            for part in chunks(batch, size=CHUNK):
                for doc, ids in zip(part.column("doc_id").to_pylist(), made.batch(text_column(part.column("text")))):
                    packer.add(doc, ids)
                    if packer.held >= BLOCK_TOKENS:
                        yield from rows(False)
        yield from rows(True)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)
