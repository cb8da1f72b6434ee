"""Conversation repair: cheapest edits to a legal order of roles by a rank-compressed dynamic programme that also runs in pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a piece of a conversation; a longer one is solved piece by piece.
PIECE_ROWS = 256
#: Rows that a task gathers before it solves the conversations that are complete.
_BLOCK = 2048

BLANKS = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: States of the repaired roles so far: nothing; a system turn; after a user; after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Macro edits, an inserted turn or none and what becomes of the row, in the order of their codes; no code begins another.
MACROS = ("D", "ID", "IK", "IR", "K", "R")
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # after an inserted or rerolled turn
_KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}  # by the row's kind
_KINDS = "sua"
#: Bits of a row's mark beside its kind (0 to 3).
_BLANK, _DUPLICATE, _OPEN_END = 4, 8, 16
_NEVER = 1 << 40


def _transitions() -> list[list[tuple[int, int, int, int | None]]]:
    """For each state the ways into it: state before, macro, cost without that of an open end, kind of row that it needs (3: any).

    Runs of two inserted turns are left out: from a user or assistant state they lead
    back to it, from the start to a state from which no more is legal than from the
    start, and after a system turn to what deleting that turn gives for less.
    """
    into: list[list[tuple[int, int, int, int | None]]] = [[] for _ in range(4)]
    for p in range(4):
        for inserted in (False, True):
            at, cost = (_NEXT[p], INSERT) if inserted else (p, 0)

            def macro(letter: str) -> int:
                return MACROS.index("I" * inserted + letter)

            into[at].append((p, macro("D"), cost + DELETE, None))
            into[_NEXT[at]].append((p, macro("R"), cost + REROLE, 3))
            for kind in range(3):
                if (at, kind) in _KEPT:
                    into[_KEPT[at, kind]].append((p, macro("K"), cost + KEEP, kind))
    return into


_INTO = _transitions()


def forward(marks: np.ndarray, sizes: np.ndarray, entries: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs and ranks [piece, entry, state] of the best edits of all pieces at once, and pointers [piece, row, entry, state].

    marks holds a piece a line, padded; pieces are in the order of falling size.  In each
    layer a state keeps its cost, the rank of its audit text among those of the layer
    (codes are prefix-free, so texts compare by their parents' ranks and then by code),
    and a pointer of macro and state before; no text is kept.
    """
    n, length = marks.shape
    cost = np.full((n, len(entries), 4), _NEVER, np.int64)
    for e, state in enumerate(entries):
        cost[:, e, state] = 0
    rank = np.zeros_like(cost)
    pointers = np.zeros((n, length, len(entries), 4), np.uint8)
    for i in range(length):
        m = int(np.searchsorted(-sizes, -i))  # pieces of more than i rows
        mark = marks[:m, i]
        stays = (mark & (_BLANK | _DUPLICATE)) == 0
        ending = np.where(mark & _OPEN_END, TRUNCATED, 0)
        extra = {None: np.zeros(m, np.int64), 3: np.where(stays, ending, _NEVER)} | {k: np.where(stays & ((mark & 3) == k), ending, _NEVER) for k in range(3)}
        before = (cost[:m] << 8) + (rank[:m] << 5) + np.arange(4)
        keys = np.stack([np.minimum.reduce([before[:, :, p] + ((extra[kind][:, None] + c) << 8) + (code << 2) for p, code, c, kind in ways]) for ways in _INTO], axis=-1)
        cost[:m] = np.minimum(keys >> 8, _NEVER)
        pointers[:m, i] = keys & 31
        text = np.where(cost[:m] < _NEVER, (keys >> 2) & 63, 64)
        rank[:m] = (text[..., None, :] < text[..., :, None]).sum(-1)
    return cost, rank, pointers


def trace(pointers: np.ndarray, sizes: np.ndarray, states: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Audit texts of pieces [piece, row, state] that end in states, and the states they begin in; pieces by falling size."""
    n, length, _ = pointers.shape
    states, codes = states.copy(), np.zeros((n, length), np.uint8)
    for i in reversed(range(length)):
        m = int(np.searchsorted(-sizes, -i))
        got = pointers[np.arange(m), i, states[:m]]
        codes[:m, i], states[:m] = got >> 2, got & 3
    return ["".join([MACROS[c] for c in line[:size]]) for line, size in zip(codes.tolist(), sizes.tolist())], states


def last_edit(cost: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost, state and whether a turn is inserted at the end, of the best legal ending [piece, state]: nothing, or a last assistant turn."""
    key = (cost << 8) + (rank << 5) + np.arange(4)
    key[:, SYSTEM] = _NEVER << 9
    key[:, USER] += INSERT << 8
    best = key.min(axis=1)
    return best >> 8, best & 3, (best & 3) == USER


def apply_audit(audit: str, roles: list[str], texts: list[str], state: int = START) -> list[tuple[str, str]]:
    """The repaired turns of rows under their audit text."""
    rows, out = iter(zip(roles, texts)), []
    for letter in audit:
        if letter == "I":
            out.append(("assistant" if state == USER else "user", ""))
            state = _NEXT[state]
            continue
        role, text = next(rows)
        if letter == "K":
            out.append((role, text))
            state = _KEPT[state, _KINDS.index(role[:1])]
        elif letter == "R":
            out.append(("assistant" if state == USER else "user", text))
            state = _NEXT[state]
    return out


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present of rows with faults put in by CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row (present is false), 1 empties its text, 2 takes out full stops,
    exclamation and question marks, 3 repeats it, 4 makes its role user.  Nulls are one
    space each; conv_id and turn stay null.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text = F.coalesce("text", blank)
    hit = F.col("hit")
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("hit"))
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (hit != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(hit == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TOTALS = ", ".join(f"{c} long" for c in TOTALS)
_PLACE = "conv_id long, part int, seq int"
_CUT = f"{_PLACE}, whole boolean, audit string, roles array<string>, texts array<string>, marks binary, tells array<binary>, first_turn long, last_turn long, turns long, {_TOTALS}"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _marked(rows: DataFrame, present: str | None) -> DataFrame:
    """Rows with what the cut needs: mark (kind, blank, open end) and a digest that tells a conversation's rows apart."""
    blank = F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.col(present) if present else F.lit(True)).alias("present"))
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    kind = F.coalesce(*(F.when(F.substring("role", 1, 1) == letter, i) for i, letter in enumerate(_KINDS)), F.lit(3))
    mark = kind + F.when(end == "", _BLANK).otherwise(0) + F.when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(_OPEN_END)
    tell = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.length("role").cast("string"), F.concat("role", "text")), 256))
    text = F.when(F.col("present"), F.col("text")).otherwise("")
    return rows.select("conv_id", "turn", "role", text.alias("text"), "present", mark.cast("int").alias("mark"), tell.alias("tell"), F.monotonically_increasing_id().alias("spread"))


def _padded(marks: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.uint8)
    line = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[line, place] = marks[np.repeat(begins, sizes) + place]
    return out


def _illegal(marks: np.ndarray) -> int:
    """Neighbours whose kinds are not system-user, user-assistant or assistant-user."""
    kinds = marks & 3
    pair = kinds[:-1] * 4 + kinds[1:]
    return int((~np.isin(pair, (1, 6, 9))).sum())


def _turns(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    """First, last and number of different turns of rows in order, without nulls."""
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None or last is None else last - first + 1 - turns


def _cutter(piece_rows: int):
    """Cuts a task's sorted rows into conversations; those that are whole and short are solved, the rest goes on in pieces."""

    def solve(table: pa.Table, part: int, seq: int, opened: bool, closing: bool) -> pa.RecordBatch:
        here = table.column("present").to_numpy()
        ids, known = table.column("conv_id").fill_null(0).to_numpy(), ~table.column("conv_id").is_null().to_numpy()
        fresh = np.append(True, (ids[1:] != ids[:-1]) | (known[1:] != known[:-1]))
        owner = np.cumsum(fresh) - 1
        table = table.filter(pa.array(here))
        owner_of, count = owner[here], int(owner[-1]) + 1
        begin = np.searchsorted(owner_of, np.arange(count + 1))
        pieces: list[tuple[int, int, int, bool]] = []  # conversation, begin, end, whole
        for c in range(count):
            low, high = int(begin[c]), int(begin[c + 1])
            whole = high - low <= piece_rows and not (c == 0 and opened) and not (c == count - 1 and closing)
            pieces += [(c, k, min(k + piece_rows, high), whole) for k in range(low, max(high, low + 1), piece_rows)]
        marks = table.column("mark").to_numpy().astype(np.uint8)
        tells, turns = table.column("tell").to_pylist(), table.column("turn").to_pylist()
        seen: set[bytes] = set()
        for i, tell in enumerate(tells):
            if tell in seen and not marks[i] & _BLANK:
                marks[i] |= _DUPLICATE
            seen.add(tell)
        values = [(int(ids[f]) if known[f] else None) for f in np.flatnonzero(fresh)]
        done: dict[int, tuple] = {}
        whole = sorted((p for p in range(len(pieces)) if pieces[p][3]), key=lambda p: pieces[p][1] - pieces[p][2])
        if whole:
            begins, sizes = np.array([pieces[p][1] for p in whole]), np.array([pieces[p][2] - pieces[p][1] for p in whole])
            cost, rank, pointers = forward(_padded(marks, begins, sizes), sizes, (START,))
            least, state, tail = last_edit(cost[:, 0], rank[:, 0])
            audits, _ = trace(pointers[:, :, 0], sizes, state)
            done = {p: (audit + "I" * bool(t), int(c)) for p, audit, t, c in zip(whole, audits, tail, least)}
        out: list[tuple] = []
        for p, (c, low, high, _) in enumerate(pieces):
            own = marks[low:high]
            first, last, different = _turns(turns[low:high])
            faults = [int(((own & (_BLANK | _DUPLICATE | _OPEN_END if k == 2 else m)) == m).sum()) for k, m in enumerate((_BLANK, _DUPLICATE, _OPEN_END))]
            if p in done:
                out.append((values[c], part, seq + p, True, done[p][0], None, None, first, last, different, _gaps(first, last, different), *faults, _illegal(own), done[p][1]))
            else:
                told = [t if not m & (_BLANK | _DUPLICATE) else None for t, m in zip(tells[low:high], own.tolist())]
                out.append((values[c], part, seq + p, False, None, own.tobytes(), told, first, last, different, None, None, None, None, None, None))
        offsets = pa.array([p[1] for p in pieces] + [pieces[-1][2]], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, table.column(c).combine_chunks().cast(pa.string())) for c in ("role", "text")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.binary(), pa.list_(pa.binary())] + [pa.int64()] * 9
        columns = [pa.array(v, k) for v, k in zip(zip(*out), kinds)]
        return pa.record_batch([*columns[:5], *lists, *columns[5:]], _names(_CUT))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, opened = TaskContext.get().partitionId(), 0, True  # type: ignore[union-attr]
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < max(_BLOCK, piece_rows):
                continue
            ids = held.column("conv_id")
            last_id = ids[-1].as_py()
            values, known = ids.fill_null(0).to_numpy(), ~ids.is_null().to_numpy()
            other = np.flatnonzero((values != (last_id or 0)) | (known != (last_id is not None)))
            until = int(other[-1]) + 1 if len(other) else 0
            if until:  # the last conversation may go on
                yield (made := solve(held.slice(0, until), part, seq, opened, False))
                seq, opened, held = seq + made.num_rows, False, held.slice(until)
            if held.num_rows >= piece_rows:
                yield (made := solve(held, part, seq, True, True))
                seq, opened, held = seq + made.num_rows, True, None
        if held is not None and held.num_rows:
            yield solve(held, part, seq, opened, True)

    return cut


_SOLVED = f"{_PLACE}, marks binary, first_turn long, last_turn long, turns long, costs array<long>, ranks array<int>, pointers binary"


def _solve_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs and ranks of each open piece from every state to every state, with its rows that repeat earlier pieces marked."""
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [np.frombuffer(m, np.uint8).copy() for m in batch.column("marks").to_pylist()]
        for m, again in zip(marks, batch.column("again").to_pylist()):
            m[np.array(again or [], np.int64)] |= _DUPLICATE
        sizes = np.array([len(m) for m in marks])
        order = np.argsort(-sizes, kind="stable")
        cost, rank, pointers = forward(_padded(np.concatenate([marks[i] for i in order]), np.cumsum(sizes[order]) - sizes[order], sizes[order]), sizes[order], (START, SYSTEM, USER, ASSISTANT))
        back = np.argsort(order)
        columns = {c: batch.column(c) for c in ("conv_id", "part", "seq", "first_turn", "last_turn", "turns")}
        columns["marks"] = pa.array([m.tobytes() for m in marks], pa.binary())
        columns["costs"] = pa.array(cost[back].reshape(len(sizes), 16).tolist(), pa.list_(pa.int64()))
        columns["ranks"] = pa.array(rank[back].reshape(len(sizes), 16).tolist(), pa.list_(pa.int32()))
        columns["pointers"] = pa.array([pointers[k, :size].tobytes() for k, size in zip(back, sizes)], pa.binary())
        yield pa.record_batch([columns[c] for c in _names(_SOLVED)], _names(_SOLVED))


_SCANNED = f"{_PLACE}, back array<int>, state int, tail boolean, {_TOTALS}"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece of a conversation in order, the state before it for each state after it; totals and the end with its last piece.

    What is carried from piece to piece is four costs and ranks and a few numbers.
    """

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def scanned() -> Iterator[tuple]:
        for conv, pieces in groupby(rows(), key=lambda r: r["conv_id"]):
            cost, rank = [0, _NEVER, _NEVER, _NEVER], [0, 1, 2, 3]
            first = last = before = waiting = None
            turns = illegal = 0
            faults = np.zeros(3, np.int64)
            for r in pieces:
                if waiting:
                    yield (*waiting, None, None, *[None] * len(TOTALS))
                best = [min((cost[e] + r["costs"][4 * e + t], rank[e], e) for e in range(4)) for t in range(4)]
                text = [(b[1], r["ranks"][4 * b[2] + t]) if b[0] < _NEVER else (4, t) for t, b in enumerate(best)]
                cost, rank = [min(b[0], _NEVER) for b in best], [sum(x < y for x in text) for y in text]
                waiting = (conv, r["part"], r["seq"], [b[2] for b in best])
                marks = np.frombuffer(r["marks"], np.uint8)
                if len(marks):
                    illegal += _illegal(marks if before is None else np.append(np.uint8(before), marks))
                    before = marks[-1]
                faults += [((marks & _BLANK) > 0).sum(), ((marks & _DUPLICATE) > 0).sum(), ((marks & (_BLANK | _DUPLICATE | _OPEN_END)) == _OPEN_END).sum()]
                if r["first_turn"] is not None:
                    turns += r["turns"] - (last == r["first_turn"])
                    first, last = r["first_turn"] if first is None else first, r["last_turn"]
            least, state, tail = last_edit(np.array([cost]), np.array([rank]))
            yield (*waiting, int(state[0]), bool(tail[0]), _gaps(first, last, turns), *faults.tolist(), illegal, int(least[0]))  # type: ignore[misc]

    yield from _batched(scanned(), _SCANNED, [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.bool_()] + [pa.int64()] * len(TOTALS))


def _batched(rows: Iterator[tuple], schema: str, kinds: list[pa.DataType], size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], _names(schema))

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


_WALKED = f"part int, seq int, entry int, state int, tail boolean, {_TOTALS}"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the last piece of each conversation to its first: the states before and after each piece."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def walked() -> Iterator[tuple]:
        for _, pieces in groupby(rows(), key=lambda r: r["conv_id"]):
            state = None
            for r in pieces:
                state = r["state"] if state is None else state
                entry = r["back"][state]
                yield (r["part"], r["seq"], entry, state, bool(r["tail"]), *(r[c] for c in TOTALS))
                state = entry

    yield from _batched(walked(), _WALKED, [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()] + [pa.int64()] * len(TOTALS))


_AUDITED = f"part int, seq int, entry int, audit string, {_TOTALS}"


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit texts of open pieces from their pointers, between the states that the walk found."""
    for batch in batches:
        audits = []
        for pointers, entry, state, tail in zip(*(batch.column(c).to_pylist() for c in ("pointers", "entry", "state", "tail"))):
            lines = np.frombuffer(pointers, np.uint8).reshape(1, -1, 4, 4)[:, :, entry]
            audits.append(trace(lines, np.array([lines.shape[1]]), np.array([state]))[0][0] + "I" * tail)
        yield pa.record_batch([batch.column("part"), batch.column("seq"), batch.column("entry"), pa.array(audits, pa.string()), *(batch.column(c) for c in TOTALS)], _names(_AUDITED))


_PIECE = ("conv_id", "part", "seq", "whole", "entry", "audit", "roles", "texts", *TOTALS)


def repair(rows: DataFrame, present: str | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Pieces of repaired conversations: conv_id, part, seq (their order), whole, entry, audit, roles, texts, totals.

    Of rows (conv_id, turn, role, text) each conversation is taken by turn, nulls first,
    rows of one turn by a digest.  A row's first fault counts: blank, duplicate (role and
    text stood earlier), truncated (no ``.``, ``!`` or ``?`` at its end).  The cheapest
    edits give roles ``(s?(ua)+)?`` by their first letters: Keep 0, Rerole 1, Delete 2 (blank and
    duplicate rows must go), Insert 5, and 5 for each truncated row that stays; of equal
    costs the least audit text wins.  gaps, blank, duplicate, truncated, illegal
    (neighbouring roles that may not follow each other) and cost are totals of a
    conversation, in its last piece and null in others.  roles and texts are the piece's
    rows; ``repaired_turns`` and ``digests`` apply the audit to them.  Rows whose
    present column is false only say that their conversation exists.

    Rows are range-partitioned by conversation, turn and digest and sorted once, so a
    conversation of a third of all rows is spread over tasks.  Conversations that lie
    within a task and piece_rows rows are solved there.  Others go on in pieces: repeats
    across pieces are found by digests; each piece gives the costs and ranks from every
    state to every state; one scan over these few numbers and one walk back fix the
    states at its ends; its audit text follows from its own pointers.

    Nulls in role and text count as one space; a null conv_id is a conversation of its
    own; other columns are ignored, whatever their names; an empty table gives no pieces.
    """
    marked = _marked(rows, present)
    order = ("conv_id", "turn", "tell", "spread")
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = materialize(dealt.drop("spread").mapInArrow(_cutter(piece_rows), _CUT), "cut")
    place = ["part", "seq"]
    cut_open = cut.filter("NOT whole")
    told = cut_open.select(*place, F.posexplode("tells").alias("at", "tell")).filter("tell IS NOT NULL")
    first = told.groupBy("tell").agg(F.min(F.struct(*place)).alias("first"))
    again = told.join(first, "tell").filter(F.struct(*place) > F.col("first")).groupBy(*place).agg(F.collect_list("at").alias("again"))
    solved = materialize(cut_open.select("conv_id", *place, "marks", "first_turn", "last_turn", "turns").join(again, place, "left").mapInArrow(_solve_open, _SOLVED), "solved")
    scanned = solved.drop("pointers").repartition("conv_id").sortWithinPartitions("conv_id", *place).mapInArrow(_scan, _SCANNED)
    walked = scanned.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq")).mapInArrow(_walk, _WALKED)
    audited = solved.select(*place, "pointers").join(walked, place).mapInArrow(_audit, _AUDITED)
    rest = cut_open.select("conv_id", *place, "whole", "roles", "texts").join(audited, place)
    return cut.filter("whole").withColumn("entry", F.lit(START)).select(*_PIECE).unionAll(rest.select(*_PIECE))


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """conv_id, part, seq, place, role, text: the repaired turns, in the order of part, seq and place within a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r["conv_id"], r["part"], r["seq"], i, *turn) for r in batch.to_pylist() for i, turn in enumerate(apply_audit(r["audit"], r["roles"], r["texts"], r["entry"]))]
            yield from _batched(iter(out), schema, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()])

    schema = f"{_PLACE}, place int, role string, text string"
    return pieces.select("conv_id", "part", "seq", "entry", "audit", "roles", "texts").mapInArrow(run, schema)


_DIGEST = f"conv_id long, {_TOTALS}, audit string, repaired_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its pieces in order; a piece's turns go through the digest as they come."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def digested() -> Iterator[tuple]:
        for conv, pieces in groupby(rows(), key=lambda r: r["conv_id"]):
            digest, audits, between, totals = hashlib.sha256(), [], b"", [0] * len(TOTALS)
            for r in pieces:
                audits.append(r["audit"])
                if turns := apply_audit(r["audit"], r["roles"], r["texts"], r["entry"]):
                    digest.update(between + "\n".join(f"{role}:{text}" for role, text in turns).encode())
                    between = b"\n"
                totals = totals if r["cost"] is None else [r[c] for c in TOTALS]
            yield (conv, *totals, "".join(audits), digest.hexdigest())

    yield from _batched(digested(), _DIGEST, [pa.int64()] * (1 + len(TOTALS)) + [pa.string()] * 2)


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, totals, audit and repaired_sha256 (of ``role:text`` lines) of each conversation of repair.

    Whole conversations need no shuffle.  The pieces of others meet in order in one
    task, which streams them: a digest of a text is sequential by its nature.
    """
    own = pieces.select("conv_id", "part", "seq", "whole", "entry", "audit", "roles", "texts", *TOTALS)
    rest = own.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return own.filter("whole").mapInArrow(_digest, _DIGEST).unionAll(rest.mapInArrow(_digest, _DIGEST))
