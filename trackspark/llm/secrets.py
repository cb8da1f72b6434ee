"""Secret scans by a trigram index, with DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams (Cox 2012): any
text that matches holds, for one of its alternatives, all of that alternative's
trigrams.  The index holds postings (trigram, document) for the rules' trigrams;
postings are intersected by document, and only candidates are verified with the
expression itself.  A rule without mandatory trigrams scans all texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as sre  # type: ignore[attr-defined]
from re import _parser as sre_parser  # type: ignore[attr-defined]

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrow

#: Alternatives of one expression that are told apart; beyond them a part counts as unknown.
MOST = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression that Java and Python read alike, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    #: What to look for instead where it surely gives the same spans after the length filter.
    scan: str | None = None


BASE_RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


def _strings(tokens, fold_limit: int = MOST) -> list[set[str] | None]:
    """The parts of a parsed expression in order: a set of all lower-case strings a part can be, or None where unknown."""
    parts: list[set[str] | None] = []
    for op, arg in tokens:
        if op is sre.LITERAL:
            parts.append({chr(arg).lower()})
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, x in arg:
                if chars is None:
                    break
                if kind is sre.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < 8:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
            parts.append(chars if chars and len(chars) <= 8 else None)
        elif op is sre.SUBPATTERN:
            inner = _join(_strings(arg[3]))
            parts += inner
        elif op is sre.BRANCH:
            whole: set[str] | None = set()
            for branch in arg[1]:
                inner = _join(_strings(branch))
                if whole is None or len(inner) > 1 or (inner and inner[0] is None):
                    whole = None
                else:
                    whole |= inner[0] if inner else {""}
            parts.append(whole if whole is not None and len(whole) <= fold_limit else None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            inner = _join(_strings(body))
            if high == 1 and len(inner) == 1 and inner[0] is not None:
                parts.append(inner[0] | {""} if low == 0 else inner[0])
            elif low == 0:
                parts.append(None)
            else:
                parts += [*inner, None]
        elif op is sre.AT:
            continue
        else:
            parts.append(None)
    return parts


def _join(parts: list[set[str] | None]) -> list[set[str] | None]:
    """Neighbouring known parts as one, while their combinations are few."""
    out: list[set[str] | None] = []
    for part in parts:
        if part is not None and out and out[-1] is not None and len(out[-1]) * len(part) <= MOST:
            out[-1] = {a + b for a, b in product(out[-1], part)}
        else:
            out.append(part)
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """All of these must hold: of each inner list one set of trigrams, whole.  Empty if nothing is mandatory."""
    query = []
    for part in _join(_strings(sre_parser.parse(pattern))):
        if part is None or any(len(x) < 3 for x in part):
            continue
        options = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in part}
        query.append(sorted((o for o in options if not any(p < o for p in options)), key=sorted))
    return query


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """All trigrams of the rules' queries."""
    return sorted({t for r in rules for options in trigram_query(r.pattern) for o in options for t in o})


def leads(rules: tuple[Rule, ...] = RULES) -> dict[str, set[str]]:
    """Of each trigram, the first trigrams of the alternatives that hold it: it matters only where one of them stands."""
    out: dict[str, set[str]] = {}
    for rule in rules:
        for options in trigram_query(rule.pattern):
            for o in options:
                for t in o:
                    out.setdefault(t, set()).add(min(o))
    return out


def postings(docs: DataFrame, rules: tuple[Rule, ...], trigrams: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """The index: a row (trigram number, doc_id) for each of the trigrams that a text holds in either case.

    Trigrams are looked for only where the first one of an alternative that holds them
    has been found, so most texts are searched for the first ones alone.
    """
    low = docs.select(F.col(key).alias("doc_id"), F.lower(text).alias("low"))
    of = leads(rules)
    heads = sorted({h for some in of.values() for h in some})
    low = low.select("doc_id", "low", *(F.contains("low", F.lit(h)).alias(f"h{i}") for i, h in enumerate(heads)))
    place = {h: F.col(f"h{i}") for i, h in enumerate(heads)}

    def posted(i: int, t: str) -> Column:
        if t in place:
            return F.when(place[t], F.lit(i))
        some = F.lit(False)
        for h in sorted(of[t]):
            some = some | place[h]
        return F.when(some, F.when(F.contains("low", F.lit(t)), F.lit(i)))

    held = F.array_compact(F.array(*(posted(i, t) for i, t in enumerate(trigrams))))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], trigrams: list[str]) -> DataFrame:
    """doc_id and a mask of the rules whose query its postings fulfil, where any does."""
    if len(rules) > 60:
        raise ValueError("a mask holds 60 rules at most")
    words = -(-len(trigrams) // 60)  # bits that are used of each long
    number = {t: i for i, t in enumerate(trigrams)}
    masks = [F.coalesce(F.bit_or(F.when(F.floor(F.col("trigram") / 60) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("trigram") % 60).cast("int")))), F.lit(0)).alias(f"m{w}") for w in range(words)]
    docs = index.groupBy("doc_id").agg(*masks)

    def holds(need: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in range(words):
            bits = sum(1 << number[t] % 60 for t in need if number[t] // 60 == w)
            if bits:
                out = out & (F.col(f"m{w}").bitwiseAND(F.lit(bits).cast("long")) == F.lit(bits).cast("long"))
        return out

    mask = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if query:
            fulfilled = F.lit(True)
            for options in query:
                one = F.lit(False)
                for o in options:
                    one = one | holds(o)
                fulfilled = fulfilled & one
            mask = mask + F.when(fulfilled, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return docs.select("doc_id", mask.alias("rules")).filter("rules <> 0")


#: Elements that one array of a fold collects; longer results are arrays of such arrays.
FOLDED = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _fold(rows: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """Fields at and out: a fold of rows by step(at, row), which gives the next at (from 0) and an out of type kind or null; outs come as an array.

    Arrays that grow are copied at each step, so outs are collected FOLDED rows at a
    time: work is nearly in proportion to the rows and not to their square.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(seen: Column, x: Column) -> Column:
        return _let(step(seen["at"], x), lambda s: F.struct(s["at"].alias("at"), F.when(s["out"].isNotNull(), F.concat(seen["out"], F.array(s["out"]))).otherwise(seen["out"]).alias("out")))

    def some(seen: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(seen["at"].alias("at"), none.alias("out")), one)
        return _let(inner, lambda s: F.struct(s["at"].alias("at"), F.concat(seen["out"], F.array(s["out"])).alias("out")))

    def whole(r: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / FOLDED).cast("int")), lambda i: F.slice(r, i * FOLDED + 1, FOLDED))
        parts = F.when(F.size(r) > 0, parts)
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.coalesce(F.aggregate(parts, start, some, lambda s: F.struct(s["at"].alias("at"), F.flatten(s["out"]).alias("out"))), F.struct(F.lit(0).alias("at"), none.alias("out")))

    return _let(rows, whole)


SPAN = "struct<start:int,order:int,end:int,kind:string>"


def matches(text: Column, rule: Rule, order: int) -> Column:
    """Spans (start, order, end, kind) of a rule's leftmost non-overlapping matches that are long enough; code points, end exclusive.

    The pieces between matches and the matches themselves, both from left to right,
    add up to the positions.
    """
    pattern = rule.scan or rule.pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    row = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("found"), tested.alias("tested"))

    def step(at: Column, x: Column) -> Column:
        start = at + F.length(x["piece"])
        end = start + F.length(x["found"])
        span = F.struct(start.cast("int").alias("start"), F.lit(order).alias("order"), end.cast("int").alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(F.coalesce(end, at).cast("int").alias("at"), F.when(F.length(x["tested"]) >= rule.least, span).alias("out"))

    return _fold(row, step, SPAN)["out"]


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then the rules' order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """doc_id, text (null: empty), kept (the columns keep in a struct, whatever their names), and found: the spans of all rules, of every row.

    Candidates come from the trigram index; repeated ids share their postings, which
    can only add candidates.  A null id has postings of its own.
    """
    trigrams = vocabulary(rules)
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), _packed(keep))
    hits = materialize(candidates(postings(base, rules, trigrams), rules, trigrams), "candidates")
    hits = hits.select(F.col("doc_id").alias("_hit"), F.col("rules").alias("_rules"))
    rows = base.join(narrow(hits), F.col("doc_id").eqNullSafe(F.col("_hit")), "left")
    empty = F.array().cast(f"array<{SPAN}>")
    parts = []
    for i, rule in enumerate(rules):
        wanted = F.col("_rules").bitwiseAND(F.lit(1 << i).cast("long")) != 0 if trigram_query(rule.pattern) else F.lit(True)
        wanted = wanted & F.col("text").rlike(rule.scan or rule.pattern)
        parts.append(F.when(wanted, matches(F.col("text"), rule, i)).otherwise(empty))
    return rows.select("doc_id", "text", "kept", F.concat(*parts).alias("found"))


def _packed(keep: tuple[str, ...] | list[str]) -> Column:
    return (F.struct(*keep) if keep else F.lit(None).cast("boolean")).alias("kept")


def report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans as text; no secrets are no spans."""
    found = find_secrets(docs, text, key)

    def count(order: int) -> Column:
        return F.size(F.filter("found", lambda s: s["order"] == order)).cast("long")

    base = F.filter("found", lambda s: s["order"] < len(BASE_RULES))
    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", mark: str = "[SECRET]", keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """doc_id, the columns keep, and text with every maximal run of overlapping spans replaced by mark."""
    found = find_secrets(docs, text, key, keep=keep)

    def step(at: Column, s: Column) -> Column:
        gap = F.col("text").substr(at + 1, s["start"] - at)
        return F.struct(F.greatest(at, s["end"]).alias("at"), F.when(s["start"] >= at, F.concat(gap, F.lit(mark))).alias("out"))

    done = _let(_fold(F.array_sort("found"), step, "string"), lambda s: F.concat(F.array_join(s["out"], ""), F.col("text").substr(s["at"] + 1, F.length("text"))))
    return found.select("doc_id", *(["kept.*"] if keep else []), F.when(F.size("found") > 0, done).otherwise(F.col("text")).alias("text"))
