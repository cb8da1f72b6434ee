"""Resampling, conversation repair and license scans against plain programs, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trackspark.llm import conversations, licenses, queries, resample

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score long, part int, rank string, known int, label string, row int, template int, present int"


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def plain_words(text):
    return PLAIN.findall(lower(text))


def table(spark, texts, ids=None):
    """Texts beside columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, "y", 4, 5, 0) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


# resampling


def prose(r, n, size=40):
    words = [f"w{k}" for k in range(size)] + ["É", "naïve", "x" * 80, "A1"]
    return r.choice((" ", ", ", "\n")).join(r.choice(words) for _ in range(n))


def plain_resample(docs, target, percent, least_words, seed):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    source, wanted = Counter(f for _, t in docs for f in features(t)), Counter(f for t in target for f in features(t))
    all_s, all_t = sum(source.values()), sum(wanted.values())
    out = []
    for i, t in docs:
        own = features(t)
        gain = sum(math.floor(1000 * math.log((wanted[f] + 1) * (all_s + 10000) / ((source[f] + 1) * (all_t + 10000)))) for f in own)
        weight = gain // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r, (_, t) in zip(out, docs) if len(plain_words(t)) >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = place
    return sorted(map(tuple, out), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("percent,range_rows,run_rows", [(25, 1 << 17, 1 << 20), (60, 3, 7), (100, 10, 2), (0, 5, 5), (1, 1, 1)])
def test_resample_equals_a_plain_program(spark, monkeypatch, percent, range_rows, run_rows):
    r = random.Random(percent)
    texts = [prose(r, r.choice((0, 1, 2, 19, 20, 21, 60))) for _ in range(60)] + [None, "", " .,", prose(r, 3000)]
    docs = [(k * 7 % 61, t) for k, t in enumerate(texts)] + [(None, texts[5]), (None, prose(r, 40)), (3, texts[4]), (3, texts[4])]
    target = [prose(r, 30, 10) for _ in range(8)] + [None]
    monkeypatch.setattr(resample.sorted_runs, "__defaults__", (run_rows,))
    made = resample.resample(table(spark, [t for _, t in docs], [i for i, _ in docs]), table(spark, target), percent=percent, range_rows=range_rows)
    assert made.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(made) == plain_resample(docs, target, percent, 20, 7)


def test_resample_of_empty_tables(spark):
    some = table(spark, ["a b c " * 10] * 5)
    assert resample.resample(some.limit(0), some).count() == 0
    assert rows_of(resample.resample(some, some.limit(0), percent=50)) == plain_resample([(i, "a b c " * 10) for i in range(5)], [], 50, 20, 7)
    with pytest.raises(ValueError):
        resample.resample(some, some, percent=101)


def test_tournament_merges_sorted_runs():
    r = random.Random(3)
    for _ in range(200):
        runs = [sorted((r.randint(0, 5), r.randint(0, 3)) for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 9))]
        at, out = [0] * len(runs), []
        for k in resample.tournament(runs):
            out.append((runs[k][at[k]], k))
            at[k] += 1
        assert out == sorted((x, k) for k, run in enumerate(runs) for x in run)


# conversations


def plain_repair(rows):
    """All totals of one conversation's rows (turn, role, text) in order, by a programme over whole audit texts and lines."""
    blanks = " \t\n\v\f\r"
    seen, faults = set(), []
    for _, role, text in rows:
        t = text.rstrip(blanks)
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {0: (0, "", [])}

    def inserted(states):
        for _ in range(3):  # runs of up to three
            for q, (cost, audit, lines) in list(states.items()):
                new = (cost + 5, audit + "I", [*lines, "assistant:" if q == 2 else "user:"])
                yield after[q], new
                states = {after[q]: new}

    def least(options):
        out = {}
        for q, value in options:
            if q not in out or value[:2] < out[q][:2]:
                out[q] = value
        return out

    def all_inserted(states):
        found = [(q, v) for q, v in states.items()]
        for q, v in states.items():
            found += list(inserted({q: v}))
        return found

    for (_, role, text), fault in zip(rows, faults):
        options = []
        for q, (cost, audit, lines) in all_inserted(best):
            options.append((q, (cost + 2, audit + "D", lines)))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], q))
                if to is not None:
                    options.append((to, (cost + more, audit + "K", [*lines, f"{role}:{text}"])))
                options.append((after[q], (cost + 1 + more, audit + "R", [*lines, f"{'assistant' if q == 2 else 'user'}:{text}"])))
        best = least(options)
    cost, audit, lines = min(((v for q, v in all_inserted(best) if q in (0, 3))), key=lambda v: v[:2])
    turns = {t for t, _, _ in rows if t is not None}
    initials = [role[:1] for _, role, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def tell(conv, role, text):
    return hashlib.sha256(f"{' ' if conv is None else conv}:{len(role)}:{role}{text}".encode()).digest()


def expected(rows):
    """rows (conv_id, turn, role, text, present) by conversation."""
    groups = {}
    for conv, turn, role, text, present in rows:
        own = groups.setdefault(conv, [])
        if present:
            own.append((turn, " " if role is None else role, " " if text is None else text))
    out = [(c, *plain_repair(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, tell(c, r[1], r[2]))))) for c, own in groups.items()]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def talk(r, conv, n):
    texts = ["Fine.", "Why?", "No!", "cut off", "", " \t", "Long text. \n", "x" * 300 + ".", None, "é.", "ends. but"]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "usr", "tool", "", None, "User"]
    return [(conv, r.choice((k, k, k, k // 2, None)), r.choice(roles), r.choice((*texts, f"t{k}.")), r.random() > 0.1) for k in range(n)]


CONV = "conv_id long, turn long, role string, text string, present boolean, part int, seq int, audit string, cost long, tell string"


@pytest.mark.parametrize("piece_rows", [1, 2, 7, 256])
def test_repair_equals_a_plain_program(spark, piece_rows):
    r = random.Random(piece_rows)
    rows = [row for c in range(50) for row in talk(r, c, r.choice((1, 1, 2, 3, 6, 9, 14)))] + talk(r, None, 9) + talk(r, 77, 400) + talk(r, 78, 60)
    rows += [(90, 1, "user", "Hi.", False), (91, None, "assistant", "Yes.", True), (92, 5, "system", "Be kind.", True), *[(93, 2, "user", "Same.", True)] * 40]
    r.shuffle(rows)
    frame = spark.createDataFrame([(*row, 1, 2, "a", 3, "t") for row in rows], CONV).repartition(3)
    pieces = conversations.repair(frame, present="present", piece_rows=piece_rows)
    made = conversations.digests(pieces)
    assert rows_of(made.select("conv_id", *conversations.TOTALS, "audit", "repaired_sha256")) == expected(rows)


def test_repaired_turns_are_those_of_the_digest(spark):
    r = random.Random(8)
    rows = [row for c in range(12) for row in talk(r, c, 11)]
    pieces = conversations.repair(spark.createDataFrame([(*row, 1, 2, "a", 3, "t") for row in rows], CONV), present="present", piece_rows=4)
    lines = {}
    for t in conversations.repaired_turns(pieces).orderBy("part", "seq", "place").collect():
        lines.setdefault(t["conv_id"], []).append(f"{t['role']}:{t['text']}")
    for d in conversations.digests(pieces).collect():
        own = lines.get(d["conv_id"], [])
        assert hashlib.sha256("\n".join(own).encode()).hexdigest() == d["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in own))


def test_damage_by_the_hash_of_conversation_and_turn(spark):
    rows = [(c, t, r, x) for c in range(40) for t, r, x in ((0, "system", "A. b!"), (None, None, None), (3, "assistant", "q? end."))]
    made = conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = []
    for c, t, role, text in rows:
        hit = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        want += [(c, t, "user" if hit == 4 else role, text, hit != 0)] * (2 if hit == 3 else 1)
    assert rows_of(made) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert {h for h in (zlib.crc32(f"{c}:0".encode()) % 20 for c in range(40))} >= {0, 1, 2, 3, 4}


def test_repair_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.digests(conversations.repair(none)).count() == 0
    lone = spark.createDataFrame([(1, 1, "user", "A very long turn " * 40_000 + ".")], "conv_id long, turn long, role string, text string")
    got = conversations.digests(conversations.repair(lone)).first()
    assert (got["audit"], got["cost"]) == ("D", 2)


# licenses


def plain_bases(text):
    w = plain_words(text)
    out = []
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        out += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    return len(w), len(out), min(out)[0] if out else None, max(out)[0] if out else None, ",".join(sorted({label for _, label in out}))


NOTICE = dict(reversed(licenses.NOTICES))


def test_licenses_equal_a_plain_program(spark):
    r = random.Random(2)
    bits = ["under the MIT license", "Apache License, Version 2", "CC BY-NC", "under the", "license", "mit", "cc", "by", "nc", "É", "apache license version", "word"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(80)]
    texts += [None, "", " ,", "under the mit", "Under\tTHE mit-License", "under the mit license " * 3000, "cc by nc"]
    frame = table(spark, texts, [*range(len(texts) - 1), None])
    made = {r["doc_id"]: r for r in licenses.scan(frame).collect()}
    assert len(made) == len(texts)
    for i, t in zip([*range(len(texts) - 1), None], texts):
        got = made[i]
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == plain_bases(t), t
        assert set(filter(None, got["base_labels"].split(","))) <= set(got["labels"].split(",")) and 0 <= got["score"] <= 1
        assert (got["score"] == 1) >= bool(got["n_base"])


def test_notices_are_found_when_slightly_edited_and_clean_texts_left_alone(spark):
    mit, bsd = NOTICE["mit"].split(), NOTICE["bsd"]
    edited = [*mit[:9], "hereby", *mit[9:20], *mit[21:30], "other", *mit[31:]]
    texts = {
        "mit": "some words before " + " ".join(edited) + " and after",
        "bsd": "x " * 500 + bsd.upper(),
        "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
        "gpl-3,mit": "Licensed under the GNU General Public License version 3, parts under the MIT license.",
        "lgpl-3": "licensed under the gnu lesser general public license version 3",
        "": "a license to use the software without restriction, granted by any person to permit persons, version 3 of the general public",
        "bsd,isc": NOTICE["isc"] + "\n" + bsd,
    }
    made = {r["doc_id"]: r for r in licenses.scan(table(spark, list(texts.values()))).collect()}
    assert [made[i]["labels"] for i in range(len(texts))] == list(texts)
    assert made[5]["score"] < 1 and made[2]["score"] == 1


def test_licenses_of_repeated_rows_and_empty_tables(spark):
    same = table(spark, ["under the mit license, under the mit license"] * 4, [1, 1, 1, None])
    assert [r["n_base"] for r in licenses.scan(same).collect()] == [2] * 4
    assert licenses.scan(same.limit(0)).count() == 0


def test_the_license_plan_has_no_python(spark):
    plan = licenses.scan(table(spark, ["a b c"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.split("== Physical Plan ==")[1])


def test_queries_are_registered():
    assert {"op11_resample", "op12_conversations", "op13_licenses"} <= set(queries.QUERIES) & set(queries.ORACLE_SQL)
