"""The pipeline's stages against plain Python, on documents with edge cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_ops import TRICKY, brute_spans, check_pieces, prose, shingles, vocabulary


#: Names that stages and operators use inside.
CLASHING = ("found", "_rules", "_hit", "_version", "_gone", "_version_of", "kept", "gone", "gone_", "version", "version_of", "row", "wins", "lang_pred_", "digest", "Score_")


@pytest.fixture(scope="module")
def docs(spark):
    r, words = random.Random(2), vocabulary(2)
    items = [(i, prose(r, words, 30)) for i in range(5)]
    rows = [(i, prose(r, words, 80), "en") for i in range(40)]
    rows += [(100, rows[3][1], "en"), (101, rows[4][1] + " one", "en"), (102, prose(r, words, 50) + " " + items[2][1] + " " + prose(r, words, 50), "en"), (103, None, "en"), (104, "12 34", "en"), (105, "", None), (106, TRICKY[2], "en"), (107, TRICKY[3], None)]
    # an id with two texts, rows that repeat, rows without an id
    rows += [(3, rows[7][1], "en"), (3, prose(r, words, 60), "en"), (110, prose(r, words, 60), "en"), (110, items[4][1], "en"), (None, prose(r, words, 60), "en"), (None, rows[9][1], "en"), (None, None, None), (111, prose(r, words, 30000), "en")]
    rows += [rows[5], rows[-4], rows[-2]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit(7), "lang_pred": F.lit("own"), "_text": F.lit("own"), **{c: F.lit(f"own {c}") for c in CLASHING}})
    return rows, items, frame


def test_stages(spark, docs, tmp_path):
    rows, items, frame = docs
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "secrets", "packing"]

    def texts(frame):
        assert frame.columns == docs[2].columns
        assert frame.filter(" OR ".join(f"`{c}` IS DISTINCT FROM 'own {c}'" for c in CLASHING)).isEmpty()
        return sorted(((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()), key=str)

    kept = sorted(((d, t) for d, t, _ in rows if t and any(c.isalpha() for c in t)), key=str)
    got = stages["language"](spark, frame, str(tmp_path))
    assert texts(got) == kept and got.filter("lang_pred = 'own' AND score = 7 AND _text = 'own'").count() == len(kept)
    got = stages["near_duplicates"](spark, got, str(tmp_path))
    order = sorted(set(kept), key=lambda e: (e[0] is None, e[0] or 0))
    groups = []
    for e in order:
        mine = [g for g in groups if any(linked(e[1], o[1]) for o in g)]
        groups = [g for g in groups if g not in mine] + [[e, *(o for g in mine for o in g)]]
    sizes = [(g, min(o[0] is None for o in g)) for g in groups]
    left = texts(got)
    assert len(left) == len(groups)
    for g, none in sizes:
        (one,) = [e for e in left if e in g]
        assert one[0] == (None if none else min(o[0] for o in g if o[0] is not None))
    assert {t for _, t in kept if not any(t != u and linked(t, u) for _, u in kept)} <= {t for _, t in left}
    got = stages["decontamination"](spark, got, str(tmp_path))
    kept = [(d, t) for d, t in left if d != 102 and t != items[4][1]]
    assert len(kept) == len(left) - 2 and texts(got) == kept and any(d == 110 for d, _ in kept)
    got = stages["secrets"](spark, got, str(tmp_path))
    clean = texts(got)
    assert [d for d, _ in clean] == [d for d, _ in kept] and got.filter("n_chars <> length(text)").count() == 0
    for (d, t), (_, c) in zip(kept, clean):
        assert ("[SECRET]" in c) == any(brute_spans(t)) and (d in (106, 107) or c == t)
    check_pieces(stages["packing"](spark, got, str(tmp_path)).collect(), clean, 2048)
    check_pieces(corpus_pipeline.run(spark, str(tmp_path)).collect(), clean, 2048)


def linked(t, u):
    x, y = shingles(t), shingles(u)
    return bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)


def test_no_text_is_lost_to_its_id(spark, tmp_path):
    t, u = "one text of a few words " * 6, "another text without those " * 6
    frame = spark.createDataFrame([(5, t), (5, t), (7, t), (7, u)], "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(5, t), (7, u)]


def test_empty_stages(spark, docs, tmp_path):
    empty = docs[2].limit(0)
    spark.createDataFrame(docs[1], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
