"""License notices by diagonal voting: word k-grams joined to template positions, votes by offset, neighbouring diagonals merged, spans verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a gram, the length of the shortest phrase.
GRAM = 3
#: Diagonals up to so many words apart belong together: words put in or left out.
SLACK = 8
#: One word in so many of a template may be missing, or come in addition.
TOLERANCE = 12

#: Phrases that name a license wherever their words stand in a row.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Wordings of well-known public notices, found also when slightly edited.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
)

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of ASCII letters and digits (A-Z in lower case) and of all characters beyond ASCII; a null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, _SEPARATORS), "")


def _grams(array: Column, place: str) -> list[Column]:
    """A generator of each word with the GRAM - 1 after it, nulls beyond the end; one row of nulls where there is no word."""
    following = [F.slice(array, k + 1, F.greatest(F.size(array), F.lit(1))).alias(f"w{k}") for k in range(GRAM)]
    return [F.posexplode_outer(F.arrays_zip(*following)).alias(place, "gram")]


def template_grams(spark: SparkSession) -> DataFrame:
    """template, label, phrase, size and each gram of all templates with its place; a table of some hundred rows."""
    rows = [(i, label, i < len(PHRASES), text) for i, (label, text) in enumerate(PHRASES + NOTICES)]
    table = spark.createDataFrame(rows, "template int, label string, phrase boolean, text string")
    table = table.select("template", "label", "phrase", words(F.col("text")).alias("words")).withColumn("size", F.size("words"))
    cut = table.select("template", "label", "phrase", "size", *_grams(F.col("words"), "at")).filter(F.col(f"gram.w{GRAM - 1}").isNotNull())
    return cut.select("template", "label", "phrase", "size", "at", *(F.col(f"gram.w{k}").alias(f"t{k}") for k in range(GRAM)), _hash("gram").alias("t_hash"))


def _hash(gram: str) -> Column:
    return F.xxhash64(*(F.col(f"{gram}.w{k}") for k in range(GRAM)))


_DOCUMENT = ("row", "doc_id", "n_words")


def hits(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words, template columns, place and diagonal of each gram that a template has; one row at least for each document.

    Every word's gram meets the broadcast templates (of fixed size) by hash and by its
    words; only matches, and each document's first word, go on to one shuffle by row.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words(F.col("text")).alias("words"))
    cut = numbered.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), *_grams(F.col("words"), "place"))
    same = F.col("hash") == F.col("t_hash")
    for k in range(GRAM):
        same &= F.col(f"gram.w{k}") == F.col(f"t{k}")
    met = cut.withColumn("hash", _hash("gram")).join(F.broadcast(template_grams(docs.sparkSession)), same, "left")
    met = met.filter(F.col("template").isNotNull() | (F.coalesce("place", F.lit(0)) == 0))
    return met.select(*_DOCUMENT, "template", "label", "phrase", "size", "at", (F.col("place") - F.col("at")).alias("diagonal")).repartition("row")


def _coverage(diagonals: Column, size: Column) -> Column:
    """covered, begin and end of the template's and the document's words that the grams of an array of diagonals hold, and their ratio."""

    def spread(values: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(values, lambda v: F.array(*(v + k for k in range(GRAM)))))))

    begin = F.array_min(F.transform(diagonals, lambda d: d["diagonal"] + F.array_min(d["places"])))
    end = F.array_max(F.transform(diagonals, lambda d: d["diagonal"] + F.array_max(d["places"]))) + GRAM
    covered = spread(F.flatten(F.transform(diagonals, lambda d: d["places"])))
    return F.struct((covered / F.greatest(size, end - begin)).alias("ratio"), covered.alias("covered"), begin.alias("begin"), end.alias("end"))


def spans(found: DataFrame) -> DataFrame:
    """For each diagonal of hits the better of itself and itself with those up to SLACK words on: votes, whole, ratio, begin, end, verified.

    whole tells that all of the template stands there word by word.  A span is verified if
    at most one in TOLERANCE of the template's words lacks, or as many others are between.
    """
    keys = (*_DOCUMENT, "template", "label", "phrase", "size")
    voted = found.groupBy(*keys, "diagonal").agg(F.count("at").alias("votes"), F.sort_array(F.collect_set("at")).alias("places"))
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(Window.currentRow, SLACK)
    voted = voted.withColumn("own", F.struct("diagonal", "places")).withColumn("near", F.collect_list("own").over(near))
    best = F.greatest(_coverage(F.array("own"), F.col("size")), _coverage(F.col("near"), F.col("size")))
    out = voted.withColumn("best", F.when(F.col("template").isNotNull(), best))
    allowed = F.floor(F.col("size") / TOLERANCE)
    lacking = F.greatest(F.col("size"), F.col("best.end") - F.col("best.begin")) - F.col("best.covered")
    return out.select(*keys, "diagonal", "votes", (F.col("votes") == F.col("size") - (GRAM - 1)).alias("whole"), "best.ratio", "best.begin", "best.end", (lacking <= allowed).alias("verified"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs (doc_id, text).

    n_base counts the places where a phrase stands word by word, first_word and last_word
    are their smallest and largest start; labels are those of all verified spans too, and
    score is the best ratio of covered words of any span, 1 for a whole phrase.

    DataFrame functions only.  One shuffle, of the matches and of one narrow row for each
    document; all grouping after it is by row, that is within a document's matches.
    Null, empty and wordless texts have no places, empty labels and score 0; repeated rows
    count each for themselves, null ids are kept; an empty table gives none; other columns
    are ignored, whatever their names.
    """
    base = F.col("phrase") & F.col("whole")

    def joined(when: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")

    return (
        spans(hits(docs))
        .groupBy(*_DOCUMENT)
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(F.col("verified")).alias("labels"),
            F.coalesce(F.max("ratio"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
