"""License scans by diagonal voting.

Rolling hashes of the documents' words are joined to the places of the same hashes in the templates. A shared passage
leaves its hits on one diagonal (place in the document less place in the template). Hits are gathered by diagonal,
neighbouring diagonals are merged, so that an inserted or missing word does not split a passage, and the spans that result
are verified: only hits count whose template places follow each other in the order of the text, word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import keyed
from tessera.llm.quality_rules import let

#: Words are runs of digits, letters and whatever is not ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening or notice passages of common licenses, and the label of each.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

#: Diagonals at most so far apart are one passage.
NEAR = 3


def words_of(text: Column) -> Column:
    """The words before lower-casing; A-Z are lower-cased where words are looked at."""
    return F.filter(F.split(text, BETWEEN), lambda w: w != "")


def ascii_lower(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def rolling(here: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(here, F.lit(j)) for j in range(k)])


def template_grams(spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    """hash and places of every k-gram of the templates: one row for each gram, at most as many as the templates have words."""
    rows = [(name, i, len(text.split()), text.split()[i : i + k]) for name, text in templates.items() for i in range(len(text.split()) - k + 1)]
    grams = spark.createDataFrame(rows, "label string, tpos int, n int, gram array<string>").select(rolling(F.col("gram"), k).alias("hash"), "label", "tpos", "n", "gram")
    return grams.groupBy("hash").agg(F.collect_list(F.struct("label", "tpos", "n", "gram")).alias("templates"))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = 4, min_share: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches of every row.

    n_base counts the places where the words of a phrase stand one after the other; first_word and last_word are the least
    and greatest of them. matches holds a struct (label, start, end, share) for each passage, with words from start to end,
    that has at least min_share of a template's words in order; templates must have k words or more. labels has the labels
    of phrases and of matches, score is the best share, 1 if a phrase stands there, else 0. Passages of several templates,
    and several of one, are all given. A null text is empty. Repeated rows each have their own result. A long text takes
    time in proportion to its words, however many passages it has.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, templates, k)
    # a hash can only match where its first two words are words of templates or phrases: all others are left out at once
    known = sorted({w for t in [*templates.values(), *phrases] for w in t.split()})
    reach = max(k, *(len(p.split()) for p in phrases), 2)
    is_known = lambda w: ascii_lower(w).isin(known)

    def places(words: Column) -> Column:
        two = lambda w, i: F.when(is_known(w) & is_known(F.get(words, i + 1)), i)
        at = F.filter(F.transform(words, two), lambda i: i.isNotNull())
        here = F.transform(at, lambda i: F.struct(i.alias("at"), F.transform(F.slice(words, i + 1, reach), ascii_lower).alias("here"), F.lit(None).cast("int").alias("n_words")))
        itself = F.struct(F.lit(-1).alias("at"), F.array().cast("array<string>").alias("here"), F.size(words).alias("n_words"))
        return F.concat(F.array(itself), here)

    stands = lambda p: F.slice("here", 1, len(p)) == F.array(*map(F.lit, p))
    found = F.filter(F.array(*[F.when(stands(p.split()), F.lit(label)) for p, label in phrases.items()]), lambda x: x.isNotNull())
    at = keyed(docs).select("doc_id", "fp", F.explode(let(words_of(F.col("text")), places)).alias("p")).select("doc_id", "fp", "p.*")
    keyed_at = at.select("doc_id", "fp", "at", "n_words", found.alias("base"), F.slice("here", 1, k).alias("here"), rolling(F.col("here"), k).alias("hash"))
    # the templates' grams are a few hundred rows
    hits = keyed_at.join(F.broadcast(grams), "hash", "left")
    same = F.transform(F.filter(F.coalesce("templates", F.array().cast("array<struct<label:string,tpos:int,n:int,gram:array<string>>>")), lambda t: t["gram"] == F.col("here")), lambda t: F.struct(t["label"].alias("label"), (F.col("at") - t["tpos"]).alias("d"), F.col("at").alias("at"), t["tpos"].alias("tpos"), t["n"].alias("n")))
    hits = hits.select("doc_id", "fp", "at", "n_words", "base", same.alias("same")).where(F.col("n_words").isNotNull() | (F.size("base") > 0) | (F.size("same") > 0))
    # sets, as a repeated row has the same places
    voted = hits.groupBy("doc_id", "fp").agg(
        F.count("n_words").alias("copies"), F.max("n_words").alias("n_words"), F.collect_set(F.when(F.size("base") > 0, F.struct("at", "base"))).alias("base"),
        F.collect_set(F.when(F.size("same") > 0, F.struct("at", "same"))).alias("hits"),
    )
    return finish(voted, k, min_share)


def passages(hits: Column, k: int) -> Column:
    """Spans of hits (label, d, at, tpos, n): neighbouring diagonals of a template are one, if their places are near too.

    share is the part of the template's words in hits whose tpos ascends with at. Each step is linear in the hits.
    """

    def cut(v: Column) -> Column:
        def new(x: Column, i: Column) -> Column:
            before = F.get(v, i - 1)
            return F.coalesce((before["label"] != x["label"]) | (x["d"] - before["d"] > NEAR) | (F.abs(x["at"] - before["at"]) > x["n"]), F.lit(True))

        starts = F.filter(F.transform(v, lambda x, i: F.when(new(x, i), i)), lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda a, j: F.slice(v, a + 1, F.coalesce(F.get(s, j + 1), F.size(v)) - a)))

    def verified(span: Column) -> Column:
        placed = F.array_sort(F.transform(span, lambda h: F.struct(h["at"].alias("at"), h["tpos"].alias("tpos"))))
        start = F.struct(F.lit(-k).alias("top"), F.lit(0).alias("words"))

        def step(acc: Column, h: Column) -> Column:
            more = h["tpos"] > acc["top"]
            return F.struct(F.greatest(acc["top"], h["tpos"]).alias("top"), (acc["words"] + F.when(more, F.least(F.lit(k), h["tpos"] - acc["top"])).otherwise(0)).alias("words"))

        return let(placed, lambda p: F.struct(
            F.get(span, F.lit(0))["label"].alias("label"), F.get(p, F.lit(0))["at"].alias("start"), (F.element_at(p, -1)["at"] + k).alias("end"),
            F.round(F.aggregate(p, start, step)["words"] / F.get(span, F.lit(0))["n"], 6).alias("share"),
        ))

    return F.when(F.size(hits) == 0, F.array().cast("array<struct<label:string,start:int,end:int,share:double>>")).otherwise(F.transform(let(F.array_sort(hits), cut), verified))


def finish(voted: DataFrame, k: int, min_share: float) -> DataFrame:
    """Diagonals of each document's hits, merged and verified. The hits of a document are at most its words times templates."""
    hits = F.flatten(F.transform("hits", lambda h: h["same"]))
    matches = F.array_sort(F.filter(passages(hits, k), lambda m: m["share"] >= min_share))
    base_labels = F.array_distinct(F.flatten(F.transform("base", lambda b: b["base"])))
    starts = F.flatten(F.transform("base", lambda b: F.transform(b["base"], lambda _: b["at"])))
    out = voted.select("doc_id", "copies", F.col("n_words").cast("long").alias("n_words"), starts.alias("starts"), base_labels.alias("base_labels"), matches.alias("matches"))
    every = F.array_distinct(F.concat("base_labels", F.transform("matches", lambda m: m["label"])))
    score = F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort("base_labels")).alias("base_labels"), F.concat_ws(",", F.array_sort(every)).alias("labels"), score.alias("score"), "matches", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
