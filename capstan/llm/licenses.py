"""Licence scan with a positional rare-token index, in DataFrame functions only.

Licence notices are indexed as postings (word, template, position).  The document
frequency of every indexed word is counted over all documents.  A template's rare
words are the rarest word of its first key phrase and all words of its notice that are
at least as rare; each file's rare words are looked up in the postings, those of a
template that agree on the relative position add up their IDF, and templates whose
mandatory key phrases stand in the file are labelled.  A standing key phrase holds the
rare word that looks it up, whatever else is in the file, so more words never take a
label away.

Edge cases: a null text counts as empty; empty texts have no labels and score 0;
rows equal in id and text get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_digest, stored, text_of

# Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short public licence notices (label, notice words, key phrases
# that all must stand in the file).
TEMPLATES = [
    ("agpl", "gnu affero general public license as published by the free software foundation",
     ["gnu affero general public license"]),
    ("lgpl", "gnu lesser general public license as published by the free software foundation",
     ["gnu lesser general public license"]),
    ("gpl-2.0", "this program is free software you can redistribute it under the terms of the gnu general public license version 2",
     ["gnu general public license", "version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ["gnu general public license", "version 3"]),
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
     ["apache license version 2 0"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met redistributions of source code must retain the above copyright notice",
     ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0",
     ["eclipse public license"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain cc0 universal license",
     ["cc0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0 creative commons attribution noncommercial international license", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0 creative commons attribution sharealike international license", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0 creative commons attribution noderivatives international license", ["cc by nd"]),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without permission license",
     ["all rights reserved", "no part"]),
]

#: Words a notice may be shifted by inserted words and still agree.
SLACK = 3

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(lowered: Column) -> Column:
    return F.filter(F.split(lowered, NOT_WORD), lambda w: w != "")


def places(words: Column, phrase: str) -> Column:
    """Positions at which the phrase's words stand one after the other."""
    parts = phrase.split(" ")

    def at(w, i):
        c = w == parts[0]
        for k, p in enumerate(parts[1:], 1):
            c = c & (F.get(words, i + k) == p)
        return F.when(c, i)

    return F.filter(F.transform(words, at), lambda i: i.isNotNull())


def labelled(positions: Column, label: str) -> Column:
    return F.transform(positions, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def needed_words() -> str:
    """Pattern of the words without which no base or key phrase can stand: the
    longest word of each phrase (for phrases of short words, the whole phrase)."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    alts = set()
    for phrase in [*BASE_PHRASES, *[t[2][0] for t in TEMPLATES]]:
        longest = max(phrase.split(" "), key=len)
        alts.add(longest if len(longest) > 4 else phrase.replace(" ", gap))
    return "|".join(sorted(alts))


def notice_words() -> list[str]:
    return sorted({w for _, notice, _ in TEMPLATES for w in notice.split(" ")} | {w for _, _, keys in TEMPLATES for w in keys[0].split(" ")})


def postings(spark: SparkSession) -> DataFrame:
    """(word, label, position, whether it is a word of the first key phrase) of the
    notices: a fixed table of some 250 rows."""
    rows = [F.struct(F.lit(w).alias("word"), F.lit(label).alias("label"), F.lit(k).cast("long").alias("at"), F.lit(w in keys[0].split(" ")).alias("key"))
            for label, notice, keys in TEMPLATES for k, w in enumerate(notice.split(" "))]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and
    score (best IDF share of a labelled notice's rare words that agree on a position;
    1 where a base phrase stands) of every document."""
    spark = docs.sparkSession
    low = F.translate(text_of(), UPPER, LOWER)
    base = docs.select("doc_id", row_digest(docs, "text").alias("rk"), low.alias("_low"))
    base = base.select("doc_id", "rk", words_of(F.col("_low")).alias("_w"),
                       F.col("_low").rlike(needed_words()).alias("_c"))
    # the words stay only for files that can hold a phrase; of the others, which notice words they hold
    vocabulary = F.array(*[F.lit(w) for w in notice_words()])
    base = stored(base.select("doc_id", "rk", F.size("_w").cast("long").alias("n_words"), F.array_intersect(vocabulary, F.col("_w")).alias("v"),
                              F.when(F.col("_c"), F.col("_w")).alias("w")), "licence-words")

    found = F.concat(*[labelled(places(F.col("w"), phrase), label) for phrase, label in BASE_PHRASES.items()])
    hits = base.select("doc_id", "rk", "n_words", F.coalesce(found, F.array().cast("array<struct<at:bigint,label:string>>")).alias("_f"))
    hits = hits.select("doc_id", "rk", "n_words", F.size("_f").cast("long").alias("n_base"),
                       F.array_min(F.col("_f.at")).alias("first_word"), F.array_max(F.col("_f.at")).alias("last_word"),
                       F.array_distinct(F.col("_f.label")).alias("_base"))

    extra = matched(base.where(F.col("w").isNotNull()), rare_postings(base, postings(spark))).select(
        F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"), "found", "best")
    out = hits.join(extra, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("rk") == F.col("_rk")), "left")
    every = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("found", F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def rare_postings(held: DataFrame, index: DataFrame) -> DataFrame:
    """Postings of the rare words with their ``idf`` and the ``weight`` of all rare words
    of their template, from the notice words ``v`` that each document holds."""
    n = held.count()
    df = held.select(F.explode("v").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = stored(df.select(F.col("word").alias("_w"), F.log1p(F.lit(float(n)) / F.col("df")).alias("idf")), "licence-idf")  # a row a notice word
    every = index.join(F.broadcast(idf), F.col("word") == F.col("_w")).drop("_w")
    limit = every.where("key").groupBy(F.col("label").alias("_l")).agg(F.max("idf").alias("_least"))
    rare = every.join(F.broadcast(limit), F.col("label") == F.col("_l")).where(F.col("idf") >= F.col("_least")).drop("_l", "_least", "key")
    weight = rare.select("label", "word", "idf").distinct().groupBy(F.col("label").alias("_l")).agg(F.sum("idf").alias("weight"))
    return stored(rare.join(F.broadcast(weight), F.col("label") == F.col("_l")).drop("_l"), "licence-postings")  # some 250 rows at the most


def matched(files: DataFrame, rare: DataFrame) -> DataFrame:
    """Labels and best score of each file (doc_id, rk) by the positional index."""
    files = files.select("doc_id", "rk", "w")
    # postings are a fixed table: its broadcast has a fixed size
    at = files.select("doc_id", "rk", F.posexplode("w").alias("pos", "_word")).join(F.broadcast(rare), F.col("_word") == F.col("word"))
    # relative positions: two neighbouring slots of width SLACK + 1 cover a shift across their border
    slot = F.floor((F.col("pos") - F.col("at")) / (SLACK + 1))
    at = at.select("doc_id", "rk", "label", "word", "idf", "weight", F.explode(F.array(slot, slot + 1)).alias("slot")).distinct()
    agree = at.groupBy("doc_id", "rk", "label", "slot").agg((F.sum("idf") / F.max("weight")).alias("share"))
    best = agree.groupBy("doc_id", "rk", "label").agg(F.max("share").alias("share"))

    # key phrases, checked on the files that have a candidate
    keys = F.lit(None).cast("boolean")
    spaced = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    for label, _, phrases in TEMPLATES:
        ok = F.lit(True)
        for p in phrases:
            ok = ok & F.contains(F.col("_s"), F.lit(f" {p} "))
        keys = F.when(F.col("label") == label, ok).otherwise(keys)
    text = files.select(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"), spaced.alias("_s"))
    grouped = best.groupBy("doc_id", "rk").agg(F.collect_list(F.struct("label", "share")).alias("_c"))  # one entry a template
    checked = grouped.join(text, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("rk") == F.col("_rk"))).select(
        "doc_id", "rk", "_s", F.explode("_c").alias("c")).select("doc_id", "rk", "_s", "c.label", "c.share")
    checked = checked.where(keys).select("doc_id", "rk", "label", "share").distinct()
    return checked.groupBy("doc_id", "rk").agg(
        F.collect_set("label").alias("found"), F.max(F.least(F.lit(1.0), F.col("share"))).alias("best"))


