"""Licence scan by a positional index of rare words.

Main path in DataFrame functions only. Each file is reduced, where it is read,
to the places of the few words that the index knows ("hits"). Then, on thin
rows:

1. Document frequencies of the index words over all files give their IDF.
2. The postings (word -> template, place in the template) hold the highest-IDF
   words of each template, and all hits of a file are looked up in them, so that
   no template's match depends on what else the file holds. Postings intersect
   by relative position: hits that agree on ``place in file - place in
   template`` support one alignment of one template, weighted by IDF.
3. An alignment counts when it covers enough of the template's weight and the
   template's mandatory key phrases stand, word by word, at their places.

The index is a constant of a few dozen words, so it is broadcast; nothing that
grows with the corpus is.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    """A licence notice; each key phrase must stand in a match, at its place."""

    label: str
    text: str
    key_phrases: tuple[str, ...]


# Wording of public licence notices.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted", "person obtaining")),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("binary forms", "permitted provided")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("hereby granted",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released",)),
)
#: Too common to say anything; not in the index.
STOP = frozenset("a and any are as can for form in into is it of or that the this to under use v with without you".split())


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text)


def _phrases() -> list[str]:
    return list(dict.fromkeys([*BASE_PHRASES, *(p for t in TEMPLATES for p in t.key_phrases)]))


def index_words() -> list[str]:
    """Every word that the postings or a phrase need."""
    rare = {w for t in TEMPLATES for w in _words(t.text)} - STOP
    return sorted(rare | {w for p in _phrases() for w in _words(p)})


def _hits(text: Column) -> tuple[Column, Column]:
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    known = index_words()
    hits = F.filter(F.transform(F.col("_words"), lambda w, i: F.when(w.isin(known), F.struct(i.alias("at"), w.alias("word")))), lambda h: h.isNotNull())
    return words, hits


def _phrase_places(hits: Column) -> Column:
    """All places of all phrases, as (phrase number, start)."""
    none = F.array().cast("array<struct<phrase:int,start:int>>")

    def places(k: int, words: list[str]) -> Column:
        def start(i):
            ok = hits[i]["word"] == words[0]
            for j, word in enumerate(words[1:], 1):
                following = F.get(hits, i + j)
                ok = ok & (following["word"] == word) & (following["at"] == hits[i]["at"] + j)
            return F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(k).alias("phrase"), hits[i]["at"].alias("start")))

        found = F.filter(F.transform(F.sequence(F.lit(0), F.size(hits) - 1), start), lambda p: p.isNotNull())
        return F.when(F.exists(hits, lambda h: h["word"] == words[0]), found).otherwise(none)

    parts = [places(k, _words(phrase)) for k, phrase in enumerate(_phrases())]
    return F.when(F.size(hits) > 1, F.concat(*parts)).otherwise(none)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rarest: int = 16, least_cover: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    ``rarest``: how many of a template's distinct words, highest IDF first
    (ties: by word), are in the postings and make up its weight. ``least_cover``: share of a template's IDF
    weight that an alignment must reach. ``score``: best such share among the
    verified alignments, else 0.

    Null and empty texts have no words, empty labels and score 0. Repeated ids
    are separate rows. Other columns are ignored, whatever they are called. An
    empty table gives an empty result."""
    words, hits = _hits(F.col("_text"))
    thin = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).select("_id", words.alias("_words"))
    thin = thin.select("_id", F.size("_words").cast("long").alias("n_words"), hits.alias("hits"))
    thin = written(thin.withColumn("places", _phrase_places(F.col("hits"))).withColumn("row", F.monotonically_increasing_id()), "license-hits")

    # One row per index word, so a constant number of rows.
    n_docs = thin.count()
    df = {r[0]: r[1] for r in thin.select(F.explode(F.array_distinct("hits.word")).alias("w")).groupBy("w").count().collect()}
    value = {w: math.log((n_docs + 1.0) / (df.get(w, 0) + 1.0)) + 1e-9 for w in index_words()}

    spark = docs.sparkSession
    postings, needs, weight_of = [], [], {}
    number = {p: k for k, p in enumerate(_phrases())}
    for t, template in enumerate(TEMPLATES):
        own = _words(template.text)
        rare = {w for w in own if w not in STOP}
        chosen = set(sorted(rare, key=lambda w: (-value[w], w))[:rarest])
        weight_of[t] = sum(value[w] for w in own if w in chosen)
        postings += [(w, t, place, value[w]) for place, w in enumerate(own) if w in chosen]
        for phrase in template.key_phrases:
            p = _words(phrase)
            place = next(i for i in range(len(own)) if own[i : i + len(p)] == p)
            needs.append((number[phrase], t, place))
    facts = [(t, x.label, weight_of[t], len(x.key_phrases)) for t, x in enumerate(TEMPLATES)]
    postings = F.broadcast(spark.createDataFrame(postings, "word string, template int, place int, weight double"))
    needs = F.broadcast(spark.createDataFrame(needs, "phrase int, template int, place int"))
    facts = F.broadcast(spark.createDataFrame(facts, "template int, label string, total double, n_keys int"))

    # Rows whose key phrases all fail can't match: they leave here.
    open_rows = thin.where(F.size("places") > 0)
    votes = open_rows.select("row", F.explode("hits").alias("h")).select("row", "h.at", "h.word").join(postings, "word").select("row", "template", (F.col("at") - F.col("place")).alias("offset"), "weight", F.lit(0).alias("key"))
    keys = open_rows.select("row", F.explode("places").alias("p")).select("row", "p.phrase", "p.start").join(needs, "phrase").select("row", "template", (F.col("start") - F.col("place")).alias("offset"), F.lit(0.0).alias("weight"), F.lit(1).alias("key"))
    aligned = votes.unionByName(keys).groupBy("row", "template", "offset").agg(F.sum("weight").alias("weight"), F.sum("key").alias("keys")).join(facts, "template")
    matched = aligned.where((F.col("keys") == F.col("n_keys")) & (F.col("weight") >= least_cover * F.col("total"))).groupBy("row").agg(F.collect_set("label").alias("own_labels"), F.max(F.least(F.lit(1.0), F.col("weight") / F.col("total"))).alias("best"))

    base = F.filter("places", lambda p: p["phrase"] < len(BASE_PHRASES))
    label = F.array(*[F.lit(x) for x in BASE_PHRASES.values()])
    out = thin.withColumn("_base", base).join(matched, "row", "left")
    base_labels = F.array_distinct(F.transform("_base", lambda p: label[p["phrase"]]))
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda p: p["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda p: p["start"])).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(base_labels)).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base_labels, F.coalesce(F.col("own_labels"), F.array().cast("array<string>"))))).alias("labels"),
        F.round(F.coalesce(F.col("best"), F.lit(0.0)), 6).alias("score"),
    )
