"""License scans: an exact set-similarity join of text blocks with license templates, in native expressions.

A template matches a block (a line, or a paragraph between blank lines) if at least LEAST of the
template's distinct words are in it. The words of all templates are ordered by their frequency over all
documents, the rarest first. A template that must share n of its words can miss its size less n, so one
of its first size - n + 1 words, its prefix, is in every matching block: only documents and blocks with a
prefix word go on. Then come the length filter (the block has n template words) and the positional filter
(n words can still be shared after the first shared one), and the rest is counted. All pairs that reach
the threshold are found. The templates are a fixed list, so the join needs no shuffle of texts; the
frequencies are one aggregation of a few hundred counts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rastrum.session import settled

LEAST = 0.8
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after A-Z became a-z
PARAGRAPH = r"\n[ \t\r]*\n"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Labels and the notices that licenses ask to be put into works.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def tokens(text: str) -> list[str]:
    """The distinct words of an English text, in order."""
    return list(dict.fromkeys(re.findall(r"[0-9a-z]+", text.lower())))


def needed(size: int) -> int:
    """Words that a block must share with a template of this size; LEAST in thousandths, to be exact."""
    return -(-round(LEAST * 1000) * size // 1000)


def rivals() -> list[list[int]]:
    """For each template the others with over half of the words of the smaller in common; best_labels has only the best of them in a block."""
    sets = [set(tokens(t)) for _, t in TEMPLATES]
    return [[j for j, b in enumerate(sets) if j != i and 2 * len(a & b) > min(len(a), len(b))] for i, a in enumerate(sets)]


def _lower(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATOR, -1), lambda w: w != "")


def frequencies(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Documents that hold each word of the templates, over all documents."""
    vocabulary = sorted({w for _, t in TEMPLATES for w in tokens(t)})
    held = F.array_intersect(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATOR), F.array(*map(F.lit, vocabulary)))
    return {w: 0 for w in vocabulary} | dict(docs.select(F.explode(held).alias("w")).groupBy("w").count().collect())


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and best_labels of each row.

    n_base counts the places of the phrases, first_word and last_word are their smallest and largest
    start (null without any). labels has the phrases' labels and those of all templates that match a
    block, so a notice of one license may also meet a shorter notice of another; in best_labels, of templates
    much alike only the best counts in a block (the larger if they tie). score is 1 with a phrase, else the
    highest containment, else 0. Label lists are distinct, sorted and
    comma-joined, empty strings if there are none. Null texts are empty; null and repeated ids stay; an
    empty table gives an empty result; other columns are ignored.
    """
    df_of = frequencies(docs, text_col)
    order = sorted(df_of, key=lambda w: (df_of[w], w))
    rank = {w: i for i, w in enumerate(order)}
    sorted_tokens = [sorted(tokens(t), key=rank.__getitem__) for _, t in TEMPLATES]
    prefixes = [t[: len(t) - needed(len(t)) + 1] for t in sorted_tokens]
    templates = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(label).alias("label"), _strings(t).alias("t"), _strings(p).alias("prefix"), F.lit(needed(len(t))).alias("need"), F.array(*map(F.lit, r)).cast("array<int>").alias("rivals"))
            for i, ((label, _), t, p, r) in enumerate(zip(TEMPLATES, sorted_tokens, prefixes, rivals(), strict=True))
        ]
    )
    marks = sorted({w for p in prefixes for w in p} | {"mit", "apache", "nc"})

    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # lower() makes more letters small than A-Z, so it can only let more documents through; words stay as many
    df = df.withColumn("rough", F.split(F.lower("text"), SEPARATOR, -1))
    edge = (F.get("rough", F.lit(0)) == "").cast("int") + ((F.size("rough") > 1) & (F.get("rough", F.size("rough") - 1) == "")).cast("int")
    df = df.select("doc_id", F.when(F.arrays_overlap("rough", _strings(marks)), _lower(F.col("text"))).otherwise(F.lit("")).alias("text"), (F.size("rough") - edge).cast("long").alias("n_words"))
    df = df.withColumn("words", words_of(F.col("text")))

    def places(phrase: str) -> Column:
        parts = phrase.split()
        here = lambda i: reduce(lambda a, b: a & b, [F.get("words", i + j) == w for j, w in reversed(list(enumerate(parts)))])
        return F.when(F.size("words") >= len(parts), F.filter(F.sequence(F.lit(0), F.size("words") - len(parts)), here)).otherwise(F.array().cast("array<int>"))

    for k, (phrase, _) in enumerate(PHRASES):
        df = df.withColumn(f"p{k}", places(phrase))
    df = df.withColumn("starts", F.concat(*[f"p{k}" for k in range(len(PHRASES))]))
    df = df.withColumn("base", F.concat(*[F.when(F.size(f"p{k}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for k, (_, label) in enumerate(PHRASES)]))

    def shared(block: Column, t: Column) -> Column:
        """Words of the template in the block, or null where a filter rules the threshold out."""
        first = F.filter(t["t"], lambda w: F.array_contains(block, w))[0]
        i, j = F.array_position(t["t"], first), F.array_position(block, first)
        room = F.least(F.size(t["t"]) - i, F.size(block) - j) + 1
        return F.when(F.arrays_overlap(block, t["prefix"]) & (F.size(block) >= t["need"]), F.when(room >= t["need"], F.size(F.array_intersect(t["t"], block))))

    def matches(block: Column) -> Column:
        found = F.transform(templates, lambda t: F.struct(t["i"].alias("i"), t["label"].alias("label"), (shared(block, t) / F.size(t["t"])).alias("c"), F.size(t["t"]).alias("n"), t["rivals"].alias("rivals"), shared(block, t).alias("k"), t["need"].alias("need")))
        return F.filter(found, lambda m: m["k"] >= m["need"])

    blocks = F.array_distinct(F.concat(F.split("text", "\n", -1), F.split("text", PARAGRAPH, -1)))
    # the template words of a block, in the global order
    df = df.withColumn("blocks", F.filter(F.array_distinct(F.transform(blocks, lambda b: F.array_intersect(_strings(order), F.split(b, SEPARATOR)))), lambda b: F.size(b) > 0))
    df = df.withColumn("found", F.filter(F.transform("blocks", matches), lambda m: F.size(m) > 0))
    best = lambda ms: F.filter(ms, lambda m: ~F.exists(ms, lambda o: F.array_contains(m["rivals"], o["i"]) & ((o["c"] > m["c"]) | ((o["c"] == m["c"]) & (o["n"] > m["n"])))))
    df = df.withColumn("kept", F.flatten("found")).withColumn("best", F.flatten(F.transform("found", best)))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    out = df.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        join(F.col("base")).alias("base_labels"),
        join(F.concat("base", F.transform("kept", lambda m: m["label"]))).alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("kept", lambda m: m["c"])), F.lit(0.0))).alias("score"),
        join(F.concat("base", F.transform("best", lambda m: m["label"]))).alias("best_labels"),
    )
    return settled(out)


def oracle() -> str:
    """The same result in SQL, by counting the words of each template in each block."""
    rows = ", ".join(f"({i}, '{label}', {tokens(t)!r}, {needed(len(tokens(t)))}, {r!r}::int[])" for i, ((label, t), r) in enumerate(zip(TEMPLATES, rivals(), strict=True)))
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
with t(i, label, t, need, rivals) as (values {rows}), f(p, label) as (values {phrases}),
d as (select row_number() over () as k, doc_id, translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}') as text from documents),
w as (select *, regexp_extract_all(text, '{word}') as w from d),
s as (select k, label, unnest(list_filter(range(0, len(w)), lambda i: w[i+1:i+len(p)] = p)) as s from w, f),
b as (select k, count(*) as n_base, min(s) as first_word, max(s) as last_word, list(distinct label) as base from s group by k),
l as (select distinct k, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t\r]*\n'))) as l from d),
x as (select k, l, regexp_extract_all(l, '{word}') as w from l),
m as (select k, l, i, label, rivals, len(t) as n, len(list_intersect(t, w)) as c, need from x, t),
g as (select *, c / n as share from m where c >= need),
o as (select k, label from g where not exists (select 1 from g as o where o.k = g.k and o.l = g.l and list_contains(g.rivals, o.i) and (o.share > g.share or o.share = g.share and o.n > g.n))),
h as (select k, list(distinct label) as best from o group by k),
a as (select k, list(distinct label) as found, max(share) as share from g group by k)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0 else coalesce(share, 0.0) end::double as score,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(best, [])))), ','), '') as best_labels
from w left join b using (k) left join a using (k) left join h using (k)
"""
