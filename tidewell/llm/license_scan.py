"""License labels of documents: exact phrases and an exact set-similarity join.

Text blocks are stretches of ``2 * STEP`` words, one beginning at every
``STEP``-th word of a text, whatever its line breaks; so a notice of at most
``STEP`` words lies in some block as a whole.  A template is found in a block
if the block holds at least ``CONTAINMENT`` of the template's distinct words.

Template words are ordered by the number of documents that have them (all
documents are counted), rarest first.  A block's words, in that order, are
looked up in an index of the templates' prefixes (the rarest words, one of
which must be present).  A template met there is a candidate if the block has
enough words (length filter) and if, from the first word they share on, enough
words are left in either (positional filter); candidates are then counted
exactly.  Templates, order and index are literals of fixed place in the plan,
whose form does not depend on their number, and every document is judged within
its own row: nothing is shuffled but word counts.  DataFrame functions only.

A null text counts as empty: no words, no labels, score 0.  Repeated rows are
judged row by row; extra columns are ignored; very long texts and lines are
scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINMENT = 0.8
STEP = 32
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed values: opening sentences and notices of public licenses
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def needed(template: str, containment: float = CONTAINMENT) -> int:
    """Distinct words of the template that a block must hold."""
    return max(1, math.ceil(containment * len(set(template.split())) - 1e-9))


# the characters of WORD by what they are, and the others: Java is many times slower with the negated class
EDGE = r"[0-9a-z\x{80}-\x{10FFFF}]"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def any_word(words: list[str]) -> str:
    """A pattern of whole words that share their beginnings, so few branches are tried at a place."""

    def tree(tails: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for t in tails:
            if t:
                heads.setdefault(t[0], []).append(t[1:])
        rest = "|".join(c + tree(v) for c, v in sorted(heads.items()))
        if not heads:
            return ""
        return f"(?:{rest})?" if "" in tails else f"(?:{rest})" if len(heads) > 1 else rest

    return rf"(?<!{EDGE}){tree(sorted(set(words)))}(?!{EDGE})"


def template_counts(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each template word occurs; texts has a column `t`."""
    found = F.array_distinct(F.regexp_extract_all("t", F.lit(any_word(vocabulary)), F.lit(0)))
    rows = texts.select(F.explode(found).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in rows.collect()}  # a row for each template word at most


def _lower(text: Column) -> Column:
    """A-Z in lower case; other letters don't matter here, but the Kelvin sign must not become a k."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.contains("\u212a"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def template_hits(order: list[str], templates: list[tuple[str, list[str], int]]) -> Column:
    """Templates (label, words in order, words needed) found in the array `words`: label and share of each."""
    prefix: dict[str, list[int]] = {}
    for k, (_, words, need) in enumerate(templates):
        for w in words[: len(words) - need + 1]:
            prefix.setdefault(w, []).append(k + 1)
    first_words = _strings(prefix)
    index = F.map_from_arrays(first_words, F.array(*[F.array(*[F.lit(k) for k in ks]) for ks in prefix.values()]))
    label, needs = _strings(t[0] for t in templates), F.array(*[F.lit(t[2]) for t in templates])
    words_of = F.array(*[_strings(t[1]) for t in templates])
    shortest = min(t[2] for t in templates)

    def found(block: Column) -> Column:
        def judged(k: Column) -> Column:
            words, need = F.element_at(words_of, k), F.element_at(needs, k)
            start = F.get(F.filter(F.slice(words, F.lit(1), F.size(words) - need + 1), lambda w: F.array_contains(block, w)), F.lit(0))
            left = F.least(F.size(words) - F.array_position(words, start), F.size(block) - F.array_position(block, start)) + 1
            share = F.when((F.size(block) >= need) & (left >= need), F.size(F.array_intersect(words, block)))
            return F.struct(F.element_at(label, k).alias("label"), F.when(share >= need, share / F.size(words)).alias("share"))

        met = F.array_distinct(F.flatten(F.transform(F.array_intersect(block, first_words), lambda w: F.element_at(index, w))))
        return F.filter(F.transform(met, judged), lambda x: x["share"].isNotNull())

    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / STEP).cast("int"))
    blocks = F.transform(starts, lambda i: F.array_intersect(_strings(order), F.slice("words", i * STEP + 1, F.lit(2 * STEP))))
    blocks = F.array_distinct(F.filter(blocks, lambda b: F.size(b) >= shortest))
    return F.flatten(F.transform(blocks, found))


def scan(documents: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    if any(len(t.split()) > STEP for _, t in templates):
        raise ValueError(f"a template has more than {STEP} words")
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _lower(F.col("text")).alias("t"))
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    count = template_counts(base, vocabulary)
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    ordered = [(label, sorted(set(t.split()), key=rank.__getitem__), needed(t, containment)) for label, t in templates]
    prefix = {w for _, words, need in ordered for w in words[: len(words) - need + 1]}
    # most texts have no word of a prefix and no phrase: only the others are cut into words
    spoken = "|".join(SEPARATOR.join(p.split()) for p, _ in phrases)
    maybe = F.lit(False)
    for w in sorted({max(p.split(), key=len) for p, _ in phrases}):
        maybe = maybe | F.col("t").contains(w)
    tokens = F.regexp_extract_all("t", F.lit(f"{EDGE}++"), F.lit(0))
    rows = base.select("doc_id", "t", F.regexp_count("t", F.lit(f"{EDGE}++")).cast("long").alias("n_words"), (maybe & F.col("t").rlike(spoken)).alias("near"), F.col("t").rlike(any_word(sorted(prefix))).alias("hit"))
    rows = rows.select("doc_id", "n_words", "near", "hit", F.when(F.col("near") | F.col("hit"), tokens).alias("words"))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    nothing = F.array().cast("array<struct<label:string,share:double>>")
    rows = rows.select(
        "doc_id",
        "n_words",
        F.when(F.col("near"), joined).otherwise(F.lit(" ")).alias("norm"),
        F.when(F.col("hit"), template_hits(order, ordered)).otherwise(nothing).alias("found"),
    )
    phrase = "|".join(p for p, _ in phrases)
    pattern = rf"(?<= )(?:{phrase})(?= )"
    rows = rows.select("*", *[F.col("norm").contains(f" {p} ").alias(f"h{k}") for k, (p, _) in enumerate(phrases)])
    any_base = F.lit(False)
    for k in range(len(phrases)):
        any_base = any_base | F.col(f"h{k}")
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    before_first = F.substr("norm", F.lit(1), F.regexp_instr("norm", F.lit(pattern)) - 1)
    before_last = F.regexp_extract("norm", rf"(?s)^(.* )(?:{phrase})(?= )", 1)
    base_names = F.array_compact(F.array(*[F.when(F.col(f"h{k}"), F.lit(label)) for k, (_, label) in enumerate(phrases)]))
    text = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.when(any_base, F.regexp_count("norm", F.lit(pattern))).otherwise(0).cast("long").alias("n_base"),
        F.when(any_base, spaces(before_first) - 1).cast("long").alias("first_word"),
        F.when(any_base, spaces(before_last) - 1).cast("long").alias("last_word"),
        text(base_names).alias("base_labels"),
        text(F.concat(base_names, F.col("found.label"))).alias("labels"),
        F.greatest(F.when(any_base, 1.0).otherwise(0.0), F.coalesce(F.array_max("found.share"), F.lit(0.0))).alias("score"),
    )


def sql() -> str:
    """The same by brute force: every block against every template."""
    values = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))!r}, {needed(t)})" for k, (label, t) in enumerate(TEMPLATES))
    hits = " union all ".join(f"select '{p}' phrase, {p.split()!r} ws, '{label}' label" for p, label in PHRASES)
    return rf"""
with d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') t from documents),
w as (select doc_id, t, regexp_extract_all(t, '{WORD}') ws from d),
p as ({hits}),
places as (select doc_id, label, unnest(list_filter(range(0, len(w.ws)), lambda i: w.ws[i + 1:i + len(p.ws)] = p.ws)) as place
  from w join p on contains(t, p.ws[1]) and contains(t, p.ws[-1])),
base as (select doc_id, count(*) n_base, min(place) first_word, max(place) last_word, list_distinct(list(label)) names from places group by doc_id),
tpl(k, label, ws, need) as (values {values}),
starts as (select doc_id, ws, unnest(range(0, len(ws), {STEP})) i from w),
blocks as (select distinct doc_id, list_sort(list_distinct(ws[i + 1:i + {2 * STEP}])) ls from starts),
m as (select doc_id, label, max(len(list_intersect(ls, tpl.ws)) / len(tpl.ws)::double) share from blocks join tpl on len(ls) >= need and len(list_intersect(ls, tpl.ws)) >= need group by all),
method as (select doc_id, list_distinct(list(label)) names, max(share) score from m group by doc_id)
select w.doc_id, len(w.ws)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(array_to_string(list_sort(base.names), ','), '') base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.names, []), coalesce(method.names, [])))), ',') labels,
  greatest(case when base.n_base > 0 then 1.0::double else 0 end, coalesce(method.score, 0))::double score
from w left join base using (doc_id) left join method using (doc_id)
"""
