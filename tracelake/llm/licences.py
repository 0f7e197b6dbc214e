"""Licence scan by a positional rare-token index, in DataFrame functions only.

One pass splits every file into words, notes which words of the mandatory phrases it has, and keeps the words of the files that have
all of some phrase.  Document frequencies are counted over the notes; each phrase is indexed under its rarest words with their
places.  In a file, the places of such words give the places where the phrase would have to begin; where several of its rare words
agree, or the rarest one stands, the phrase is compared word by word.  The score is the greatest share of a licence's or notice's
text, in pairs of neighbouring words, that stands behind a verified phrase, within a quarter more words than the text has; so words
put in or left out cost the pairs around them only.

Rows: a null text has no words; a file without licence words gets no label and score 0; repeated rows are each scanned; an empty
table gives no rows; further columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored

#: Label -> mandatory phrase, and the licence's or notice's text from the phrase's first word on.
BASE = {
    "mit": ("under the mit license", "under the mit license"),
    "apache-2": (
        "apache license version 2",
        "apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "cc-by-nc": ("cc by nc", "cc by nc 4 0"),
}
MORE = {
    "gpl-3": ("gnu general public license version 3", "gnu general public license version 3"),
    "bsd": (
        "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
    ),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to "
        "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
        "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
    ),
    "cc-by-sa": ("cc by sa", "cc by sa 4 0"),
    "mpl-2": ("mozilla public license version 2", "mozilla public license version 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    "reserved": ("all rights reserved", "all rights reserved"),
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: neither ASCII sign nor blank; after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def noted(docs: DataFrame, templates: dict, text: str, keep: tuple[str, ...]) -> DataFrame:
    """docs' `keep` columns with __n words, those of the phrases' words that a file has, and its words if it has all of a phrase's."""
    phrases = [sorted(set(phrase.split())) for phrase, _ in templates.values()]
    vocabulary = sorted({w for p in phrases for w in p})
    d = docs.select(*keep, words_of(F.col(text)).alias("__w")).withColumn("__has", F.array_intersect("__w", F.array(*map(F.lit, vocabulary))))
    may = F.lit(False)
    for p in phrases:
        may = may | (F.size(F.array_intersect("__has", F.array(*map(F.lit, p)))) == len(p))
    return d.select(*keep, F.size("__w").cast("long").alias("__n"), "__has", F.when(may, F.col("__w")).alias("__w"))


def rare_words(notes: DataFrame, templates: dict, kept: int = 2) -> dict[str, list[tuple[str, int]]]:
    """label -> the phrase's rarest words (fewest documents, then the longest) with their first place in it."""
    counted = notes.select(F.explode("__has").alias("w")).groupBy("w").count().collect()  # as many rows as licence words
    df = {r["w"]: r["count"] for r in counted}
    return {
        label: [(w, phrase.split().index(w)) for w in sorted(set(phrase.split()), key=lambda w: (df.get(w, 0), -len(w), w))[:kept]]
        for label, (phrase, _) in templates.items()
    }


def scan_licences(docs: DataFrame, templates: dict | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' `keep` columns with n_words and found: an array of (label, start, share), start counting words from 0, share how
    much of the wording stands there."""
    templates = templates or {**BASE, **MORE}
    d = stored(noted(docs, templates, text, keep))
    rare = rare_words(d, templates)
    looked_up = sorted({w for r in rare.values() for w, _ in r})
    hit = F.filter(F.transform("__w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*looked_up))
    places = [phrase_places(label, *templates[label], rare[label]) for label in templates]
    empty = F.array().cast("array<struct<label:string,start:bigint,share:double>>")
    found = F.when(F.size("__hit") > 0, F.flatten(F.array(*places))).otherwise(empty)
    return d.withColumn("__hit", hit).select(*keep, F.col("__n").alias("n_words"), found.alias("found"))


def pairs_of(full: list[str]) -> list[str]:
    """The distinct pairs of neighbouring words of a wording."""
    return list(dict.fromkeys(" ".join(p) for p in zip(full, full[1:], strict=False)))


def reach(full: list[str]) -> int:
    """In how many words from the phrase on the wording is looked for."""
    return len(full) + len(full) // 4


def posted(word: str, at: int) -> Column:
    """Where a phrase with that word at that place would begin, for every place of the word in the file."""
    return F.transform(F.filter("__hit", lambda x: x["w"] == word), lambda x: x["i"] - at)


def phrase_places(label: str, phrase: str, wording: str, rare: list[tuple[str, int]]) -> Column:
    """The places (label, start, share) of a phrase, by the postings of its rarest words."""
    key, full = phrase.split(), wording.split()
    postings = [posted(w, p) for w, p in rare]
    if len(key) != len(set(key)):  # a word that stands more than once in the phrase has a posting for each place
        postings = [F.concat(*[posted(rare[0][0], p) for p, k in enumerate(key) if k == rare[0][0]])]
    starts = F.array_distinct(postings[0])
    for p in postings[1:]:
        starts = F.array_intersect(starts, p)

    def stands(s: Column) -> Column:
        return (s >= 0) & (F.slice("__w", F.greatest(s, F.lit(0)) + 1, len(key)) == F.array(*map(F.lit, key)))

    pairs = pairs_of(full)

    def place(s: Column) -> Column:
        own = F.slice("__w", s + 1, reach(full))
        here = F.transform(F.sequence(F.lit(1), F.size(own) - 1), lambda i: F.concat_ws(" ", F.get(own, i - 1), F.get(own, i)))
        share = F.size(F.array_intersect(F.array(*map(F.lit, pairs)), here)) / len(pairs)
        return F.struct(F.lit(label).alias("label"), s.cast("long").alias("start"), share.alias("share"))

    return F.transform(F.filter(starts, stands), place)


def licence_digest(docs: DataFrame) -> DataFrame:
    def joined(x: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(x, lambda p: p["label"]))))

    d = scan_licences(docs).withColumn("base", F.filter("found", lambda p: p["label"].isin(*BASE)))
    starts = F.transform("base", lambda p: p["start"])
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def digest_sql() -> str:
    """The digest in DuckDB's SQL, straight from the definition of a place."""

    def places(label: str, phrase: str, wording: str) -> str:
        key, full = phrase.split(), wording.split()
        ok = " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(key))
        pairs = pairs_of(full)
        here = f"list_transform(range(i + 1, least(i + {reach(full)}, len(w))), lambda j: concat(w[j], ' ', w[j + 1]))"
        share = f"len(list_intersect([{', '.join(map(repr, pairs))}], {here}))"
        return f"list_transform(list_filter(range(len(w)), lambda i: {ok}), lambda i: {{'label': '{label}', 'start': i, 'share': {share} / {float(len(pairs))}}})"

    every = ", ".join(places(k, *v) for k, v in {**BASE, **MORE}.items())
    base = ", ".join(f"'{k}'" for k in BASE)
    labels = "coalesce(array_to_string(list_sort(list_distinct(list_transform({0}, lambda p: p.label))), ','), '')"
    return f"""
with words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
hits as (select doc_id, len(w) as n_words, flatten([{every}]) as found from words),
split as (select *, list_filter(found, lambda p: p.label in ({base})) as base from hits)
select doc_id, cast(n_words as bigint) as n_words, cast(len(base) as bigint) as n_base,
 cast(list_min(list_transform(base, lambda p: p.start)) as bigint) as first_word,
 cast(list_max(list_transform(base, lambda p: p.start)) as bigint) as last_word,
 {labels.format("base")} as base_labels, {labels.format("found")} as labels,
 coalesce(list_max(list_transform(found, lambda p: cast(p.share as double))), 0.0) as score
from split"""
