"""Licence scans with a positional rare-token index, in DataFrame functions only.

Method. Words of the licence templates form a positional index: for each word,
its postings (template, position); words too common to tell templates apart are
left out. In each file all indexed words are looked up, so that none of several
licences crowds out another;
subtracting a posting's position from the word's place gives the offset at which
the template would stand, and postings are intersected by counting equal
(template, offset). A template that reaches its share at one offset is accepted
if each of its mandatory key phrases stands about where the template has it.

All of it works within a row on arrays, so that no file is exchanged, however
many files carry the same licence.

Defined cases. Null and empty texts have no words, no places and score 0. A
label is named once however often it occurs. Very long texts are scanned whole. All other input columns
are left out, so that none can clash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases of the base rule and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Labels of the method, notices in public use, and their mandatory key phrases.
TEMPLATES = {
    "agpl-3.0": ("gnu affero general public license version 3", ["affero general public license"]),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    "bsl-1.0": ("distributed under the boost software license version 1 0", ["boost software license"]),
    "cc-by-4.0": ("licensed under cc by 4 0", ["cc by 4 0"]),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "cc0-1.0": ("released under cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    "epl-2.0": ("made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    "gpl-2.0": ("licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    "lgpl": ("licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    "mit-notice": ("released under the mit license", ["mit license"]),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
}
#: A template's label where it differs from its name.
NAMED = {"mit-notice": "mit"}
# Words of the templates too common to be looked up.
COMMON = set("0 1 2 3 4 a and any are by code copy files following for form free in into is made met of or person provided public purpose source subject that terms the this to under universal use v version with without".split())

#: Share of a template's indexed words that must agree on an offset, and words by which a phrase may stand off its place.
SHARE, NEAR = 0.6, 3

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _tokens(text: str) -> str:
    return f"filter(split(translate(coalesce(cast(`{text}` as string), ''), '{_UPPER}', '{_UPPER.lower()}'), '{_GAP}'), w -> w != '')"


def _words() -> list[str]:
    found = {w for t, _ in TEMPLATES.values() for w in t.split() if w not in COMMON}
    return sorted(found | {w for p in PHRASES for w in p.split()[:1]} | {p.split()[0] for _, ps in TEMPLATES.values() for p in ps})


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _places(phrase: str) -> str:
    """Places where the words of a phrase stand consecutively, by way of the hits on its first word."""
    first, *rest = phrase.split()
    same = " and ".join([f"h.w = '{first}'", *(f"get(tokens, h.i + {k + 1}) <=> '{w}'" for k, w in enumerate(rest))])
    return f"transform(filter(hits, h -> {same}), h -> h.i)"


def _place(template: str, phrase: str) -> int:
    """The word of the template at which the phrase begins."""
    return len(f" {template} ".split(f" {phrase} ")[0].split())


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score and ``found`` (template, offset, share) of every file."""
    words = _words()
    rare = {w for w in words if w not in COMMON}
    names = sorted(TEMPLATES)
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, name in enumerate(names):
        for p, w in enumerate(TEMPLATES[name][0].split()):
            if w in rare:
                postings.setdefault(w, []).append((t, p))
    indexed = sorted(postings)
    posted = "map(" + ", ".join(f"'{w}', array({', '.join(f'struct({t} as t, {p} as p)' for t, p in postings[w])})" for w in indexed) + ")"
    phrases = sorted({p for _, ps in TEMPLATES.values() for p in ps} | set(PHRASES))
    column = {p: f"p{k}" for k, p in enumerate(phrases)}

    d = df.select(F.col(id_col), F.expr(_tokens(text_col)).alias("tokens"))
    hits = f"filter(transform(tokens, (w, i) -> struct(i as i, w as w)), h -> h.w in ({_list(words)}))"
    d = d.withColumn("hits", F.expr(hits))
    d = d.withColumns({c: F.expr(_places(p)) for p, c in column.items()})
    d = d.withColumn("n_words", F.size("tokens").cast("long")).drop("tokens")
    found = f"transform(element_at({posted}, h.w), p -> struct(p.t as t, h.i - p.p as d))"
    # Every indexed word votes, since a template must reach its share of all of them.
    votes = f"array_sort(flatten(transform(filter(hits, h -> h.w in ({_list(indexed)})), h -> {found})))"
    d = d.withColumn("votes", F.expr(votes)).drop("hits")
    starts = "transform(filter(transform(votes, (v, k) -> if(coalesce(get(votes, k - 1) = v, false), -1, k)), k -> k >= 0), k -> k)"
    d = d.withColumn("starts", F.expr(starts))
    d = d.withColumn("runs", F.expr("transform(starts, (s, k) -> struct(votes[s].t as t, votes[s].d as d, coalesce(get(starts, k + 1), size(votes)) - s as n))"))
    accepted = []
    for t, name in enumerate(names):
        template, needed = TEMPLATES[name]
        wanted = sum(w in rare for w in template.split())
        near = " and ".join(f"exists({column[p]}, x -> x between r.d + {_place(template, p) - NEAR} and r.d + {_place(template, p) + NEAR})" for p in needed)
        reach = f"r.n / {float(wanted)}D"
        accepted.append(f"transform(filter(runs, r -> r.t = {t} and {reach} >= {SHARE} and {near}), r -> struct('{NAMED.get(name, name)}' as label, r.d as at, least(1.0D, {reach}) as share))")
    d = d.withColumn("found", F.expr(f"if(size(runs) = 0, cast(array() as array<struct<label:string,at:int,share:double>>), concat({', '.join(accepted)}))"))
    base = {p: column[p] for p in PHRASES}
    d = d.withColumn("places", F.expr(f"concat({', '.join(base.values())})"))
    labels = ", ".join(f"if(size({c}) > 0, '{PHRASES[p]}', null)" for p, c in base.items())
    d = d.withColumn("b", F.expr(f"array_sort(filter(array({labels}), x -> x is not null))"))
    return d.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("b", ",").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(b, transform(found, f -> f.label)))), ',')").alias("labels"),
        F.expr("greatest(if(size(b) > 0, 0.5D, 0.0D), coalesce(array_max(transform(found, f -> f.share)), 0.0D))").alias("score"),
        "found",
    )
