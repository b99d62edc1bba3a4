"""License scans by a positional index of rare words, in built-in functions only.

Each template keeps the postings (template, place) of its highest-IDF words. A text's rare words are looked up; each pair of places
votes for the offset between text and template, and the template's score is the IDF weight of the words that agree on its best
offset (a bin of 2 SLACK places) over the weight of all its rare words; texts without any word of SIGNS score 0. A template counts when its score reaches THRESHOLD
and all its mandatory phrases stand in the text. Base phrases are found apart from that, by exact places, and always stay.

The templates are a fixed table, so their postings travel as literals in the plan. Nothing is shuffled.

Defined cases: null and empty texts have no words, no labels, score 0; output columns replace input columns of the same name.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, SLACK, RARE = 0.5, 8, 12

# The phrases that name a licence, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Opening notices of public licences, with phrases that must stand in a text that bears them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted", "free of charge")),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("in compliance with the license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("free software", "gnu general public license")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("free software", "lesser general public license")),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("free software", "affero general public license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    ("mpl", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license you may obtain a copy of the license at software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied", ("mozilla public license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at", ("eclipse public license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("alter it and redistribute it freely",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software", ("accompanying documentation covered by this license",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit", ("creative commons attribution",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", ("free and unencumbered software",)),
)
# Words of which each mandatory phrase and each base phrase but "cc by" holds one.
SIGNS = ("license", "permission", "redistribution", "software", "distribute", "commons", " fee", "charge", "waived")
COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def rare_postings(templates=TEMPLATES, rare: int = RARE) -> tuple[dict[str, list[tuple[int, int]]], list[float], dict[str, float]]:
    """(word -> [(template, place)], weight of each template, IDF of each word): of each template the distinct words of highest IDF, at all their places."""
    words = [t.split() for _, t, _ in templates]
    df = Counter(w for ws in words for w in set(ws))
    idf = {w: math.log(1 + len(words) / n) for w, n in df.items()}
    postings: dict[str, list[tuple[int, int]]] = {}
    weights = []
    for k, ws in enumerate(words):
        top = sorted(set(ws), key=lambda w: (-idf[w], -len(w), w))[:rare]
        places = [(p, w) for p, w in enumerate(ws) if w in top]
        weights.append(sum(idf[w] for _, w in places))
        for p, w in places:
            postings.setdefault(w, []).append((k, p))
    return postings, weights, idf


def _places(norm: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(number, first word, last word) of the places of a phrase in ' a b c '."""
    pieces = F.split(norm, f"(?<= ){phrase}(?= )")
    n = F.size(pieces) - 1
    spaces = lambda c: F.length(c) - F.length(F.translate(c, " ", ""))
    first = F.when(n > 0, spaces(F.get(pieces, F.lit(0))) - 1)
    after = spaces(F.get(pieces, n)) - 1
    total = spaces(norm) - 1
    return n, first, F.when(n > 0, total - after - len(phrase.split()))


def _alignments(words: Column, postings: dict[str, list[tuple[int, int]]], idf: dict[str, float]) -> Column:
    """Array of (template, offset, place, weight) votes, in order."""
    table = F.create_map(*[x for w, ps in postings.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), F.lit(idf[w]).alias("v")) for k, p in ps]))])
    indexed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    hits = F.filter(indexed, lambda x: x["w"].isin(list(postings)))
    votes = F.flatten(F.transform(hits, lambda x: F.transform(F.element_at(table, x["w"]), lambda q: F.struct(q["k"].alias("k"), (x["i"] - q["p"]).alias("o"), q["p"].alias("p"), q["v"].alias("v")))))
    return F.array_sort(votes)


def _best(votes: Column, k: int, weight: float, slack: int) -> Column:
    """Share of template k's weight at its best offset. Offsets are counted in bins of twice the slack on two grids, half a bin apart, so all votes within slack of each other share a bin on one of them; a bin counts each place of the template once."""
    mine = F.filter(votes, lambda v: v["k"] == k)
    best = []
    for shift in (0, slack):
        bin_of = lambda v: F.floor((v["o"] + F.lit(shift)) / (2 * slack)).cast("int")  # noqa: B023, E731
        start = F.struct(F.lit(None).cast("int").alias("bin"), F.array().cast("array<int>").alias("seen"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

        def step(a: Column, v: Column) -> Column:
            fresh = ~a["bin"].eqNullSafe(bin_of(v))  # noqa: B023
            again = ~fresh & F.array_contains(a["seen"], v["p"])
            total = F.when(fresh, v["v"]).when(again, a["sum"]).otherwise(a["sum"] + v["v"])
            seen = F.when(fresh, F.array(v["p"])).when(again, a["seen"]).otherwise(F.concat(a["seen"], F.array(v["p"])))
            return F.struct(bin_of(v).alias("bin"), seen.alias("seen"), total.alias("sum"), F.greatest(a["best"], total).alias("best"))  # noqa: B023

        best.append(F.coalesce(F.aggregate(mine, start, step, lambda a: a["best"]), F.lit(0.0)))
    return F.greatest(*best) / F.lit(weight)


def scan(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, slack: int = SLACK) -> DataFrame:
    """The documents with COLUMNS added."""
    postings, weights, idf = rare_postings()
    docs = docs.drop(*COLUMNS)
    t = F.coalesce(F.col(text), F.lit(""))
    # Separators and capitals are single bytes, so words count alike before and after lowering A-Z.
    out = docs.withColumn("_n", F.size(F.split(F.concat(F.lit("."), t), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)))
    out = out.withColumn("_e", F.when(F.length(t) == 0, 1).otherwise(F.substring(t, -1, 1).rlike(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").cast("int")))
    # Each phrase of the base and each mandatory phrase holds one of these; the others skip all that follows. lower() folds more than A-Z, so it only lets more through.
    low = F.lower(t)
    sign = reduce(lambda a, b: a | b, [low.contains(w) for w in SIGNS]) | (low.contains("cc") & low.rlike("cc[^a-z0-9]+by"))
    out = out.withColumn("_sign", sign)
    plain = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = out.withColumn("_norm", F.when(F.col("_sign"), F.concat(F.lit(" "), F.btrim(F.regexp_replace(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))))
    out = out.withColumn("n_words", (F.col("_n") - 1 - F.col("_e")).cast("long"))
    for k, (phrase, _) in enumerate(BASE):
        n, first, last = _places(F.col("_norm"), phrase)
        out = out.withColumn(f"_b{k}", F.when(F.col("_norm").contains(f" {phrase} "), F.struct(n.alias("n"), first.alias("f"), last.alias("l"))))
    out = out.withColumn("_v", F.when(F.col("_norm").isNotNull(), _alignments(F.split(F.btrim(F.col("_norm")), " "), postings, idf)))
    for k in range(len(TEMPLATES)):
        out = out.withColumn(f"_s{k}", F.when(F.size("_v") > 0, F.least(F.lit(1.0), _best(F.col("_v"), k, weights[k], slack))).otherwise(0.0))
    verified = [reduce(lambda a, b: a & b, [F.col("_norm").contains(f" {p} ") for p in phrases]) for _, _, phrases in TEMPLATES]
    base = F.array_compact(F.array(*[F.when(F.col(f"_b{k}.n") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    more = F.array_compact(F.array(*[F.when((F.col(f"_s{k}") >= threshold) & verified[k], F.lit(label)) for k, (label, _, _) in enumerate(TEMPLATES)]))
    at = lambda f, pick: pick(*[F.col(f"_b{k}.{f}") for k in range(len(BASE))]).cast("long")
    return out.select(
        *docs.columns,
        "n_words",
        sum((F.coalesce(F.col(f"_b{k}.n"), F.lit(0)) for k in range(len(BASE))), F.lit(0)).cast("long").alias("n_base"),
        at("f", F.least).alias("first_word"),
        at("l", F.greatest).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.greatest(*[F.col(f"_s{k}") for k in range(len(TEMPLATES))]).alias("score"),
    )
