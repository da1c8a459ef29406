"""Licences in documents by diagonal voting.

Templates are the wordings of licence notices. Every run of K words of a document is hashed
and joined to the places where the templates have it. A hit of document place p on template
place t votes for the diagonal p - t, where the template would begin. Votes are gathered by
diagonal; a word left out or put in moves the rest of a notice to a neighbouring diagonal,
so diagonals up to DRIFT apart are merged around the one with most votes. What has half of
its votes is verified word by word, and its key phrases must stand there unbroken.

Phrases are templates too, but exact: their own diagonal must match in every word.

The words that verification needs travel with the first hit of each run of hits, so texts
are scanned once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.decontaminate import item_words

K, DRIFT, LEAST_SHARE = 3, 3, 0.8
#: Words of the longest template: votes are bits of a long.
LONGEST = 64
#: Words of a document that are looked up together, and words around them that bands may reach.
SEGMENT, REACH = 512, LONGEST + DRIFT + 1
#: Template places up to which they are sent to every task.
BROADCAST_PLACES = 100_000

# Phrases and labels of the contract.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Wordings of public licence notices, in lower case and without punctuation,
# and the phrases in them that must not be broken.
TEMPLATES = (
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "version 3")),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("distributed on an as is basis",)),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    ("cc-by-4", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial 4 0",)),
    ("cc-by-sa-4", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike 4 0",)),
    ("cc0-1", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", ("with or without fee is hereby granted",)),
    ("lgpl-2", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("gnu lesser general public license", "version 2 1")),
    ("lgpl-3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ("gnu lesser general public license", "version 3")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("associated documentation files",)),
    ("mit", "licensed under the terms of the mit license", ("mit license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors",)),
)


def _place(words: list[str], phrase: str) -> tuple[int, int]:
    part = phrase.split(" ")
    for i in range(len(words) - len(part) + 1):
        if words[i : i + len(part)] == part:
            return i, len(part)
    raise ValueError(f"the template has no phrase {phrase!r}")


def _templates(phrases: Sequence[tuple], templates: Sequence[tuple]) -> list[tuple]:
    """(tpl, label, exact, words, keys) of both kinds; of K to LONGEST words each."""
    out = []
    for label, text, *keys in [*phrases, *templates]:
        words = text.split(" ")
        if not K <= len(words) <= LONGEST:
            raise ValueError(f"a template has {K} to {LONGEST} words: {text!r}")
        out.append((len(out), label, len(out) < len(phrases), words, [_place(words, p) for p in (keys[0] if keys else ())]))
    return out


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: Sequence[tuple] = PHRASES, templates: Sequence[tuple] = TEMPLATES) -> DataFrame:
    """(row, key, n_words, tpl, label, exact, at, n, share): the verified spans, and one row with a null tpl for every document.

    ``at`` is the word where the template begins (under 0 if its beginning is cut off), ``n``
    the template's words, ``share`` the part of them that stands in its place or up to DRIFT
    words beside it.
    """
    spark = docs.sparkSession
    known = _templates(phrases, templates)
    places = [(tpl, t, words[t - 1] if t else None, words[t : t + K], len(words)) for tpl, _, _, words, _ in known for t in range(len(words) - K + 1)]
    table = spark.createDataFrame(places, "tpl int, t int, before string, g array<string>, n int")
    table = table.select("tpl", "t", "before", "n", F.xxhash64(*[F.col("g")[j] for j in range(K)]).alias("h"))
    kinds = spark.createDataFrame(known, "tpl int, label string, exact boolean, words array<string>, keys array<struct<at:int,n:int>>")

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("doc"), item_words(F.col(f"`{text}`")).alias("w"))
    size = F.size("w")
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(SEGMENT)),
        lambda s: F.struct(s.alias("s"), F.slice("w", F.greatest(s - REACH, F.lit(0)) + 1, F.lit(SEGMENT + 2 * REACH)).alias("seg")),
    )
    cut = rows.select("row", "doc", size.cast("long").alias("n_words"), F.explode(cut).alias("x")).select("row", "doc", "n_words", "x.*")
    seg, s = F.col("seg"), F.col("s")
    lead = s - F.greatest(s - REACH, F.lit(0))  # words in seg before s
    last = F.least(F.lit(SEGMENT), F.size(seg) - lead - K + 1)
    # Words are read by their place and not in a lambda, so that hashing is compiled. Place -1
    # has no hash and stands for the document itself.
    looked = cut.select("row", "doc", "n_words", "s", "seg", F.explode(F.sequence(F.lit(-1), F.greatest(last, F.lit(0)) - 1)).alias("i"))
    i = F.col("i")
    looked = looked.withColumn("h", F.when(i >= 0, F.xxhash64(*[F.get(seg, lead + i + j) for j in range(K)])))
    small = F.broadcast(table) if len(places) <= BROADCAST_PLACES else table
    hits = looked.join(small, "h", "left").filter("t is not null or (i = -1 and s = 0)")

    d = s + i - F.col("t")
    begin = F.greatest(d - DRIFT, F.lit(0))
    band = F.slice(seg, begin - s + lead + 1, d + F.col("n") + DRIFT - begin)
    opens = (F.col("t") == 0) | F.coalesce(F.get(seg, lead + i - 1) != F.col("before"), F.lit(True))
    hits = hits.select(
        "row", F.when(F.col("tpl").isNull(), F.col("doc")).alias("doc"), F.when(F.col("tpl").isNull(), F.col("n_words")).alias("n_words"),
        "tpl", d.alias("d"), F.expr("shiftleft(1L, t)").alias("vote"), F.when(opens, band).alias("band"),
    )
    votes = hits.repartition("row").groupBy("row", "tpl", "d").agg(F.max("doc").alias("doc"), F.max("n_words").alias("n_words"), F.bit_or("vote").alias("votes"), F.max("band").alias("band"))

    near = Window.partitionBy("row", "tpl").orderBy("d").rangeBetween(-DRIFT, DRIFT)
    rank = F.struct(F.bit_count("votes"), -F.col("d"))
    merged = votes.withColumns({"all": F.bit_count(F.bit_or("votes").over(near)), "first": F.max(rank).over(near) == rank})
    held = merged.join(F.broadcast(kinds), "tpl", "left")
    n = F.size("words")
    # A diagonal's words begin here in its band.
    zero = F.col("d") - F.greatest(F.col("d") - DRIFT, F.lit(0))
    beside = F.array(*[F.lit(o) for o in range(-DRIFT, DRIFT + 1)])

    def word(i):
        return F.get("band", zero + i)

    whole = F.forall(F.transform("words", lambda x, i: F.coalesce(word(i) == x, F.lit(False))), lambda x: x)
    there = F.transform("words", lambda x, i: F.exists(beside, lambda o: F.coalesce(word(i + o) == x, F.lit(False))))
    share = F.size(F.filter(there, lambda x: x)) / n
    unbroken = F.forall(
        "keys", lambda k: F.exists(beside, lambda o: F.forall(F.sequence(k["at"], k["at"] + k["n"] - 1), lambda i: F.coalesce(word(i + o) == F.get("words", i), F.lit(False))))
    )
    candidate = F.col("first") & (2 * F.col("all") >= n - K + 1)
    judged = F.when(F.col("exact"), F.when(whole, 1.0)).when(candidate & unbroken, F.when(share >= LEAST_SHARE, share))
    held = held.withColumn("share", judged).filter("tpl is null or share is not null")
    return held.select("row", F.col("doc").alias(key), "n_words", "tpl", "label", "exact", F.col("d").alias("at"), n.alias("n"), "share")


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: Sequence[tuple] = PHRASES, templates: Sequence[tuple] = TEMPLATES) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of phrases, overlapping ones too; labels are those of phrases and
    of verified notices; score is the largest share of a verified span, 0 without any. Null and
    empty texts have no words and no labels; repeated rows, and rows with a null key, each get
    their own row; very long texts are looked up in segments; other columns are not read.
    """
    base = F.col("exact")
    found = spans(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "doc_id", "text", phrases, templates)
    out = found.groupBy("row").agg(
        F.max("doc_id").alias(key),
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("at"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("at"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")


def _sql_list(words: Sequence) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def oracle() -> str:
    """The same by texts of word runs instead of hashes, for DuckDB."""
    rows = ",\n".join(
        f"({tpl}, '{label}', {str(exact).lower()}, {_sql_list(words)}, [{', '.join(f'[{a}, {m}]' for a, m in keys)}]::INT[][])" for tpl, label, exact, words, keys in _templates(PHRASES, TEMPLATES)
    )
    near = f"OVER (PARTITION BY r, tpl ORDER BY d RANGE BETWEEN {DRIFT} PRECEDING AND {DRIFT} FOLLOWING)"
    return rf"""
WITH d0 AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tp(tpl, label, exact, tw, keys) AS (VALUES {rows}),
tg AS (SELECT tpl, t, array_to_string(list_slice(tw, t + 1, t + {K}), ' ') AS g FROM (SELECT tpl, tw, unnest(range(0, len(tw) - {K - 1})) AS t FROM tp)),
dg AS (SELECT r, p, array_to_string(list_slice(w, p + 1, p + {K}), ' ') AS g FROM (SELECT r, w, unnest(range(0, len(w) - {K - 1})) AS p FROM d0)),
votes AS (SELECT r, tpl, p - t AS d, count(*) AS n, list(t) AS ts FROM dg JOIN tg USING (g) GROUP BY ALL),
merged AS (SELECT *, len(list_distinct(flatten(list(ts) {near}))) AS every, max((n, -d)) {near} = (n, -d) AS leads FROM votes),
held AS (SELECT r, tpl, label, exact, tw, keys, d, w FROM merged JOIN tp USING (tpl) JOIN d0 USING (r) WHERE exact OR (leads AND 2 * every >= len(tw) - {K - 1})),
judged AS (SELECT r, label, exact, d, len(list_filter(range(0, len(tw)), lambda t: tw[t + 1] = CASE WHEN d + t >= 0 THEN w[d + t + 1] END)) = len(tw) AS whole,
  len(list_filter(range(0, len(tw)), lambda t: len(list_filter(range(-{DRIFT}, {DRIFT + 1}), lambda o: d + t + o >= 0 AND w[d + t + o + 1] = tw[t + 1])) > 0)) / len(tw) AS share,
  len(list_filter(keys, lambda k: len(list_filter(range(-{DRIFT}, {DRIFT + 1}), lambda o: d + k[1] + o >= 0 AND list_slice(w, d + k[1] + o + 1, d + k[1] + o + k[2]) = list_slice(tw, k[1] + 1, k[1] + k[2]))) > 0)) = len(keys) AS keyed FROM held),
found AS (SELECT r, label, exact, d, CASE WHEN exact THEN 1.0::DOUBLE ELSE share END AS share FROM judged WHERE CASE WHEN exact THEN whole ELSE keyed AND share >= {LEAST_SHARE} END)
SELECT doc_id, len(w)::BIGINT AS n_words, count(d) FILTER (exact) AS n_base, min(d) FILTER (exact) AS first_word, max(d) FILTER (exact) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0) AS score
FROM d0 LEFT JOIN found USING (r) GROUP BY r, doc_id, w"""
