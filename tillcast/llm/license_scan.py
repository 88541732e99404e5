"""License scan: phrases in their places, and an exact set-similarity join of text blocks with license notices.

DataFrame functions only.  A text's words are cut into overlapping blocks of ``BLOCK`` words, one every ``STEP``
words, so that every passage of at most STEP + 1 words lies whole in some block.  A notice is found in a block
that holds at least ``THRESHOLD`` of its distinct words (containment).  The join that finds all such pairs:

* The words of all notices are ordered by their frequency in the blocks of the whole corpus, rarest first.
  Words outside the notices can't add to an overlap, so a block is its set of notice words, in that order.
* Length filter: a block with fewer words than a notice needs can't match it.
* Prefix filter: two sets that share ``need`` words share one among the first |T| - need + 1 of the notice
  and the first |B| - need + 1 of the block.  Only those words meet in the join.
* Positional filter: the first shared word, at positions i and j, leaves at most
  1 + min(|T| - i - 1, |B| - j - 1) shared words.  The pair of the first shared word always passes it.
* Verification: the overlap is counted on the full sets.

The notices are a fixed list of a few hundred words, so their side of the join is broadcast; nothing else is.
No row but one small one per text with a hit is shuffled for the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same class by what it holds, ten times faster in Java's regular expressions.
JAVA_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Sentences of public license notices, lower case, in words; at most STEP + 1 words each.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
            "the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

BLOCK, STEP = 64, 32
#: Containment in tenths: 9 of 10 distinct words of a notice.
THRESHOLD = 9


def need(words: set[str], tenths: int = THRESHOLD) -> int:
    return -(-len(words) * tenths // 10)


def words_of(text: Column) -> Column:
    """Words of a text in order, A-Z in lower case; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(JAVA_WORD), F.lit(0))


def places(words: Column, phrase: str) -> Column:
    """All starts (from 0) at which the phrase's words stand consecutively."""
    parts = phrase.split()

    def here(i):
        found = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            found = found & (F.get(words, i + k) == p)
        return found

    some = (F.size(words) >= len(parts)) & F.array_contains(words, parts[-1])
    return F.when(some, F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)).otherwise(F.array().cast("array<int>"))


def blocks_of(words: Column, vocabulary: list[str], least: int) -> Column:
    """(block, words) of every block with at least ``least`` distinct words of the vocabulary."""
    last = F.greatest(F.lit(0), F.floor((F.size(words) - 1) / STEP).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(
        b.alias("block"), F.array_distinct(F.filter(F.slice(words, b * STEP + 1, BLOCK), lambda w: w.isin(vocabulary))).alias("words")))
    return F.filter(cut, lambda b: F.size(b["words"]) >= least)


def notice_rows(spark, order: list[str], notices, tenths: int) -> DataFrame:
    """One row per word of each notice's prefix: token, i, label, t_words, t_size, t_need.  A fixed, small table."""
    place, rows = {w: i for i, w in enumerate(order)}, []
    for label, text in notices:
        t = sorted(set(text.split()), key=place.__getitem__)
        n = need(set(t), tenths)
        rows += [(t[i], i, label, t, len(t), n) for i in range(len(t) - n + 1)]
    return spark.createDataFrame(rows, "token string, i int, label string, t_words array<string>, t_size int, t_need int")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices=NOTICES,
         tenths: int = THRESHOLD) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, hits) of every row of ``df``.

    ``base_labels``: labels of phrases whose words stand consecutively, at ``n_base`` places from word
    ``first_word`` to ``last_word`` (null without any).  ``labels`` adds those of notices found in a block.
    ``score``: 1 with a phrase, else the largest containment found, else 0.  ``hits``: (block, label,
    containment) of every block and label that meet, sorted; block b starts at word b * STEP.
    Null texts are empty; empty texts have no words and score 0.  Repeated rows and ids, and null ids, are
    rows of their own; other columns are ignored."""
    spark = df.sparkSession
    vocabulary = sorted({w for _, text in notices for w in text.split()})
    least = min(need(set(text.split()), tenths) for _, text in notices)
    words = df.select(F.col(f"`{id_col}`").alias("id"), words_of(F.col(f"`{text_col}`").cast("string")).alias("words"))
    w = F.col("words")
    starts = words.select("id", F.size(w).cast("bigint").alias("n_words"), F.struct(*[places(w, p).alias(f"p{i}") for i, p in enumerate(phrases)]).alias("at"),
                          blocks_of(w, vocabulary, least).alias("blocks"))
    found = [(F.col(f"at.p{i}"), label) for i, label in enumerate(phrases.values())]
    every = F.concat(*[p for p, _ in found])
    base = F.filter(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in found]), lambda x: x.isNotNull())
    rows = starts.select(
        F.monotonically_increasing_id().alias("_row"), "id", "n_words", F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base"), "blocks")
    rows = materialize(rows, "license-blocks")

    # Global order: the number of blocks that hold each word; the vocabulary is that of the fixed notices.
    counted = rows.select(F.explode("blocks.words").alias("ws")).select(F.explode("ws").alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in counted.collect()}
    order = sorted(vocabulary, key=lambda x: (seen.get(x, 0), x))

    sets = rows.select("_row", F.explode("blocks").alias("b")).select(
        "_row", "b.block", F.array_intersect(F.array(*[F.lit(x) for x in order]), F.col("b.words")).alias("tokens"))
    sets = sets.withColumn("b_size", F.size("tokens"))
    prefix = sets.select("*", F.posexplode(F.slice("tokens", F.lit(1), F.col("b_size") - least + 1)).alias("j", "token"))
    pairs = prefix.join(F.broadcast(notice_rows(spark, order, notices, tenths)), "token")
    left = 1 + F.least(F.col("t_size") - F.col("i") - 1, F.col("b_size") - F.col("j") - 1)
    pairs = pairs.where((F.col("b_size") >= F.col("t_need")) & (F.col("j") <= F.col("b_size") - F.col("t_need")) & (left >= F.col("t_need")))
    shared = F.size(F.array_intersect("tokens", "t_words"))
    hits = pairs.withColumn("shared", shared).where("shared >= t_need")
    hits = hits.groupBy("_row", "block", "label").agg(F.max(F.col("shared") / F.col("t_size")).alias("containment"))
    hits = hits.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("block", "label", "containment"))).alias("hits"))

    out = rows.drop("blocks").join(hits, "_row", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<block:int,label:string,containment:double>>")))
    labels = F.array_sort(F.array_union("base", F.col("hits.label")))
    return out.select(
        "id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("hits.containment"), F.lit(0.0))).alias("score"), "hits")


def _op11_sql() -> str:
    """Plain containment of every block and notice, without any filter: the same rows by the definition alone."""
    t = ", ".join(f"({i}, '{label}', '{w}', {len(set(text.split()))}, {need(set(text.split()))})"
                  for i, (label, text) in enumerate(NOTICES) for w in sorted(set(text.split())))
    size = max(len(p.split()) for p in PHRASES)
    ahead = ", ".join(f"lead(word, {k}) OVER (PARTITION BY r ORDER BY pos) AS w{k}" for k in range(1, size))
    at = " UNION ALL ".join(
        f"SELECT r, pos, '{label}' AS label FROM l WHERE " + " AND ".join(f"{'word' if not k else f'w{k}'} = '{w}'" for k, w in enumerate(p.split()))
        for p, label in PHRASES.items())
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
  FROM documents),
u AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
l AS (SELECT *, {ahead} FROM u),
p AS ({at}),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS base FROM p GROUP BY r),
t (notice, label, word, t_size, t_need) AS (VALUES {t}),
k AS (SELECT r, word, pos // {STEP} AS block FROM u UNION SELECT r, word, pos // {STEP} - 1 FROM u WHERE pos >= {STEP}),
h AS (SELECT r, block, any_value(label) AS label, count(DISTINCT k.word) / any_value(t_size) AS containment
      FROM k JOIN t ON k.word = t.word GROUP BY r, block, notice HAVING count(DISTINCT k.word) >= any_value(t_need)),
m AS (SELECT r, list_distinct(list(label)) AS labels, max(containment) AS containment FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(labels, [])))), ','), '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(containment, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""


OP11_SQL = _op11_sql()
