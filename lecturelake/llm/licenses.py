"""License scans by diagonal voting: word k-grams joined to template positions, votes by diagonal, merging, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import ascii_lower, stored

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Passages of well-known license texts and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-text",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-text",
    "you should have received a copy of the gnu general public license along with this program": "gpl-text",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl-text",
    "creative commons attribution": "cc-by-text",
    "all rights reserved": "reserved",
}
#: Offset by which neighbouring diagonals may differ, and the share of a template's k-grams that a span must hold.
DRIFT, ENOUGH = 2, 0.75


def template_grams(spark: SparkSession) -> DataFrame:
    """(template, at, gram, hash) of every k-gram of every template: a fixed table of a few hundred rows."""
    rows = []
    for i, text in enumerate([*BASE, *TEMPLATES]):
        words = text.split(" ")
        rows += [(i, at, " ".join(words[at : at + K])) for at in range(len(words) - K + 1)]
    return spark.createDataFrame(rows, "template int, at int, gram string").withColumn("hash", F.xxhash64("gram"))


def template_table(spark: SparkSession) -> DataFrame:
    """(template, label, base, grams) of every template."""
    rows = [(i, label, i < len(BASE), len(text.split(" ")) - K + 1) for i, (text, label) in enumerate([*BASE.items(), *TEMPLATES.items()])]
    return spark.createDataFrame(rows, "template int, label string, base boolean, grams int")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, template, diagonal, n, first, last): k-grams of a document that stand at one offset from their
    places in a template.

    All rolling k-grams of all texts are joined by hash to the broadcast template positions, a fixed table; the gram
    itself is compared too, so a hash collision gives no vote. Votes are combined before the shuffle. Repeated rows
    (same doc_id and text) vote once.
    """
    grams = docs.select("doc_id", "digest", F.posexplode(F.expr("transform(slice(words, 1, greatest(size(words) - 1, 0)), (w, i) -> concat(w, ' ', words[i + 1]))")).alias("place", "gram"))
    grams = grams.withColumn("hash", F.xxhash64("gram"))
    met = grams.join(F.broadcast(template_grams(docs.sparkSession)), ["hash", "gram"])
    diagonal = (F.col("place") - F.col("at")).alias("diagonal")
    return met.groupBy("doc_id", "digest", "template", diagonal).agg(F.count_distinct("at").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, template, n, first, last, whole): verified places of templates.

    Diagonals of one template that differ by DRIFT or less and lie within the template's length of each other are one
    span, as a text with inserted or missing words makes; it is kept if its votes reach ENOUGH of the template's
    k-grams. whole: one diagonal alone holds all of them, so the phrase stands there word for word.
    """
    size = F.broadcast(template_table(docs.sparkSession))
    one = votes(docs).join(size, "template")
    order = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT) | (F.col("first") - F.lag("last").over(order) > F.col("grams") + DRIFT)
    whole = F.col("n") == F.col("grams")
    runs = one.withColumn("new", F.coalesce(apart, F.lit(True)) | whole | F.lag(whole, 1, False).over(order))
    runs = runs.withColumn("run", F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = runs.groupBy("doc_id", "digest", "template", "run", "label", "base", "grams").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"), F.max(whole).alias("whole")
    )
    return merged.withColumn("share", F.least(F.lit(1.0), F.col("n") / F.col("grams"))).where(F.col("share") >= ENOUGH)


def license_labels(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases; first_word and last_word are their smallest and largest start. labels has
    base labels and those of the templates, score the greatest share of a template that was found (0 for none). A null
    text counts as empty. Null and repeated doc_ids are allowed; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("digest"), words_of(F.col("text")).alias("words"))
    base = F.col("base") & F.col("whole")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans(named).where(~F.col("base") | F.col("whole")).groupBy("doc_id", "digest").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("share").alias("score"),
    )
    rows = named.select("doc_id", "digest", F.size("words").cast("long").alias("n_words")).alias("a")
    met = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest"))
    return rows.join(stored(found).alias("b"), met, "left").select(
        "a.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def labels_sql() -> str:
    """DuckDB SQL for license_labels over the view documents."""
    both = [*BASE.items(), *TEMPLATES.items()]
    grams = ", ".join(f"({i}, {at}, '{' '.join(text.split(' ')[at : at + K])}')" for i, (text, _) in enumerate(both) for at in range(len(text.split(" ")) - K + 1))
    table = ", ".join(f"({i}, '{label}', {i < len(BASE)}, {len(text.split(' ')) - K + 1})" for i, (text, label) in enumerate(both))
    return rf"""
WITH g(template, pos, gram) AS (VALUES {grams}), t(template, label, base, grams) AS (VALUES {table}),
d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
p AS (SELECT n, place, w[place + 1] || ' ' || w[place + 2] AS gram FROM (SELECT n, w, unnest(range(0, len(w) - 1)) AS place FROM d)),
v AS (SELECT n, template, place - pos AS diagonal, count(DISTINCT pos) AS c, min(place) AS first, max(place) AS last FROM p JOIN g USING (gram) GROUP BY ALL),
o AS (SELECT v.*, label, base, grams, c = grams AS whole FROM v JOIN t USING (template)),
r AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER x > {DRIFT} OR first - lag(last) OVER x > grams + {DRIFT}, true) OR whole OR lag(whole, 1, false) OVER x AS new FROM o WINDOW x AS (PARTITION BY n, template ORDER BY diagonal)),
q AS (SELECT *, sum(new::INT) OVER (PARTITION BY n, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM r),
m AS (SELECT n, template, run, label, base, least(1.0, sum(c) / grams::DOUBLE)::DOUBLE AS share, min(first) AS first, bool_or(whole) AS whole FROM q GROUP BY n, template, run, label, base, grams),
f AS (SELECT n, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM m WHERE share >= {ENOUGH} AND (NOT base OR whole) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN f USING (n)
"""
