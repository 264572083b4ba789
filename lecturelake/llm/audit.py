"""Filter interaction audit: coalitions of filters tabulated, exact Shapley values by constrained least squares."""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, stored

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
#: Fewest words; least share of distinct words and most of capital letters, in percent; characters that a text may not hold.
LEAST_WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 3, "[#$%&*|]"


def shapley_weights(n: int) -> list[list[Fraction]]:
    """For each of n players its weights of the 2^n coalition values: Shapley values are these weighted sums.

    They solve a least squares problem exactly: shares phi with sum v(all) - v(none) that come nearest to
    v(S) - v(none) = sum of phi over S for every other coalition S, each weighted by the kernel
    (n - 1) / (C(n, |S|) |S| (n - |S|)). Its normal equations, bordered by the condition on the sum, are reduced in
    rationals for all coalition values at once, a column each, so that one solution serves every table of values.
    """
    size, full = 1 << n, (1 << n) - 1
    rows = [[Fraction(0)] * (n + 1 + size) for _ in range(n + 1)]
    for s in range(1, full):
        inside = [i for i in range(n) if s >> i & 1]
        weight = Fraction(n - 1, comb(n, len(inside)) * len(inside) * (n - len(inside)))
        for i in inside:
            for j in inside:
                rows[i][j] += weight
            rows[i][n + 1 + s] += weight
            rows[i][n + 1] -= weight
    for i in range(n):
        rows[i][n] = rows[n][i] = Fraction(1)
    rows[n][n + 1 + full], rows[n][n + 1] = Fraction(1), Fraction(-1)
    for c in range(n + 1):
        p = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[p] = rows[p], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n + 1):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [rows[i][n + 1 :] for i in range(n)]


def failures(text: Column, words: Column, is_copy: Column) -> Column:
    """A number with a bit for each filter that the text fails, A the lowest; words are the text's words."""
    fails = [
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITALS * F.length(text),
        text.rlike(MARKS),
        is_copy,
    ]
    return sum((F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(fails)), F.lit(0))


def failed_filters(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): one row per row of docs; mask has the bits of the filters that it fails, part is its lang.

    Equal texts are found by their MD5: only digests that several rows share are joined back, from a stored table, so
    that a text of which there are very many copies is split over tasks. Null texts and langs are empty ones. Nothing is
    smaller than a null doc_id, and it is smaller than nothing; rows of one doc_id are no copies of each other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    rows = stored(slim.select("doc_id", "part", F.unhex(F.md5("text")).alias("digest"), failures(F.col("text"), F.col("words"), F.lit(False)).alias("own")))
    firsts = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return rows.join(firsts, "digest", "left").select("doc_id", "part", (F.col("own") + F.when(copy, 1 << (len(FILTERS) - 1)).otherwise(0)).alias("mask"))


def coalitions(rows: DataFrame, n: int) -> DataFrame:
    """(part, rows, v): v holds for every set of n filters, by the number of its bits, what it removes of a part's rows
    (part, mask, good, toxic): n, good and toxic. Rows are counted by part and mask first, 2^n rows a part at most."""
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    each = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    removed = [F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("n", "good", "toxic")]
    table = each.groupBy("part", "coalition").agg(F.sum("n").alias("rows"), *removed)
    return table.groupBy("part").agg(F.max("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("coalition", "n", "good", "toxic"))).alias("v"))


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters (a letter each, the lowest bit first) and step; rows: part, mask, good, toxic.

    kept, removed, redundant, unique_fails, good_lost and toxic_lost are differences of the values of two coalitions;
    shapley is the filter's Shapley value of removed rows times the number of orders, a whole number.
    """
    n, whole = len(filters), factorial(len(filters))
    weights = [[int(x * whole) for x in row] for row in shapley_weights(n)]
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order):
            steps.append({"filter_order": "".join(filters[j] for j in order), "step": step + 1, "i": i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    fixed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, i: int, before: int, after: int>>")
    shares = F.array(*(F.aggregate(F.zip_with("v", F.lit(w), lambda x, c: x["n"] * c), F.lit(0).cast("long"), lambda a, x: a + x) for w in weights))
    table = coalitions(rows, n).withColumn("shares", shares).withColumn("s", F.explode(fixed))
    at = lambda coalition, c: F.col("v")[coalition][c]
    after, before, full = F.col("s.after"), F.col("s.before"), (1 << n) - 1
    alone = after - before
    removed = at(after, "n") - at(before, "n")
    return table.select(
        "part", "s.filter_order", "s.step", (F.col("rows") - at(after, "n")).alias("kept"), removed.alias("removed"), (at(alone, "n") - removed).alias("redundant"),
        (at(F.lit(full), "n") - at(F.lit(full) - alone, "n")).alias("unique_fails"), (at(after, "good") - at(before, "good")).alias("good_lost"), (at(after, "toxic") - at(before, "toxic")).alias("toxic_lost"),
        F.col("shares")[F.col("s.i")].alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit of the five filters over docs (doc_id, text, lang), with labels (doc_id, quality, toxic): part is each lang.

    A document with several labels is good, or toxic, if one of them says so; a null label says nothing, a null doc_id
    has none. Every row of docs counts, repeated ones too; other columns are ignored. No rows give no rows.
    """
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return audit(failed_filters(docs).join(said, "doc_id", "left").select("part", "mask", zero("good"), zero("toxic")))


def audit_sql() -> str:
    """DuckDB SQL for filter_audit over the views documents and labels: every order's steps counted row by row of masks."""
    bits = " ".join(f"WHEN '{c}' THEN {1 << i}" for i, c in enumerate(FILTERS))
    one = ", ".join(f"'{c}'" for c in FILTERS)
    return rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
f AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(w) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {DISTINCT} * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > {CAPITALS} * length(t))::INT
    + 8 * regexp_matches(t, '{MARKS}')::INT + 16 * coalesce(first < doc_id, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w JOIN f USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
k AS (SELECT unnest([{one}]) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o)),
b AS (SELECT s.*, CASE letter {bits} END AS bit, coalesce(list_sum(list_transform(range(1, step), lambda i: CASE filter_order[i::INT] {bits} END)), 0)::INT AS before FROM s),
r AS (SELECT part, filter_order, step, letter, sum(n) FILTER (WHERE mask & (before | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0) AS removed,
    sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0) AS toxic_lost
  FROM c, b GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley FROM r
"""
