"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums to token budgets, complete epochs first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored, word_count

#: By source in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: All targets together, times all words; and the most of a source or document, times its own words.
SHARE, MOST = 1.5, 2.0
SEED = 7
#: Rows of a source, about, that one sorting task gets, and sources up to which their table is broadcast (some
#: 20 MB, as a row holds up to 62 pairs of doubles).
BUCKET_ROWS, BROADCAST_SOURCES = 4096, 20_000
#: Ratio of neighbouring rates as which weights are counted; from 0.05 to 1 there are 62 of them.
RATIO = 1.05


def quality_weight(text: Column) -> Column:
    """Share of a text's characters that are letters or white space, 0.05 at least and for a text without characters."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\x20\x09-\x0D]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(kept, F.length(text)), F.lit(0.05)))


def sampling_key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """An exponential variate with rate `weight`, fixed by doc_id and seed: the smallest keys are the sample."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def measured(docs: DataFrame) -> DataFrame:
    """docs as one column `row`, with source, doc_id, size, quality weight and sampling key beside it."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    slim = docs.select(
        row, F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("size"),
        quality_weight(F.col("text")).alias("weight"),
    )
    return slim.withColumn("key", sampling_key(F.col("doc_id"), F.col("weight")))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with `rank` from 0 by code point, null last; the rows are sorted in ranges, only counts of ranges meet."""
    order = F.col("source").asc_nulls_last()
    ranges = stored(sources.orderBy(order).withColumn("range", F.spark_partition_id()))
    counts, first, before = ranges.groupBy("range").count().orderBy("range").collect(), [], 0
    for r in counts:
        first += [F.lit(r["range"]), F.lit(before)]
        before += r["count"]
    if not first:
        return ranges.drop("range").withColumn("rank", F.lit(0))
    within = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return ranges.withColumn("rank", within + F.create_map(*first)[F.col("range")]).drop("range")


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, n, source_size, target) of every source in rows (source, size).

    share times all sizes is dealt out by weight; what is above `most` times a source's size is dealt out again by
    weight to those below, until none is above. The water level is found by repeated sums over the table of sources.
    """
    sources = ranked(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(sources.select("source", "n", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")))
    level, full = 0.0, -1
    while True:
        capped = F.col("cap") < level * F.col("weight")
        x = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("cap"))).alias("gone"), F.sum(F.when(~capped, F.col("weight"))).alias("open"), F.count(F.when(capped, 1)).alias("full")
        ).first()
        if x["full"] == full or not x["open"]:
            break
        full, level = x["full"], (share * (x["all"] or 0) - (x["gone"] or 0.0)) / x["open"]
    return sources.select("source", "n", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def with_rates(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """sources with `rates`: an array of (rate, share), the share of a source's rows with weights of about that rate.

    Weights are rounded to powers of RATIO, so the array is short, and counted before the shuffle.
    """
    near = F.round(F.log(F.col("weight")) / F.log(F.lit(RATIO))).cast("int")
    counts = rows.groupBy("source", near.alias("power")).count()
    pair = F.struct(F.pow(F.lit(RATIO), F.col("power")).alias("rate"), F.col("count").alias("share"))
    rates = counts.groupBy(F.col("source").alias("s")).agg(F.array_sort(F.collect_list(pair)).alias("rates"))
    share = F.transform("rates", lambda x: F.struct(x["rate"].alias("rate"), (x["share"] / F.col("n")).alias("share")))
    return sources.join(rates, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("rates", share)


def _bucket() -> Column:
    """A range of keys, in the order of keys; a source has one for about BUCKET_ROWS of its rows.

    Keys of rate w are below k with probability 1 - exp(-w k); over all rates of a source this gives the share of its
    rows that is expected below a key, whatever its weights are. It rises with the key, so any rates give right results.
    """
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    below = F.aggregate("rates", F.lit(0.0), lambda acc, x: acc + x["share"] * (1 - F.exp(-x["rate"] * F.col("key"))))
    return F.least(buckets - 1, F.floor(below * buckets)).cast("long")


def _beside(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of their source, broadcast if there are few sources; else Spark splits a skewed one."""
    small = sources.count() <= BROADCAST_SOURCES
    other = sources.withColumnRenamed("source", "their_source")
    met = F.col("source").eqNullSafe(F.col("their_source"))
    return rows.join(F.broadcast(other) if small else other, met).drop("their_source")


def plan(rows: DataFrame, **options) -> DataFrame:
    """Of each source: n, source_size, target, epochs, and the bucket in which its fractional budget ends with what
    is left of the budget there.

    Sums of buckets, made before the shuffle, are prefix-summed; no source's documents meet in a task.
    """
    sources = stored(with_rates(targets(rows, **options), rows))
    buckets = _beside(rows, sources).groupBy("source", _bucket().alias("bucket")).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.withColumn("until", F.sum("words").over(run))
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    budgets = sources.withColumn("epochs", epochs).withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    ends = _beside(buckets, budgets.select("source", "budget")).where((F.col("until") > F.col("budget")) & (F.col("until") - F.col("words") <= F.col("budget")))
    ends = ends.select(F.col("source").alias("s"), F.col("bucket").alias("last"), (F.col("budget") - F.col("until") + F.col("words")).alias("left"))
    ends = ends.groupBy("s").agg(F.min(F.struct("last", "left")).alias("end"))
    out = budgets.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    return stored(out.select("source", "n", "rates", "source_size", "target", "epochs", F.coalesce("end.last", F.lit(-1)).alias("last"), F.coalesce("end.left", F.lit(0)).alias("left")))


def taken(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with source_size, target and taken: the words that the mix takes of each row.

    Every row is taken whole once for each complete epoch of its source; then rows are taken by ascending key until the
    rest of the budget is used up. Only the rows of the bucket in which it ends are sorted; of the row that crosses the
    end, the first words up to it are taken.
    """
    placed = _beside(rows, sources).withColumn("bucket", _bucket())
    inner = F.when(F.col("bucket") < F.col("last"), F.col("size")).otherwise(F.lit(0))
    sure = placed.where("bucket <> last").withColumn("extra", inner)
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.sum("size").over(order) + F.col("size")))
    edge = placed.where("bucket = last").withColumn("extra", part)
    return sure.unionByName(edge).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target (its source's) and taken, in words.

    A null text has size 0; a null source is a source of its own, the last. Null and repeated doc_ids are allowed;
    rows of equal keys (the same doc_id) go by size, and rows equal in that too are interchangeable. Sources without
    words have target 0. An empty input gives an empty result. Reruns agree: keys depend on doc_id and seed only.
    """
    slim = docs.select("doc_id", "source", "text")
    rows = stored(measured(slim).select("source", "doc_id", "size", "weight", "key"))
    return taken(rows, plan(rows, **options)).select("doc_id", "size", "source_size", "target", "taken")


def sample(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: docs' rows, each as many times as the mix takes it; of the row at the end of a source's budget
    the whole is taken if half of it or more is in the budget. Columns stay as they are, whatever their names.

    Rows without words (a null text among them) are not taken; null and repeated doc_ids, null sources and an empty table
    are treated as in mix.
    """
    rows = measured(docs)
    slim = stored(rows.select("source", "doc_id", "size", "weight", "key"))
    copies = F.floor(F.try_divide("taken", "size") + 0.5).cast("int")
    out = taken(rows, plan(slim, **options)).where("size > 0").withColumn("copies", copies)
    return out.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def mix_sql() -> str:
    """DuckDB SQL for mix over the view documents."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || md5('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT + 0.5) / {1 << 52}.0)
      / greatest(0.05, coalesce(length(regexp_replace(text, '[^\p{{L}}\x20\x09-\x0D]+', '', 'g')) / nullif(length(text), 0)::DOUBLE, 0.05)) AS key
  FROM documents),
s AS (
  SELECT source, source_size, {list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS w, {MOST} * source_size::DOUBLE AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
r AS (
  SELECT *, ({SHARE} * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, cap / w) FROM r WHERE cap >= level * w) * w)::DOUBLE AS target FROM s),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
b AS (SELECT *, floor(target - epochs * source_size)::BIGINT AS budget FROM e)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + size)))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
