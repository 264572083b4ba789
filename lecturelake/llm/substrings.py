"""Substring dedup: content-defined chunks from a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

#: Least and greatest bytes of a chunk, and the bits of the hash that are zero at a cut (a cut every 32 bytes, about).
LEAST, MOST, BITS = 16, 128, 5
#: A repeat is a run of repeated chunks with so many words. A repeated passage loses up to a chunk or two at either
#: end, where chunks hold other text too, so that passages of 50 words or more reach it.
LEAST_WORDS = 16
#: A random 32-bit number for each byte value, by rule; the hash of a place depends on the 32 bytes up to it.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the rolling hash: twice the hash before plus the byte's gear value, in 32 bits.

    Sums of 1, 2, 4, 8, 16 and 32 terms come from one another, so whole texts are hashed without a loop over bytes.
    """
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h = longer
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks: the first place past LEAST bytes whose hash has BITS leading zeros, or MOST bytes, or the end."""
    out, last = [], 0
    for at in (np.flatnonzero(gear_hashes(data) < np.uint32(1 << (32 - BITS))) + 1).tolist():
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST:
            last = at
            out.append(at)
    while len(data) - last > MOST:
        last += MOST
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


_COLUMNS = ("doc_id", "row", "d1", "d2", "start", "end", "words")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        ids, rows, texts = batch.columns
        counts, digests, starts, ends, words, held, first = [], [], [], [], [], 0, 0

        def out(upto: int) -> pa.RecordBatch:
            take = np.repeat(np.arange(first, upto), counts)
            pairs = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            flat = [np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (starts, ends, words)]
            columns = [ids.take(pa.array(take)), rows.take(pa.array(take)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *map(pa.array, flat)]
            return pa.RecordBatch.from_arrays(columns, names=list(_COLUMNS))

        for i in range(len(texts)):
            raw = texts[i].as_py().encode()
            data = np.frombuffer(raw, np.uint8)
            end = np.array(cuts(data), np.int64)
            start = np.concatenate([[0], end[:-1]]).astype(np.int64)[: len(end)]
            space = _SPACE[data]
            begins = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))]) if len(data) else np.zeros(1, np.int64)
            digests += [digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())]
            counts.append(len(end))
            starts.append(start)
            ends.append(end)
            words.append(begins[end] - begins[start])
            held += len(end)
            if held >= 100_000:
                yield out(i + 1)
                counts, digests, starts, ends, words, held, first = [], [], [], [], [], 0, i + 1
        if counts:
            yield out(len(texts))


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, row, d1, d2, start, end, words): the chunks of every text; row tells texts of one doc_id apart, d1 and d2
    are the 128-bit digest, start and end bytes of the UTF-8 text, words those that begin in the chunk."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"), text.alias("text"))
    return slim.mapInArrow(_chunks, "doc_id long, row long, d1 long, d2 long, start int, end int, words int")


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Passages that stand in more than one place: doc_id, row, start, end (bytes), n_words, first_doc_id, removed.

    A passage is a run of neighbouring chunks whose digests stand elsewhere too, in other documents or in the same one.
    first_doc_id is the smallest doc_id of those that hold its chunks. removed is true where each of these chunks stands
    in a document with a smaller doc_id, or before in the same text; so one place of every chunk stays. Digests are
    combined before the shuffle (least and greatest place and smallest doc_id only), so a chunk that a third of all rows
    share costs a row a task, and the join back can split it. A null or empty text has no chunks. Rows that repeat a
    doc_id and text are one document; a null doc_id is never the first.
    """
    every, place = chunks(docs), F.xxhash64("row", "start")
    seen = every.groupBy("d1", "d2").agg(F.min(place).alias("least"), F.max(place).alias("most"), F.min("doc_id").alias("first_doc_id"))
    common = stored(seen.where("least < most").select("d1", "d2", "first_doc_id"))  # a plain table: Spark can split a skewed join with it
    shared = every.join(common, ["d1", "d2"])
    shared = shared.groupBy("doc_id", "row", "start").agg(*(F.first(c).alias(c) for c in ("end", "words", "first_doc_id", "d1", "d2")))
    text = Window.partitionBy("doc_id", "row").orderBy("start")
    sight = F.row_number().over(Window.partitionBy("doc_id", "row", "d1", "d2").orderBy("start"))
    elsewhere = F.col("first_doc_id").isNotNull() & ~F.col("first_doc_id").eqNullSafe(F.col("doc_id"))
    new = F.coalesce((F.col("start") != F.lag("end").over(text)) | (F.col("removed") != F.lag("removed").over(text)), F.lit(True))
    runs = shared.repartition("doc_id", "row").withColumn("removed", elsewhere | (sight > 1)).withColumn("new", new.cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = runs.groupBy("doc_id", "row", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.min("first_doc_id").alias("first_doc_id"), F.first("removed").alias("removed")
    )
    return out.where(F.col("n_words") >= least_words).drop("run")


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs without the passages that stand in a document with a smaller doc_id, or before in the same text; columns stay.

    A null or empty text stays as it is, and an empty table is one again. Rows that repeat a doc_id and text lose the
    same passages each."""
    gone = repeats(docs, least_words).where("removed").groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    text, kept = F.coalesce("text", F.lit("")), docs.columns
    wrapped = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"), text.cast("binary").alias("b"))
    met = wrapped.alias("a").join(gone.alias("g"), F.col("a.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("a.row") == F.col("g.row")), "left")
    part = lambda at, n: F.substring(F.col("b"), at + 1, n)
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], part(acc["at"], s["start"] - acc["at"])).alias("out"))
    cut = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out")), step, lambda acc: F.concat(acc["out"], part(acc["at"], F.octet_length("b"))))
    return met.select("r", F.when(F.col("spans").isNotNull(), F.decode(cut, "UTF-8")).alias("cut")).select(
        *(F.coalesce("cut", "r.text").alias("text") if c == "text" else F.col(f"r.`{c}`") for c in kept)
    )
