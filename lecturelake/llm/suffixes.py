"""Suffix-array dedup: q-gram buckets of suffixes, refined by sorting on the bucket identifiers of later offsets.

The corpus is cut so that no task needs it whole. Of any LENGTH bytes the gram with the smallest hash is the anchor: equal
strings have equal anchors at equal places, so all suffixes that can agree for LENGTH bytes lie in the bucket of one
anchor. Buckets of one text alone are done; the others get their suffixes, and are sorted in tasks by bucket-pointer
refinement. A bucket that is too large for a task is refined over tasks first, by what stands beside its anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

#: Bytes of a repeat, of an anchor, and of the first buckets of a sort.
LENGTH, ANCHOR, FIRST = 50, 16, 8
#: Grams of LENGTH bytes, one of which is the anchor.
WINDOW = LENGTH - ANCHOR + 1
#: Bytes of texts, or of suffixes, that a task looks at together, and rows up to which a bucket is sorted in one task.
BLOCK, MOST_ROWS = 1 << 20, 50_000
_U = np.uint64


def _slide(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """f over every `width` neighbours, from results over 1, 2, 4 and so on."""
    k = 1
    while 2 * k <= width:
        x, k = f(x[: len(x) - k], x[k:]), 2 * k
    return f(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that sorts as they do."""
    x = data.astype(_U)
    for k in (1, 2, 4):
        x = (x[: len(x) - k] << _U(8 * k)) | x[k:]
    return x


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    x = _words(data)
    h = x[:-8] * _U(0x9E3779B97F4A7C15) ^ (x[8:] * _U(0xC2B2AE3D27D4EB4F) >> _U(7))
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ h >> _U(29)


class _Texts:
    """Texts of a block side by side: where strings of LENGTH bytes may start, gram hashes and anchors."""

    def __init__(self, raws: list[bytes]):
        self.raw = b"".join(raws)
        sizes = np.array([len(r) for r in raws], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        data = np.frombuffer(self.raw, np.uint8)
        self.hashes = _gram_hashes(data)
        self.valid = np.zeros(len(data) - LENGTH + 1, bool)
        for a, b in zip(self.starts.tolist(), (self.ends - LENGTH + 1).tolist()):
            self.valid[a : max(a, b)] = True
        self.least = _slide(np.minimum, self.hashes, WINDOW)
        pad = np.zeros(WINDOW - 1, _U)
        seen = _slide(np.maximum, np.concatenate([pad, np.where(self.valid, self.least, _U(0)), pad]), WINDOW)
        self.anchors = np.flatnonzero(seen == self.hashes)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Row numbers and texts, of LENGTH bytes or more, in blocks of BLOCK bytes or one text."""
    rows, raws, held = [], [], 0
    for i, raw in enumerate(x.as_py() for x in batch.column(column)):
        if len(raw) < LENGTH:
            continue
        if rows and held + len(raw) > BLOCK:
            yield rows, raws
            rows, raws, held = [], [], 0
        rows.append(i)
        raws.append(raw)
        held += len(raw)
    if rows:
        yield rows, raws


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in schema.split(", ")])


ORDINARY, SURE, SEVERAL = 0, 1, 2
_ANCHORS = "h long, tid long, kind int"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of texts (tid, raw), once a text. What several texts of a block share is known to be shared: each of these
    gets a SURE row, which need meet no other, and the hash goes on once, as SEVERAL."""
    for batch in batches:
        tids = batch.column(0).to_numpy()
        for rows, raws in _blocks(batch, 1):
            own, first = np.unique(tids[rows], return_index=True)
            t = _Texts([raws[i] for i in first])
            h, text = t.hashes[t.anchors].view(np.int64), t.text_of(t.anchors)
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, bool)
            h, text = h[once], text[once]
            new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            shared = np.bincount(group, minlength=1)[group] > 1 if len(h) else np.zeros(0, bool)
            kind = np.where(shared, SURE, ORDINARY)
            many = h[new & shared]
            yield _batch(_ANCHORS, np.concatenate([h, many]), np.concatenate([own[text], np.zeros(len(many), np.int64)]), np.concatenate([kind, np.full(len(many), SEVERAL)]).astype(np.int32))


_SHARED = "tid long, h long"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, h) of anchors that two texts or more have; anchors come sorted by (h, kind, tid). Of a hash whose first rows
    all name one text, that text waits until another shows."""
    at, waits, open_ = None, None, False  # the hash at hand, the only text that has it so far, whether it is shared
    for batch in batches:
        h, tid, kind = (batch.column(k).to_numpy() for k in range(3))
        sure = kind == SURE
        out_t, out_h = [tid[sure]], [h[sure]]
        h, tid, kind = h[~sure], tid[~sure], kind[~sure]
        if len(h):
            new = np.concatenate([[True], h[1:] != h[:-1]])
            begins = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            single = kind == ORDINARY
            least = np.minimum.reduceat(np.where(single, tid, np.iinfo(np.int64).max), begins)
            most = np.maximum.reduceat(np.where(single, tid, np.iinfo(np.int64).min), begins)
            known = np.logical_or.reduceat(~single, begins) | (least < most)
            if at is not None and h[0] == at:
                known[0] |= open_ or (waits is not None and least[0] <= most[0] and least[0] != waits)
                if known[0] and waits is not None:
                    out_t.append(np.array([waits]))
                    out_h.append(np.array([at]))
                    single &= ~((group == 0) & (tid == waits))
                    waits = None
            elif at is not None:
                waits = None
            keep = known[group] & single
            keep[1:] &= ~((h[1:] == h[:-1]) & (tid[1:] == tid[:-1]) & single[:-1])
            out_t.append(tid[keep])
            out_h.append(h[keep])
            at, open_ = int(h[-1]), bool(known[-1])
            waits = None if open_ else int(tid[-1])
        yield _batch(_SHARED, np.concatenate(out_t), np.concatenate(out_h))


_PIECES = "h long, s long, doc_id long, more long, nth int, start int, n int, at int, piece binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of LENGTH bytes of texts (doc_id, nth, raw, hs) that have an anchor in hs, as runs of neighbours with
    one anchor; s is a digest of a run's bytes, `at` the anchor's place in them. The smallest doc_id of a block that holds
    a run has the bytes themselves, as piece, and how far the block's largest such doc_id lies above, as more."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        ids, nth = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for rows, raws in _blocks(batch, 2):
            t = _Texts(raws)
            text, hashes = t.text_of(t.anchors), t.hashes[t.anchors]
            wanted = np.zeros(len(t.anchors), bool)
            edges = np.searchsorted(text, np.arange(len(rows) + 1))
            for k, i in enumerate(rows):
                a, b = edges[k], edges[k + 1]
                wanted[a:b] = np.isin(hashes[a:b].view(np.int64), batch.column(3)[i].values.to_numpy())
            places = np.flatnonzero(t.valid)
            near = np.searchsorted(t.anchors, places)  # the first anchor in the string; then the first with its least hash
            left = np.arange(len(places))
            while len(left):
                left = left[hashes[near[left]] != t.least[places[left]]]
                near[left] += 1
            places, near = places[wanted[near]], near[wanted[near]]
            if not len(places):
                continue
            begins = np.flatnonzero(np.concatenate([[True], (near[1:] != near[:-1]) | (places[1:] != places[:-1] + 1)]))
            start, n = places[begins], np.diff(np.concatenate([begins, [len(places)]]))
            anchor = near[begins]
            slices = [t.raw[a:b] for a, b in zip(start.tolist(), (start + n + LENGTH - 1).tolist())]
            doc = text[anchor]
            h, s = hashes[anchor].view(np.int64), np.array([digest(x) for x in slices], _U).view(np.int64)
            doc_ids = ids[rows][doc]
            order = np.lexsort((doc_ids, s, h))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (s[order][1:] != s[order][:-1])])
            first = np.flatnonzero(new)
            more = np.zeros(len(order), np.int64)
            more[order[first]] = np.maximum.reduceat(doc_ids[order], first) - doc_ids[order[first]]
            same = np.ones(len(order), bool)
            same[order[first]] = False
            held = pa.array([None if x else y for y, x in zip(slices, same.tolist())], pa.binary())
            yield _batch(_PIECES, h, s, doc_ids, more, nth[rows][doc], (start - t.starts[doc]).astype(np.int32), n.astype(np.int32), (t.anchors[anchor] - start).astype(np.int32), held)


def refined(bucket: np.ndarray, room: np.ndarray, depth: int, offset: int) -> np.ndarray:
    """Buckets of suffixes that agree for `depth` bytes, split into those that agree for depth + offset.

    bucket numbers the first place of each suffix's bucket in the order of suffixes; room has the bytes left from each
    place. The members of every bucket are sorted by the bucket of the suffix `offset` later, which is as deep as the last
    refinement has made it, so that depth doubles. Buckets of one suffix, and suffixes with too little room, stay.
    """
    size = np.bincount(bucket, minlength=len(bucket))
    at = np.flatnonzero((room >= depth + offset) & (size[bucket] > 1))
    if not len(at):
        return bucket
    mine, later = bucket[at], bucket[at + offset]
    order = np.lexsort((later, mine))
    at, mine, later = at[order], mine[order], later[order]
    own = np.concatenate([[True], mine[1:] != mine[:-1]])
    part = own | np.concatenate([[True], later[1:] != later[:-1]])
    place = np.arange(len(at))
    out = bucket.copy()
    out[at] = mine + np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(own, place, 0))
    return out


def suffix_buckets(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, begins): for each place of the pieces side by side a number that two places with `length` bytes left share
    if and only if these bytes are equal, by bucket-pointer refinement; begins has the places where pieces start.

    Suffixes are bucketed by FIRST bytes; then buckets are refined by the buckets of later offsets, 8, 16 and so on."""
    data = np.frombuffer(b"".join(pieces) + bytes(FIRST), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(ends[-1])
    grams = _words(data)[: ends[-1]]
    order = np.argsort(grams, kind="stable")
    new = np.concatenate([[True], grams[order][1:] != grams[order][:-1]])
    bucket = np.empty(len(grams), np.int64)
    bucket[order] = np.maximum.accumulate(np.where(new, np.arange(len(grams)), 0))
    short = room < FIRST  # these reach into the next piece; none is as long as a repeat, or the later part of one
    depth = FIRST
    while depth < length:
        offset = min(depth, length - depth)
        bucket, depth = refined(np.where(short, np.arange(len(bucket)), bucket), room, depth, offset), depth + offset
    return bucket, ends - sizes


#: Rows of buckets; h is the anchor where the key is a finer one, else null. shape holds, a byte each, the first and last start of the strings and where the core begins and ends.
_ROWS = "key long, h long, s long, doc_id long, more long, shape long, piece binary"
_RUNS = "h long, s long, doc_id long, a int, b int"


def _shape(lo: Column, hi: Column, core: Column, core_end: Column) -> Column:
    return sum((F.shiftleft(c.cast("long"), 8 * k) for k, c in enumerate((hi, core, core_end), 1)), lo.cast("long"))


def _runs(h, s, doc_id, a=None, b=None) -> pa.RecordBatch:
    nothing = pa.nulls(len(h), pa.int32())
    return _batch(_RUNS, h, s, doc_id, *(nothing if x is None else x.astype(np.int32) for x in (a, b)))


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns change."""
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])) if len(columns[0]) else np.zeros(0, np.int64)


def _anchor(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return pc.coalesce(rows.column(1), rows.column(0)).to_numpy()


def _earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, s, doc_id, a, b): the strings from a to b of a piece, which doc_id has first, that a smaller doc_id has too; a null
    if a larger doc_id has the whole piece. Rows come sorted by (key, doc_id); whole keys are decided together, some BLOCK
    bytes of them. Where the core is the whole string, a key's rows hold the same one, and its first row the smallest
    doc_id: these are decided as they come."""
    held, size, last, least = [], 0, None, 0
    for batch in batches:
        key, s, doc, shape = (batch.column(k).to_numpy() for k in (0, 2, 3, 5))
        h = _anchor(batch)
        final = (shape >> 24) - (shape >> 16 & 255) >= LENGTH
        if final.any():
            own, of = key[final], doc[final]
            first = _edges(own)
            low = np.repeat(of[first], np.diff(np.concatenate([first, [len(own)]])))
            if own[0] == last:
                low[: first[1] if len(first) > 1 else len(low)] = least
            last, least = int(own[-1]), int(low[-1])
            hit = of > low
            yield _runs(h[final][hit], s[final][hit], of[hit], shape[final][hit] & 255, shape[final][hit] >> 8 & 255)
            batch = batch.filter(pa.array(~final))
            key = key[~final]
        if not len(key):
            continue
        border = int(_edges(key)[-1])
        if held and (border or key[0] != held[-1].column(0)[-1].as_py()) and size + batch.nbytes >= BLOCK:
            yield from _decided([*held, batch.slice(0, border)])
            held, size, batch = [], 0, batch.slice(border)
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from _decided(held)


def _decided(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_RUNS of whole keys, the same piece of several blocks taken once, with its smallest doc_id."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    key, s, doc, more, shape = (rows.column(k).to_numpy() for k in (0, 2, 3, 4, 5))
    h = _anchor(rows)
    order = np.lexsort((doc, s, key))
    first = _edges(key[order], s[order])
    if not len(first):
        return
    once = order[first]
    several = np.maximum.reduceat((doc + more)[order], first) > doc[once]
    yield _runs(h[once][several], s[once][several], doc[once][several])
    of_key = _edges(key[once])
    count = np.diff(np.concatenate([of_key, [len(once)]]))
    kept = once[np.repeat(count > 1, count)]
    if not len(kept):
        return
    doc, lo, hi = doc[kept], shape[kept] & 255, shape[kept] >> 8 & 255
    bucket, begins = suffix_buckets(rows.column(6).take(pa.array(kept)).to_pylist())
    count = hi - lo + 1
    row = np.repeat(np.arange(len(kept)), count)
    rel = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + lo[row]
    b = bucket[begins[row] + rel]
    order = np.argsort(b, kind="stable")
    first = _edges(b[order])
    least = np.empty(len(b), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[row][order], first), np.diff(np.concatenate([first, [len(b)]])))
    hit = np.flatnonzero(least < doc[row])
    begin = _edges(row[hit], rel[hit] - np.arange(len(hit)))
    who = kept[row[hit][begin]]
    yield _runs(h[who], s[who], doc[row[hit][begin]], rel[hit][begin], rel[hit][np.concatenate([begin[1:], [len(hit)]]) - 1] if len(hit) else rel[hit])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets under finer keys: of the strings around a core, those that reach half of what is missing or
    more to the left share these bytes, the others as much to the right, so that no row makes more than two."""
    for batch in batches:
        out = []
        for key, h, s, doc_id, more, shape, piece in zip(*(batch.column(k).to_pylist() for k in range(7))):
            lo, hi, core, end = (shape >> 8 * k & 255 for k in range(4))
            missing = LENGTH - (end - core)
            half = (missing + 1) // 2
            for side, a, b, c, e in (("<", lo, min(hi, core - half), core - half, end), (">", max(lo, core - half + 1), hi, core, end + missing - half + 1)):
                if a <= b:
                    finer = xxhash.xxh64_intdigest(b"%d%s" % (key, side.encode()) + piece[c:e]) - (1 << 63)
                    out.append((finer, key if h is None else h, s, doc_id, more, a | b << 8 | c << 16 | e << 24, piece))
        kinds = [pa.int64()] * 6 + [pa.binary()]
        yield _batch(_ROWS, *(pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)))


def earlier_runs(pieces: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """_earlier over all buckets of pieces. Buckets of more than most_rows rows are refined until none is left: each
    refinement halves what is missing between core and string, after six a bucket holds one string only, which needs no sort."""
    names = [c.split()[0] for c in _ROWS.split(", ")]
    shape = _shape(F.lit(0), F.col("n") - 1, F.col("at"), F.col("at") + ANCHOR).alias("shape")
    rows = pieces.where("piece is not null").select(F.col("h").alias("key"), F.lit(None).cast("long").alias("h"), "s", "doc_id", "more", shape, "piece")
    core = F.shiftright("shape", 24) - F.shiftright("shape", 16).bitwiseAND(F.lit(255))
    parts, known = [], []
    for _ in range(LENGTH.bit_length()):
        large = stored(rows.where(core < LENGTH).groupBy("key").count().where(F.col("count") > most_rows).select("key"))
        if not large.head(1):
            break
        parts.append(rows.join(large, "key", "left_anti"))
        hot = stored(rows.join(large, "key", "left_semi").select(*names))
        known.append(hot.groupBy(F.coalesce("h", "key").alias("h"), "s").agg(F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id") + F.col("more")).alias("most")).where("most > doc_id").select("h", "s", "doc_id", *(F.lit(None).cast("int").alias(c) for c in "ab")))
        rows = stored(hot.mapInArrow(_split, _ROWS))
    out = [*known, *(part.select(*names).repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_earlier, _RUNS) for part in (*parts, rows))]
    for more in out[1:]:
        out[0] = out[0].union(more)
    return out[0]


def _raw(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.cast("binary").alias("raw"))


def repeated_spans(docs: DataFrame, firsts: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, tid, spans) of texts of which a smaller doc_id has some LENGTH bytes; spans, of bytes, may overlap.

    firsts (tid, doc_id) names for each text the smallest doc_id that has it; other documents with the same text are left
    out. Texts are told apart by 64-bit digests, pieces by 128 bits, half of them their anchor's.
    """
    raw = _raw(docs)
    anchors = raw.select("tid", "raw").mapInArrow(_anchors, _ANCHORS)
    dealt = anchors.repartition(F.when(F.col("kind") == SURE, F.col("tid")).otherwise(F.col("h"))).sortWithinPartitions("h", "kind", "tid")
    # texts of one doc_id are numbered, as a small number takes less room beside every piece than a digest
    numbered = stored(firsts.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("tid"))))
    texts = dealt.mapInArrow(_shared, _SHARED).groupBy("tid").agg(F.collect_list("h").alias("hs")).join(numbered, "tid")
    pieces = stored(raw.join(texts, ["doc_id", "tid"]).select("doc_id", "nth", "raw", "hs").mapInArrow(_pieces, _PIECES), codec="zstd")
    known = stored(earlier_runs(pieces, most_rows).withColumnRenamed("doc_id", "first"))
    met = pieces.select("h", "s", "doc_id", "nth", "start", "n").join(known, ["h", "s"])
    whole = F.col("a").isNull()
    met = met.where((whole & (F.col("doc_id") > F.col("first"))) | (~whole & (F.col("doc_id") == F.col("first"))))
    begin, end = F.col("start") + F.coalesce("a", F.lit(0)), F.col("start") + F.coalesce("b", F.col("n") - 1) + LENGTH
    spans = met.groupBy("doc_id", "nth").agg(F.collect_set(F.struct(begin.alias("start"), end.alias("end"))).alias("spans"))
    return spans.join(numbered, ["doc_id", "nth"]).select("doc_id", "tid", "spans")


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tids, raws, spans = batch.columns
        kept, gone, number = [], [], []
        for i in range(len(raws)):
            raw, runs = raws[i].as_py(), merged([(s["start"], s["end"]) for s in spans[i].as_py()])
            edges = [0, *(x for run in runs for x in run), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            gone.append(len(raw) - len(kept[-1]))
            number.append(len(runs))
        yield pa.RecordBatch.from_arrays([ids, tids, pa.array(gone, pa.int64()), pa.array(number, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "tid", "n_removed", "n_spans", "kept"])


def cut_texts(docs: DataFrame, most_rows: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): rows (doc_id, tid, digest, n_bytes, copy), one per row of docs, digest being the text's SHA-256 and
    copy whether a smaller doc_id has the whole text; cuts (doc_id, tid, n_removed, n_spans, kept) of the texts that lose
    some bytes, kept has the others."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")))
    by_text = slim.groupBy("tid", "digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    several = stored(by_text.where("n > 1").select("tid", "digest", "first"))
    rows = slim.join(several, ["tid", "digest"], "left").withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).drop("first")
    firsts = slim.groupBy("tid").agg(F.min("doc_id").alias("doc_id"))
    spans = stored(repeated_spans(docs, firsts, most_rows))
    cuts = _raw(docs).join(spans, ["doc_id", "tid"]).select("doc_id", "tid", "raw", "spans").mapInArrow(_cut, "doc_id long, tid long, n_removed long, n_spans long, kept binary")
    return rows, cuts


def removal_digests(docs: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte of a text, as UTF-8, that some LENGTH bytes cover which also start in a text of a smaller doc_id is removed;
    n_spans counts the runs of removed bytes. A null text is empty. A null doc_id removes nothing and loses nothing, texts
    of one doc_id lose nothing to each other, and repeated rows have equal results. Other columns are ignored.
    """
    rows, cuts = cut_texts(docs, most_rows)
    cuts = stored(cuts.select("doc_id", "tid", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).distinct())
    gone = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    none = F.lit(0).cast("long")
    return rows.join(cuts, ["doc_id", "tid"], "left").select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"), F.when(gone, 1).otherwise(F.coalesce("n_spans", none)).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """docs with a column kept, a text's remaining bytes (a cut may fall within a character); other columns stay."""
    rows, cuts = cut_texts(docs, most_rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("tid"), F.octet_length(text).alias("n_bytes"))
    copies = rows.where("copy").select(F.col("doc_id").alias("copy_id"), F.col("tid").alias("copy_tid")).distinct()
    cuts = cuts.dropDuplicates(["doc_id", "tid"]).select(F.col("doc_id").alias("cut_id"), F.col("tid").alias("cut_tid"), "kept")
    met = own.join(copies, (F.col("id") == F.col("copy_id")) & (F.col("tid") == F.col("copy_tid")), "left").join(cuts, (F.col("id") == F.col("cut_id")) & (F.col("tid") == F.col("cut_tid")), "left")
    gone = F.col("copy_id").isNotNull() & (F.col("n_bytes") >= LENGTH)
    kept = F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", F.coalesce(F.col("r.text").cast("string"), F.lit("")).cast("binary")))
    return met.select(*(F.col(f"r.`{c}`") for c in docs.columns if c != "kept"), kept.alias("kept"))


def removal_sql() -> str:
    """DuckDB SQL for removal_digests over the view documents: every string of LENGTH bytes, grouped."""
    n = 2 * LENGTH
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
q AS (SELECT r, doc_id, o, x[2 * o + 1 : 2 * o + 512 + {n - 2}] AS y FROM (SELECT r, doc_id, x, unnest(range(0, greatest(0, len(x) // 2 - {LENGTH - 1}), 256)) AS o FROM d)),
g AS (SELECT r, doc_id, o + p AS p, md5_number(y[2 * p + 1 : 2 * p + {n}]) AS k FROM (SELECT r, doc_id, o, y, unnest(range(0, len(y) // 2 - {LENGTH - 1})) AS p FROM q)),
m AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
h AS (SELECT r, p FROM g JOIN m USING (k) WHERE first < doc_id),
b AS (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > {LENGTH}, true) AS new FROM h),
s AS (SELECT r, p, sum(new::INT) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS i FROM b),
o AS (SELECT r, i, min(p) AS a, max(p) + {LENGTH} AS e FROM s GROUP BY ALL),
w AS (SELECT o.*, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY a) AS since FROM o),
c AS (SELECT r, count(*) AS n_spans, sum(e - a)::BIGINT AS n_removed, string_agg(x[2 * since + 1 : 2 * a], '' ORDER BY a) || arg_max(x[2 * e + 1 :], a) AS kept FROM w JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN c USING (r)
"""
