"""SimHash near-duplicates: deletion-variant signatures of fingerprint segments, an equality join, verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import LOWER_BYTES, bounded_batches, stored
from .components import connected_components, forest_roots

SEED = 42
#: Fixed odd multipliers, two a word, that turn one shingle hash into several independent ones.
MIX = tuple(xxhash.xxh64_intdigest(str(k), SEED) | 1 for k in range(64))
#: The wide fingerprint: words of 64 bits, the first 54 in three segments, so that a segment's variants stay selective.
WIDE_WORD, WIDE_SEGMENT, WIDE_PER_WORD = 64, 18, 3
#: Bits that go along with a node's keys: the fingerprint's first word, p, and the low half of its second, q. Of texts with
#: nothing in common one pair in 3,000 is near in these (at similarity 0.8), in a single word one in 120.
HEAD = 96
#: A one in each byte of a long.
BYTE_ONES = np.uint64(0x0101010101010101)
#: How the work on near-duplicates is dealt: groups of a hot key, candidates of a node in the first pass, nodes of a key whose
#: pairs are all looked at, and holders of a shingle that counts as rare. None of them decides what is found.
SALTS, NEAREST, CROWD, RARE = 64, 8, 32, 32
#: Bins by hash, a bit of each: whether a text has an odd number of shingles there. A bin whose bits differ holds a shingle
#: that only one of two texts has.
BINS = 1024


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of every n-word shingle, repeats included; fewer words make one shingle, none makes none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - n + 1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """For each of the 64 bits, highest first, the number of hashes that have it."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):  # blocks keep the unpacked bits in the cache
        block = hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1).sum(0, dtype=np.uint32)
    return total


def fingerprint(text: str | None, n: int = 3) -> int:
    """The 64-bit SimHash as a signed long: a bit is 1 if more than half of the shingle hashes have it."""
    hashes = shingle_hashes(text, n)
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes)).view(">i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprint3(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t, 3) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row: the contract's 64-bit fingerprint of three-word shingles."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fingerprint3("text").alias("fp"))


def _segment(word: Column, at: Column, width: int) -> Column:
    return F.call_function("shiftrightunsigned", word, at * width).bitwiseAND(F.lit((1 << width) - 1))


def close_pairs(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (src, dst) of different 64-bit fingerprints, src < dst, that differ in max_bits bits or fewer.

    max_bits of 3 or fewer: of two 32-bit segments, one then differs in at most one bit, so the two fingerprints share
    that segment's variant with the differing (or any) bit blotted out. Each fingerprint makes 64 such keys; an
    equality join on the key finds the candidates and its condition verifies all 64 bits, so only true pairs leave
    the join. A fingerprint has at most 2,080 others within two bits: true pairs grow in proportion to fingerprints.
    Each pair is taken once: equal segments share all 32 variants, of which the first alone counts, and a pair that both
    segments find counts in the first.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one wildcard cover 0 to 3 bits")
    i = F.col("i")
    value = _segment(F.col("fp"), F.floor(i / 32).cast("int"), 32)
    hole = F.call_function("shiftleft", F.lit(1).cast("long"), (i % 32).cast("int"))
    keys = fps.select("fp").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63))))
    keys = keys.select("fp", (i.cast("long") * (1 << 32)).bitwiseOR(value.bitwiseAND(F.bitwise_not(hole))).alias("key"))
    a, b = keys.alias("a"), keys.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    at = F.call_function("shiftrightunsigned", F.col("a.key"), F.lit(32))
    here = F.when(at < 32, differ.bitwiseAND(F.lit((1 << 32) - 1))).otherwise(F.call_function("shiftrightunsigned", differ, F.lit(32)))
    met = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(differ) <= max_bits)
        & ((here != 0) | (at % 32 == 0))
        & ((at < 32) | (F.bit_count(differ.bitwiseAND(F.lit((1 << 32) - 1))) > 1))
    )
    # sorted and merged: Spark takes the 64 keys of a fingerprint for one and would broadcast them all, up to 64 times its threshold
    return a.join(b.hint("merge"), met).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))


def simhash_components(docs: DataFrame, max_bits: int = 2) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of max_bits bits or fewer can reach, itself included. A null text
    counts as empty and an empty one has fingerprint zero, linked like any other. A null doc_id gets its group's
    component (null if the group has no other); repeated rows stay. Other columns are ignored. Only distinct
    fingerprints are linked, so any number of exact copies costs one node.
    """
    rows = stored(fingerprints(docs))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(close_pairs(fps, max_bits)).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(ids, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near-duplicates by similarity of word shingles ----


class _WordHashes(dict):
    """XXH64 of words as they are asked for; it forgets all when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_set(text: str | None, n: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of n-word shingles; fewer words make one shingle, none makes none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = total * np.uint64(MIX[0]) + each[k : k + len(total)]
    total ^= total >> np.uint64(32)
    total *= np.uint64(MIX[1])
    return np.unique(total)


def wide_signatures(sets: list[np.ndarray], words: int, wildcards: int) -> tuple[np.ndarray, np.ndarray]:
    """Wide fingerprints of sets of shingle hashes, none of them empty: (words of 64 bits, wildcards of each segment).

    Distinct shingles count once each, as they do in the similarity, so a line that is repeated often rules no bit.
    A segment's wildcards are those of its bits that are nearest to flipping, five bits of a long for each: an edit of
    the text that changes one bit of the segment nearly always changes one of these.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    balance = np.zeros((len(sets), words, 64), np.int64)
    for first, last in _spans(sizes):
        balance[first:last] = _bit_balance(sets[first:last], sizes[first:last], words)
    prints = np.packbits(balance > 0, axis=2, bitorder="little").view("<i8")[..., 0]
    spans = np.abs(balance[..., : WIDE_SEGMENT * WIDE_PER_WORD].reshape(len(sets), words * WIDE_PER_WORD, WIDE_SEGMENT))
    nearest = np.partition(spans * 32 + np.arange(WIDE_SEGMENT), wildcards - 1, axis=2)[..., :wildcards] & 31
    return prints, (nearest << (5 * np.arange(wildcards))).sum(2)


def _spans(sizes: np.ndarray, most: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Ranges of documents with `most` shingles or so together; a longer document has a range of its own."""
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def _bit_balance(sets: list[np.ndarray], sizes: np.ndarray, words: int, most: int = 1 << 15) -> np.ndarray:
    """For every set, word and bit: the hashes that have the bit less those that do not.

    Eight bits at a time are summed in the bytes of a long, over runs of 255 hashes or fewer.
    """
    runs = [np.arange(0, size, 255) for size in sizes.tolist()]
    of = np.repeat(np.arange(len(sets)), [len(r) for r in runs])
    ones = np.zeros((len(sets), words, 64), np.int64)
    hashes = np.concatenate(sets)
    cuts = np.concatenate([r + start for r, start in zip(runs, np.cumsum(sizes) - sizes)])
    step = max(1, most // 255)
    for k in range(0, len(cuts), step):
        here, end = cuts[k : k + step], cuts[k + step] if k + step < len(cuts) else len(hashes)
        heads = np.flatnonzero(np.diff(of[k : k + step], prepend=-1))
        for w in range(words):
            mixed = hashes[here[0] : end] * np.uint64(MIX[2 * w])
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(MIX[2 * w + 1])
            for bit in range(8):
                sums = np.add.reduceat((mixed >> np.uint64(bit)) & BYTE_ONES, here - here[0])
                ones[of[k : k + step][heads], w, bit::8] += np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), heads, axis=0, dtype=np.int64)
    return 2 * ones - sizes[:, None, None]


def _wide_rows(n: int, words: int, wildcards: int):
    """(doc_id, text) to (doc_id, digest of the set of shingles, fingerprint words, wildcards), a few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = [shingle_set(t.as_py(), n, known) for t in part.column("text")]
                some = [s for s in sets if len(s)]
                prints, holes = wide_signatures(some, words, wildcards) if some else ([], [])
                rows = iter(zip(prints, holes))
                both = [next(rows) if len(s) else (None, None) for s in sets]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                columns = [pa.array([b[k] for b in both], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests, pa.binary()), *columns], names=["doc_id", "digest", "prints", "holes"])

    return run


def _shingle_sets(n: int):
    """(doc_id, text) to (node, part, shingles, bins): the distinct shingle hashes and the bits of their bins; part tells
    texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = [shingle_set(t.as_py(), n, known).view(np.int64) for t in part.column("text")]
                odd = np.stack([np.bincount(s & BINS - 1, minlength=BINS) & 1 for s in sets]).astype(np.uint8)
                bits = np.packbits(odd, axis=1).view(np.int64)
                bins = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bits.shape[1], pa.int32()), pa.array(bits.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
                parts = pa.array([xxhash.xxh64_intdigest(s.tobytes()) >> 1 for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), parts, lists, bins], names=["node", "part", "shingles", "bins"])

    return run


def most_bits(similarity: float, bits: int, lost: float) -> int:
    """Fewest bits d such that texts of that similarity differ in more than d of `bits` with probability `lost` or less."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    tail, d = 1.0, -1
    while tail > lost:
        d += 1
        tail -= math.comb(bits, d) * p**d * (1 - p) ** (bits - d)
    return d


def _bits(a: str, b: str) -> Column:
    """Differing bits of two heads, whose columns p and q have these prefixes."""
    return _head_bits(F.col(f"{a}p"), F.col(f"{a}q"), F.col(f"{b}p"), F.col(f"{b}q"))


def _head_bits(p: Column, q: Column, other_p: Column, other_q: Column) -> Column:
    return F.bit_count(p.bitwiseXOR(other_p)) + F.bit_count(q.bitwiseXOR(other_q))


def _segment_keys(classes: DataFrame, words: int, wildcards: int) -> DataFrame:
    """(key, node, p, q): a key for each one-wildcard variant of each segment; p and q are the head of the fingerprint."""
    i = F.col("i")
    at = F.expr(f"cast(i div {wildcards} as int)")
    hole = _segment(F.get("holes", at), i % wildcards, 5).cast("int")
    value = _segment(F.get("prints", F.expr(f"cast(i div {wildcards * WIDE_PER_WORD} as int)")), at % WIDE_PER_WORD, WIDE_SEGMENT)
    blotted = value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), hole)))
    key = ((at * 32 + hole).cast("long") * (1 << WIDE_SEGMENT)).bitwiseOR(blotted)
    every = F.sequence(F.lit(0), F.lit(words * WIDE_PER_WORD * wildcards - 1))
    q = F.coalesce(F.get("prints", F.lit(1)).bitwiseAND(F.lit((1 << HEAD - WIDE_WORD) - 1)), F.lit(0))
    return classes.where("prints is not null").withColumn("i", F.explode(every)).select(key.alias("key"), "node", F.get("prints", F.lit(0)).alias("p"), q.alias("q"))


def _shared_keys(classes: DataFrame, words: int, wildcards: int, near: int) -> DataFrame:
    """(node, p, q, keys, reps) of every node that may share a key with a near one.

    keys are the node's keys (words * 3 * wildcards at most) in which another node is near, its head differing in `near` bits
    or fewer. In a key of up to CROWD + 1 nodes all of them are looked at, so that nodes which meet by chance, as ever
    more do in a larger table, leave here; keys of more nodes are kept whole. reps are, for these keys, the smallest node
    that is near, with its distance (of a larger key, its smallest node if that is near). A key
    that one node in 1,000 has, as a sample of the nodes tells, is dealt over SALTS groups with a smallest node each, so that
    no task gets all of a hot key; of these keys there are 1,000 times a node's keys at most, which bounds the
    broadcast. The sample only decides how rows are dealt.
    """
    keys = _segment_keys(classes, words, wildcards)
    sample = _segment_keys(classes.where("pmod(xxhash64(node, 7), 64) = 0"), words, wildcards)
    least = max(16, sample.select("node").distinct().count() // 1000)
    hot = stored(sample.groupBy("key").count().where(F.col("count") > least).select("key", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.expr(f"cast(pmod(xxhash64(node, 8), {SALTS}) as int)")).otherwise(0)
    dealt = keys.join(F.broadcast(hot), "key", "left").select("key", "node", "p", "q", F.coalesce("hot", F.lit(False)).alias("hot"), salt.alias("salt"))
    bucket = Window.partitionBy("key", "salt").orderBy("node")
    whole = bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = dealt.select("*", *(F.first(c).over(whole).alias(f"rep_{c}") for c in ("node", "p", "q")), F.count("*").over(whole).alias("n")).where("n > 1 or hot")
    few = ~F.col("hot") & (F.col("n") <= CROWD + 1)
    around = F.collect_list(F.when(few, F.struct("node", "p", "q"))).over(bucket.rowsBetween(-CROWD, CROWD))
    others = F.filter("around", lambda x: (x["node"] != F.col("node")) & (_head_bits(x["p"], x["q"], F.col("p"), F.col("q")) <= near))
    met = met.withColumn("around", around).withColumn("others", F.when(few, others)).where("others is null or size(others) > 0")
    least = F.array_min(F.transform("others", lambda x: F.struct(x["node"].alias("rep"), _head_bits(x["p"], x["q"], F.col("p"), F.col("q")).alias("d"))))
    rep = F.coalesce(least, F.when(_bits("", "rep_") <= near, F.struct(F.col("rep_node").alias("rep"), _bits("", "rep_").alias("d"))))
    met = met.select("key", "node", "p", "q", rep.alias("r"))
    reps = F.collect_list(F.when(F.col("r.rep") < F.col("node"), F.col("r")))
    return met.groupBy("node", "p", "q").agg(F.collect_set("key").alias("keys"), reps.alias("reps"))


def _closest(shared: DataFrame) -> DataFrame:
    """Pairs (src, dst): to each node the NEAREST of its reps, those that share most keys and then those with most equal bits."""
    each = shared.select(F.col("node").alias("dst"), F.explode("reps").alias("r"))
    each = each.groupBy("dst", "r.rep").agg((-F.count("*")).alias("c"), F.min("r.d").alias("d"))
    best = F.slice(F.array_sort(F.collect_list(F.struct("c", "d", "rep"))), 1, NEAREST)
    return each.groupBy("dst").agg(best.alias("best")).select(F.explode("best.rep").alias("src"), "dst")


class _Verifier:
    """Decides candidate pairs (src, dst) of nodes: on all bits of their fingerprints, then on their shingles."""

    def __init__(self, base: DataFrame, classes: DataFrame, n: int, similarity: float, words: int):
        self.base, self.n, self.similarity = base, n, similarity
        self.prints = classes.select("node", "prints")
        self.far = most_bits(similarity, WIDE_WORD * words, 1e-6)
        self.words = words

    def near(self, pairs: DataFrame) -> DataFrame:
        """(src, dst, bits) of the pairs near in all words."""
        left, right = (self.prints.select(F.col("node").alias(k), F.col("prints").alias(f"{k}_prints")) for k in ("src", "dst"))
        bits = sum((F.bit_count(F.get("src_prints", F.lit(k)).bitwiseXOR(F.get("dst_prints", F.lit(k)))) for k in range(self.words)), F.lit(0))
        return pairs.join(left, "src").join(right, "dst").select("src", "dst", bits.alias("bits")).where(F.col("bits") <= self.far)

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, part, shingles, bins) of these distinct nodes."""
        texts = self.base.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
        return stored(texts.mapInArrow(_shingle_sets(self.n), "node long, part long, shingles array<long>, bins array<long>"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that share enough of their shingles."""
        sets = self.sets(stored(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()))
        left, right = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}_set")) for k in ("src", "dst"))
        both, all_ = F.size(F.array_intersect("src_set", "dst_set")), F.size("src_set") + F.size("dst_set")
        sized = pairs.join(left, "src").join(right, "dst").select("src", "dst", both.alias("both"), all_.alias("all"))
        return sized.where(F.col("both") >= self.similarity * (F.col("all") - F.col("both")) - 1e-9).select("src", "dst").distinct()


def _several_components(rows: DataFrame) -> DataFrame:
    """The rows whose keys hold nodes of several components."""
    of_key = rows.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"))
    return rows.join(stored(of_key.where("a <> b").select("key")), "key", "left_semi")


def _possible(rows: DataFrame, similarity: float) -> DataFrame:
    """The rows without nodes that match none of their key's, where all of these have sizes known from one centre."""
    of_key = stored(rows.groupBy("key").agg(F.min("size").alias("least"), ((F.count("*") == F.count("size")) & (F.min("centre") == F.max("centre"))).alias("known")))
    whole = F.col("size") + F.greatest("least", "common") - F.col("common")
    return rows.join(of_key, "key").where(~F.col("known") | (F.col("common") >= similarity * whole - 1e-9)).drop("least", "known")


def _named(nodes: DataFrame, *columns: str) -> DataFrame:
    """(key, node, comp) and these columns: a row for each key of each node."""
    return nodes.select("node", "comp", *columns, F.explode("keys").alias("key"))


def _enough(shared: Column, similarity: float) -> Column:
    """Whether sides a and b, of which `shared` shingles or fewer are common to both, may be similar; so are those of unknown size."""
    either = F.greatest(F.col("a.size") + F.col("b.size") - shared, shared)
    return F.coalesce(shared >= similarity * either - 1e-9, F.lit(True))


def _alike(similarity: float, near: int) -> Column:
    """Whether sides a and b share a key, are of different components and may be similar by their heads and bins."""
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") < F.col("b.comp")) & (_bits("a.", "b.") <= near)
    differ = sum((F.bit_count(F.get("a.bins", F.lit(k)).bitwiseXOR(F.get("b.bins", F.lit(k)))) for k in range(BINS // 64)), F.lit(0))
    return met & _enough((F.col("a.size") + F.col("b.size") - differ) / 2, similarity)


def _pairs(a: DataFrame, b: DataFrame, met: Column) -> DataFrame:
    """Pairs (src, dst) of a's and b's nodes that meet; sorted and merged, as Spark sizes rows by key too low for a broadcast."""
    return a.join(b.hint("merge"), met).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))


def _pairs_across(shared: DataFrame, comps: DataFrame, verifier: _Verifier, near: int) -> DataFrame:
    """Pairs (src, dst) of nodes that share a key, are not joined yet and may be near-duplicates.

    Texts differ in as many shingles as bits of their bins differ, or more, so nodes somewhat less similar than asked to a
    large group do not make a pair with each of its nodes. Nodes with several texts have no bins. In keys of CROWD nodes
    or fewer that decides. Larger keys of a single component need no more work: copies of a text, however many, leave
    here. Nodes of the others are looked at more closely, so that texts which only resemble a large group do not meet
    all of it: shingles that RARE of these nodes or fewer have are `rare`; a pair that shares a rare one is found by
    it, and any other pair shares at most the `common` shingles of either side, which bounds its similarity. Shingles
    of a node's centre, a member of the largest component that it meets in such keys, are `common` without being counted, so a
    copy spreads only the shingles in which it departs from its group. (A component is the smallest of its nodes, so its
    name is also a node whose shingles can be looked up.) Pairs of different centres may share more than that. What is
    known of a node is put to it once, with its keys as a list, before these become rows.
    """
    comp = comps.select("node", F.col("component").alias("comp"))
    nodes = stored(shared.join(comp, "node", "left").select("node", "p", "q", F.coalesce("comp", "node").alias("comp"), "keys"))
    members = stored(nodes.groupBy("comp").agg(F.count("*").alias("members")))
    nodes = stored(nodes.join(members, "comp"))
    largest = F.max(F.struct("members", (-F.col("comp")).alias("c")))
    of_key = _named(nodes, "members").groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("a"), F.max("comp").alias("b"), largest.alias("best"))
    crowded = stored(of_key.where(F.col("n") > CROWD))
    sets = verifier.sets(stored(nodes.select("node").union(nodes.select("comp")).distinct()))
    one_text = F.when(F.min("part") == F.max("part"), F.first("bins"))
    seen = stored(sets.groupBy("node").agg(F.min(F.size("shingles")).alias("size"), one_text.alias("bins")))

    few = _named(nodes, "p", "q").join(crowded.select("key"), "key", "left_anti")
    few = stored(few.groupBy("node", "comp", "p", "q").agg(F.collect_list("key").alias("keys")).join(seen, "node"))
    rows = _named(few, "p", "q", "size", "bins")
    by_small_key = _pairs(rows.alias("a"), rows.alias("b"), _alike(verifier.similarity, near))

    met = _named(nodes, "p", "q").join(stored(crowded.where("a <> b").select("key", "best")), "key")
    centre = (-F.max("best")["c"]).alias("centre")
    pool = stored(met.groupBy("node", "comp", "p", "q").agg(F.collect_list("key").alias("keys"), centre))
    centres = stored(sets.join(stored(pool.select(F.col("centre").alias("node")).distinct()), "node", "left_semi").groupBy(F.col("node").alias("centre")).agg(F.min_by("shingles", "part").alias("centre_set")))
    sets = sets.join(stored(pool.select("node", "centre")), "node")
    own_words = sets.join(centres, "centre").select("node", "part", F.array_except("shingles", "centre_set").alias("own"))
    spread = own_words.select("node", "part", F.explode("own").alias("shingle"))
    rare = stored(spread.groupBy("shingle").agg(F.count("*").alias("holders")).where(F.col("holders") <= RARE))
    held = stored(spread.join(rare, "shingle").join(pool.select("node", "comp"), "node"))
    own = held.groupBy("node", "part").agg(F.count("*").alias("rare"))
    common = F.size("shingles") - F.coalesce("rare", F.lit(0))
    known = sets.join(own, ["node", "part"], "left").groupBy("node").agg(F.max(common).alias("common"))
    rows = stored(_named(pool.join(seen, "node").join(stored(known), "node"), "p", "q", "centre", "common", "size", "bins"))
    rows = _several_components(stored(_possible(rows, verifier.similarity)))
    possible = F.coalesce(F.col("a.centre") != F.col("b.centre"), F.lit(True)) | _enough(F.least("a.common", "b.common"), verifier.similarity)
    by_key = _pairs(rows.alias("a"), rows.alias("b"), _alike(verifier.similarity, near) & possible)
    many = held.where("holders > 1")
    by_rare = _pairs(many.alias("a"), many.alias("b"), (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.comp") < F.col("b.comp")))
    return by_small_key.union(by_key).union(by_rare).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, words: int = 20, wildcards: int = 4) -> DataFrame:
    """(doc_id, component_id) of every row of docs (doc_id, text): the smallest doc_id that links can reach, itself included.

    Near-duplicates share `similarity` or more of their n-word shingles (Jaccard, ASCII case ignored). `words` words
    of 64 bits are the fingerprint, three segments of 18 bits each. With the four wildcards nearest to flipping, of 18,
    two texts at similarity 0.8 share a variant of a segment with probability 0.121 (0.217 with all 18, at 4.5 times the
    keys), so of one in 60 segments with 0.9996. Candidates must also be near in the fingerprint's first HEAD bits, which
    one true pair in 100,000 at the similarity asked is not, and in all its words (one in a million); they are then
    verified on all their shingles.

    Texts of equal sets of shingles are one node, so copies cost one node however many. Links are found in two
    passes, neither of which makes a row for each pair of a group. First every node is compared with one of the
    smallest nodes of its keys, the nearest, and what is linked becomes a component. Then only keys that hold several components
    are looked at, and only pairs across them: every pair that shares a key is decided or joined by a chain of
    verified links.

    Texts of fewer than n words are one shingle; null texts are empty; texts without words are near-duplicates of each
    other. Rows with a null doc_id are left alone. Rows that repeat a doc_id are one document with several texts.
    Columns other than doc_id and text are ignored. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    near = most_bits(similarity, min(HEAD, WIDE_WORD * words), 1e-5)
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shown = stored(base.mapInArrow(_wide_rows(n, words, wildcards), "doc_id long, digest binary, prints array<long>, holes array<long>"))
    classes = shown.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("prints").alias("prints"), F.first("holes").alias("holes"))
    classes = stored(classes)
    shared = stored(_shared_keys(classes, words, wildcards, near))
    verifier = _Verifier(base, classes, n, similarity, words)

    first = verifier.near(_closest(shared)).groupBy("dst").agg(F.min(F.struct("bits", "src"))["src"].alias("src"))
    trees = forest_roots(verifier.links(stored(first)).select(F.col("dst").alias("node"), F.col("src").alias("component")))
    across = _pairs_across(shared, trees, verifier, near)
    links = trees.select(F.col("component").alias("src"), F.col("node").alias("dst")).union(verifier.links(stored(verifier.near(across).select("src", "dst"))))

    members = stored(shown.select("doc_id", "digest").join(classes.select("digest", "node"), "digest").select("doc_id", "node"))
    texts = members.groupBy("doc_id").agg(F.min("node").alias("src"), F.max("node").alias("last")).where("src <> last")
    same_doc = members.join(stored(texts.select("doc_id", "src")), "doc_id").where("src <> node").select("src", F.col("node").alias("dst"))
    comps = stored(connected_components(links.union(same_doc)))
    return members.join(comps, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the near-duplicates of a document with a smaller doc_id; one document of each group stays.

    All columns stay. Rows with a null doc_id are kept; rows that repeat a doc_id stay or go together.
    """
    groups = near_duplicates(docs, n, similarity)
    return docs.join(groups.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
