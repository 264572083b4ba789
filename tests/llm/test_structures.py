"""Prefix trie, filter audit and suffix-array dedup against brute force, SQL, and on odd and empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lecturelake.llm import audit, queries, suffixes, tries

from conftest import DATA

FOLDER = DATA / "sf0.001"


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(map(str, r)) for r in zip(*(table.column(c).to_pylist() for c in names)))


@pytest.mark.parametrize("name", ["op11_tries", "op12_audit", "op13_suffixes"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, str(FOLDER)).toArrow()) == rows(c.sql(queries.oracle_sql()[name]).to_arrow_table())


# ---- trie ----


def brute_trie(data):
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = turns.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + turns[c][h:]
    nodes = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in under if len(q) == len(p) + 1]
        leaves = sum(1 for q in under if not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in under))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(whole[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def test_trie_equals_brute_force(spark):
    """Copies, shared beginnings, one conversation of 70 turns, nulls, repeated rows, ids below zero, and none left."""
    rng = random.Random(9)
    data = [(c, t, rng.choice(["user", None]), rng.choice(["a", "bb", "é日"]) if t else "hello") for c in [*range(95, 130), *range(200, 206), -5, -100] for t in range(rng.choice([1, 2, 3, 9]))]
    data += [(300, t, "user", "x" * (t % 3)) for t in range(70)] + [(399, t, "user", "x" * (t % 3)) for t in range(68)]
    data += [(7, None, "user", None), (7, None, "user", None), (7, 0, None, "b"), (8, None, "user", None), (None, 0, "user", "a")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("depth", "pos", "x1", "len", "n", "range", "parent", "r", "t")})
    got = tries.prefix_trie(df)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == brute_trie(data)
    assert tries.prefix_trie(df.where("false")).count() == 0
    lone = spark.createDataFrame([(5, 0, "user", "a")], "conv_id long, turn long, role string, text string")  # its only turn is replaced by nothing
    assert sorted(tuple(r) for r in tries.prefix_trie(lone).select(*names).collect()) == brute_trie([(5, 0, "user", "a")])


# ---- audit ----


def test_shapley_weights_are_exact():
    for n in (2, 3, 5):
        weights, rng = audit.shapley_weights(n), random.Random(n)
        v = [Fraction(rng.randrange(-50, 50)) for _ in range(1 << n)]
        want = [Fraction(0)] * n
        orders = list(permutations(range(n)))
        for order in orders:
            s = 0
            for i in order:
                want[i] += Fraction(v[s | 1 << i] - v[s], len(orders))
                s |= 1 << i
        assert [sum(w * x for w, x in zip(row, v)) for row in weights] == want


def brute_audit(docs, labels):
    good, toxic, by_text = defaultdict(bool), defaultdict(bool), {}
    for d, q, x in labels:
        good[d] |= q == 1 and d is not None
        toxic[d] |= x == 1 and d is not None
    for d, text, _ in docs:
        if d is not None:
            by_text[text or ""] = min(d, by_text.get(text or "", d))
    fails = []
    for d, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and by_text[t] < d}
        fails.append((lang or "", f, good[d], toxic[d]))
    out, sums = {}, defaultdict(int)
    for part in {x[0] for x in fails}:
        own = [x for x in fails if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, k in enumerate(order, 1):
                gone = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                sums[part, k] += len(gone)
                alone = sum(x[1][k] and sum(x[1].values()) == 1 for x in own)
                out[part, order, step] = (len(left), len(gone), sum(x[1][k] for x in own) - len(gone), alone, sum(x[2] for x in gone), sum(x[3] for x in gone))
    return {(p, o, s): (*v, sums[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (250, 260, 199, 200)] + ["a b " * 150, "A" * 30, "x # y", None, "", "\x0b\x1c \x85"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "es", None, ""])) for _ in range(120)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 40, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("part", "mask", "digest", "words", "own", "n", "good", "quality", "first")})
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.filter_audit(df, said).collect()}
    assert got == brute_audit(docs, labels)
    assert audit.filter_audit(df.where("false"), said).count() == 0
    assert audit.filter_audit(df, said.where("false")).count() == len(got)


# ---- suffixes ----


def brute_removal(docs, length=50):
    least = {}
    for d, text in docs:
        raw = (text or "").encode()
        for p in range(len(raw) - length + 1 if d is not None else 0):
            least[raw[p : p + length]] = min(d, least.get(raw[p : p + length], d))
    out = []
    for d, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1 if d is not None else 0):
            if least[raw[p : p + length]] < d:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((str(d), len(raw), len(raw) - len(kept), len(re.findall(b"\1+", bytes(gone))), kept))
    return sorted(out)


def test_suffix_buckets_sort_suffixes():
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(50, 85))) for _ in range(60)] + [b"a" * 84, b"a" * 70, b"ab" * 40]
    bucket, begins = suffixes.suffix_buckets(pieces)
    seen, order = {}, []
    for piece, at in zip(pieces, begins.tolist()):
        for p in range(len(piece) - 49):
            assert seen.setdefault(piece[p : p + 50], bucket[at + p]) == bucket[at + p]
            order.append((bucket[at + p], piece[p : p + 50]))
    assert len(set(seen.values())) == len(seen) and [s for _, s in sorted(order)] == sorted(s for _, s in order)


@pytest.mark.parametrize("most_rows", [suffixes.MOST_ROWS, 2])
def test_removal_equals_brute_force(spark, most_rows):
    """Copies, shared lines with other text around, monotonous and unbroken texts, borders in characters, nulls, repeated
    ids and rows; with buckets of two rows at most, so that nearly all are refined over tasks, too."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeñ日") for _ in range(rng.randrange(1, 8)))
    line = " ".join(word() for _ in range(14))
    near = " ".join(word() for _ in range(300))
    docs = [(i, " ".join([word() for _ in range(rng.randrange(30))] + [line] * (i % 3) + [word() for _ in range(rng.randrange(30))])) for i in range(25)]
    docs += [(30 + i, near[: 400 + i] + f" {i} " + near[400 + 3 * i :]) for i in range(12)] + [(50, "x" * 300), (51, "x" * 49), (52, "x" * 50), (53, "xy" * 90), (54, "y" + "xy" * 40)]
    docs += [(60, None), (61, ""), (None, near), (None, None), (5, near), (5, near), (5, "other " + near), (70, line), (71, line), (71, line), (-3, line + " end"), (72, "z" * 5000 + near)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({c: F.lit("clash") for c in ("tid", "raw", "h", "s", "n", "spans", "nth", "digest", "copy", "kept")})
    want = brute_removal(docs)
    got = suffixes.removal_digests(df, most_rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == sorted((*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in want)
    if most_rows > 2:
        kept = suffixes.without_repeats(df)
        assert kept.columns == df.columns and sorted((str(r.doc_id), len((r.text or "").encode()), bytes(r.kept)) for r in kept.collect()) == sorted((w[0], w[1], w[4]) for w in want)
        assert suffixes.removal_digests(df.where("false")).count() == 0


def test_shared_anchors_over_batches():
    """A hash whose texts come in different batches is shared once the second text shows, whatever the cuts between batches."""
    import pyarrow as pa

    rng = random.Random(1)
    rows_ = sorted((rng.randrange(12), suffixes.ORDINARY if rng.random() < 0.8 else suffixes.SEVERAL, rng.randrange(3)) for _ in range(60))
    want = {h: {t for x, k, t in rows_ if x == h and k == suffixes.ORDINARY} for h in range(12)}
    want = {(t, h) for h, ts in want.items() for t in ts if len(ts) > 1 or any(x == h and k == suffixes.SEVERAL for x, k, _ in rows_)}
    for size in (1, 2, 7, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c, t)) for c, t in zip(zip(*rows_[i : i + size]), (np.int64, np.int32, np.int64))], names=["h", "kind", "tid"]).select(["h", "tid", "kind"]) for i in range(0, 60, size)]
        got = [(r["tid"], r["h"]) for b in suffixes._shared(iter(batches)) for r in b.to_pylist()]
        assert set(got) == want
