"""SentencePiece encoding and decoding by suffix-array matching.

Texts fall into segments that no piece crosses. The segments that a task has not met before are concatenated and
indexed by a suffix array; every piece is binary-searched for its range of occurrences; the occurrences are edges,
sorted by position, and are relaxed from left to right. In a BPE model exactly one edge into each position belongs to
the encoding of what stands before it: the one whose piece may follow the last piece at its start. Relaxation by that
test in place of a sum of scores gives the model's own result.

A long segment (a text without spaces) is relaxed in overlapping lanes, side by side. A lane begins as if the text did, and
is right from where it has agreed with the lane before it over as many places as the longest piece has characters, since
no later place depends on more; a lane that does not agree is relaxed again, place by place, until it does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches

SPACE = "▁"
#: Characters indexed at once, bytes of text segmented at once, and segments that a task remembers.
BLOCK, GROUP_BYTES, REMEMBERED = 200_000, 3 << 20, 250_000
#: Characters of a segment from which on it is relaxed in lanes, of a lane, and before a lane for it to fall into step (both as
#: long as the longest piece or longer); pairs of pieces whose test is remembered for places relaxed alone.
LONG, LANE, LEAD, PAIRS = 1024, 256, 128, 1_000_000


def _merged(symbols: list[str], rank: dict[str, int]) -> Iterator[tuple[str, str]]:
    """Merges the adjacent pair of best rank, leftmost first, until none is left; yields each pair."""
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank), default=None)
        if best is None:
            return
        i = best[1]
        yield symbols[i], symbols[i + 1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


class Model:
    """A BPE model's tables. Pieces are numbered by rank: single characters first, then merges by falling score."""

    def __init__(self, serialized: bytes):
        reader = sentencepiece.SentencePieceProcessor(model_proto=serialized)
        ids = range(reader.get_piece_size())
        plain = [i for i in ids if not (reader.is_control(i) or reader.is_unknown(i) or reader.is_byte(i) or reader.is_unused(i))]
        self.bytes = {int(reader.id_to_piece(i)[3:5], 16): i for i in ids if reader.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        name = {i: reader.id_to_piece(i) for i in plain}
        order = sorted((i for i in plain if len(name[i]) > 1), key=lambda i: -reader.get_score(i))
        singles = [i for i in plain if len(name[i]) == 1]
        rank = {name[i]: k for k, i in enumerate(order)}
        splits = {}
        for i in order:
            pair, symbols = ("", ""), list(name[i])
            for pair in _merged(symbols, rank):
                pass
            if len(symbols) == 1:  # a piece that merging its own characters does not give is never chosen
                splits[name[i]] = pair
        kept = [name[i] for i in singles] + [name[i] for i in order if name[i] in splits]
        number = {p: k for k, p in enumerate(kept)}
        id_of = {name[i]: i for i in plain}
        self.pieces, self.ids = kept, np.array([*map(id_of.get, kept), -1], np.int32)
        self.unknown = len(kept)
        self.lengths = np.array([*map(len, kept), 1])
        base = len(singles)
        own = np.arange(len(kept) + 1)
        self.left, self.right = own.copy(), own.copy()
        for p, (a, b) in splits.items():
            if a not in number or b not in number:
                raise ValueError("a merge is made of pieces that merging does not give")
            self.left[number[p]], self.right[number[p]] = number[a], number[b]
        self.level = np.where(own < base, 0, own - base + 1)
        self.level[-1] = 0
        merges = np.arange(base, len(kept))
        keys = self.left[merges] * (len(kept) + 1) + self.right[merges]
        by_key = np.argsort(keys)
        self.pair_keys, self.pair_levels = keys[by_key], self.level[merges[by_key]]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(self.pair_keys)] = True
        letters = sorted({c for p in kept for c in p})
        self.code = {c: k + 1 for k, c in enumerate(letters)}
        self.bits = max(1, len(letters).bit_length())
        self.per_key = 62 // self.bits
        self.longest = max(map(len, kept))
        codes = np.zeros((len(kept), self.per_key * -(-self.longest // self.per_key)), np.int64)
        for k, p in enumerate(kept):
            codes[k, : len(p)] = [self.code[c] for c in p]
        top = np.where(np.arange(codes.shape[1]) < self.lengths[:-1, None], codes, (1 << self.bits) - 1)
        self.least, self.most = self._packed(codes), self._packed(top)
        self.tested: dict[int, bool] = {}
        table = np.zeros(0x110000, np.int16 if len(letters) < 1 << 15 else np.int32)
        table[[ord(c) for c in letters]] = range(1, len(letters) + 1)
        self.table = table
        self.segment = re.compile(self._segments())
        self.shown = ["" if reader.is_control(i) else reader.id_to_piece(i) for i in ids]
        self.spaced = [x.replace(SPACE, " ").encode() for x in self.shown]
        for b, i in self.bytes.items():
            self.spaced[i] = bytes([b])

    def _packed(self, codes: np.ndarray) -> np.ndarray:
        groups = codes.reshape(len(codes), -1, self.per_key)
        return (groups << (np.arange(self.per_key)[::-1] * self.bits)).sum(2)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 >> 7) & ((1 << 22) - 1)

    def _segments(self) -> str:
        """A pattern that cuts a text before a space mark or ASCII character that, in pieces, stands only first or after
        such characters."""
        starters = {SPACE, *(chr(c) for c in range(128) if not chr(c).isalnum())}
        while True:
            inner = {p[k] for p in self.pieces for k in range(1, len(p)) if p[k] in starters and p[k - 1] not in starters}
            if not inner:
                break
            starters -= inner
        s = "".join(re.escape(c) for c in sorted(starters))
        return f"[{s}]*[^{s}]+|[{s}]+"

    # -- matching --

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece in text (codes, 0 for a character of no piece)."""
        n, step = len(text), self.per_key
        groups = self.least.shape[1]
        room = np.concatenate([text, np.zeros(step * groups, np.int64)])
        window = np.zeros(n + step * (groups - 1), np.int64)
        for k in range(step):
            window = window << self.bits | room[k : k + len(window)]
        order = np.argsort(window)
        ranks = np.empty(len(window), np.int64)
        ranks[order] = np.concatenate([[0], np.cumsum(np.diff(window[order]) != 0)])
        width = step
        while width < self.longest:  # ranks of doubled width, until they tell apart what pieces can
            key = ranks[:n] * (len(ranks) + 1) + np.concatenate([ranks, np.zeros(width, np.int64)])[width : width + n]
            order = np.argsort(key)
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            ranks, width = new, width * 2
        suffixes = order
        low, high = self._bound(window, suffixes, self.least, False), self._bound(window, suffixes, self.most, True)
        counts = high - low
        begin = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        return suffixes[begin + np.arange(counts.sum())], np.repeat(np.arange(len(counts)), counts)

    def _bound(self, window: np.ndarray, suffixes: np.ndarray, keys: np.ndarray, after: bool) -> np.ndarray:
        """For every piece, the first suffix that is not below its keys, or with `after` above them."""
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(suffixes))
        for _ in range(len(suffixes).bit_length()):
            open_ = low < high
            middle = (low + high) >> 1
            at = suffixes[np.minimum(middle, len(suffixes) - 1)]
            below, same = np.zeros(len(keys), bool), np.ones(len(keys), bool)
            for g in range(keys.shape[1]):
                value = window[at + g * self.per_key]
                below |= same & (value < keys[:, g])
                same &= value == keys[:, g]
            below |= same & after
            low, high = np.where(open_ & below, middle + 1, low), np.where(open_ & ~below, middle, high)
        return low

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves the two pieces as they are when they stand side by side.

        The two are taken apart from the latest merge back; at each step the pair of pieces that meet at the border must
        not have a merge that comes before the one just undone. Of equal merges the left one comes first.
        """
        out = np.ones(len(left), bool)
        at = np.arange(len(left))
        limit = np.full(len(left), np.iinfo(np.int64).max)
        while len(at):
            key = left * (self.unknown + 1) + right
            hit = np.flatnonzero(self.maybe[self._slot(key)])
            merged = np.full(len(at), np.iinfo(np.int64).max)
            if len(hit):
                where = np.minimum(np.searchsorted(self.pair_keys, key[hit]), len(self.pair_keys) - 1)
                merged[hit] = np.where(self.pair_keys[where] == key[hit], self.pair_levels[where], merged[hit])
            bad = merged < limit
            out[at[bad]] = False
            a, b = self.level[left], self.level[right]
            go = ~bad & ((a > 0) | (b > 0))
            undo_left = a > b
            limit = np.where(undo_left, a, b + 1)[go]
            left, right = np.where(undo_left, self.right[left], left)[go], np.where(undo_left, right, self.left[right])[go]
            at = at[go]
        return out

    def _lasts(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of the segments joined: the last piece of what stands before each place; where segments begin and stop; edges
        (start, end, piece)."""
        joined = "\0".join(segments) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        stops = np.cumsum(lengths + 1) - 1
        begins = stops - lengths
        text = self.table[points].astype(np.int64)
        text[stops] = 0
        start, piece = self.edges(text)
        size = self.lengths[piece]
        end = start + size
        depth = np.arange(len(text) + 1) - np.repeat(np.append(begins, len(text)), np.append(lengths + 1, 1))
        depth[stops] = lengths  # the place after a segment's last character
        last = np.full(len(text) + 1, self.unknown)
        order = np.argsort(depth[end] << 40 | end << 6 | (63 - size))  # by depth, then position, longest first
        start, end, piece = start[order], end[order], piece[order]
        levels = depth[end]
        opens = start == np.repeat(begins, np.diff(np.append(begins, len(text))))[start]
        bounds = np.searchsorted(levels, np.arange(1, int(lengths.max()) + 2))
        for lo, hi in zip(bounds, bounds[1:]):
            s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
            nth = np.arange(len(e)) - np.maximum.accumulate(np.where(np.concatenate([[True], e[1:] != e[:-1]]), np.arange(len(e)), 0)) if len(e) else s
            todo = np.flatnonzero(nth == 0)
            while len(todo):
                ok = opens[lo + todo] | self.follows(last[s[todo]], p[todo])
                last[e[todo[ok]]] = p[todo[ok]]
                todo = todo[~ok] + 1
                todo = todo[todo < len(e)]
                todo = todo[nth[todo] > 0]
        return last, begins, stops, (start, end, piece)

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment, as bytes of 32-bit integers."""
        last, begins, stops, _ = self._lasts(segments)
        return self._traced(segments, last, begins, stops)

    def encode_long(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment, relaxed in lanes; about BLOCK characters are indexed at once, whatever a segment's length."""
        lasts = [np.full(len(s) + 1, self.unknown, np.int32) for s in segments]
        lanes = [(k, a) for k, s in enumerate(segments) for a in range(0, len(s), LANE)]
        at_once = max(1, BLOCK // (LANE + LEAD))
        for first in range(0, len(lanes), at_once):
            some = lanes[first : first + at_once]
            last, begins, _, edges = self._lasts([segments[k][max(0, a - LEAD) : a + LANE] for k, a in some])
            by_end = None
            for (k, a), begin in zip(some, begins.tolist()):
                whole, zero = lasts[k], begin - max(0, a - LEAD)
                stop, back = min(a + LANE, len(segments[k])) + 1, a - self.longest + 1
                if a and not np.array_equal(whole[back : a + 1], last[zero + back : zero + a + 1]):
                    if by_end is None:
                        by_end = self._by_end(*edges, len(last))
                    a = self._in_step(whole, last, zero, a, stop, *by_end)
                whole[a + 1 : stop] = last[zero + a + 1 : zero + stop]
        return [self._back(s, x) for s, x in zip(segments, lasts)]

    def _by_end(self, start: np.ndarray, end: np.ndarray, piece: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges as (start, piece) by end, longest first, and where those of each end begin."""
        order = np.argsort(end << 6 | (63 - (end - start)))
        return start[order], piece[order], np.searchsorted(end[order], np.arange(places + 1))

    def _in_step(self, whole: np.ndarray, last: np.ndarray, zero: int, a: int, stop: int, start: np.ndarray, piece: np.ndarray, bounds: np.ndarray) -> int:
        """Relaxes the places of a lane after a, one by one, until the lane's own have been the same for long enough;
        returns the place reached."""
        lo, hi, off, same = bounds[zero + a + 1], bounds[zero + stop], max(0, a - self.longest), 0
        starts, pieces = (start[lo:hi] - zero - off).tolist(), piece[lo:hi].tolist()
        cuts, own, done = (bounds[zero + a + 1 : zero + stop + 1] - lo).tolist(), last[zero + a + 1 : zero + stop].tolist(), whole[off : a + 1].tolist()
        for i, lane in enumerate(own):
            found = self.unknown
            for j in range(cuts[i], cuts[i + 1]):
                if self._tested(done[starts[j]], pieces[j]):
                    found = pieces[j]
                    break
            done.append(found)
            same = same + 1 if found == lane else 0
            if same == self.longest:
                break
        whole[off : off + len(done)] = done
        return off + len(done) - 1

    def _tested(self, left: int, right: int) -> bool:
        """follows for one pair, remembered."""
        key = left * (self.unknown + 1) + right
        if key not in self.tested:
            if len(self.tested) >= PAIRS:
                self.tested.clear()
            self.tested[key] = bool(self.follows(np.array([left]), np.array([right]))[0])
        return self.tested[key]

    def _back(self, segment: str, last: np.ndarray) -> bytes:
        """The ids along the last pieces from a segment's end to its begin."""
        pieces, sizes, at, found = last.tolist(), self.lengths.tolist(), len(segment), []
        while at > 0:
            found.append(pieces[at])
            at -= sizes[pieces[at]]
        ids = self.ids[np.array(found[::-1], np.int64)]
        return self._with_bytes(segment, ids) if (ids < 0).any() else ids.tobytes()

    def _traced(self, segments: list[str], last: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> list[bytes]:
        """Follows the last pieces back from each segment's end."""
        at, alive, found, owner = stops.copy(), np.arange(len(stops)), [], []
        while len(alive):
            p = last[at[alive]]
            found.append(p)
            owner.append(alive)
            at[alive] -= self.lengths[p]
            alive = alive[at[alive] > begins[alive]]
        owners, pieces = np.concatenate(owner), np.concatenate(found)
        turn = np.repeat(np.arange(len(owner))[::-1], [len(o) for o in owner])
        order = np.argsort(owners * len(owner) + turn)
        ids = self.ids[pieces[order]]
        ends = np.cumsum(np.bincount(owners, minlength=len(segments)))
        out, raw, first = [], ids.tobytes(), 0
        for k, stop in enumerate(ends.tolist()):
            out.append(raw[4 * first : 4 * stop])
            first = stop
        for k in np.unique(owners[order][ids < 0]).tolist():
            out[k] = self._with_bytes(segments[k], np.frombuffer(out[k], np.int32))
        return out

    def _with_bytes(self, segment: str, ids: np.ndarray) -> bytes:
        """A character of no piece becomes the ids of its UTF-8 bytes."""
        whole, at = [], 0
        for i in ids.tolist():
            if i >= 0:
                whole.append(i)
                at += len(self.shown[i])
            else:
                whole += [self.bytes[b] for b in segment[at].encode("utf-8", "surrogatepass")]
                at += 1
        return np.array(whole, np.int32).tobytes()

    # -- texts --

    def encode(self, texts: list[str], known: dict[str, bytes]) -> list[bytes]:
        """The ids of each text, as bytes; known keeps the segments' ids for later calls."""
        cut = [self.segment.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        met = set().union(*cut)
        new = met.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = met
        long = [s for s in new if len(s) > LONG]
        new.difference_update(long)
        block, held = [], 0
        for k, s in enumerate(new):
            block.append(s)
            held += len(s) + 1
            if held >= BLOCK or k == len(new) - 1:
                known.update(zip(block, self.encode_segments(block)))
                block, held = [], 0
        known.update(zip(long, self.encode_long(long)))
        encoded = [b"".join(map(known.__getitem__, c)) for c in cut]
        for s in long:  # too long to be remembered
            del known[s]
        return encoded

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces joined, the mark of spaces replaced, the space before the text dropped."""
        text = b"".join(map(self.spaced.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_models: dict[bytes, Model] = {}


def _model(serialized: bytes) -> Model:
    """The model, once for each Python worker. Segments are known to a task only: workers go on to other work."""
    key = hashlib.sha256(serialized).digest()
    if key not in _models:
        _models[key] = Model(serialized)
    return _models[key]


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    group, held = [], 0
    for t in texts:
        group.append(t.as_py() or "")
        held += len(group[-1])
        if held >= GROUP_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


def tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids (array of int) and decoded_sha256, of the text that ids decode to.

    model_path names a SentencePiece BPE model with byte fallback, identity normalisation and a space put before the
    text; the driver reads it (about 0.5 MB) and sends it with the task. ids equal the model's own encoding. Decoding
    gives the text back, but that the mark U+2581 is read as a space. A null text counts as empty and has no ids.
    Null and repeated doc_ids are allowed; other columns are ignored. Each row is done in one task; nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        serialized = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = _model(serialized), {}
        for batch in batches:
            first = 0
            for group in _groups(batch.column("text")):
                encoded = model.encode(group, known)
                flat = np.frombuffer(b"".join(encoded), np.int32)
                counts = np.fromiter((len(x) // 4 for x in encoded), np.int64, len(encoded))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                digests = [hashlib.sha256(model.decode(flat[a:b].tolist()).encode("utf-8", "surrogatepass")).hexdigest() for a, b in zip(offsets, offsets[1:])]
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(group)), pa.array(counts), ids, pa.array(digests, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded_sha256"],
                )
                first += len(group)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")
