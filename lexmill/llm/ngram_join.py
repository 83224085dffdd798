"""Documents whose sets of word n-grams have a Jaccard similarity of at least ``threshold``: their classes and links.

The grams of all documents are put in one order, rare before frequent.  Two sets
that reach the threshold share a gram among their first
``size - ceil(threshold * size) + 1``, so only these prefixes are exchanged:
each reading task packs its prefix grams into one column block per range of gram
hashes, and the blocks of a range meet.  There a pair must pass

* the length filter: sizes within ``threshold`` of each other,
* the positional filter: what remains after the shared gram still suffices, it
  being one of the first ``q`` that are shared,
* the suffix filter: the sets' counts in four hash ranges (modulo 256, compared
  around the circle) bound their symmetric difference from below,

and the grams that pass are counted over all ranges.  A pair whose sets of sizes
``a <= b`` share at least ``need`` grams shares ``need - ceil(threshold * b) + 1``
of them in the two prefixes, whatever the order is; ``q`` is that number,
``SHARED`` at most, and a pair that passes with fewer grams is none.  Each pair
that is left is verified once, on the whole sets, in a group that holds the
texts of its neighbours as well.

Rare-first order: grams that many documents share are found by counts over all
documents and ordered last by frequency; the others are ordered by hash.  The
table of frequent grams has a fixed size, since it decides only what is cheap:
any order finds every pair.

No group of copies is expanded into its pairs.  Documents with identical sets
are one, of lowest ``doc_id``.  Sets that agree in two of their least hashes with
``BALL`` others or more are compared with the lowest of these, their leader: by the
triangle inequality of the Jaccard distance two sets at distances ``x`` and ``y``
from it are similar for certain if ``x + y <= 1 - threshold``.  Such pairs are
counted by a histogram of distances (in steps of 1/``STEPS``, rounded up) and never
built; all other pairs are found and verified one by one.

Defined results: one row (doc_id, class_id, links) for every document with a
partner.  ``links`` is the number of other documents whose similarity reaches the
threshold, ``class_id`` the lowest ``doc_id`` that can be reached through links.
Rows with a null ``doc_id`` or text and texts without a word have no partner; a
text of fewer than ``n`` words has one gram, of all its words; repeated rows are
one document, and of different texts under one ``doc_id`` the one that sorts last
stands for it.  Ids must be integers (else a TypeError).  Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_sizes, durable, give_back, id_bitmap, mapped, maybe_in, row_slices, small, stored, without_ids
from ._text import mix, ngrams, per_row, words

N = 2
THRESHOLD = 0.6
LOCAL_REPEATS = 2  # a gram is counted where this many of a task's documents at hand hold it
FREQUENT = 1 << 18  # entries of the table of frequent grams
RANGE_ROWS = 500_000  # prefix grams that meet in one range
PACK_ROWS = 250_000  # prefix grams that a task holds before it packs them
COUNT_GRAMS = 1_000_000  # grams among which a task counts repeats
HOT_GRAM = 1 << 20  # a gram of more documents is split, each part meeting each other one
PAIRS_AT_ONCE = 30_000  # pairs verified in one group before it is split
COMPARED = 1 << 18  # pairs of one range compared at once
SHARED = 8  # shared grams that are counted of a pair
KEYS = 4  # pairs of least hashes by which large groups are seen
BALL = 16  # sets that share such a pair before they are compared with a leader
BALL_TASK = 2_000  # sets compared with a leader in one task
STEPS = 1024
SLICE = 1 << 20


def _sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram hashes of each row in ascending order, and their row boundaries."""
    g, splits = ngrams(*words(pc.utf8_lower(text)), n)
    rows = len(splits) - 1
    if not len(g):
        return g, splits
    row = per_row(g, splits).astype(np.uint16 if rows < 1 << 16 else np.int64)
    first = np.argsort(g)
    order = first[np.argsort(row[first], kind="stable")]
    g, row = g[order], row[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[keep], np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=rows))))


def _parts(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, to in row_slices(byte_sizes(b.column("text")), limit):
            part = b.slice(at, to - at)
            known = pc.and_(pc.is_valid(part.column("doc_id")), pc.is_valid(part.column("text")))
            yield part if pc.all(known).as_py() or not part.num_rows else part.filter(known)


def _signatures(g: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(g))))
    return mix((sums[splits[1:]] - sums[splits[:-1]]) ^ np.diff(splits).astype(np.uint64))


def _keys(g: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """``KEYS`` hashes of each row, each of the least grams of two hash ranges; 0 where both are empty."""
    rows, bins = len(splits) - 1, 2 * KEYS
    row = per_row(g, splits)
    which = ((g >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(g), bool)
    first[1:] = (row[1:] != row[:-1]) | (which[1:] != which[:-1])
    least = np.zeros((rows, bins), np.uint64)
    least[row[first], which[first]] = g[first]
    a, b = least[:, ::2], least[:, 1::2]
    keys = mix((a * np.uint64(0x9E3779B97F4A7C15) ^ mix(b + np.uint64(1))) + np.arange(KEYS, dtype=np.uint64)) | np.uint64(1)
    keys[(a == 0) & (b == 0)] = 0
    return keys


def _scan(n: int):
    """Two kinds of rows: a document's signature, size and keys; a gram and its documents in one slice."""

    none = lambda k: pa.nulls(k, pa.int64())

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        key = np.concatenate(held)
        key.sort()
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(edge, len(key)))
        often = count >= LOCAL_REPEATS
        return pa.RecordBatch.from_arrays([pa.array(key[edge[often]].view(np.int64)), pa.array(count[often]), *[none(int(often.sum()))] * (3 + KEYS)], names=_SCANNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in _parts(batches):
            g, splits = _sets(part.column("text"), n)
            size = np.diff(splits)
            some = np.flatnonzero(size > 0)
            if not len(some):
                continue
            keys = _keys(g, splits)[some].view(np.int64)
            docs = [part.column("doc_id").take(pa.array(some)), pa.array(_signatures(g, splits)[some].view(np.int64)), pa.array(size[some]), *(pa.array(keys[:, i].copy()) for i in range(KEYS))]
            yield pa.RecordBatch.from_arrays([none(len(some)), none(len(some)), *docs], names=_SCANNED)
            held.append(g)
            if sum(map(len, held)) >= COUNT_GRAMS:
                yield repeated(held)
                held = []
        if held:
            yield repeated(held)

    return run


_SCANNED = ["g", "c", "doc_id", "sig", "size", *(f"k{i}" for i in range(KEYS))]


def _frequent(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted frequent grams, their ranks (1 = least frequent), and into how many parts each is split."""
    counts = scanned.where("g is not null").groupBy("g").agg(F.sum("c").alias("c"))
    top = counts.orderBy(F.desc("c"), "g").limit(FREQUENT).toArrow()
    g, c = top["g"].to_numpy().view(np.uint64), top["c"].to_numpy()
    by_count = np.lexsort((g, c))
    rank = np.empty(len(g), np.int64)
    rank[by_count] = np.arange(1, len(g) + 1)
    order = np.argsort(g)
    return g[order], rank[order], -(-c[order] // HOT_GRAM)


def _least(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of integers by significance, which compresses where high bytes repeat."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def _unplanes(data, at: int, n: int, kind) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind), at + n * width


def _prefixes(g: np.ndarray, splits: np.ndarray, hot: np.ndarray, rank: np.ndarray, threshold: float):
    """(row, place in the order, gram) of all prefix grams, row by row in order."""
    size = np.diff(splits)
    rows = len(size)
    row = per_row(g, splits)
    length = np.where(size > 0, size - _least(size, threshold) + 1, 0)
    is_hot = np.zeros(len(g), bool)
    if len(hot):
        at = np.searchsorted(hot, g)
        at[at == len(hot)] = 0
        is_hot = hot[at] == g
    cold_before = np.concatenate(([0], np.cumsum(~is_hot)))
    cold = cold_before[splits[1:]] - cold_before[splits[:-1]]
    place = cold_before[:-1] - cold_before[splits[:-1]][row]
    hot_at = np.flatnonzero(is_hot)
    if len(hot_at):
        ordered = hot_at[np.lexsort((rank[at[hot_at]], row[hot_at]))]
        first = np.concatenate(([0], np.cumsum(np.bincount(row[ordered], minlength=rows))))
        place[ordered] = np.arange(len(ordered)) - first[row[ordered]] + cold[row[ordered]]
    inside = place < length[row]
    start = np.concatenate(([0], np.cumsum(length)))
    out_g = np.empty(start[-1], np.uint64)
    out_g[start[row[inside]] + place[inside]] = g[inside]
    out_row = np.repeat(np.arange(rows), length)
    out_place = np.arange(start[-1]) - start[:-1][out_row]
    return out_row, out_place, out_g


def _limit(threshold: float) -> int:
    """Distances in steps that add up to this at most are those of similar sets."""
    return int(np.floor((1 - threshold) * STEPS + 1e-9))


class _Packer:
    """Collects prefix grams and packs them into a block per range of gram hashes."""

    def __init__(self, threshold: float, hot: np.ndarray, rank: np.ndarray, ways: np.ndarray, ranges: int):
        self.threshold, self.hot, self.rank, self.ranges = threshold, hot, rank, ranges
        self.split, self.ways = hot[ways > 1], ways[ways > 1]
        self.held: list[tuple] = []
        self.docs = self.grams = 0

    def add(self, ids: np.ndarray, g: np.ndarray, splits: np.ndarray, ball: np.ndarray, step: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of sets; ``step``: the distance from the leader ``ball``, -1 for none."""
        size = np.diff(splits)
        row = per_row(g, splits)
        quarters = np.zeros((len(size), 4), np.int64)
        np.add.at(quarters.reshape(-1), row * 4 + (g >> np.uint64(62)).astype(np.int64), 1)
        packed = ((quarters & 255) << np.array([0, 8, 16, 24])).sum(axis=1).astype(np.uint32)
        p_row, place, p_g = _prefixes(g, splits, self.hot, self.rank, self.threshold)
        if len(self.split):
            p_row, place, p_g = self._spread(ids, p_row, place, p_g)
        self.held.append((ids, size, packed, ball, step, p_row + self.docs, place, p_g))
        self.docs += len(ids)
        self.grams += len(p_g)
        if self.grams >= PACK_ROWS:
            yield self.pack()

    def _spread(self, ids: np.ndarray, row: np.ndarray, place: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A gram of very many documents becomes a gram for each pair of its parts, so that no task holds all of them."""
        at = np.minimum(np.searchsorted(self.split, g), len(self.split) - 1)
        w = np.where(self.split[at] == g, self.ways[at], 1)
        every = np.repeat(np.arange(len(g)), w)
        other = np.arange(len(every)) - np.repeat(np.cumsum(w) - w, w)
        own = (mix(ids[row[every]].astype(np.uint64)) % w[every].astype(np.uint64)).astype(np.int64)
        cell = (np.minimum(own, other) * w[every] + np.maximum(own, other)).astype(np.uint64)
        return row[every], place[every], np.where(w[every] > 1, mix(g[every] + (cell + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), g[every])

    def pack(self) -> pa.RecordBatch:
        ids, size, quarters, ball, step, row, place, g = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.docs, self.grams = [], 0, 0
        g48 = g >> np.uint64(16)
        order = np.argsort(g48)
        row, place, g48 = row[order], place[order], g48[order]
        which = (g48 * np.uint64(self.ranges) >> np.uint64(48)).astype(np.int64) if self.ranges < 1 << 16 else (g48 // np.uint64((1 << 48) // self.ranges + 1)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(which) else np.zeros(0, np.int64)
        names, blobs = [], []
        local = np.empty(len(ids), np.uint32)
        for a, b in zip(edges, np.append(edges[1:], len(which))):
            docs = np.unique(row[a:b])
            local[docs] = np.arange(len(docs), dtype=np.uint32)
            gap = np.diff(g48[a:b], prepend=np.uint64(0))
            led = np.flatnonzero(step[docs] >= 0)
            blobs.append(b"".join((
                np.array([len(docs), b - a, len(led)], np.int64).tobytes(), _planes(ids[docs].astype(np.int64)), _planes(size[docs].astype(np.uint32)), _planes(quarters[docs]),
                _planes(led.astype(np.uint32)), _planes(ball[docs[led]].astype(np.int64)), _planes(step[docs[led]].astype(np.uint16)), _planes(gap), _planes(local[row[a:b]]), _planes(place[a:b].astype(np.uint32)),
            )))
            names.append(int(which[a]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.large_binary() if sum(map(len, blobs)) > 1 << 30 else pa.binary())], names=["part", "block"])


def _alone(n: int, *packing):
    """Blocks of documents that no leader was found for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(*packing)
        for part in _parts(batches):
            if part.num_rows:
                g, splits = _sets(part.column("text"), n)
                yield from packer.add(part.column("doc_id").to_numpy(), g, splits, np.zeros(part.num_rows, np.int64), np.full(part.num_rows, -1))
        if packer.held:
            yield packer.pack()

    return run


def _share(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0.0
    where = np.searchsorted(y, x)
    where[where == len(y)] = 0
    both = int((y[where] == x).sum())
    return both / (len(x) + len(y) - both)


def _led(n: int, threshold: float, *packing):
    """Blocks of documents that stand behind their leader's text, and a row of part -1 for each of them that is near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, limit = _Packer(threshold, *packing), _limit(threshold)
        at, leader = None, np.zeros(0, np.uint64)
        near: list[tuple[int, int, int]] = []
        for part in _parts(batches):
            if not part.num_rows:
                continue
            g, splits = _sets(part.column("text"), n)
            ids = part.column("doc_id").to_numpy()
            lead, salt, is_leader = (part.column(c).to_pylist() for c in ("lead", "salt", "is_leader"))
            ball, step = np.zeros(len(ids), np.int64), np.full(len(ids), -1)
            for i in range(len(ids)):
                own = g[splits[i] : splits[i + 1]]
                if lead[i] is None:
                    continue
                if is_leader[i]:
                    at, leader = (lead[i], salt[i]), own.copy()
                elif at == (lead[i], salt[i]) and (share := _share(own, leader)) >= threshold:
                    far = int(np.ceil((1 - share) * STEPS - 1e-9))
                    if far <= limit:
                        ball[i], step[i] = lead[i], far
                        near.append((lead[i], int(ids[i]), far))
            member = np.array([not x for x in is_leader])
            if member.any():
                size = np.diff(splits)
                yield from packer.add(ids[member], g[np.repeat(member, size)], np.concatenate(([0], np.cumsum(size[member]))), ball[member], step[member])
        if packer.held:
            yield packer.pack()
        if near:
            yield pa.RecordBatch.from_arrays([pa.array([-1 - (near[0][0] % 1021)], pa.int64()), pa.array([np.array(near, np.int64).tobytes()], pa.binary())], names=["part", "block"])

    return run


def _unpack(blob) -> tuple[np.ndarray, ...]:
    docs, rows, led = np.frombuffer(blob, np.int64, 3)
    out, at = [], 24
    for count, kind in ((docs, np.int64), (docs, np.uint32), (docs, np.uint32), (led, np.uint32), (led, np.int64), (led, np.uint16), (rows, np.uint64), (rows, np.uint32), (rows, np.uint32)):
        x, at = _unplanes(blob, at, count, kind)
        out.append(x)
    ids, size, quarters, which, leader, far, gap, local, place = out
    ball, step = np.zeros(docs, np.int64), np.full(docs, -1)
    ball[which], step[which] = leader, far
    return ids, size.astype(np.int64), quarters, ball, step, np.cumsum(gap), local.astype(np.int64), place.astype(np.int64)


def _pairs(first: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each of ``first`` with ``lo`` to ``hi``, ``COMPARED`` or so at once."""
    count = np.maximum(hi - lo, 0)
    some = np.flatnonzero(count)
    first, lo, count = first[some], lo[some], count[some]
    for at, to in row_slices(count, COMPARED):
        c = count[at:to]
        a = np.repeat(first[at:to], c)
        yield a, np.repeat(lo[at:to] - (np.cumsum(c) - c), c) + np.arange(len(a))


def candidates_of(blobs: list, threshold: float, shared: int = SHARED) -> tuple[np.ndarray, ...]:
    """(lower id, higher id, shared grams, shared grams needed in all ranges) of the pairs that pass the filters within one range."""
    parts = [_unpack(b) for b in blobs]
    base = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))
    ids, size, quarters, ball, step = (np.concatenate([p[i] for p in parts]) for i in range(5))
    g, place = (np.concatenate([p[i] for p in parts]) for i in (5, 7))
    doc = np.concatenate([p[6] + o for p, o in zip(parts, base)])
    del parts
    # grams held once have no partner
    t = np.argsort(g)
    same = np.zeros(len(t) + 1, bool)
    same[1:-1] = g[t][1:] == g[t][:-1]
    t = t[same[:-1] | same[1:]]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.int16)
    if not len(t):
        return none
    d = doc[t]
    # within a gram: balls, by distance in each; then the others by size
    in_ball = step[d] >= 0
    t = t[np.lexsort((np.where(in_ball, step[d], size[d]), np.where(in_ball, ball[d], np.iinfo(np.int64).max), g[t]))]
    d = doc[t]
    gt, st, pt, qt, it, bt, dt = g[t], size[d], place[t], quarters[d], ids[d], ball[d], step[d]
    del g, place, doc, t, d
    n = len(gt)
    new = np.ones(n, bool)
    new[1:] = gt[1:] != gt[:-1]
    gram = np.cumsum(new) - 1
    ends = np.append(np.flatnonzero(new)[1:], n)
    lone = dt < 0
    lones = np.flatnonzero(lone)
    starts_lone = ends - np.bincount(gram[lones], minlength=len(ends))  # where the others begin in each gram
    by_size = (gram[lones] << 32) | st[lones]

    def sized(key: np.ndarray, side: str) -> np.ndarray:
        at = np.searchsorted(by_size, key, side=side)
        return np.where(at < len(lones), lones[np.minimum(at, len(lones) - 1)], n) if len(lones) else np.full(len(key), n)

    longest = np.floor(st / threshold + 1e-9).astype(np.int64)
    spans = [(lones, lones + 1, np.minimum(sized((gram[lones] << 32) | longest[lones], "right"), ends[gram[lones]]))]
    led = np.flatnonzero(~lone)
    if len(led):
        seg = np.ones(len(led), bool)
        seg[1:] = (gram[led][1:] != gram[led][:-1]) | (bt[led][1:] != bt[led][:-1]) | (np.diff(led) != 1)
        which = np.cumsum(seg) - 1
        seg_end = led[np.append(np.flatnonzero(seg)[1:], len(led)) - 1] + 1
        by_step = (which << 16) | dt[led]
        from_ = np.searchsorted(by_step, (which << 16) | (_limit(threshold) - dt[led]), side="right")
        from_ = np.where(from_ < len(led), led[np.minimum(from_, len(led) - 1)], n)
        spans.append((led, np.maximum(led + 1, from_), seg_end[which]))  # uncertain pairs of one ball
        spans.append((led, seg_end[which], starts_lone[gram[led]]))  # other balls
        low = np.maximum(sized((gram[led] << 32) | _least(st[led], threshold), "left"), starts_lone[gram[led]])
        spans.append((led, low, np.minimum(sized((gram[led] << 32) | longest[led], "right"), ends[gram[led]])))
    out: list[tuple] = []
    for span in spans:
        for a, b in _pairs(*span):
            sa, sb = st[a], st[b]
            small, large = np.minimum(sa, sb), np.maximum(sa, sb)
            need = np.ceil(threshold / (1 + threshold) * (sa + sb) - 1e-9).astype(np.int64)
            q = np.clip(need - _least(large, threshold) + 1, 1, shared)
            ok = (small >= threshold * large - 1e-9) & (np.minimum(sa - pt[a], sb - pt[b]) + q - 1 >= need) & (it[a] != it[b])
            a, b, need, q = a[ok], b[ok], need[ok], q[ok]
            gap = np.zeros(len(a), np.int64)
            for shift in (0, 8, 16, 24):
                x = ((qt[a] >> np.uint32(shift)).astype(np.int64) - (qt[b] >> np.uint32(shift)).astype(np.int64)) & 255
                gap += np.minimum(x, 256 - x)
            ok = gap <= st[a] + st[b] - 2 * need
            a, b, q = a[ok], b[ok], q[ok]
            if len(a):
                out.append((np.minimum(it[a], it[b]), np.maximum(it[a], it[b]), q.astype(np.int16)))
    if not out:
        return none
    low, high, q = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((q, high, low))
    low, high, q = low[order], high[order], q[order]
    first = np.ones(len(low), bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    at = np.flatnonzero(first)
    return low[at], high[at], np.minimum(np.diff(np.append(at, len(low))), shared).astype(np.int16), q[at]


def _meet(threshold: float):
    shared = SHARED

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        blobs = [x.as_buffer() for x in rows["block"]]
        if key[0].as_py() < 0:
            near = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 3) for b in blobs])
            a, b, c, q, step = near[:, 0], near[:, 1], np.zeros(len(near), np.int16), np.ones(len(near), np.int16), pa.array(near[:, 2].astype(np.int16))
        else:
            a, b, c, q = candidates_of(blobs, threshold, shared)
            step = pa.nulls(len(a), pa.int16())
        del blobs, rows
        give_back()
        return pa.table({"a": pa.array(a.copy()), "b": pa.array(b.copy()), "c": pa.array(c), "q": pa.array(q), "step": step})

    return run


def _whole_ids(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"doc_id must be an integer, not {kind}")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def _prepared(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Documents of one text each, and what a pass over them gives."""
    docs = _whole_ids(docs)
    schema = "g bigint, c bigint, doc_id bigint, sig bigint, size bigint, " + ", ".join(f"k{i} bigint" for i in range(KEYS))
    scanned = stored(mapped(docs, _scan(n), schema), "grams")
    several = durable(scanned.where("doc_id is not null").select("doc_id", "sig").distinct().groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not several.isEmpty():
        one = docs.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
        docs = docs.join(several, "doc_id", "left_anti").unionByName(one)
        scanned = stored(mapped(docs, _scan(n), schema), "grams")
    return docs, scanned


def _leaders(sets: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, lead) of sets that share a key with ``BALL`` or more: the lowest id of the largest such group of like size."""
    keyed = sets.select("doc_id", "size", F.explode(F.array(*(f"k{i}" for i in range(KEYS)))).alias("k")).where("k <> 0")
    large = keyed.groupBy("k").agg(F.min("doc_id").alias("lead"), F.min_by("size", "doc_id").alias("lead_size"), F.count("*").alias("many")).where(F.col("many") >= BALL)
    fit = keyed.join(large, "k").where((F.col("size") >= threshold * F.col("lead_size")) & (F.col("lead_size") >= threshold * F.col("size")))
    return durable(fit.groupBy("doc_id").agg(F.max_by("lead", F.struct(F.col("many"), -F.col("lead"))).alias("lead")))


def candidate_pairs(docs: DataFrame, scanned: DataFrame, sets: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, step) once for every pair that is to be verified (``step`` null), and for every member ``b`` of the ball of leader ``a``."""
    hot, rank, ways = _frequent(scanned)
    total = sets.agg(F.sum("size")).first()[0] or 0
    packing = (hot, rank, ways, max(1, round(total * (1 - threshold) / RANGE_ROWS)))
    led = _leaders(sets, threshold)
    if led.isEmpty():
        blocks = mapped(docs, _alone(n, threshold, *packing), "part bigint, block binary")
    else:
        split = led.groupBy("lead").agg(F.ceil(F.count("*") / BALL_TASK).alias("ways"))
        members = led.join(split, "lead").select("doc_id", "lead", F.pmod(F.xxhash64("doc_id"), "ways").alias("salt"), F.lit(False).alias("is_leader"))
        leaders = split.select(F.col("lead").alias("doc_id"), "lead", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ways") - 1)).alias("salt"), F.lit(True).alias("is_leader"))
        routes = durable(members.unionByName(leaders))
        marked = maybe_in(docs, id_bitmap(routes), "doc_id", "maybe")
        alone = mapped(marked.where("not maybe").select("doc_id", "text"), _alone(n, threshold, *packing), "part bigint, block binary")
        sent = marked.where("maybe").select("doc_id", "text").join(small(routes), "doc_id", "left").withColumn("is_leader", F.coalesce("is_leader", F.lit(False)))
        sent = sent.repartition(F.coalesce("lead", "doc_id"), "salt").sortWithinPartitions("lead", "salt", F.desc("is_leader"))
        blocks = alone.unionByName(mapped(sent, _led(n, threshold, *packing), "part bigint, block binary"))
    met = blocks.groupBy("part").applyInArrow(_meet(threshold), "a bigint, b bigint, c smallint, q smallint, step smallint")
    return durable(met.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("q").alias("q"), F.min("step").alias("step")).where("step is not null or c >= q").select("a", "b", "step"))


def _verify(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for b in batches:
            for lo, hi in row_slices(byte_sizes(b.column("text")) + 64, SLICE):
                part = b.slice(lo, hi - lo)
                g, splits = _sets(part.column("text"), n)
                keys = list(zip(*(part.column(c).to_pylist() for c in ("g", "ga", "gb"))))
                first, second = part.column("a").to_pylist(), part.column("b").to_pylist()
                found: tuple[list, list] = ([], [])
                for i, key in enumerate(keys):
                    if key != at:
                        at, held = key, {}
                    if second[i] is None:
                        held[first[i]] = g[splits[i] : splits[i + 1]].copy()
                    elif _share(held[first[i]], held[second[i]]) >= threshold:
                        found[0].append(first[i])
                        found[1].append(second[i])
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])
        del held

    return run


def _verified(docs: DataFrame, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` that reach the threshold."""

    def lower(near: DataFrame) -> DataFrame:
        """(u, m): the least label of each document and its neighbours."""
        both = near.select(F.col("a").alias("u"), F.col("mb").alias("m")).unionByName(near.select(F.col("b").alias("u"), F.col("ma").alias("m"))).unionByName(near.select(F.col("a").alias("u"), F.col("ma").alias("m")))
        return both.groupBy("u").agg(F.min("m").alias("m"))

    # pairs go where the least of the ids two steps around them is, so that a text goes to few places
    near = pairs.select("a", "b", F.col("a").alias("ma"), F.col("b").alias("mb"))
    label = lower(near)
    near = pairs.join(label.select(F.col("u").alias("a"), F.col("m").alias("ma")), "a").join(label.select(F.col("u").alias("b"), F.col("m").alias("mb")), "b")
    placed = durable(pairs.join(lower(near).select(F.col("u").alias("a"), F.col("m").alias("g")), "a").select("a", "b", "g"))
    # a group in which very many pairs meet is split by both ids
    ways = F.ceil(F.sqrt(F.count("*") / PAIRS_AT_ONCE))
    crowded = placed.groupBy("g").agg(ways.alias("k")).where("k > 1")
    keyed = placed.join(crowded, "g", "left").select(
        "g", *(F.when(F.col("k").isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.col("k"))).cast("bigint").alias(f"g{c}") for c in ("a", "b")), "a", "b")
    needed = durable(keyed.select("g", "ga", "gb", F.col("a").alias("doc_id")).unionByName(keyed.select("g", "ga", "gb", F.col("b").alias("doc_id"))).distinct())
    ids = placed.select(F.explode(F.array("a", "b")).alias("doc_id"))
    wanted = maybe_in(docs.where("text is not null"), id_bitmap(ids), "doc_id", "maybe").where("maybe").drop("maybe")
    texts = wanted.join(small(needed), "doc_id").select("g", "ga", "gb", F.col("doc_id").alias("a"), F.lit(None).cast("bigint").alias("b"), "text")
    met = texts.unionByName(keyed.withColumn("text", F.lit(None).cast("string"))).repartition("g", "ga", "gb").sortWithinPartitions("g", "ga", "gb", F.col("b").isNotNull())
    return mapped(met, _verify(n, threshold), "a bigint, b bigint")


def _counted(members: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, links) of the certain pairs within balls; and (a, b) of leaders that are in no ball of their own, with the members of theirs."""
    limit = _limit(threshold)
    m = members.join(sets.select(F.col("doc_id").alias("b"), "copies"), "b")
    steps = m.groupBy("a", "step").agg(F.sum("copies").alias("w"))
    balls = steps.groupBy("a").agg(F.collect_list(F.struct("step", "w")).alias("h"))  # one entry a step, STEPS at most
    certain = F.aggregate(F.filter("h", lambda x: x["step"] + F.col("step") <= limit), F.lit(0).cast("bigint"), lambda acc, x: acc + x["w"])
    reached = steps.join(balls, "a").select("a", "step", certain.alias("sum"))
    counted = m.join(reached, ["a", "step"]).select(F.col("b").alias("doc_id"), (F.col("sum") - F.when(2 * F.col("step") <= limit, F.col("copies")).otherwise(0)).alias("links"))
    own = members.where("a = b").select("a")
    return counted, members.join(own, "a", "left_anti").select("a", "b")


def _linked(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, ...]:
    """(doc_id, sig) of all documents, (doc_id, sig, copies) of their sets, (a, b) of verified pairs, (a, b, step) of the members ``b`` of balls, (doc_id) of later copies of sets."""
    docs, scanned = _prepared(docs, n)
    units = scanned.where("doc_id is not null").select("doc_id", "sig", "size", *(f"k{i}" for i in range(KEYS))).dropDuplicates(["doc_id"])
    sets = stored(units.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("size").alias("size"), *(F.first(f"k{i}").alias(f"k{i}") for i in range(KEYS))), "sets")
    later = durable(units.join(sets.where("copies > 1").select("sig", F.col("doc_id").alias("first")), "sig").where("doc_id <> first").select("doc_id"))
    docs = without_ids(docs, later)
    found = candidate_pairs(docs, scanned, sets, n, threshold)
    edges = durable(_verified(docs, found.where("step is null").select("a", "b"), n, threshold))
    return units.select("doc_id", "sig"), sets.select("doc_id", "sig", "copies"), edges, found.where("step is not null"), later


def _groups_of(edges: DataFrame, members: DataFrame) -> DataFrame:
    return groups(edges.unionByName(members.where("a <> b").select("a", "b")).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")))


def similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of all documents with a partner, as the module describes them."""
    units, sets, edges, members, _ = _linked(docs, n, threshold)
    parts, linked = [], edges
    if not members.isEmpty():
        counted, more = _counted(members, sets, threshold)
        parts.append(counted)
        linked = edges.unionByName(more)
    copies = sets.select("doc_id", "copies")
    for one, other in (("a", "b"), ("b", "a")):
        parts.append(linked.join(copies.withColumnRenamed("doc_id", other), other).select(F.col(one).alias("doc_id"), F.col("copies").alias("links")))
    links = parts[0]
    for p in parts[1:]:
        links = links.unionByName(p)
    known = links.groupBy("doc_id").agg(F.sum("links").alias("links")).join(_groups_of(edges, members), "doc_id", "left")
    wide = sets.join(known, "doc_id", "left").where("copies > 1 or links is not null")
    wide = wide.select("sig", F.coalesce("keep_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return units.join(wide, "sig").where("links > 0").select("doc_id", "class_id", "links")


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, keep_id): each document of a connected group but its lowest, with that lowest id.

    Alternates large-star and small-star steps until the edges stay as they are;
    each step is an aggregation and a join of edges, kept in the shared folder.
    """
    edges = durable(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).distinct())

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        edges = durable(small.where("u <> v").distinct())
        after = state(edges)
        if after == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("keep_id"))
        before = after


def drop_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the lowest ``doc_id`` of each class of similar documents, columns as they were.

    Rows that share a ``doc_id`` stay or go together.
    """
    _, _, edges, members, later = _linked(docs, n, threshold)
    return without_ids(docs, durable(later.unionByName(_groups_of(edges, members).select("doc_id"))))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) ELSE [array_to_string(w, ' ')] END)) AS s FROM w WHERE len(w) > 0),
lead AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS first, count(*) OVER (PARTITION BY s) AS copies FROM g),
grams AS (SELECT doc_id, len(s) AS n, copies, unnest(s) AS g FROM lead WHERE doc_id = first),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, any_value(a.copies) AS ca, any_value(b.copies) AS cb, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n >= {THRESHOLD} * b.n - 1e-9 AND b.n >= {THRESHOLD} * a.n - 1e-9 GROUP BY a.doc_id, b.doc_id),
pairs AS (SELECT * FROM common WHERE c::DOUBLE / (na + nb - c) >= {THRESHOLD}),
both_ AS (SELECT a AS x, b AS y, cb AS w FROM pairs UNION ALL SELECT b, a, ca FROM pairs),
reach(x, y) AS (SELECT x, y FROM both_ UNION SELECT r.x, e.y FROM reach r JOIN both_ e ON r.y = e.x),
class AS (SELECT x, least(x, min(y)) AS class_id FROM reach GROUP BY x), linked AS (SELECT x, sum(w) AS n FROM both_ GROUP BY x)
SELECT doc_id, coalesce(class_id, first)::BIGINT AS class_id, (coalesce(n, 0) + copies - 1)::BIGINT AS links FROM lead LEFT JOIN class ON class.x = first LEFT JOIN linked ON linked.x = first WHERE coalesce(n, 0) + copies > 1
"""
