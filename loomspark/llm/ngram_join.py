"""N-gram Jaccard join: near-duplicate documents by shingle sets, exactly, with prefix trees.

A document is its set of five-word shingles, hashed to 64 bits and put in one global
order.  Any order that is the same for all gives the same result; rare shingles
first makes prefixes selective.  Two sets with Jaccard >= t share a shingle among
their first n - ceil(t n) + 1, and l of them among the first n - ceil(t n) + l.

1. In an order learnt from a bounded sample, every document sends its prefix shingles,
   packed per batch and range of hashes, to count in how many documents each occurs.
   A shingle that a batch holds more than once is sent once, so a passage of a third
   of all documents is a row per batch.  Documents with too few shared prefix
   shingles have no partner and are done.
2. Of the others, one for each exact set, all shingles are counted in the same way.
   Sets with under 75 % shared shingles are done; the rest are ordered by count.
3. They meet in groups of equal min-hashes (three of them, in blocks of bounded size)
   and are joined there by prefix tree.  This finds most links; components follow.
4. Every prefix shingle that still joins two components is a group in which all its
   documents meet, which completes the join: no link is lost.  Of shingles with the
   same documents one is enough, and shingles whose documents overlap are one group,
   whose documents meet once (in pairs of blocks).

In a group, sets are stored in a trie in global order, without shingles that no two
components share.  All documents walk it together, sharing overlaps along common
paths; each leaves out subtrees whose lengths cannot reach the overlap, or that are
already in its component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.shared import components, delete, map_arrow, map_groups, release, save, together

WORDS = 5
THRESHOLD = 75  # percent
#: Documents whose shingles are counted to learn which are common (order only, not results), and from how many on.
ORDER_SAMPLE = 4000
COMMON = 3
#: At most so many common shingles are kept (16 bytes each), the most frequent.
COMMON_MOST = 400_000
#: Documents of one min-hash that meet in one call.
BLOCK = 256
#: Documents of open shingles that meet in one call, and the bytes of their shingles: of one block, on average.
TILE_SETS = 1024
TILE_BYTES = 4 << 20
#: Most bytes of the bits that tell which document of a call holds which token.
BITS_BYTES = 64 << 20
#: Packed bytes of a range of hashes in one group, on average.
RANGE_BYTES = 12 << 20
BATCH = 4096
#: Bytes of text whose words are hashed at once.
STRETCH = 1 << 20
#: 64 bits each: at most 8 MB are broadcast to find texts again.
BITMAP_WORDS = 1 << 20

_MULT = np.random.default_rng(7).integers(1, 1 << 62, size=WORDS + 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINAL = np.uint64(0xFF51AFD7ED558CCD)
_MANY = 65535


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _FINAL
    return h ^ (h >> np.uint64(29))


#: A random value for each byte, 0 for white space, and an odd one for each place in a word.
_LETTERS = np.random.default_rng(11).integers(1, 1 << 63, size=256, dtype=np.uint64)
_LETTERS[list(b" \t\n\x0b\x0c\r")] = 0


def _places(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(np.arange(1, n + 1, dtype=np.uint64) * _MULT[7]) | np.uint64(1)


_PLACES = _places(1024)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 text in order: letters times places, summed.  No word is remembered."""
    letters = np.frombuffer(text.lower(), np.uint8)
    inside = np.concatenate([[False], _LETTERS[letters] != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + STRETCH, side="right")))
        at, size = starts[lo:hi], ends[lo:hi] - starts[lo:hi]
        first = np.cumsum(size) - size  # where each word begins when only words are laid end to end
        place = np.arange(size.sum()) - np.repeat(first, size)
        places = _PLACES if size.max() <= len(_PLACES) else _places(size.max())
        with np.errstate(over="ignore"):
            terms = _LETTERS[letters[np.repeat(at, size) + place]] * places[place]
            out[lo:hi] = _mixed(np.add.reduceat(terms, first))
        lo = hi
    return out


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of UTF-8 text; A-Z are folded, words end at ASCII white space."""
    w = word_hashes(text or b"")
    n = len(w)
    if not n:
        return w
    with np.errstate(over="ignore"):
        if n < WORDS:  # the whole sequence is one shingle, apart from those of five words
            return _mixed(np.sum(w * _MULT[:n], keepdims=True, dtype=np.uint64) + np.uint64(n))
        h = w[: n - WORDS + 1] * _MULT[0]
        for i in range(1, WORDS):
            h = h + w[i : n - WORDS + 1 + i] * _MULT[i]
        return np.unique(_mixed(h))


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a = int(np.sum(_mixed(s + _MULT[5]), dtype=np.uint64))
        b = int(np.sum(_mixed(s * _MULT[6]), dtype=np.uint64))
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


class Order:
    """The global order: a set as sorted 64-bit tokens, class of frequency in the top four bits."""

    def __init__(self, hashes: np.ndarray, classes: np.ndarray):
        self.hashes, self.classes = hashes, classes

    def tokens(self, s: np.ndarray) -> np.ndarray:
        t = s >> np.uint64(4)
        if len(self.hashes) and len(s):
            at = np.searchsorted(self.hashes, s)
            at[at == len(self.hashes)] = 0
            t = t | np.where(self.hashes[at] == s, self.classes[at], np.uint64(0))
        return np.sort(t)


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares at least with any partner."""
    return -(-THRESHOLD * n // 100)


def depth(n: int) -> int:
    """How many shared prefix shingles stage 1 asks of a set of n."""
    return 1 + n // 20


def learn_order(docs: DataFrame) -> Order:
    """Common shingles from a sample of documents by hash of doc_id."""
    n = docs.count()
    share = min(1.0, ORDER_SAMPLE / max(n, 1))
    picked = docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches):
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text).view(np.int64))], ["h"])

    seen = map_arrow(picked.select("text"), run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    rows = seen.orderBy(F.desc("n"), "h").limit(COMMON_MOST).toArrow()
    h = rows.column("h").to_numpy().astype(np.int64).view(np.uint64)
    k = np.minimum(np.floor(np.log2(np.maximum(rows.column("n").to_numpy(), 1))), 15).astype(np.uint64) << np.uint64(60)
    at = np.argsort(h)
    return Order(h[at], k[at])


def ranges_of(docs: DataFrame) -> int:
    """Ranges of hashes, so that the packed shingles of one are of bounded size on average."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(48, int(size * 0.5 / RANGE_BYTES))


def with_candidates(docs: DataFrame, order) -> DataFrame:
    """doc_id, n, k1, k2, candidate for every row: stage 1.  order: a broadcast Order."""
    ranges = ranges_of(docs)

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in together(batches, BATCH):
            number += 1
            ids = batch.column(0).to_pylist()
            sets = [shingle_set(t) if i is not None else np.zeros(0, np.uint64) for i, t in zip(ids, batch.column(1).cast(pa.binary()).to_pylist())]
            sizes = np.array([len(s) for s in sets], np.int64)
            names = np.array([identity(s) for s in sets], np.int64).reshape(-1, 2)
            heads = [order.value.tokens(s)[: len(s) - least_overlap(len(s)) + depth(len(s))] for s in sets]
            h = np.concatenate(heads)
            ref = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in heads])
            at = np.argsort(h, kind="stable")
            h, ref = h[at], ref[at]
            new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            many = (np.bincount(group) > 1)[group] if len(h) else np.zeros(0, bool)
            shared = np.bincount(ref[many], minlength=len(sets)).astype(np.int64)
            ref = np.where(many, np.uint16(_MANY), ref)[new]
            h = h[new]
            part = (h & np.uint64(0xFFFFFFFF)) % np.uint64(ranges)
            at = np.argsort(part, kind="stable")
            h, ref, part = h[at], ref[at], part[at]
            cut = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
            used = np.flatnonzero(cut[1:] > cut[:-1])
            rows = len(used)
            blank = pa.nulls(rows, pa.binary())
            fields = ["part", "number", "hashes", "refs", "docs"]
            yield pa.RecordBatch.from_arrays([
                pa.array(used.astype(np.int64)), pa.array(np.full(rows, number, np.int64)),
                pa.array([h[cut[p] : cut[p + 1]].tobytes() for p in used], pa.binary()), pa.array([ref[cut[p] : cut[p + 1]].tobytes() for p in used], pa.binary()), blank,
            ], fields)
            table = np.column_stack([np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], np.int64), sizes, names, shared])
            yield pa.RecordBatch.from_arrays([pa.array([number % ranges]), pa.array([number]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([table.tobytes()], pa.binary())], fields)

    def count(key, table: pa.Table) -> pa.Table | None:
        numbers = table.column("number").to_numpy()
        hs, rs, docs_ = (table.column(c).to_pylist() for c in ("hashes", "refs", "docs"))
        out = []
        tokens = [i for i, x in enumerate(hs) if x is not None]
        if tokens:
            h = np.concatenate([np.frombuffer(hs[i], np.uint64) for i in tokens])
            ref = np.concatenate([np.frombuffer(rs[i], np.uint16) for i in tokens])
            num = np.repeat(numbers[tokens], [len(rs[i]) // 2 for i in tokens])
            at = np.argsort(h, kind="stable")
            h, ref, num = h[at], ref[at], num[at]
            group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
            # in two batches, or more than once in one
            shared = (np.bincount(group, weights=1 + (ref == _MANY)) > 1)[group] & (ref != _MANY)
            doc, n = np.unique(num[shared] * 65536 + ref[shared], return_counts=True)
            z = np.zeros(len(doc), np.int64)
            out.append(np.column_stack([doc, z, z - 1, z - 1, z, z, n]))
        for num, blob in zip(numbers, docs_):
            if blob is not None:
                t = np.frombuffer(blob, np.int64).reshape(-1, 6)
                out.append(np.column_stack([num * 65536 + np.arange(len(t)), t]))
        if not out:
            return None
        t = np.concatenate(out)
        return pa.table({c: np.ascontiguousarray(t[:, i]) for i, c in enumerate(("doc", "doc_id", "no_id", "n", "k1", "k2", "shared"))})

    packed = map_arrow(docs.select("doc_id", "text"), pack, "part long, number long, hashes binary, refs binary, docs binary")
    counted = map_groups(packed, ["part"], count, "doc long, doc_id long, no_id long, n long, k1 long, k2 long, shared long")
    # one row per document has its facts (n >= 0), the others only counts
    own = F.col("n") >= 0
    first = lambda c: F.max(F.when(own, F.col(c))).alias(c)
    sums = counted.groupBy("doc").agg(first("doc_id"), first("no_id"), first("n"), first("k1"), first("k2"), F.sum("shared").alias("shared"))
    least = F.ceil(F.lit(THRESHOLD) * F.col("n") / 100).cast("long")
    return sums.select(
        F.when(F.col("no_id") == 0, F.col("doc_id")).alias("doc_id"), "n", "k1", "k2", ((F.col("n") > 0) & (F.col("shared") >= 1 + F.floor(least / 20))).alias("candidate")
    )


def kin(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of docs that may have an id in ids, none lost: a bitmap of hashes as a broadcast table of at most BITMAP_WORDS rows."""
    bit = lambda c: F.pmod(F.xxhash64(F.lit(11), c), F.lit(BITMAP_WORDS * 64))
    word = lambda c: F.floor(bit(c) / 64).cast("int")
    mask = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (bit(c) % 64).cast("int"))
    bitmap = ids.groupBy(word(F.col(column)).alias("word")).agg(F.bit_or(mask(F.col(column))).alias("bits"))
    near = docs.join(F.broadcast(bitmap), word(F.col("doc_id")) == F.col("word"))
    return near.where(F.col("bits").bitwiseAND(mask(F.col("doc_id"))) != 0).drop("word", "bits")


def _lists(col, dtype=np.uint64) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype) for b in col.to_pylist()]


def ordered_by_count(sets: DataFrame, ranges: int) -> DataFrame:
    """Stage 2: sets (rep, cls, n, batch, tokens) with enough shared shingles, tokens in order of count, with head and mins."""

    def pack(batches):
        for whole in batches:
            names = whole.column(0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]]) if len(names) else [0]
            for lo, hi in zip(cut[:-1], cut[1:]):
                h, n = np.unique(np.concatenate(_lists(whole.column(1).slice(lo, hi - lo))) << np.uint64(4), return_counts=True)
                part = ((h >> np.uint64(4)) & np.uint64(0xFFFFFFFF)) % np.uint64(ranges)
                at = np.argsort(part, kind="stable")
                h, n, part = h[at], np.minimum(n[at], 65535).astype(np.uint16), part[at]
                edge = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
                used = np.flatnonzero(edge[1:] > edge[:-1])
                yield pa.RecordBatch.from_arrays([
                    pa.array(used.astype(np.int64)), pa.array(np.full(len(used), names[lo], np.int64)),
                    pa.array([h[edge[p] : edge[p + 1]].tobytes() for p in used], pa.binary()), pa.array([n[edge[p] : edge[p + 1]].tobytes() for p in used], pa.binary()),
                ], ["part", "batch", "hashes", "counts"])

    def count(key, table: pa.Table) -> pa.Table | None:
        batch, hs = table.column("batch").to_numpy(), _lists(table.column("hashes"))
        h, n = np.concatenate(hs), np.concatenate(_lists(table.column("counts"), np.uint16)).astype(np.int64)
        _, inv = np.unique(h, return_inverse=True)
        total = np.bincount(inv, weights=n)[inv]
        level = np.where(total < 128, total, 127 + np.floor(np.log2(total))).astype(np.uint8)
        edge = np.concatenate([[0], np.cumsum([len(x) for x in hs])])
        rows = []
        for i in range(len(hs)):
            own, lev = h[edge[i] : edge[i + 1]], level[edge[i] : edge[i + 1]]
            if (lev > 1).any():
                rows.append((batch[i], own[lev > 1].tobytes(), lev[lev > 1].tobytes()))
        return pa.table({"batch": pa.array([r[0] for r in rows], pa.int64()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "levels": pa.array([r[2] for r in rows], pa.binary())}) if rows else None

    def put(key, table: pa.Table) -> pa.Table | None:
        known = pa.compute.is_valid(table.column("hashes"))
        told, own = table.filter(known), table.filter(pa.compute.invert(known))
        if not told.num_rows or not own.num_rows:
            return None
        h, level = np.concatenate(_lists(told.column("hashes"))), np.concatenate(_lists(told.column("levels"), np.uint8))
        h, first = np.unique(h, return_index=True)
        level = level[first].astype(np.uint64)
        cols = [[] for _ in range(6)]
        for rep, cls, n, old in zip(own.column("rep").to_pylist(), own.column("cls").to_pylist(), own.column("n").to_pylist(), _lists(own.column("tokens"))):
            low = old << np.uint64(4)
            at = np.minimum(np.searchsorted(h, low), len(h) - 1)
            hit = h[at] == low
            if np.count_nonzero(hit) < least_overlap(n):
                continue
            t = np.sort((np.where(hit, level[at], np.uint64(1)) << np.uint64(56)) | (low >> np.uint64(8)))
            with np.errstate(over="ignore"):
                mins = [int((low * m).min() >> np.uint64(1)) for m in _MULT[:3]]
            for c, v in zip(cols, (rep, cls, n, t.tobytes(), t[: n - least_overlap(n) + 1].view(np.int64), mins)):
                c.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["rep", "cls", "n", "tokens", "head", "mins"])

    packed = map_arrow(sets.select("batch", "tokens"), pack, "part long, batch long, hashes binary, counts binary")
    told = map_groups(packed, ["part"], count, "batch long, hashes binary, levels binary")
    both = sets.unionByName(told, allowMissingColumns=True)
    return map_groups(both, ["batch"], put, "rep long, cls long, n long, tokens binary, head array<long>, mins array<long>")


class Node:
    __slots__ = ("seg", "end", "kids", "here", "lo", "hi", "least", "most", "longest")

    def __init__(self, seg, end, lo, hi, sizes, lengths):
        self.seg, self.end, self.lo, self.hi = seg, end, lo, hi
        self.least, self.most, self.longest = int(sizes[lo:hi].min()), int(sizes[lo:hi].max()), int(lengths[lo:hi].max())
        self.kids, self.here = [], []


def build(sets: list[np.ndarray], sizes: np.ndarray) -> Node:
    """A path-compressed trie of lexicographically sorted arrays; a node covers sets[lo:hi].  sizes: of the sets they were made of."""

    def common(a, b):
        n = min(len(a), len(b))
        diff = a[:n] != b[:n]
        return int(diff.argmax()) if diff.any() else n

    lengths = np.array([len(s) for s in sets])
    same = np.array([0] + [common(a, b) for a, b in zip(sets, sets[1:])])  # with the set before
    root = Node(sets[0][:0], 0, 0, len(sets), sizes, lengths)
    work = [(root, 0, len(sets), 0)]
    while work:
        parent, lo, hi, at = work.pop()
        while lo < hi and lengths[lo] == at:
            parent.here.append(lo)
            lo += 1
        if lo == hi:
            continue
        cuts = [lo, *(np.flatnonzero(same[lo + 1 : hi] == at) + lo + 1).tolist(), hi]
        for a, b in zip(cuts, cuts[1:]):  # sets that go on with the same token are one child
            end = int(same[a + 1 : b].min()) if b > a + 1 else int(lengths[a])
            kid = Node(sets[a][at:end], end, a, b, sizes, lengths)
            parent.kids.append(kid)
            work.append((kid, a, b, end))
    return root


class Holders:
    """How many numbers of an ascending list each of some documents holds: by bits of the documents, or by lists of who holds a number."""

    def __init__(self, rank: np.ndarray, who: np.ndarray, ranks: int, docs: int):
        """rank, ascending, and who: document who[i] holds the number rank[i]."""
        self.docs, self.who = docs, who
        self.starts = np.searchsorted(rank, np.arange(ranks + 1))
        self.bits = None
        words = (ranks + 63) >> 6
        if words * docs * 8 <= BITS_BYTES:
            key = (rank >> 6) * docs + who
            at = np.argsort(key, kind="stable")
            key = key[at]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
            self.bits = np.zeros(words * docs, np.uint64)
            if len(key):
                self.bits[key[first]] = np.bitwise_or.reduceat(np.uint64(1) << (rank[at] & 63).astype(np.uint64), first)
            self.bits = self.bits.reshape(words, docs)

    def __call__(self, seg: np.ndarray, active: np.ndarray) -> np.ndarray:
        lo, hi = int(seg[0]) >> 6, (int(seg[-1]) >> 6) + 1
        starts = self.starts[seg]
        held = self.starts[seg + 1] - starts
        total = int(held.sum())
        if self.bits is not None and len(active) * (hi - lo) <= 8 * total:
            mask = np.zeros((hi - lo) << 6, bool)
            mask[seg - (lo << 6)] = True
            mask = np.packbits(mask, bitorder="little").view(np.uint64)
            return np.bitwise_count(self.bits[lo:hi].take(active, axis=1) & mask[:, None]).sum(axis=0, dtype=np.int64)
        places = np.arange(total) + np.repeat(starts - np.cumsum(held) + held, held)
        return np.bincount(self.who[places], minlength=self.docs)[active]


def tree_join(sets: list[np.ndarray], group: list[int], side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join the sets' components: (i, j) with Jaccard >= 75 %, enough to connect all that link.

    group: a number for each set, equal where sets are known to be connected.  side: if
    given, only sets of different sides (of two) are compared.
    """
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2 or not n.sum():
        return []
    label = np.array(group)
    if len(sets) == 2:  # a pair needs no tree
        overlap = len(np.intersect1d(*sets, assume_unique=True))
        apart = label[0] != label[1] and (side is None or side[0] != side[1])
        return [(0, 1)] if apart and 175 * overlap >= THRESHOLD * int(n.sum()) else []
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    at = np.argsort(tokens, kind="stable")
    tokens, own = tokens[at], owner[at]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    # tokens that sets to be compared share; the others add to no overlap
    useful = np.minimum.reduceat(label[own], first) != np.maximum.reduceat(label[own], first)
    right = None
    if side is not None:
        right = np.asarray(side) == max(side)
        useful &= np.minimum.reduceat(right[own], first) != np.maximum.reduceat(right[own], first)
    many = np.diff(first, append=len(tokens))
    keep, rank = np.repeat(useful, many), np.repeat(np.cumsum(useful) - 1, many)
    length = np.bincount(own[keep], minlength=len(sets))
    alive = 100 * length >= THRESHOLD * n
    keep &= alive[own]
    # the sets that are left, as ascending numbers of useful tokens
    own, rank, ranks = own[keep], rank[keep], int(useful.sum())
    by_set = rank[np.argsort(own, kind="stable")]
    edge = np.concatenate([[0], np.cumsum(np.where(alive, length, 0))])
    short = {i: by_set[edge[i] : edge[i + 1]] for i in np.flatnonzero(alive).tolist()}
    tree = sorted((i for i in short if right is None or right[i]), key=lambda i: short[i].astype(">u4").tobytes())
    walks = tree if right is None else [i for i in short if not right[i]]
    if not tree or not walks:
        return []
    tree, walks = np.array(tree), np.array(walks)
    place = np.full(len(sets), -1)
    place[walks] = np.arange(len(walks))
    mine = place[own] >= 0
    count = Holders(rank[mine], place[own[mine]], ranks, len(walks))
    size, most = n[walks], length[walks]

    links = []
    work = [(build([short[i] for i in tree.tolist()], n[tree]), np.arange(len(walks)), np.zeros(len(walks), np.int64))]
    while work:
        node, active, overlap = work.pop()
        if right is None:  # each pair once
            active = active[: int(np.searchsorted(active, node.hi - 1))]
            overlap = overlap[: len(active)]
        if not len(active):
            continue
        fit = (THRESHOLD * size[active] <= 100 * node.most) & (100 * size[active] >= THRESHOLD * node.least)
        below = label[tree[node.lo : node.hi]]
        if len(below) == 1 or (below == below[0]).all():
            fit &= label[walks[active]] != below[0]
        active, overlap = active[fit], overlap[fit]
        if not len(active):
            continue
        if len(node.seg):
            overlap = overlap + count(node.seg, active)
        # |x & y| >= 75 / 175 (|x| + |y|), for the smallest y below and the most that can still be shared
        fit = 175 * np.minimum(overlap + (node.longest - node.end), most[active]) >= THRESHOLD * (size[active] + node.least)
        active, overlap = active[fit], overlap[fit]
        if not len(active):
            continue
        for j in node.here:
            y = tree[j]
            near = 175 * overlap >= THRESHOLD * (size[active] + n[y])
            if right is None:
                near &= active < j
            near = walks[active[near]]
            near = near[label[near] != label[y]]
            while len(near):
                links.append((int(near[0]), int(y)))
                label[label == label[near[0]]] = label[y]
                near = near[label[near] != label[y]]
        work.extend((k, active, overlap) for k in node.kids)
    return links


def blocks(members, shingles):
    """Blocks that so many documents with so many shingles are dealt into, each of bounded size on average."""
    return F.least(members, F.ceil(F.greatest(members / F.lit(TILE_SETS), shingles * F.lit(8) / F.lit(TILE_BYTES)))).cast("int")


def gathered(hits: DataFrame) -> DataFrame:
    """Where the documents of open shingles meet: (alone, token, ti, tj, blk, comp, cls).

    hits: (token, size, shingles, cls, comp, n), size and shingles (the sum of n) those of
    the token.  Shingles whose documents overlap are put together by passing the smallest
    document along them twice, so that documents meet once and not for every shingle
    that they share.  Where a gathering has more pairs of documents than its shingles
    have, and does not fit in one block, each shingle is alone.  What is larger than
    a block meets in pairs of blocks.
    """
    key = hits.select("token", "cls", F.col("cls").alias("k"))
    for _ in range(2):
        per_token = key.groupBy("token").agg(F.min("k").alias("k"))
        per_doc = hits.select("token", "cls").join(per_token, "token").groupBy("cls").agg(F.min("k").alias("k"))
        key = hits.select("token", "cls", "size").join(per_doc, "cls")
    square = lambda c: F.col(c).cast("double") * F.col(c)
    per_token = save(key.groupBy("token").agg(F.min("k").alias("key"), F.first("size").alias("size")), "keys")
    members = hits.select("token", "cls", "comp", "n").join(per_token.select("token", "key"), "token").select("key", "cls", "comp", "n").distinct()
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    sizes = sizes.join(per_token.groupBy("key").agg(F.sum(square("size")).alias("pairs")), "key").withColumn("nb", blocks(F.col("members"), F.col("shingles")))
    sizes = save(sizes.select("key", "nb", ((F.col("nb") > 1) & (square("members") > F.col("pairs"))).alias("alone")), "sizes")
    once = members.join(sizes.where("not alone").drop("alone"), "key").select(F.lit(False).alias("alone"), F.col("key").alias("token"), "comp", "cls", "nb")
    split = per_token.join(sizes.where("alone").select("key"), "key").select("token")
    alone = hits.join(split, "token").select(F.lit(True).alias("alone"), "token", "comp", "cls", blocks(F.col("size"), F.col("shingles")).alias("nb"))
    placed = once.unionByName(alone).withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return placed.select("alone", "token", F.least("blk", "other").alias("ti"), F.greatest("blk", "other").alias("tj"), "blk", "comp", "cls")


def _joined(table: pa.Table, two_sided: bool) -> pa.Table | None:
    rep = table.column("rep").to_numpy()
    if len(rep) < 2:
        return None
    groups, side = list(range(len(rep))), None
    if two_sided:
        groups = table.column("comp").to_numpy()
        if table.column("ti")[0] != table.column("tj")[0]:
            side = table.column("blk").to_numpy()
            if side.min() == side.max():  # they meet where ti = tj
                return None
    links = tree_join(_lists(table.column("tokens")), groups, side)
    return pa.table({"src": rep[[a for a, _ in links]].astype(np.int64), "dst": rep[[b for _, b in links]].astype(np.int64)}) if links else None


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links, the document's own
    included.  Null or blank texts have no shingles and link with nothing; a text of
    fewer than five words is one shingle.  Rows that share a doc_id are one node.  A
    null doc_id keeps its row, with null component_id, and links with nothing (its
    n_shingles is 0).  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = spark.sparkContext.broadcast(learn_order(docs))
    facts = save(with_candidates(docs, order), "facts")
    release(spark)
    classes = facts.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.max("candidate").alias("candidate"))
    classes = save(classes.where("candidate"), "classes")

    def again(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for part in together(batches, 512):
            number += 1
            cols = [[] for _ in range(4)]
            facts_ = zip(*(part.column(i).to_pylist() for i in range(4)), part.column(4).cast(pa.binary()).to_pylist())
            for rep, n, k1, k2, text in facts_:
                s = shingle_set(text)
                if len(s) == n and identity(s) == (k1, k2):  # else another row with this doc_id
                    for c, v in zip(cols, (rep, k1, n, order.value.tokens(s).tobytes())):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(np.full(len(cols[0]), number, np.int64)), pa.array(cols[3], pa.binary())], ["rep", "cls", "n", "batch", "tokens"])

    texts = kin(docs, classes, "rep").join(classes.select(F.col("rep").alias("doc_id"), "n", "k1", "k2"), "doc_id").select("doc_id", "n", "k1", "k2", "text")
    raw = save(map_arrow(texts, again, "rep long, cls long, n long, batch long, tokens binary"), "raw")
    sets = save(ordered_by_count(raw, ranges_of(docs)), "sets")
    delete(raw)
    release(spark)

    # 3: groups of equal min-hash, in blocks
    mins = sets.select("cls", F.posexplode("mins").alias("perm", "value"))
    shared = mins.groupBy("perm", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    at = mins.join(shared, ["perm", "value"]).withColumn("blk", F.pmod(F.xxhash64("cls", "perm"), F.ceil(F.col("size") / BLOCK)).cast("int")).drop("size")
    meet = at.join(sets.select("cls", "rep", "tokens"), "cls").select("perm", "value", "blk", "rep", "tokens")
    first = map_groups(meet, ["perm", "value", "blk"], lambda _, t: _joined(t, False), "src long, dst long")
    first = save(first.distinct(), "first")
    parts = components(first).withColumnRenamed("node", "rep")
    delete(first)

    # 4: prefix shingles that still join two components, one for each list of documents
    labelled = sets.join(parts, "rep", "left").select("rep", "cls", "n", "head", F.coalesce("component", "rep").alias("comp"))
    heads = labelled.select("rep", "cls", "n", "comp", F.explode("head").alias("token"))
    lists = heads.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.min("comp").alias("a"), F.max("comp").alias("b"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y")
    )
    open_ = lists.where("a < b").groupBy("size", "shingles", "x", "y").agg(F.min("token").alias("token"))
    hits = save(heads.join(open_.select("token", "size", "shingles"), "token"), "open")
    tiles = gathered(hits).join(sets.select("cls", "rep", "tokens"), "cls").drop("cls")
    last = map_groups(tiles, ["alone", "token", "ti", "tj"], lambda _, t: _joined(t, True), "src long, dst long").distinct()
    star = parts.where("rep <> component").select(F.col("rep").alias("src"), F.col("component").alias("dst"))
    final = components(star.unionByName(last)).withColumnRenamed("node", "rep")

    named = classes.join(final, "rep", "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = facts.join(named, ["n", "k1", "k2"], "left")
    by_row = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return by_row


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORD_LIST = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORD_LIST} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' '))) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p WHERE 100 * c >= {THRESHOLD} * (na + nb - c)),
reach(v, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT v, min(r) AS c FROM reach GROUP BY v) m ON m.v = s.doc_id
"""
