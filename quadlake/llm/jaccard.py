"""Jaccard join of n-gram sets by prefix trees.

Documents are sets of word n-grams (as 64-bit hashes); equal sets are one set.

0. A set that is similar to another shares at least the threshold's part of its n-grams with
   it. All n-grams are counted once, dealt by ranges of their hashes; a set with too many that no
   other set has is similar to none and stays out of what follows (``shared_sets``).
1. The range of hashes is cut into m parts, m by size class. Similar sets of a class differ
   in at most D n-grams, so at least m - D parts of them are equal. A set posts a key for
   each part that is not small; it counts as small only as far as fewer than m - D of the
   set's parts are, so similar sets always meet at a key. Sets that meet are chained to
   one of them, within a task first and then per key: a key of a million copies sends a
   row per task. The connected components of the chains are families; all links lie
   within them. Documents that merely share a passage hardly ever meet.
2. The texts of a family meet in blocks of bounded size. A block keeps its sets in a trie
   in global order, the common n-grams first, so that similar sets share paths. Each set
   walks down the trie once; the overlap along a path is counted once for all sets below.
   A subtree is left out if its lengths and what remains of the set cannot reach the
   threshold, or if all of it is already in the set's component.
3. A family of several blocks first joins the largest components of its blocks through one
   member each. Every set outside the largest component of the family is then held against a
   bit map of the n-grams of each block; only where that holds enough of its n-grams the set
   itself is sent to the block. Bit maps take a few bits for each n-gram, and meet many sets
   at once, so what moves is far less than the texts. Pairs inside the largest component
   need no comparison, all others get it.

The components of links are those of step 2 and 3, contracted. Copies and long chains of
near copies thus need few comparisons, and no pair is listed.

A text without words, or null, has no n-grams and links with nothing. Rows of a repeated
doc_id count as documents of their own; a null doc_id is never the least. Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.llm.graph import components
from quadlake.llm.screen import screened
from quadlake.llm.tables import map_rows
from quadlake.llm.words import WordHashes, mix, shingles
from quadlake.session import checkpoint_folder, cut, remove

N = 4
PERCENT = 85
# Sizes of a class grow by this ratio, and so many parts more than differences are made.
CLASS_GROWTH, MORE_PARTS = 1.15, 0.25
# Parts below this size are left out where enough others remain.
SMALL_PART = 4
# Postings held in a task, n-grams held to be counted, and n-grams of a block: bounds of memory.
HELD = 2_000_000
COUNTED = 1_000_000
BLOCK_GRAMS = 1_000_000
# Bits of a block's map for each n-gram, at least.
MAP_BITS = 2
# Sets that are held against the maps at once, in blocks.
CHUNK_BLOCKS = 8
# Places found for them that are kept before they are sent.
HELD_PLACES = 1_000_000
# N-grams of them that are looked up in a map at once.
PIECE_GRAMS = 1_000_000
# Bytes of a key that are sent, beside its bucket: sets of equal short keys share a family,
# which does no harm.
KEY_BYTES = 6
# N-grams whose postings make a bucket of keys, about 8 bytes for each.
BUCKET_GRAMS = 8_000_000


def gram_set(text: str | None, n: int = N) -> np.ndarray:
    """The sorted distinct n-grams of a text."""
    grams = np.sort(shingles(WordHashes(text).lower, n)) if text else np.empty(0, np.uint64)
    fresh = np.ones(len(grams), bool)
    np.not_equal(grams[1:], grams[:-1], out=fresh[1:])
    return grams[fresh]


def signature(grams: np.ndarray) -> bytes | None:
    """128 bits that name a set; none for the empty set."""
    if not len(grams):
        return None
    a = mix(grams ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    b = mix(grams ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def text_digest() -> Column:
    """What names a text as it is written."""
    return F.unhex(F.sha2("text", 256)).alias("digest")


def signatures(docs: DataFrame, n: int = N) -> DataFrame:
    """The size and signature of each document's set, and the digest of its text."""
    def sign(rows: Iterator[tuple]) -> Iterable[tuple]:
        for doc_id, text, digest in rows:
            grams = gram_set(text, n)
            yield doc_id, len(grams), signature(grams), digest

    return map_rows(docs.select("doc_id", "text", text_digest()), sign,
                    "doc_id long, n_shingles long, sig binary, digest binary")


@functools.cache
def classes(percent: int) -> list[tuple[int, int, int]]:
    """(largest size, most differences D, parts m) of the classes of sizes."""
    out, size = [], 1
    while size < 1 << 40:
        # |x ^ y| = |x| + |y| - 2 |x & y|, and |x & y| >= t (|x| + |y|) / (1 + t).
        differences = (100 - percent) * 2 * size // (100 + percent)
        out.append((size, differences, differences + 1 + int(MORE_PARTS * differences)))
        size = max(size + 1, int(size * CLASS_GROWTH))
    return out


@functools.lru_cache(64)
def _part_names(m: int) -> np.ndarray:
    return mix(np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(m))


def part_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set of sorted n-grams, for each class that a similar set may be of."""
    n, kinds, out = len(grams), classes(percent), []
    first = bisect.bisect_left(kinds, (n,))
    last = bisect.bisect_left(kinds, (100 * n // percent,))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(grams + np.uint64(0x632BE59BD9B4E019)), out=sums[1:])
    high = grams >> np.uint64(32)
    for _, differences, m in kinds[first:last + 1]:
        part = (high * np.uint64(m)) >> np.uint64(32)
        sizes = np.bincount(part.view(np.int64), minlength=m)
        below = np.cumsum(np.bincount(np.minimum(sizes, SMALL_PART), minlength=SMALL_PART)[:SMALL_PART])
        # Parts smaller than this are left out: fewer than those that must be equal.
        least = int(np.searchsorted(below, m - differences))
        ends = np.cumsum(sizes)
        big = np.flatnonzero(sizes >= least)
        ends, sizes = ends[big], sizes[big]
        out.append(mix(sums[ends] - sums[ends - sizes] + _part_names(m)[big]))
    return np.concatenate(out)


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first posting of each key, and the different edges from it to the key's others."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
    of = np.repeat(nodes[first], np.diff(first, append=len(keys)))
    apart = nodes != of
    return keys[first], nodes[first], np.unique(np.column_stack((nodes[apart], of[apart])), axis=0)


def _posted(keys: np.ndarray, nodes: np.ndarray) -> tuple[bytes, bytes]:
    """Postings of one bucket, sorted by node: the high KEY_BYTES of the keys; each node once, with its number of keys."""
    starts = np.flatnonzero(np.diff(nodes, prepend=nodes[0] ^ 1))
    counts = np.diff(starts, append=len(nodes)).astype("<i4")
    short = np.ascontiguousarray(keys.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    return short.tobytes(), nodes[starts].astype("<i8").tobytes() + counts.tobytes()


def _read_postings(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    short = np.frombuffer(a, np.uint8).reshape(-1, KEY_BYTES)
    keys = np.zeros((len(short), 8), np.uint8)
    keys[:, :KEY_BYTES] = short
    n = len(b) // 12
    return keys.view(">u8").reshape(-1).astype(np.uint64), np.repeat(np.frombuffer(b[:8 * n], "<i8"), np.frombuffer(b[8 * n:], "<i4"))


def node_of(sig: bytes) -> int:
    """A set's number in the chains: 64 bits of its signature. Sets that share it share a
    family, which does no harm."""
    return int.from_bytes(sig[:8], "big", signed=True)


def chains(docs: DataFrame, n_grams: int, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Edges (src, dst) between nodes, enough to connect all sets that are similar.

    n_grams is how many n-grams there are in all. Keys are dealt to so many buckets that
    the postings of one stay within bounds; a task takes its buckets one after the other.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = tasks * max(1, -(-n_grams // (tasks * BUCKET_GRAMS)))

    def post(rows: Iterator[tuple]) -> Iterable[tuple]:
        keys, nodes, size, seen = [], [], 0, set()

        def flush() -> Iterator[tuple]:
            key, node, edges = _stars(np.concatenate(keys), np.concatenate(nodes))
            bucket = (key % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((node, bucket))
            bounds = np.searchsorted(bucket[order], np.arange(shards + 1))
            for k in range(shards):
                part = order[bounds[k]:bounds[k + 1]]
                if len(part):
                    yield k, *_posted(key[part], node[part]), False
            if len(edges):
                yield int(edges[0, 0]) % shards, edges[:, 0].tobytes(), edges[:, 1].tobytes(), True

        for (text,) in rows:
            grams = gram_set(text, n)
            sig = signature(grams)
            if sig is None or sig in seen:
                continue
            seen.add(sig)
            found = part_keys(grams, percent)
            keys.append(found)
            nodes.append(np.full(len(found), node_of(sig)))
            size += len(found)
            if size > HELD:
                yield from flush()
                keys, nodes, size, seen = [], [], 0, set()
        if keys:
            yield from flush()

    def meet(rows: Iterator[tuple]) -> Iterable[tuple]:
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            keys, nodes = [], []
            for _, a, b, edges in group:
                if edges:
                    yield from zip(np.frombuffer(a, np.int64).tolist(), np.frombuffer(b, np.int64).tolist())
                else:
                    key, node = _read_postings(a, b)
                    keys.append(key)
                    nodes.append(node)
            if keys:
                yield from map(tuple, _stars(np.concatenate(keys), np.concatenate(nodes))[2].tolist())

    posted = map_rows(docs.select("text"), post, "bucket int, a binary, b binary, edges boolean", 1)
    dealt = posted.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")
    return map_rows(dealt, meet, "src long, dst long").distinct()


def _tally(owners: np.ndarray) -> bytes:
    """How often each number below 2 ** 16 is there: the numbers, then the counts."""
    found, counts = np.unique(owners, return_counts=True)
    return found.astype("<u2").tobytes() + counts.astype("<u4").tobytes()


def _read_tally(a: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(a) // 6
    return np.frombuffer(a[:2 * n], "<u2"), np.frombuffer(a[2 * n:], "<u4")


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which of the values are there more than once."""
    order = np.argsort(values)
    values = values[order]
    same = np.zeros(len(values) + 1, bool)
    np.equal(values[1:], values[:-1], out=same[1:-1])
    out = np.empty(len(values), bool)
    out[order] = same[1:] | same[:-1]
    return out


def shared_sets(docs: DataFrame, n_grams: int, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(sig): the sets that other sets share enough n-grams with, taken all together, for one to be similar.

    A task holds some sets at a time. Of n-grams that several of them have it sends one mark, of
    the others 32 bits, to the bucket of their range of hashes, where they are looked for among
    those of all tasks; back goes how many of each set were found. N-grams that are taken for
    each other, and copies of a set in other tasks, only let more sets pass.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = tasks * max(1, -(-n_grams // (tasks * BUCKET_GRAMS)))

    def post(rows: Iterator[tuple]) -> Iterable[tuple]:
        held, size = {}, 0

        def flush() -> Iterator[tuple]:
            # A name that follows from the sets, so that a task that is run again gives the same one.
            names = b"".join(held)
            chunk = hashlib.sha256(names).digest()[:16]
            flat, sizes = np.concatenate(list(held.values())), np.array([len(g) for g in held.values()])
            owners = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            again = _repeated(flat)
            known = np.bincount(owners[again], minlength=len(sizes))
            marks = np.unique(flat[again])
            flat, owners = flat[~again], owners[~again]

            def bucket_of(grams: np.ndarray) -> np.ndarray:
                return ((grams >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.uint32 if shards > 1 << 16 else np.uint16)

            buckets = bucket_of(flat)
            order = np.argsort(buckets, kind="stable")
            flat, owners = flat[order].astype("<u4"), owners[order]
            bounds = np.searchsorted(buckets[order], np.arange(shards + 1))
            at, marks = np.searchsorted(bucket_of(marks), np.arange(shards + 1)), marks.astype("<u4")
            sent = 0
            for k in range(shards):
                a, b = bounds[k], bounds[k + 1]
                if a < b or at[k] < at[k + 1]:
                    sent += 1
                    yield k, chunk, flat[a:b].tobytes(), _tally(owners[a:b]), marks[at[k]:at[k + 1]].tobytes(), 0
            yield int.from_bytes(chunk[:4]) % shards, chunk, names, sizes.astype("<i8").tobytes() + known.astype("<i8").tobytes(), None, sent

        for (text,) in rows:
            grams = gram_set(text, n)
            sig = signature(grams)
            if sig is None or sig in held:
                continue
            held[sig] = grams
            size += len(grams)
            if size > COUNTED or len(held) >= 1 << 16:
                yield from flush()
                held, size = {}, 0
        if held:
            yield from flush()

    def find(rows: Iterator[tuple]) -> Iterable[tuple]:
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            asked, marks = [], []
            for _, chunk, a, b, marked, sent in group:
                if marked is None:
                    yield chunk, a, b, sent
                else:
                    asked.append((chunk, len(a) // 4, a, b))
                    marks.append(marked)
            if not asked:
                continue
            # A mark counts twice: several sets have its n-gram.
            marked = np.frombuffer(b"".join(marks), "<u4")
            again = _repeated(np.concatenate([np.frombuffer(b"".join(a for _, _, a, _ in asked), "<u4"), marked, marked]))
            start = 0
            for chunk, size, _, b in asked:
                yield chunk, None, _tally(np.repeat(*_read_tally(b))[again[start:start + size]]), 0
                start += size

    def pick(rows: Iterator[tuple]) -> Iterable[tuple]:
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            found = names = None
            left = 0
            for _, a, b, sent in group:
                if a is not None:
                    names, (sizes, found), left = a, np.frombuffer(b, "<i8").reshape(2, -1).copy(), left + sent
                else:
                    numbers, counts = _read_tally(b)
                    found[numbers] += counts
                    left -= 1
            # All pass where the buckets' answers are not those to this name's rows.
            passed = np.arange(len(sizes)) if left else np.flatnonzero(100 * found >= percent * sizes)
            yield from ((names[16 * k:16 * k + 16],) for k in passed.tolist())

    posted = map_rows(docs.select("text"), post, "bucket int, chunk binary, a binary, b binary, marks binary, sent int", 16)
    dealt = posted.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")
    answers = map_rows(dealt, find, "chunk binary, names binary, tally binary, sent int", 64)
    of_chunk = answers.repartition(tasks, "chunk").sortWithinPartitions("chunk", F.col("names").isNull())
    return map_rows(of_chunk, pick, "sig binary").distinct()


class Forest:
    """Union-find over the numbers below n."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


class Node:
    """A stretch of one path, the sets that end at it and those below it."""

    __slots__ = ("grams", "depth", "last", "low", "high", "least", "most", "children", "one")

    def __init__(self, grams: np.ndarray, depth: int, low: int):
        self.grams, self.depth, self.low = grams, depth, low  # depth: n-grams from the root to its end
        self.children: list[Node] = []
        self.one = False  # whether all sets below are in one component


def trie(sets: list[np.ndarray]) -> Node:
    """The path-compressed trie of sets, which are sorted as sequences. Sets low .. high - 1
    lie below a node; those of its own depth end at it and come first."""
    root = Node(sets[0][:0], 0, 0)
    path = [root]
    for k, s in enumerate(sets):
        shared = 0
        if k:
            m = min(len(s), len(sets[k - 1]))
            differ = np.flatnonzero(s[:m] != sets[k - 1][:m])
            shared = int(differ[0]) if len(differ) else m
        below = None
        while path[-1].depth > shared:
            below = path.pop()
            below.high = k
        if path[-1].depth < shared:
            # The stretch below is split where the new set leaves it.
            start = path[-1].depth
            middle = Node(below.grams[:shared - start], shared, below.low)
            below.grams = below.grams[shared - start:]
            middle.children.append(below)
            path[-1].children[-1] = middle
            path.append(middle)
        if len(s) > shared:
            leaf = Node(s[shared:], len(s), k)
            path[-1].children.append(leaf)
            path.append(leaf)
    for node in path:
        node.high = len(sets)

    sizes = np.array([len(s) for s in sets])
    todo = [root]
    while todo:
        node = todo.pop()
        below = sizes[node.low:node.high]
        node.least, node.most = int(below.min()), int(below.max())
        todo += node.children
    return root


def links(sets: list[np.ndarray], forest: Forest, probes: Iterable[int], percent: int = PERCENT,
          back: bool = False) -> list[tuple[int, int]]:
    """Pairs that join the components of similar sets; with back, probes also meet the sets
    before them. The sets are sorted sequences of numbers in the global order."""
    if len(sets) < 2:
        return []
    root, found = trie(sets), []
    inside = np.zeros(int(max(int(s[-1]) for s in sets)) + 1, bool)
    for x in probes:
        own = sets[x]
        size = len(own)
        inside[own] = True
        visited, todo = [], [(root, 0)]
        while todo:
            node, overlap = todo.pop()
            if not back and node.high <= x + 1:
                continue
            if node.one and forest.find(node.low) == forest.find(x):
                continue
            # Bounds before the stretch is read: the longest and the shortest set below.
            before = node.depth - len(node.grams)
            if 100 * (overlap + min(node.most - before, size - overlap)) < percent * max(size, node.least):
                continue
            if len(node.grams):
                overlap += int(np.count_nonzero(inside[node.grams]))
            left = size - overlap
            if len(node.grams) and node.children:
                left = min(left, size - int(np.searchsorted(own, node.grams[-1], "right")))
            # An overlap o suffices for lengths a and b if (100 + p) o >= p (a + b).
            longest = (100 + percent) * (overlap + node.most - node.depth) >= percent * (size + node.most)
            shortest = (100 + percent) * (overlap + left) >= percent * (size + node.least)
            if not (longest and shortest):
                continue
            visited.append(node)
            end = node.children[0].low if node.children else node.high
            if (100 + percent) * overlap >= percent * (size + node.depth):
                for y in range(node.low, end):
                    if y != x and forest.join(x, y):
                        found.append((x, y))
            todo += [(child, overlap) for child in node.children]
        inside[own] = False
        for node in reversed(visited):
            if not node.one:
                top = forest.find(node.low)
                end = node.children[0].low if node.children else node.high
                node.one = (all(forest.find(y) == top for y in range(node.low, end))
                            and all(c.one and forest.find(c.low) == top for c in node.children))
    return found


def numbered(grams: list[np.ndarray]) -> tuple[list[int], list[np.ndarray]]:
    """Sets as sequences in the order of the trie, sorted; and which set each one is."""
    flat, number, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    rank = np.empty(len(flat), np.uint32)
    rank[np.lexsort((flat, -count))] = np.arange(len(flat), dtype=np.uint32)
    coded = rank[number]
    ends = np.cumsum([len(g) for g in grams]).tolist()
    sequences = [np.sort(coded[a:b]) for a, b in zip([0, *ends], ends)]
    order = sorted(range(len(grams)), key=lambda k: sequences[k].astype(">u4").tobytes())
    return order, [sequences[k] for k in order]


def block_links(texts: list[str], labels: list, probe: list[bool], n: int, percent: int,
                back: bool) -> list[tuple[int, int]]:
    """Pairs of texts that join components; equal labels are joined from the start."""
    return joining_pairs([gram_set(t, n) for t in texts], labels, probe, percent, back)


def joining_pairs(grams: list[np.ndarray], labels: list, probe: list[bool], percent: int, back: bool) -> list[tuple[int, int]]:
    """The same for sets."""
    order, sets = numbered(grams)
    forest, first = Forest(len(sets)), {}
    for k, i in enumerate(order):
        if labels[i] is not None:
            forest.join(k, first.setdefault(labels[i], k))
    probes = [k for k, i in enumerate(order) if probe[i]]
    return [(order[a], order[b]) for a, b in links(sets, forest, probes, percent, back)]


def _within(blocks: DataFrame, n: int, percent: int, back: bool) -> DataFrame:
    """Links of each block of (family, block, part, sig, label, probe, mapped, text), and with no
    ends (family, block, bits): the bit map of each block that is to be mapped.

    A row without a text only says the label of a set of its block."""
    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for (family, block, _), group in itertools.groupby(rows, key=lambda r: r[:3]):
            rows_of, named = [], {}
            for r in group:
                if r[7] is None:
                    named[r[3]] = r[4]
                else:
                    rows_of.append(r)
            sigs = [r[3] for r in rows_of]
            grams = [gram_set(r[7], n) for r in rows_of]
            for a, b in joining_pairs(grams, [r[4] or named.get(r[3], r[3]) for r in rows_of], [r[5] for r in rows_of], percent, back):
                yield sigs[a], sigs[b], None, None, None
            if rows_of[0][6]:
                yield None, None, family, block, bit_map(grams)

    keys = ("family", "block", "part")
    shards = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (blocks.repartition(shards, *keys).sortWithinPartitions(*keys, "sig")
               .select(*keys, "sig", "label", "probe", "mapped", "text"))
    return map_rows(ordered, run, "src binary, dst binary, family long, block int, bits binary", 256)


def places_of(grams: np.ndarray) -> np.ndarray:
    """32 bits of each n-gram, whose highest ones are its place in a bit map."""
    return (mix(grams) >> np.uint64(32)).astype(np.uint32)


def bit_map(grams: list[np.ndarray]) -> bytes:
    """Bits of the n-grams of some sets; their number is a power of two, 2 ** 32 at most."""
    all_grams = np.unique(np.concatenate(grams))
    size = min(32, max(3, (MAP_BITS * len(all_grams) - 1).bit_length()))
    bits = np.zeros(1 << size, bool)
    bits[places_of(all_grams) >> np.uint32(32 - size)] = True
    return np.packbits(bits).tobytes()


def set_links(docs: DataFrame, n: int = N, percent: int = PERCENT, block_grams: int = BLOCK_GRAMS) -> tuple[DataFrame, DataFrame]:
    """The signed documents, and links (src, dst) that connect similar sets."""
    signed = cut(signatures(docs, n))
    sets = signed.where("sig is not null").groupBy("sig").agg(
        F.max("n_shingles").alias("n"), F.min(F.struct("digest", "doc_id")).alias("one"))
    n_grams = signed.agg(F.sum("n_shingles")).first()[0] or 0
    worded = docs.where("text is not null").select("doc_id", "text")
    sets = cut(sets.join(shared_sets(worded, n_grams, n, percent), "sig"))
    n_grams = sets.agg(F.sum("n")).first()[0] or 0
    # By a row's id, which may be that of other rows as well: these only make families larger.
    worded, _ = screened(worded, "doc_id", sets.select("one.doc_id"))
    families = components(chains(worded, n_grams, n, percent)).select("node", F.col("label").alias("family"))
    node = F.conv(F.hex(F.substring("sig", 1, 8)), 16, -10).cast("long")
    sized = cut(families.join(sets.withColumn("node", node), "node").drop("node"))
    blocks = sized.groupBy("family").agg(F.ceil(F.sum("n") / block_grams).cast("int").alias("blocks"))
    # Small tables are written first, so the planner knows which are small enough to broadcast.
    chosen = cut(sized.join(blocks, "family").select(
        "sig", "n", "family", "blocks", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int").alias("block"),
        F.col("one.doc_id").alias("one_id"), F.col("one.digest").alias("one")))
    # One text for each set of a family, by a row's id and digest. Texts outside families stay where they are.
    near, _ = screened(worded, "doc_id", chosen.select(F.col("one_id").alias("doc_id")))
    texts = near.select("doc_id", text_digest(), "text")
    members = ["sig", "n", "family", "blocks", "block"]
    held = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("digest") == F.col("one"))).select(*members, "text")
    if not signed.where("sig is not null").groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        held = held.groupBy(*members).agg(F.first("text").alias("text"))
    # Tables that only the steps below read; they go when the links are written.
    folder = f"{checkpoint_folder(docs.sparkSession).rstrip('/')}/near-{uuid.uuid4()}"
    joined = _held_links(cut(held, folder), folder, n, percent, block_grams)
    remove(docs.sparkSession, folder)
    return signed, joined


def _held_links(held: DataFrame, folder: str, n: int, percent: int, block_grams: int) -> DataFrame:
    """Written links (src, dst) that connect the similar sets of (sig, n, family, blocks, block, text)."""
    unlabelled, mapped = F.lit(None).cast("binary").alias("label"), (F.col("blocks") > 1).alias("mapped")
    plain = held.select("family", "block", F.lit(0).alias("part"), "sig", unlabelled, F.lit(True).alias("probe"), mapped, "text")
    found = cut(_within(plain, n, percent, back=False), folder)
    joined = found.where("src is not null").select("src", "dst")
    large = held.where("blocks > 1")
    if large.isEmpty():
        return cut(joined)
    # One member of the largest component of each block, all of a family in one block of
    # representatives (a row for each block). Labels are joined to sets without their texts.
    sets = large.drop("text")
    labelled = _labelled(sets, components(joined))
    tops = labelled.groupBy("family", "block", "label").agg(F.count("*").alias("size"), F.min("sig").alias("one"))
    top = tops.groupBy("family", "block").agg(F.max(F.struct("size", "one")).alias("top"))
    chosen = cut(top.select("family", F.col("top.one").alias("sig")), folder)
    heads = large.join(chosen, ["family", "sig"], "left_semi").select(
        "family", F.lit(0).alias("block"), F.lit(0).alias("part"), "sig", unlabelled,
        F.lit(True).alias("probe"), F.lit(False).alias("mapped"), "text")
    joined = cut(joined.unionByName(_within(heads, n, percent, back=False).select("src", "dst")), folder)
    labelled = cut(_labelled(sets, components(joined)), folder)
    # What is outside a family's largest component meets the blocks that may hold similar sets.
    main = cut(labelled.groupBy("family", "label").count().groupBy("family")
               .agg(F.max(F.struct("count", "label")).alias("main")).select("family", F.col("main.label").alias("main")), folder)
    rest = labelled.join(main, "family").where("label <> main").drop("main")
    maps = found.where("src is null").select("family", "block", "bits")
    guests = cut(_near_blocks(maps, rest, large, folder, n, percent, block_grams), folder)
    visited = guests.select("family", F.explode("visits").alias("block"), "sig", "n", "label", "text")
    parts = cut(visited.groupBy("family", "block").agg(F.ceil(F.sum("n") / block_grams).cast("int").alias("parts")), folder)
    visits = visited.join(parts, ["family", "block"]).select(
        "family", "block", F.pmod(F.xxhash64("sig", F.lit(1)), F.col("parts")).cast("int").alias("part"), "sig", "label",
        F.lit(True).alias("probe"), F.lit(False).alias("mapped"), "text")
    # The labels of the hosts go to their blocks as rows of their own; without one a set is its own.
    named = labelled.where("label <> sig").select("family", "block", "sig", "label", F.lit(None).cast("string").alias("text"))
    hosts = large.select("family", "block", "sig", unlabelled, "text").unionByName(named).join(parts, ["family", "block"]).select(
        "family", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "sig",
        F.when(F.col("text").isNull(), F.col("label")).alias("label"), F.lit(False).alias("probe"), F.lit(False).alias("mapped"), "text")
    return cut(joined.unionByName(_within(visits.unionByName(hosts), n, percent, back=True).select("src", "dst")))


def _near_blocks(drawn: DataFrame, rest: DataFrame, large: DataFrame, folder: str, n: int, percent: int,
                 block_grams: int) -> DataFrame:
    """(family, sig, n, label, text, visits): the sets of rest that other blocks hold enough n-grams of
    for a similar one, with these blocks; a set of very many has several rows."""
    def hold(rows: Iterator[tuple]) -> Iterable[tuple]:
        for (family, _), group in itertools.groupby(rows, key=lambda r: r[:2]):
            asked, kept, held, sizes, own, pieces = {}, [], [], [], [], []
            places, size, waiting = [], 0, 0

            def close() -> None:
                lengths = np.array([len(g) for g in held])
                pieces.append((np.concatenate(held), np.cumsum(lengths) - lengths))
                held.clear()

            def send() -> Iterator[tuple]:
                sets, blocks = (np.concatenate(x) for x in zip(*places))
                order = np.argsort(sets, kind="stable")
                sets, blocks = sets[order], blocks[order]
                starts = np.flatnonzero(np.diff(sets, prepend=-1))
                for k, at in zip(sets[starts].tolist(), np.split(blocks, starts[1:])):
                    sig, text = kept[k]
                    yield family, sig, int(n_grams[k]), asked[sig][1], zlib.decompress(text).decode(), at.tolist()

            for *_, kind, block, sig, label, text, bits in group:
                if kind == 0:
                    asked[sig] = block, label
                    continue
                if kind == 1:
                    if sig in asked:
                        # Texts are held packed, until some are sent.
                        kept.append((sig, zlib.compress(text.encode(), 1)))
                        held.append(places_of(gram_set(text, n)))
                        sizes.append(len(held[-1]))
                        own.append(asked[sig][0])
                        waiting += sizes[-1]
                        if waiting > PIECE_GRAMS:
                            close()
                            waiting = 0
                    continue
                if not kept:
                    continue
                if held:
                    close()
                n_grams, from_block = np.array(sizes), np.array(own)
                seen = np.unpackbits(np.frombuffer(bits, np.uint8))
                shift = np.uint32(32 - (len(seen) - 1).bit_length())
                hits = np.concatenate([np.add.reduceat(seen[flat >> shift], starts, dtype=np.int64) for flat, starts in pieces])
                near = np.flatnonzero((100 * hits >= percent * n_grams) & (from_block != block))
                if len(near):
                    places.append((near, np.full(len(near), block)))
                    size += len(near)
                if size > HELD_PLACES:
                    yield from send()
                    places, size = [], 0
            if places:
                yield from send()

    tasks = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = cut(rest.groupBy("family").agg(F.ceil(F.sum("n") / (CHUNK_BLOCKS * block_grams)).cast("int").alias("chunks")), folder)
    no_label, no_text, no_bits = (F.lit(None).cast(t).alias(c) for t, c in (("binary", "label"), ("string", "text"), ("binary", "bits")))
    chunk = F.pmod(F.xxhash64("sig", F.lit(2)), F.col("chunks")).cast("int").alias("chunk")
    # Texts go to the chunk of their set, and what is asked of the set goes there before them.
    asked = rest.join(chunks, "family").select("family", chunk, F.lit(0).alias("kind"), "block", "sig", "label", no_text, no_bits)
    texts = large.join(chunks, "family").select("family", chunk, F.lit(1).alias("kind"), "block", "sig", no_label, "text", no_bits)
    maps = drawn.join(chunks, "family").select(
        "family", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(2).alias("kind"),
        "block", F.lit(None).cast("binary").alias("sig"), no_label, no_text, "bits")
    # The sets of a chunk are held, the maps pass by one after the other.
    dealt = (asked.unionByName(texts).unionByName(maps).repartition(tasks, "family", "chunk")
             .sortWithinPartitions("family", "chunk", "kind"))
    return map_rows(dealt, hold, "family long, sig binary, n long, label binary, text string, visits array<int>", 256)


def _labelled(large: DataFrame, labels: DataFrame) -> DataFrame:
    named = cut(labels.select(F.col("node").alias("sig"), "label"))
    return large.join(named, "sig", "left").withColumn("label", F.coalesce("label", "sig"))


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """n_shingles and component_id, the smallest doc_id reachable by links, of each document."""
    signed, joined = set_links(docs, n, percent, block_grams)
    labels = components(joined).select(F.col("node").alias("sig"), "label")
    own = signed.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    named = own.join(labels, "sig", "left").select("sig", "least", F.coalesce("label", "sig").alias("label"))
    first = named.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = named.join(first, "label").select("sig", "component_id")
    return signed.join(ids, "sig", "left").select(
        "doc_id", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of each component, all columns kept: that of the smallest doc_id (null last),
    then of the smallest signature and digest, then any one of what are repeated rows."""
    signed, joined = set_links(docs, n, percent)
    worded = signed.where("sig is not null")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sig", "digest")
    labels = components(joined).select(F.col("node").alias("sig"), "label")
    named = (worded.groupBy("sig").agg(F.min(order).alias("least")).join(labels, "sig", "left")
             .select("sig", "least", F.coalesce("label", "sig").alias("label")))
    first = named.select("sig", "label").join(named.groupBy("label").agg(F.min("least").alias("first")), "label")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    gone = worded.join(first, "sig").where(~stays).select("doc_id", "digest").distinct()
    again = worded.groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest")
    # Rows that go, or that are there several times; all others stay where they are.
    keys = cut(gone.withColumn("goes", F.lit(True)).unionByName(again.withColumn("goes", F.lit(False)))
               .groupBy("doc_id", "digest").agg(F.max("goes").alias("goes")))
    doubtful, clear = screened(docs, "doc_id", keys)
    rows = doubtful.withColumn("__digest", text_digest())

    def is_one_of(few: DataFrame) -> Column:
        return rows["doc_id"].eqNullSafe(few["doc_id"]) & rows["__digest"].eqNullSafe(few["digest"])

    left = rows.join(keys, is_one_of(keys), "left_anti")
    twice = keys.where("not goes")
    once = rows.join(twice, is_one_of(twice), "left_semi").dropDuplicates(["doc_id", "__digest"])
    return clear.unionByName(left.unionByName(once).select(*docs.columns))
