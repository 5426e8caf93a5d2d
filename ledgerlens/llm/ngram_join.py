"""Near-duplicate documents by Jaccard similarity of word shingles, found with token-combination prefixes.

The tokens of a document are its distinct shingles. All documents order their tokens alike: by frequency class, then
by hash. Classes come from a table of counters over all documents with a fixed number of slots, so the copy every task
holds has a fixed size; any such order gives whole results, a good one gives few candidates. Class 0 is rare.

A document's prefix is the shortest run of its tokens that a partner with enough overlap cannot miss. A rare token in
the prefix counts one and is indexed alone. Frequent tokens are dealt by hash to subclasses; in a subclass all but the
first count one and every pair of them is indexed together. With ``c`` the sum of these counts, two documents that
share no indexed token or pair differ in at least ``c`` prefix tokens, so the prefix ends once ``c`` exceeds
``n - ceil(t * n)``. The number of subclasses follows the size (zones); a document near the lower end of its zone is
also indexed by the zone below, where shorter partners are.

Equal sets are one node of the similarity graph. In posting lists of more than ``SMALL`` nodes only links to a hub that
lists of one bucket lead to are tried first; when the components of the verified links are known, a few members of a
list's largest component are tried with all others. So a large group of near copies costs a few pairs for each member.
Candidates first meet as bit maps of their sets (four bits a token or more), whose difference bounds the overlap from above;
the pairs that are left are verified on the full sets: the sets of a hub's partners are sent to the hub in groups of
bounded size. In the end all remaining pairs of nodes in one list but in different components meet as bit maps; the nodes
that such pairs lead to one another are compared all with all on their full sets, in tasks of two blocks of them, so no
link that matters for the components is left out. Neither step hands over pairs: a task gives a spanning forest of its own.

That finds the components. All links lie inside them, so the whole join (``linked_pairs``, ``link_counts``) compares
every pair of a component's distinct sets of suitable sizes, in tasks of two blocks of members with their full sets.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .base import dropped, parts, release, stored
from .hashing import WORDS, Powers, mix, shingle_sets

SLOTS = 1 << 22      # counters in the frequency table
SEGMENTS = 32        # pieces in which tasks hand over their counters
SMALL = 8            # posting lists up to this size give all their pairs at once
EDGES = 1_000_000    # links that one task contracts in memory
COARSE = 2048        # bits of the map by which members of a long posting list are compared
PROBES = 4           # members of a list's largest component that meet all others
TURNS = 2            # times that other ones do
PAIRS = 8192         # bit maps compared at once
GROUP = 256          # partners verified against one copy of a hub's set
BLOCK = 1024         # members of a long posting list that meet another block in one task
TOKENS = 1 << 20     # tokens of such a block where whole sets are compared
ZONE = 64            # sizes below it are indexed by single tokens only; zones grow by four


def describe(docs: DataFrame, words: int) -> DataFrame:
    """One row per document ``(kind 0: doc_id, n, node, blob = its bit map)`` and the tasks' counters ``(kind 1: part, blob)``.

    ``node`` is a 64-bit hash of the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, counts, seen = Powers(), np.zeros(SLOTS, np.uint16), set()
        names = ["kind", "doc_id", "n", "node", "part", "blob"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

        def rows(**columns) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            n, node, bits = [], [], []
            for _, s in shingle_sets(batch.column(1), powers, words):
                n.append(len(s))
                node.append(int(mix(s).sum().astype(np.int64)))
                bits.append(bit_map(s))
                if len(s) and (n[-1], node[-1]) not in seen:     # copies within a task count once
                    seen.add((n[-1], node[-1]))
                    slot = np.unique(s & np.uint64(SLOTS - 1))
                    counts[slot] += counts[slot] < 65535
            yield rows(kind=np.zeros(len(n), np.int32), doc_id=batch.column(0), n=n, node=node, blob=bits)
        for i, piece in enumerate(np.split(counts, SEGMENTS)):
            yield rows(kind=[1], part=[i], blob=[zlib.compress(piece.tobytes(), 1)])

    return docs.select("doc_id", "text").mapInArrow(
        run, "kind int, doc_id long, n long, node long, part int, blob binary")


def bit_map(tokens: np.ndarray) -> bytes:
    size = 64
    while size < 4 * len(tokens):
        size *= 2
    bits = np.zeros(size, bool)
    bits[(tokens >> np.uint64(24)) & np.uint64(size - 1)] = True
    return np.packbits(bits).tobytes()


def may_link(a: bytes, n: int, b: bytes, m: int, percent: int) -> bool:
    """False only if the bit maps prove that the sets of ``n`` and ``m`` tokens overlap too little: a bit that only one
    has is a token that the other lacks."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    x, y = np.bitwise_or.reduce(x.reshape(-1, size)), np.bitwise_or.reduce(y.reshape(-1, size))
    most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(~x & y).sum()))
    return 100 * most >= percent * (n + m - most)


def frequency_classes(told: DataFrame, tokens: int) -> bytes:
    """A byte per slot: 0 for rare tokens, else one more than the binary logarithm of the excess over the usual count."""
    usual = 2 * tokens / SLOTS + 16

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(blob), np.uint16)
                total[part] = total.get(part, 0) + got.astype(np.int64)
        for part, counts in total.items():
            cls = np.where(counts > usual, 1 + np.log2(np.maximum(counts, 1) / usual), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(cls.tobytes())], pa.binary())],
                                             ["part", "blob"])

    found = told.filter("kind = 1").select("part", "blob").repartition(SEGMENTS, "part").mapInArrow(add, "part int, blob binary")
    pieces = {row["part"]: zlib.decompress(row["blob"]) for row in found.collect()}     # SLOTS bytes, whatever the input
    return b"".join(pieces.get(i, bytes(SLOTS // SEGMENTS)) for i in range(SEGMENTS))


def zones(n: int, threshold: float) -> list[int]:
    """The numbers of subclasses under which a set of ``n`` tokens is indexed; 0 means single tokens only."""
    zone, low = 0, ZONE
    while n >= low:
        zone, low = zone + 1, low * 4
    start = ZONE * 4 ** (zone - 1) if zone else 0
    used = [zone] + ([zone - 1] if zone and n * threshold < start else [])
    return [ZONE // 4 * 4 ** (z - 1) if z else 0 for z in used]


def needed_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def signatures(tokens: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """What a document is indexed by: rare prefix tokens, and pairs of frequent ones of one subclass."""
    n = len(tokens)
    need = n - needed_overlap(n, percent) + 1
    cls = classes[tokens & np.uint64(SLOTS - 1)]
    rare = tokens[cls == 0]
    if len(rare) >= need:
        return rare[:need]
    often = tokens[cls > 0][np.argsort(cls[cls > 0], kind="stable")]
    out = [rare]
    for subclasses in zones(n, percent / 100):
        if not subclasses:
            out.append(often[:need - len(rare)])
            continue
        sub = (often >> np.uint64(20)) % np.uint64(subclasses)
        place = np.argsort(sub, kind="stable")
        fresh = np.ones(len(sub), bool)
        fresh[1:] = sub[place][1:] != sub[place][:-1]
        counts = np.ones(len(sub), np.int64)
        counts[place[fresh]] = 0                      # the first of its subclass counts nothing
        end = int(np.searchsorted(len(rare) + np.cumsum(counts), need)) + 1
        place = place[place < end]
        s, t = sub[place], often[place]
        for lag in range(1, end):
            same = s[lag:] == s[:-lag]
            if not same.any():
                break
            out.append(mix(t[:-lag][same] * np.uint64(3) + t[lag:][same] * np.uint64(0xE7037ED1A0B428DB)
                           + np.uint64(subclasses)))
    return np.unique(np.concatenate(out))


def postings(docs: DataFrame, classes, spread: int, percent: int, words: int) -> DataFrame:
    """``(bucket, blob)``: for one batch, the signatures of its distinct sets that fall into a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, cls, seen = Powers(), np.frombuffer(classes.value, np.uint8), set()
        for batch in batches:
            sigs, nodes, sizes = [], [], []
            for _, s in shingle_sets(batch.column(0), powers, words):
                if not len(s):
                    continue
                node = int(mix(s).sum().astype(np.int64))
                if (node, len(s)) in seen:
                    continue
                seen.add((node, len(s)))
                sigs.append(signatures(s, cls, percent))
                nodes.append(node)
                sizes.append(len(s))
            if not sigs:
                continue
            owner = np.repeat(np.arange(len(sigs), dtype=np.uint32), [len(x) for x in sigs])
            sig = np.concatenate(sigs)
            bucket = (mix(sig) >> np.uint64(33)) % np.uint64(spread)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(spread + 1))
            nodes, sizes = np.array(nodes, np.int64), np.array(sizes, np.int64)
            for b in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[b]:cuts[b + 1]]
                used, short = np.unique(owner[at], return_inverse=True)
                blob = pack(sig[at], short.astype(np.uint32), nodes[used], sizes[used])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])

    return docs.select("text").mapInArrow(run, "bucket int, blob binary")


def pack(sig: np.ndarray, owner: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> bytes:
    return b"".join([np.array([len(sig), len(nodes)], np.int64).tobytes(), sig.tobytes(), nodes.tobytes(), sizes.tobytes(),
                     owner.tobytes()])


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(blob, np.int64, 2)
    sig = np.frombuffer(blob, np.uint64, n, 16)
    nodes = np.frombuffer(blob, np.int64, m, 16 + 8 * n)
    sizes = np.frombuffer(blob, np.int64, m, 16 + 8 * (n + m))
    owner = np.frombuffer(blob, np.uint32, n, 16 + 8 * (n + 2 * m))
    return sig, nodes[owner], sizes[owner]


def fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough at all."""
    return np.minimum(a, b) * 100 >= np.maximum(a, b) * percent


def hubs(node: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Posting lists of the given lengths lie end to end; for each member the position of a node of the smallest number
    that chains of these lists lead to."""
    if not len(node):
        return np.empty(0, np.int64)
    known, at = np.unique(node, return_inverse=True)
    first = np.cumsum(length) - length
    label = np.arange(len(known))
    while True:
        least = np.repeat(np.minimum.reduceat(label[at], first), length)
        new = label.copy()
        np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    where = np.empty(len(known), np.int64)
    where[at[::-1]] = np.arange(len(node))[::-1]
    return where[label[at]]


def meet(posted: DataFrame, percent: int) -> DataFrame:
    """Posting lists met in their bucket: candidate pairs ``(kind 0: a, b)`` and members of long lists
    ``(kind 1: a = list, b = node, n)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [unpack(blob) for batch in batches for blob in batch.column(1).to_pylist()]
        if not got:
            return
        sig, node, size = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.argsort(sig, kind="stable")
        sig, node, size = sig[order], node[order], size[order]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        first = np.append(np.flatnonzero(new), len(sig))
        shared = np.repeat(np.diff(first) > 1, np.diff(first))      # most lists have one member and go
        sig, node, size = sig[shared], node[shared], size[shared]
        order = np.lexsort((node, sig))
        sig, node, size = sig[order], node[order], size[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])   # a set read by two tasks is there twice
        sig, node, size = sig[new], node[new], size[new]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        first = np.append(np.flatnonzero(new), len(sig))
        length = np.diff(first)
        pairs = []
        for m in range(2, SMALL + 1):
            at = first[:-1][length == m]
            pairs += [(at + i, at + j) for i in range(m) for j in range(i + 1, m)]
        long = np.flatnonzero(length > SMALL)
        member = np.repeat(first[long], length[long])
        member += np.arange(len(member)) - np.repeat(np.cumsum(length[long]) - length[long], length[long])
        hub = member[hubs(node[member], length[long])]
        pairs.append((hub, member))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        keep = fits(size[a], size[b], percent) & (node[a] != node[b])
        both = np.unique(np.stack([node[a[keep]], node[b[keep]]]), axis=1) if keep.any() else np.empty((2, 0), np.int64)
        names, kinds = ["kind", "a", "b", "n"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for kind, x, y, n in ((0, both.min(axis=0, initial=2 ** 63 - 1), both.max(axis=0, initial=-2 ** 63), np.zeros(both.shape[1], np.int64)),
                              (1, sig[member].view(np.int64), node[member], size[member])):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind), kinds[0]), pa.array(x, kinds[1]),
                                              pa.array(y, kinds[2]), pa.array(n, kinds[3])], names)

    return posted.repartition(parts(posted.sparkSession), "bucket").mapInArrow(run, "kind int, a long, b long, n long")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int, words: int) -> DataFrame:
    """The candidate ``pairs (a, b)`` whose sets are similar enough. ``nodes`` has size, bit map and a document of each."""
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, m, y = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [may_link(x[i], n[i], y[i], m[i], percent) for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    at_a, at_b = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    pairs = pairs.join(at_a, "a").join(at_b, "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    pairs = stored(pairs.mapInArrow(likely, "a long, b long"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = docs.join(nodes.join(ends, "node").select("doc_id").distinct(), "doc_id", "left_semi")

    sets = stored(token_sets(texts, words))
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
    hubs = salts.select(F.col("a").alias("node"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                        F.lit(0).alias("role"))
    members = pairs.join(salts, "a").select(F.col("b").alias("node"), F.col("a").alias("hub"),
                                            F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"))
    sent = sets.join(hubs.unionByName(members), "node").select("hub", "salt", "role", "node", "tokens")
    spark = pairs.sparkSession
    sent = sent.repartition(4 * parts(spark), "hub", "salt").sortWithinPartitions("hub", "salt", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            a, b = [], []
            for h, role, node, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(),
                                             batch.column(3).to_pylist(), batch.column(4), strict=True):
                tokens = np.frombuffer(tokens.as_buffer(), np.uint64)
                if role == 0:
                    hub, own = h, tokens.copy()
                elif hub == h:
                    at = np.searchsorted(own, tokens)
                    common = int((own[np.minimum(at, len(own) - 1)] == tokens).sum())
                    if 100 * common >= percent * (len(own) + len(tokens) - common):
                        a.append(h)
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])

    links = stored(sent.mapInArrow(compare, "src long, dst long").distinct())
    dropped(sets)
    return links


def folded_maps(bits: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of bit maps, at most ``COARSE``, and the maps at that size and at half of it, both repeated up to ``COARSE``."""
    length = np.array([len(x) for x in bits])
    sizes = np.minimum(8 * length, COARSE)
    own, half = (np.empty((len(bits), COARSE // 32), np.uint32) for _ in range(2))
    for n in np.unique(length):
        at, size = np.flatnonzero(length == n), min(8 * int(n), COARSE)
        x = np.frombuffer(b"".join([bits[i] for i in at]), np.uint32).reshape(len(at), -1, size // 32)
        x = np.bitwise_or.reduce(x, axis=1)
        y = x[:, :size // 64] | x[:, size // 64:]
        own[at], half[at] = np.tile(x, COARSE // size), np.tile(y, 2 * COARSE // size)
    return sizes, own.view(np.uint64), half.view(np.uint64)


def coarse_maps(bits: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """``folded_maps`` of one bit map."""
    return tuple(x[0] for x in folded_maps([bits]))


class Forest:
    """Numbers joined to trees; those it never met are trees of their own."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (above := up.get(x, x)) != x:
            up[x] = x = up.get(above, above)
        return x

    def join(self, x: int, y: int) -> bool:
        """False if both were in one tree before."""
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = self.up[min(x, y)] = min(x, y)
        return x != y

    def trees(self, numbers: list[int]) -> np.ndarray:
        return np.array([self.root(x) for x in numbers], np.int64)


def tables(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows that share their first ``keys`` columns, of batches sorted by them."""
    held, last = [], None
    for batch in batches:
        at = np.stack([batch.column(i).to_numpy() for i in range(keys)], axis=1)
        cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
            if b > a:
                if held and tuple(at[a]) != last:
                    yield pa.Table.from_batches(held)
                    held = []
                last = tuple(at[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def labelled(long_lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the posting lists with their component so far, of lists that have more than one."""
    known = stored(long_lists.join(labels, long_lists.node == labels.id, "left").select(
        "list", "node", "n", F.coalesce("component", "node").alias("component")))
    mixed = known.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("list")
    return stored(known.join(mixed, "list"))


def probe_pairs(known: DataFrame, turn: int) -> DataFrame:
    """For every posting list a few members of its largest component, each with all members outside of it.

    In a large group of near copies these few find a link for most members, so that the exact step has little left."""
    top = known.groupBy("list", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("list").agg(F.max_by("component", "c").alias("top"))
    picked = [F.min_by("node", F.xxhash64("node", F.lit(PROBES * turn + i))).alias(f"p{i}") for i in range(PROBES)]
    inside = known.join(top, "list").filter("component = top").groupBy("list", "top").agg(*picked)
    outside = known.join(inside, "list").filter("component <> top")
    return outside.select("node", F.explode(F.array(*(f"p{i}" for i in range(PROBES)))).alias("p")).distinct().select(
        F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))


def cross_forest(known: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes in one posting list but in different components so far, unless their bit maps rule a link
    out: first the folded maps, for many pairs at once, then the whole ones.

    The pairs only have to lead from node to node as all of them would: a task gives a spanning forest, fewer pairs than it
    has nodes however many there are, and it passes over pairs that other lists have joined before."""
    mixed = known.groupBy("list").agg(F.count(F.lit(1)).alias("m")).select("list", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    at = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    dealt = known.join(mixed, "list").join(nodes.select("node", "n", "bits"), ["node", "n"])
    dealt = dealt.withColumn("mine", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("list", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "n",
                         "component", "bits")

    def forest(table: pa.Table, grown: Forest) -> tuple[np.ndarray, np.ndarray]:
        i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
        mine, node, n, comp = (table.column(c).to_numpy() for c in ("mine", "node", "n", "component"))
        bits = table.column("bits").to_pylist()
        size, own, half = folded_maps(bits)
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        ids = node.tolist()
        tree, a, b = grown.trees(ids), [], []
        step = max(1, PAIRS // max(1, len(right)))
        for s in range(0, len(left), step):
            x = left[s:s + step]
            apart = (comp[x][:, None] != comp[right]) & (tree[x][:, None] != tree[right]) & fits(n[x][:, None], n[right], percent)
            if i == j:
                apart &= node[x][:, None] < node[right]
            x, y = np.nonzero(apart)
            x, y = left[s + x], right[y]
            # sets of similar size have maps of the same size or of twice that: they meet at the smaller one
            common = np.minimum(size[x], size[y])
            x_map = np.where((common == size[x])[:, None], own[x], half[x])
            y_map = np.where((common == size[y])[:, None], own[y], half[y])
            only_x = np.bitwise_count(x_map & ~y_map).sum(axis=1, dtype=np.int64) // (COARSE // common)
            only_y = np.bitwise_count(~x_map & y_map).sum(axis=1, dtype=np.int64) // (COARSE // common)
            most = np.minimum(n[x] - only_x, n[y] - only_y)
            keep = 100 * most >= percent * (n[x] + n[y] - most)
            for u, v, f in zip(x[keep].tolist(), y[keep].tolist(), (common == COARSE)[keep].tolist(), strict=True):
                if grown.root(ids[u]) != grown.root(ids[v]) and (not f or may_link(bits[u], n[u], bits[v], n[v], percent)):
                    grown.join(ids[u], ids[v])
                    a.append(u)
                    b.append(v)
            if keep.any():
                tree = grown.trees(ids)
        return node[np.array(a, np.int64)], node[np.array(b, np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = Forest()
        for table in tables(batches, 3):
            if len(grown.up) > EDGES:
                grown = Forest()
            a, b = forest(table, grown)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    keys = ["list", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def cross_links(maybe: DataFrame, docs: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int, words: int) -> DataFrame:
    """Links ``(src, dst)`` between nodes of different components so far, of all pairs that the pairs ``maybe (a, b)`` lead
    from one to the other of; of a task's links those that are needed to join the components."""
    near = components(contracted(maybe.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    so_far = near.select("id").join(labels.select("id", F.col("component").alias("known")), "id", "left")
    placed = nodes.join(near, nodes.node == near.id).drop("id").join(
        so_far.select(F.col("id").alias("node"), F.coalesce("known", "id").alias("known")), "node")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        part = np.unique(table.column("known").to_numpy(), return_inverse=True)[1].tolist()
        joined = Forest()
        links = [(x, v) for x, y in links_of_cell(key[1].as_py(), key[2].as_py(), table, percent)
                 for v in y.tolist() if joined.join(part[x], part[v])]
        return pa.table({"src": node[np.array([x for x, _ in links], np.int64)], "dst": node[np.array([v for _, v in links], np.int64)]})

    return stored(cells(docs, stored(placed.select("node", "n", "doc_id", "component", "known")), words, "known")
                  .groupBy("component", "i", "j").applyInArrow(run, "src long, dst long"))


def contracted(links: DataFrame) -> DataFrame:
    """``links (src, dst)`` with the same components but few links: tasks of ``EDGES`` links keep a spanning forest each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grown.join(a, b)
        pairs = [(grown.root(x), x) for x in list(grown.up)]
        pairs = [(r, x) for r, x in pairs if r != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["src", "dst"])

    return stored(links.repartition(max(1, -(-links.count() // EDGES))).mapInArrow(run, "src long, dst long"))


def grouped(docs: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """One row per row of ``docs (doc_id, text)`` with ``n, node``, and the distinct sets with a document, the number of
    rows that have them and their component ``(node, n, doc_id, copies, component)``."""
    spark = docs.sparkSession
    told = stored(describe(docs, words))
    rows = told.filter("kind = 0").select("doc_id", "n", "node", F.col("blob").alias("bits"))
    linked = rows.filter("doc_id is not null and n > 0")
    nodes = stored(linked.groupBy("node", "n").agg(F.min("doc_id").alias("doc_id"), F.min("bits").alias("bits"),
                                                   F.count(F.lit(1)).alias("copies")))
    tokens = rows.agg(F.sum("n")).first()[0] or 0
    classes = spark.sparkContext.broadcast(frequency_classes(told, tokens))

    found = stored(meet(postings(docs.filter("doc_id is not null"), classes, 8 * parts(spark), percent, words), percent))
    pairs = stored(found.filter("kind = 0").select("a", "b").distinct())
    links = contracted(verified(pairs, docs, nodes, percent, words))
    long_lists = found.filter("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("node"), "n")
    labels = components(links)
    for turn in range(TURNS):
        release(spark)
        more = stored(probe_pairs(labelled(long_lists, labels), turn).join(pairs, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            links = contracted(links.unionByName(verified(more, docs, nodes, percent, words)))
            labels = components(links)
            pairs = pairs.unionByName(more)
    release(spark)
    maybe = stored(cross_forest(labelled(long_lists, labels), nodes, percent))
    if not maybe.isEmpty():
        labels = components(contracted(links.unionByName(cross_links(maybe, docs, nodes, labels, percent, words))))
    placed = nodes.join(labels, nodes.node == labels.id, "left").select("node", "n", "doc_id", "copies",
                                                                        F.coalesce("component", "node").alias("component"))
    return rows, stored(placed)


def cells(docs: DataFrame, placed: DataFrame, words: int, more: str = "copies") -> DataFrame:
    """Members of the components of more than one set, with their tokens and the column ``more``, for every pair ``i <= j`` of
    the component's blocks."""
    size = placed.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all")).filter("m > 1")
    size = size.select("component", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("all") / TOKENS)).cast("int").alias("blocks"))
    members = stored(placed.join(size, "component"))
    texts = docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    mine = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    dealt = members.withColumn("mine", mine).join(stored(token_sets(texts, words)), "node")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "n",
                        more, "tokens")


def links_of_cell(i: int, j: int, table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of block ``i`` with the members of block ``j`` that it links to, as places in ``table``."""
    node, n, mine = (table.column(c).to_numpy() for c in ("node", "n", "mine"))
    once = np.zeros(len(node), bool)
    once[np.unique(node, return_index=True)[1]] = True      # rows that share an id and a text bring a set twice
    left, right = np.flatnonzero(once & (mine == i)), np.flatnonzero(once & (mine == j))
    if not len(left) or not len(right):
        return
    right = right[np.argsort(n[right], kind="stable")]
    tokens = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
    known, number = np.unique(np.concatenate([tokens[y] for y in right]), return_inverse=True)
    first = np.cumsum(n[right]) - n[right]
    ends, has = np.append(first, len(number)), np.zeros(len(known) + 1, np.int32)
    for x in left:
        low, high = np.searchsorted(n[right] * 100, n[x] * percent), np.searchsorted(n[right] * percent, n[x] * 100, "right")
        if low == high:
            continue
        at = np.searchsorted(known, tokens[x])
        at = np.where(known[np.minimum(at, len(known) - 1)] == tokens[x], at, len(known))
        has[at] = 1
        has[-1] = 0
        common = np.add.reduceat(has[number[ends[low]:ends[high]]], first[low:high] - first[low])
        has[at] = 0
        y = right[low:high]
        yield x, y[(100 * common >= percent * (n[x] + n[y] - common)) & ((node[y] > node[x]) | (i != j))]


def token_sets(texts: DataFrame, words: int) -> DataFrame:
    """``(node, tokens)`` of the texts."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), powers, words):
                yield pa.RecordBatch.from_arrays([pa.array([int(mix(s).sum().astype(np.int64))], pa.int64()),
                                                  pa.array([s.tobytes()], pa.binary())], ["node", "tokens"])

    return texts.select("text").mapInArrow(build, "node long, tokens binary")


def component_ids(rows: DataFrame, placed: DataFrame, more: dict | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row; ``more``: further columns of ``placed`` and what stands for none."""
    # label every component by its smallest document
    more = more or {}
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = stored(placed.join(smallest, "component").select("node", "n", "component_id", *more))
    out = rows.join(by_node.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & (rows.n == by_node.n)
                    & rows.doc_id.isNotNull(), "left")
    return out.select("doc_id", rows.n.alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
                      *(F.coalesce(by_node[c], v).alias(c) for c, v in more.items()))


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row: its set size and the smallest id reachable over links.

    Two rows link when ``100 * intersection >= percent * union`` of their sets of distinct ``words``-word shingles of
    lower-cased (A-Z) words. Fewer words make one shingle of the whole sequence. Rows without words or text have an
    empty set and link with nothing; rows without an id link with nothing and have a null component. Rows that share
    an id are compared each on its own. Other columns are ignored. Sets are compared as 64-bit shingle hashes.
    """
    return component_ids(*grouped(plain(docs, id_col, text_col), percent, words))


def linked_pairs(docs: DataFrame, percent: int = 75, words: int = WORDS, id_col: str = "doc_id",
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links as ``(a, b)``, pairs ``a < b`` of distinct sets, and the sets' members ``(doc_id, node)``, one per row that
    has an id and words. Rows of one set link as well; they are not listed as pairs. Rules as in ``near_duplicates``."""
    docs = plain(docs, id_col, text_col)
    rows, placed = grouped(docs, percent, words)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        got = [(np.full(len(y), node[x]), node[y]) for x, y in links_of_cell(key[1].as_py(), key[2].as_py(), table, percent)]
        x, y = (np.concatenate([*(g[k] for g in got), np.empty(0, np.int64)]) for k in (0, 1))
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    pairs = cells(docs, placed, words).groupBy("component", "i", "j").applyInArrow(run, "a long, b long")
    return pairs, rows.filter("doc_id is not null and n > 0").select("doc_id", "node")


def link_counts(docs: DataFrame, percent: int = 75, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_duplicates`` with ``n_links``: with how many other rows each row links, those of the same set among them."""
    docs = plain(docs, id_col, text_col)
    rows, placed = grouped(docs, percent, words)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        total = np.zeros(len(node), np.int64)
        for x, y in links_of_cell(key[1].as_py(), key[2].as_py(), table, percent):
            total[x] += copies[y].sum()
            total[y] += copies[x]
        some = np.flatnonzero(total)
        return pa.table({"node": node[some], "links": total[some]})

    found = cells(docs, placed, words).groupBy("component", "i", "j").applyInArrow(run, "node long, links long")
    found = found.groupBy("node").agg(F.sum("links").alias("links"))
    counted = placed.join(found, "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    return component_ids(rows, stored(counted), {"n_links": F.lit(0).cast("long")})
