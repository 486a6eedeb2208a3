"""SimHash fingerprints and their links, searched in a Gray-ordered hierarchical index.

Equal fingerprints are one entry from the start, so exact copies never meet each other. The top of the index are
masked bit patterns: the 64 bits are cut into segments, and two fingerprints that differ in at most 3 bits agree on all
segments but 3. Every choice of the other segments is a mask, and a fingerprint goes to one bucket a mask, keyed by its
masked bits. Inside a bucket the fingerprints are sorted by Gray rank and grouped 16 to a node, the nodes 16 to a
higher node, and so on. A node holds the bits that all below it share. Two nodes are compared by those shared
bits alone: more than 3 differences there rule out everything below. Nodes whose members are already
in one component needn't be compared, so a dense group of near copies costs about its size, and only
a spanning forest of links leaves a bucket.

A bucket of more than ``BLOCK`` fingerprints is dealt into blocks, and each pair of blocks is a task's work of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tussis.llm.common import fresh, if_small, whole_text, written

BITS = 64
MAX_DIFFERENCES = 3
SHINGLE_WORDS = 3
HASH_SEED = 42
FAN_OUT = 16
#: Most fingerprints of one bucket in one block, and node pairs that are expanded at a time.
BLOCK = 16_384
PAIRS_AT_A_TIME = 2_048
#: Segments of the top masks, by the number of fingerprints they suit: buckets of uniform fingerprints stay near 1,000.
SEGMENTS = ((1 << 26, 4), (1 << 35, 5), (1 << 62, 6))


def fingerprint(text: bytes) -> int:
    """SimHash of a UTF-8 text: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split()  # both know ASCII only: A to Z, and the white space that parts words
    if not words:
        return 0
    k = SHINGLE_WORDS
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, HASH_SEED) for s in shingles), np.uint64, max(1, len(words) - k + 1))
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def _text_key(text):
    return F.xxhash64(whole_text(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, fp`` (the fingerprint's 64 bits as a bigint) of every row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"])

    narrow = docs.select("doc_id", _text_key(F.col("text")).alias("text_key"), whole_text(F.col("text")).cast("binary").alias("b"))
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, text_key bigint, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in the reflected Gray order."""
    r = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(shift)
    return r


class Index:
    """The hierarchy over the buckets of one task, and the components found so far.

    ``fps`` are sorted by bucket and, inside, by Gray rank; ``starts`` are the first positions of the buckets.
    """

    def __init__(self, fps: np.ndarray, starts: np.ndarray):
        self.fps, self.labels, self.parent = fps, np.arange(len(fps)), np.arange(len(fps))
        every = np.full(len(fps), ~np.uint64(0))
        # Of each level: shared-bit masks, patterns, first child and end of the children.
        self.levels = [(every, fps, None, None)]
        first, spans = np.arange(len(fps)), starts  # ``spans``: each bucket's first node of the level
        self.member_starts = [first]
        while True:
            mask, pattern, _, _ = self.levels[-1]
            n = len(mask)
            ends = np.append(spans[1:], n)
            counts = -(-(ends - spans) // FAN_OUT)
            bucket = np.repeat(np.arange(len(spans)), counts)
            begin = spans[bucket] + FAN_OUT * (np.arange(len(bucket)) - np.repeat(np.cumsum(counts) - counts, counts))
            end = np.minimum(begin + FAN_OUT, ends[bucket])
            head = np.repeat(begin, end - begin)
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ pattern[head]), begin)
            self.levels.append((shared, pattern[begin] & shared, begin, end))
            first = self.member_starts[-1][begin]
            self.member_starts.append(first)
            spans = np.cumsum(counts) - counts
            if (counts == 1).all():
                break

    def relabel(self) -> None:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                break
            self.parent = up
        self.labels = self.parent[self.labels]
        self.uniform = []
        for begin in self.member_starts:
            low, high = np.minimum.reduceat(self.labels, begin), np.maximum.reduceat(self.labels, begin)
            self.uniform.append(np.where(low == high, low, -1))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.labels[a], self.labels[b]
        open_ = x != y
        if not open_.any():
            return
        pairs = np.unique(np.stack([np.minimum(x, y)[open_], np.maximum(x, y)[open_]], axis=1), axis=0)
        for p, q in pairs.tolist():
            p, q = self.find(p), self.find(q)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
        self.relabel()

    def expand(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children, of a node with itself or of two nodes, that may hold links."""
        _, _, begin, end = self.levels[level]
        mask, pattern, _, _ = self.levels[level - 1]
        size_i, size_j = end[i] - begin[i], end[j] - begin[j]
        total = size_i * size_j
        pair = np.repeat(np.arange(len(i)), total)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
        a, b = begin[i][pair] + k // size_j[pair], begin[j][pair] + k % size_j[pair]
        keep = a < b if level == 1 else a <= b
        a, b = a[keep], b[keep]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= MAX_DIFFERENCES
        a, b = a[near], b[near]
        mark = self.uniform[level - 1]
        todo = (mark[a] < 0) | (mark[a] != mark[b])
        return a[todo], b[todo]

    def run(self) -> np.ndarray:
        """Position of each fingerprint's component root; equal roots are one component."""
        self.relabel()
        top = len(self.levels) - 1
        roots = np.flatnonzero(self.levels[top][3] - self.levels[top][2] > 0)
        stack = [(top, roots, roots)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > PAIRS_AT_A_TIME:
                stack.append((level, i[PAIRS_AT_A_TIME:], j[PAIRS_AT_A_TIME:]))
                i, j = i[:PAIRS_AT_A_TIME], j[:PAIRS_AT_A_TIME]
            mark = self.uniform[level]
            todo = (mark[i] < 0) | (mark[i] != mark[j])
            a, b = self.expand(level, i[todo], j[todo])
            if not len(a):
                continue
            if level == 1:
                self.link(a, b)
            else:
                stack.append((level - 1, a, b))
        return self.labels


def masks_for(n: int) -> list[int]:
    """Masks of which any two patterns with at most 3 differences agree on one."""
    parts = next(s for most, s in SEGMENTS if n <= most)
    edges = [BITS * i // parts for i in range(parts + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(bits, parts - MAX_DIFFERENCES)]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All buckets of a task at once; a star of links for each component of a bucket."""
    got = list(batches)
    if not sum(b.num_rows for b in got):
        return
    family, key, low, high, fp = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in got]) for k in range(5))
    fps = fp.view(np.uint64)
    order = np.lexsort((gray_rank(fps), high, low, key, family))
    fps = fps[order]
    ids = [x[order] for x in (family, key, low, high)]
    new = np.ones(len(fps), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in ids], axis=0)
    alone = new & np.append(new[1:], True)
    fps, new = fps[~alone], new[~alone]
    if not len(fps):
        return
    root = Index(fps, np.flatnonzero(new)).run()
    linked = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([pa.array(fps[linked].view(np.int64)), pa.array(fps[root[linked]].view(np.int64))], ["a", "b"])


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that connect whatever 3 or fewer differing bits connect."""
    masks = masks_for(distinct.count())
    families = F.array(*[F.struct(F.lit(i).alias("family"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint")).alias("key")) for i, m in enumerate(masks)])
    routed = distinct.select("fp", F.inline(families))
    large = written(routed.groupBy("family", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select(F.col("family").alias("f"), F.col("key").alias("k"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large-buckets")
    dealt = routed.join(if_small(large), (F.col("family") == F.col("f")) & (F.col("key") == F.col("k")), "left")
    own = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks")), F.lit(0)).cast("int")
    cells = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    cells = cells.select("family", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    return cells.repartition("family", "key", "low", "high").mapInArrow(_bucket_links, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of ``edges`` (``a, b``) reaches.

    Large-star and small-star steps in turn, each written to the shared folder, until nothing changes.
    """

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def large_star(df: DataFrame) -> DataFrame:
        both = df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
        return both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small_star(df: DataFrame) -> DataFrame:
        down = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        moved = down.join(least, F.col("a") == F.col("n")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()

    now = written(edges.filter("a <> b").distinct(), "links")
    seen = state(now)
    while seen[0]:
        now = written(small_star(large_star(now)), "links")
        last, seen = seen, state(now)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_key, fp, root, component_id``.

    ``root`` is the smallest fingerprint of the class.
    ``component_id`` is the smallest id that is reachable over links of 3 or fewer differing bits, the row's own included.
    Null and empty texts have fingerprint zero, which links like any other. Null ids get a class, but never name one
    unless all ids of the class are null. Repeated rows each get their row, an empty table gives
    none, other columns are ignored.
    """
    prints = written(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), block))
    rooted = distinct.join(if_small(roots), F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(rooted.join(classes, "root").select(F.col("fp").alias("named_fp"), "root", "component_id"), "classes")
    return prints.join(if_small(named), F.col("fp") == F.col("named_fp")).select("doc_id", "text_key", "fp", "root", "component_id")


def hex_digits(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# -- near copies by similarity ---------------------------------------------------

#: Fingerprints of samples per text, and shingles in a sample: two texts of similarity 0.8 share one of them with a chance of 0.98.
TABLES = 8
SAMPLE = 4
#: Share of the rows, and rows at least, that tell which shingles are common, and the most of these that are sent to the
#: tasks. They change no class, only how many texts meet in vain.
ORDER_SHARE = 1 / 8
ORDER_SAMPLE = 4_096
MOST_COMMON = 262_144
#: Largest table of pairs' routes that is sent whole, and pairs of list entries that are looked at a time.
ROUTE_BYTES = 32 << 20
PAIRS_OF_LISTS = 1 << 20
#: Kept off the bounds, so that rounding never drops a pair.
SLACK = 1e-6
#: Side of an entry whose own block is both blocks of its cell; 0 is the lower, 1 the higher.
BOTH = 2


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hashes of the distinct shingles of ``width`` words, ascending; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, HASH_SEED) for s in shingles), np.uint64))


def sample_prints(hashes: np.ndarray, tables: int = TABLES, sample: int = SAMPLE) -> np.ndarray:
    """A SimHash per table over ``sample`` shingles, each the least under an order of its own (min-wise samples)."""
    if not len(hashes):
        return np.zeros(tables, np.uint64)
    turns = np.random.default_rng(HASH_SEED).integers(1, 1 << 63, size=tables * sample, dtype=np.uint64) | np.uint64(1)
    chosen = np.empty(len(turns), np.uint64)
    for i, turn in enumerate(turns):
        order = hashes * turn  # modulo 2^64
        chosen[i] = hashes[np.argmin(order ^ (order >> np.uint64(29)))]
    bits = np.unpackbits(chosen.reshape(tables, sample).view(np.uint8).reshape(tables, sample, 8), axis=2, bitorder="little")
    return np.packbits(2 * bits.sum(axis=1) > sample, axis=1, bitorder="little").view(np.uint64).ravel()


def prefix_length(n: int, similarity: float) -> int:
    """Shingles at the head of a set of ``n`` of which a set similar to it must hold one among its own."""
    return max(1, min(n, n - math.ceil(similarity * n - SLACK) + 1))


def _common_shingles(docs: DataFrame, width: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles seen twice or more in a share ``rate`` of the rows, ascending, and how often; the ``MOST_COMMON`` most seen at most.

    They only put rare shingles before common ones and tell which lists to deal. Any order gives the same classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t.as_buffer().to_pybytes(), width).view(np.int64))], ["shingle"])

    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    seen = drawn.select(whole_text(F.col("text")).cast("binary").alias("b")).mapInArrow(run, "shingle bigint")
    often = written(seen.groupBy("shingle").agg(F.count(F.lit(1)).cast("long").alias("n")).filter("n > 1"), "common-shingles")
    least, total = 2, 0
    for n, many in sorted(((r.n, r.many) for r in often.groupBy("n").agg(F.count(F.lit(1)).alias("many")).collect()), reverse=True):
        total += many
        if total > MOST_COMMON:
            least = n + 1
            break
    often = often.filter(F.col("n") >= least).toArrow()
    shingles, n = often["shingle"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def _sampled(docs: DataFrame, width: int, similarity: float, tables: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, text_key, fps, size, head`` of every row: sample fingerprints, number of shingles, and the first of these in rising commonness."""

    def head(hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(1, np.uint64)  # texts without words meet in a list of their own
        weight = np.zeros(len(hashes), np.int64)
        if len(common[0]):
            at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
            weight = np.where(common[0][at] == hashes, common[1][at], 0)
        return hashes[np.argsort(weight, kind="stable")[: prefix_length(len(hashes), similarity)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_buffer().to_pybytes(), width) for t in batch.column(2)]
            fps, heads = ([f(s).view(np.int64) for s in sets] for f in (lambda s: sample_prints(s, tables), head))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, lists), pa.array([len(s) for s in sets], pa.int32()), pa.array(heads, lists)], ["doc_id", "text_key", "fps", "size", "head"])

    narrow = docs.select("doc_id", _text_key(F.col("text")).alias("text_key"), whole_text(F.col("text")).cast("binary").alias("b"))
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, text_key bigint, fps array<bigint>, size int, head array<bigint>")


def _dealt(n, block: int):
    """Blocks of a group of ``n``."""
    return F.ceil(n / block).cast("int")


def _similar(docs: DataFrame, texts: DataFrame, pairs: DataFrame, width: int, similarity: float, block: int) -> DataFrame:
    """``a, b``: links that connect what the similar ones among ``pairs`` connect, told by whole shingle sets.

    Pairs go to the cell of the smallest partner of ``a``, so that a group's sets travel about once each. The cells of more
    than ``block`` texts are dealt into pairs of blocks.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shingle_hashes(t.as_buffer().to_pybytes(), width).view(np.int64) for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(got, pa.list_(pa.int64()))], ["lead", "cell", "key", "others", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            for lead, part, key, others, shingles in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), batch.column(4)):
                if (lead, part) != cell:
                    yield _cell_links(held, similarity)
                    cell, held = (lead, part), {}
                held[key] = (others.values.to_pylist(), shingles.values.to_numpy().view(np.uint64).copy())
        yield _cell_links(held, similarity)

    pairs = written(pairs, "met-pairs")
    turned = pairs.select(F.col("a").alias("key"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("key"), F.col("a").alias("other")))
    least = turned.groupBy("key").agg(F.least(F.min("other"), F.col("key")).alias("lead"))
    led = written(pairs.join(least, F.col("a") == F.col("key")).select("lead", "a", "b"), "led-pairs")
    members = led.select("lead", F.col("a").alias("key")).unionByName(led.select("lead", F.col("b").alias("key"))).distinct()
    large = members.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select(F.col("lead").alias("l"), _dealt(F.col("n"), block).alias("blocks"))
    large = written(large, "large-cells")
    cells = led.withColumn("cell", F.lit(0).cast("bigint"))
    if not large.isEmpty():
        p, q = (F.pmod(F.xxhash64(c), F.coalesce("blocks", F.lit(1))) for c in ("a", "b"))
        cells = led.join(if_small(large), F.col("lead") == F.col("l"), "left").select("lead", "a", "b", (F.least(p, q) * (1 << 31) + F.greatest(p, q)).alias("cell"))
    ends = cells.select("lead", "cell", F.col("a").alias("key"), F.col("b").alias("other")).unionByName(cells.select("lead", "cell", F.col("b").alias("key"), F.lit(None).cast("bigint").alias("other")))
    routes = ends.groupBy("lead", "cell", "key").agg(F.collect_list("other").alias("others"))
    ids = texts.select("text_key", F.col("first_id").alias("id"))
    routes = written(routes.join(ids, F.col("key") == F.col("text_key")).drop("text_key"), "routes")
    rows = docs.select(F.col("doc_id").alias("own_id"), _text_key(F.col("text")).alias("own_key"), whole_text(F.col("text")).cast("binary").alias("b"))
    rows = rows.join(if_small(routes, ROUTE_BYTES), (F.col("own_key") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("id"))).select("lead", "cell", "key", "others", "b")
    placed = rows.mapInArrow(sets, "lead bigint, cell bigint, key bigint, others array<bigint>, shingles array<bigint>")
    return placed.repartition("lead", "cell").sortWithinPartitions("lead", "cell").mapInArrow(compare, "a bigint, b bigint")


def _cell_links(held: dict, similarity: float) -> pa.RecordBatch:
    """A spanning forest of the similar pairs of a cell; ``held`` has the partners and the shingles of each text."""
    parent = {key: key for key in held}
    links = []

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, (others, x) in held.items():
        for b in others:
            p, q = find(a), find(b)
            if p == q:
                continue
            y = held[b][1]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= similarity * (len(x) + len(y) - both):
                parent[p] = q
                links.append((a, b))
    return pa.RecordBatch.from_arrays([pa.array([link[i] for link in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def _list_pairs(cell: np.ndarray, key: np.ndarray, root: np.ndarray, size: np.ndarray, pos: np.ndarray, side: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """Pairs of keys of different roots in one cell that sizes and places allow to be similar, a part at a time.

    ``pos`` is the shingle's place in its set's order. Where it is the first that two sets share, they share no more than
    what follows it in either, and so each similar pair passes in the list of its first shared shingle.
    """
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
    kept = np.repeat(mixed, np.diff(np.append(start, len(cell))))
    if not kept.any():
        return
    cell, key, root, size, pos, side = (x[kept] for x in (cell, key, root, size, pos, side))
    cell = np.cumsum(np.append(0, cell[1:] != cell[:-1]))
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    # Pairs are counted from the entries outside a list's main root, so that a large class costs its size.
    main = root[np.lexsort((root, cell))][start + np.diff(np.append(start, len(cell))) // 2]
    order = np.lexsort((size, cell))
    key, root, size, pos, side = (x[order] for x in (key, root, size, pos, side))
    minor = root != main[cell]
    span = int(size.max()) + 2
    place = cell * span + size
    at = np.flatnonzero(minor)
    low = np.searchsorted(place, cell[at] * span + np.ceil(similarity * size[at] - SLACK).astype(np.int64))
    high = np.searchsorted(place, cell[at] * span + np.minimum(np.floor(size[at] / similarity + SLACK).astype(np.int64), span - 1), "right")
    many = np.cumsum(high - low)
    cuts = np.searchsorted(many, np.arange(0, many[-1], PAIRS_OF_LISTS), "right")
    for f, t in zip(cuts, np.append(cuts[1:], len(at))):
        n = (high - low)[f:t]
        i = np.repeat(at[f:t], n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[f:t], n)
        rest = np.minimum(size[i] - pos[i], size[j] - pos[j])
        keep = (root[i] != root[j]) & ((i < j) | ~minor[j]) & ((side[i] != side[j]) | (side[i] == BOTH))
        keep &= rest >= similarity / (1 + similarity) * (size[i] + size[j]) - SLACK
        x, y = key[i[keep]], key[j[keep]]
        if len(x):
            yield np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1), axis=0)


def _meetings(rows: DataFrame, roots: DataFrame, large: list[tuple[int, int]], similarity: float) -> DataFrame:
    """``a, b``: all pairs of texts of different roots that may be similar; none that is similar is missing.

    Two sets of similarity s share one of the first n - ceil(s n) + 1 shingles of each, in any order that is the same for
    all. ``large`` names the shingles whose lists are dealt into pairs of blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                now = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if held is None or not len(held[0]):
                continue
            new = np.append(True, (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            end = len(new) if batch is None else int(np.flatnonzero(new)[-1])  # the last list may go on
            if not end:
                continue
            cell = np.cumsum(new[:end])
            for got in _list_pairs(cell, *(x[:end] for x in held[2:]), similarity):
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], ["a", "b"])
            held = [x[end:] for x in held]

    rooted = rows.join(if_small(roots), F.col("text_key") == F.col("node"), "left")
    entries = rooted.select("text_key", "root", "size", F.posexplode("head").alias("pos", "shingle"))
    entries = entries.withColumn("cell", F.lit(0).cast("bigint")).withColumn("side", F.lit(BOTH))
    if large:
        lists = rows.sparkSession.createDataFrame(large, "s bigint, blocks int")
        dealt = entries.drop("cell", "side").join(F.broadcast(lists), F.col("shingle") == F.col("s"), "left")
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("text_key"), F.coalesce("blocks", F.lit(1)))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        side = F.when(F.col("own") == F.col("other"), BOTH).otherwise((F.col("own") > F.col("other")).cast("int"))
        entries = dealt.select("text_key", "root", "size", "pos", "shingle", (F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).alias("cell"), side.alias("side"))
    once = entries.repartition("shingle", "cell").dropDuplicates(["shingle", "cell", "text_key"])
    sorted_lists = once.select("shingle", "cell", "text_key", F.coalesce("root", "text_key").alias("root"), "size", "pos", "side").sortWithinPartitions("shingle", "cell")
    return sorted_lists.mapInArrow(run, "a bigint, b bigint").distinct()


def similar_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """``text_key, first_id, root`` of every distinct text: its class of texts of at least this shingle similarity (Jaccard).

    Texts meet first where one of their sample fingerprints is equal or linked by the index; each such group is compared
    with its member of the smallest key, which settles most of the classes. Then all texts of different classes meet that
    share one of the first shingles of their sets, which similar ones must, so no similar pair is left out. Every link is
    told by whole shingle sets; a class is all that chains of links reach. A large class costs about its size in each list;
    only texts of different classes are paired. Texts without any word are similar to each other.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    docs = docs.select("doc_id", "text")
    n = docs.count()
    rate = min(1.0, max(ORDER_SHARE, ORDER_SAMPLE / max(n, 1)))
    common = _common_shingles(docs, width, rate)
    rows = written(_sampled(docs, width, similarity, tables, common), "sampled-rows")
    texts = rows.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), *[F.max(F.get("fps", F.lit(i))).alias(f"f{i}") for i in range(tables)])
    texts = written(texts, "sampled-texts")
    long = texts.select("text_key", F.inline(F.array(*[F.struct(F.lit(i).alias("sample"), F.col(f"f{i}").alias("fp")) for i in range(tables)])))
    prints = written(long.groupBy("fp").agg(F.count("*").alias("n")), "sample-prints")
    linked = components(links(prints.select("fp")))
    rooted = long.join(if_small(linked), F.col("fp") == F.col("node"), "left").select("text_key", "sample", F.coalesce("root", "fp").alias("spot"))
    lead = rooted.groupBy("sample", "spot").agg(F.min("text_key").alias("b"), F.count("*").alias("n")).filter("n > 1").select(F.col("sample").alias("s"), F.col("spot").alias("p"), "b")
    met = rooted.join(if_small(written(lead, "leaders")), (F.col("sample") == F.col("s")) & (F.col("spot") == F.col("p"))).filter(F.col("text_key") > F.col("b"))
    first = written(_similar(docs, texts, met.select(F.col("text_key").alias("a"), "b").distinct(), width, similarity, block), "similar-texts")
    # A list's length is told from the sample; one that it misses is only a larger cell.
    guess = common[1] / rate
    large = [(int(s), int(-(-g // block))) for s, g in zip(common[0].view(np.int64), guess) if g > block]
    rest = written(_similar(docs, texts, _meetings(rows, components(first), large, similarity), width, similarity, block), "similar-texts")
    roots = components(first.unionByName(rest))
    return texts.join(if_small(roots), F.col("text_key") == F.col("node"), "left").select("text_key", "first_id", F.coalesce("root", "text_key").alias("root"))


def keep_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each class of similar texts, with all its columns: the one with the smallest id.

    Nulls: a null text is empty; a null id stays only where its class has no other. Rows of the same id and text stay
    once. Extra columns may have any names; an empty table gives no rows.
    """
    doc, key, own = fresh(docs, "__kept_doc", "__kept_key", "__text_key")
    classes = similar_texts(docs, width, similarity)
    first = F.min(F.struct(F.col("first_id").isNull(), "first_id", "text_key")).alias("s")
    kept = written(classes.groupBy("root").agg(first).select(F.col("s.first_id").alias(doc), F.col("s.text_key").alias(key)), "kept-documents")
    keyed = docs.withColumn(own, _text_key(docs["text"]))
    whole = keyed.join(kept, keyed["doc_id"].eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key)), "left_semi")
    again = whole.groupBy("doc_id", own).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if again.isEmpty():
        return whole.drop(own)
    again = written(again.select(F.col("doc_id").alias(doc), F.col(own).alias(key)), "repeated-rows")
    same = whole["doc_id"].eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key))
    return whole.join(if_small(again), same, "left_anti").unionByName(whole.join(if_small(again), same, "left_semi").dropDuplicates(["doc_id", own])).drop(own)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: the one whose id names the class.

    Where several texts of a class share that id, or a class has no id at all, the text with the smallest hash
    stays; of rows with the same id and text one stays.
    """
    doc, key, own, many = fresh(docs, "__kept_doc", "__kept_key", "__text_key", "__many")
    rows = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct("text_key", "n")).alias("s")
    kept = written(rows.groupBy("root", "doc_id").agg(first).select(F.col("doc_id").alias(doc), F.col("s.text_key").alias(key), (F.col("s.n") > 1).alias(many)), "kept-documents")
    keyed = docs.withColumn(own, _text_key(docs["text"]))

    def of(which: DataFrame) -> DataFrame:
        # Most documents stay: as many keys as rows, so this join is never a broadcast.
        return keyed.join(which, keyed["doc_id"].eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key)), "left_semi")

    whole = of(kept.filter(~F.col(many)))
    if not kept.filter(many).isEmpty():
        whole = whole.unionByName(of(kept.filter(many)).dropDuplicates(["doc_id", own]))
    return whole.drop(own)
