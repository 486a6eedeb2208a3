"""Code length of texts under prediction by partial matching, beside an add-one word model.

The byte model is a trie of contexts of up to five bytes, learnt from the training rows: every task counts its own byte
sequences, and the counts are added up over all rows; every context seen is kept, so the trie grows with the rows. A byte
is predicted from the longest context in the trie. If it wasn't seen there, the model escapes to the
context one byte shorter (every symbol seen gives up half an occurrence to the escape, method D), where symbols of the longer context
are excluded; below the empty context all symbols left are equally likely. Since the counts
of all orders come from the same rows, exclusions nest, and each node's share can be worked out beforehand:
the contexts seen most often become an automaton of log probabilities and transitions, of bounded size, which is sent to
the tasks. It settles what follows a context of full length that it holds. All other places are counted per text, packed
by the three nearest symbols of their contexts, and meet the counts of all contexts there.

Word counts have no such bound. Frequent words are looked up in a table of bounded size; the others go through a join.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tussis.llm.common import if_small, whole_text, written

ORDER = 5
#: Most contexts in the automaton, and most words in the broadcast table.
NODES = 1 << 16
FREQUENT_WORDS = 1 << 17
#: What every symbol seen in a context gives up for the escape, in occurrences (method D).
DISCOUNT = 0.5
#: Longer words are never in the table.
LONG_WORD = 64
#: Contexts and words are taken by classes of frequency, 16 to a doubling.
CLASSES = 16

#: The end of a text, also what stands before its start.
END = 256
SYMBOLS = 257
SYMBOL_BITS = 9
SYMBOL_MASK = (1 << SYMBOL_BITS) - 1
ORDER_BITS = 3
#: Symbols counted at a time, entries a task holds, symbols a lane scores.
SLICE = 1 << 20
HELD = 1 << 21
LANE = 256
#: Texts a worker scores at a time: their number has as many bits as a key leaves free.
TEXT_BITS = 9
TEXTS = 1 << TEXT_BITS
#: Bytes of the texts a worker scores at a time; walking them takes some 60 times as much memory.
BATCH_BYTES = 1 << 22
#: Symbols of a context that name its bucket; counts below that order are sent whole (at most 257 to the third power).
NEAR = 3
#: Bytes of all texts to a bucket, and the least number of buckets. A text has a gain a bucket it has places in, so with few
#: buckets their number would grow with the square of the input until every place has its own.
#: A bucket of one name can't be cut further: beyond so many places it is dealt into slices.
BUCKET_BYTES = 1 << 22
LEAST_BUCKETS = 1 << 10
SLICE_PLACES = 1 << 22
#: Places or counts that a task gathers before it packs them by bucket.
GATHERED = 1 << 19


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each with its start and end marks, and the position of each text's first byte."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + ORDER + 1) - (lengths + 1)
    out = np.full(int(lengths.sum()) + (ORDER + 1) * len(texts), END, np.uint16)
    data = np.frombuffer(b"".join(texts), np.uint8)
    inside = np.arange(len(data)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out[inside] = data
    return out, starts


def gram_keys(texts: list[bytes]) -> np.ndarray:
    """A key for every predicted symbol: the symbol in the low bits, above it its context, nearest symbol first."""
    symbols, starts = stream(texts)
    keys = np.zeros(len(symbols), np.int64)
    for back in range(ORDER + 1):
        keys[ORDER:] |= symbols[ORDER - back : len(symbols) - back].astype(np.int64) << (SYMBOL_BITS * back)
    predicted = np.ones(len(symbols), bool)
    predicted[(starts[:, None] - 1 - np.arange(ORDER)).ravel()] = False
    return keys[predicted]


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(count, first)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def take() -> None:
        nonlocal held, size
        if held:
            k, n = np.unique(gram_keys(held), return_counts=True)
            keys.append(k)
            counts.append(n)
        held, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        if keys:
            k, n = added(keys, counts)
            for i in range(0, len(k), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 18)]), pa.array(n[i : i + (1 << 18)])], ["gram", "n"])
        keys.clear()
        counts.clear()

    for batch in batches:
        for text in batch.column(0):
            held.append(text.as_buffer().to_pybytes().lower())
            size += len(held[-1])
            if size >= SLICE:
                take()
                if sum(map(len, keys)) >= HELD:
                    k, n = added(keys, counts)
                    keys[:], counts[:] = [k], [n]
                    if len(k) >= HELD // 2:
                        yield from out()
    take()
    yield from out()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for i in range(0, len(words), 1 << 16):
            part = words[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], ["word", "n"])
        counts.clear()

    for batch in batches:
        for text in batch.column(0):
            counts.update(text.as_buffer().to_pybytes().lower().split())  # ASCII only, both
            if len(counts) >= 250_000:
                yield from out()
    yield from out()


def most_frequent(table: DataFrame, n: Column, most: int) -> DataFrame:
    """The rows of the highest classes of frequency that are ``most`` together at the utmost. A class is whole or left out."""
    level = F.floor(F.log2(n.cast("double")) * CLASSES).cast("int")
    sizes = sorted(table.groupBy(level.alias("c")).count().collect(), reverse=True)  # 16 to a doubling: some hundred
    least, total = None, 0
    for c, size in sizes:
        total += size
        if total > most:
            break
        least = c
    return table.filter(F.lit(False) if least is None else level >= least)


class Automaton:
    """The trie as two tables over (context, symbol): log10 probability of the symbol, and the next context.

    ``ids`` are the contexts (bits above order), ``entry_*`` the counts of the symbols seen in them. Columns are the
    symbols seen in training, and one for all others.
    """

    def __init__(self, ids: np.ndarray, entry_ids: np.ndarray, entry_symbols: np.ndarray, entry_counts: np.ndarray):
        order = np.lexsort((ids, ids & 7))
        ids = ids[order]
        orders, bits = ids & 7, ids >> ORDER_BITS
        if not len(ids):  # nothing to learn from: every symbol is as likely
            ids, orders, bits = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        sorted_ids = np.argsort(ids)

        def place(wanted: np.ndarray) -> np.ndarray:
            return sorted_ids[np.searchsorted(ids, wanted, sorter=sorted_ids)]

        seen = np.unique(entry_symbols)
        self.width = len(seen) + 1
        self.column = np.full(SYMBOLS, len(seen), np.int64)
        self.column[seen] = np.arange(len(seen))
        n = len(ids)
        counts = np.zeros((n, self.width), np.float32)
        if len(entry_ids):
            counts[place(entry_ids), self.column[entry_symbols]] = entry_counts
        has = counts > 0
        total, distinct = counts.sum(axis=1, dtype=float), has.sum(axis=1)
        short = np.maximum(orders - 1, 0)
        parent = place((bits & ((1 << (SYMBOL_BITS * short)) - 1)) << ORDER_BITS | short)
        left = SYMBOLS - int(distinct[0])  # symbols below the empty context

        def log(x):
            return np.log10(np.where(x > 0, x, 1))

        def shares(node: np.ndarray, mass: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """log10 of the symbols' shares and of the escape at contexts with ``mass`` occurrences of ``kinds`` symbols."""
            last = (node == 0) & (left == 0)  # nothing to escape to
            whole = log(np.where(last, mass - DISCOUNT * kinds, mass))
            return log(counts[node].astype(float) - DISCOUNT) - whole[:, None], np.where(kinds > 0, log(DISCOUNT * kinds) - whole, 0)[:, None]

        # ``down``: of a symbol after an escape from the context, whose own symbols are excluded from there on.
        down, self.next = np.zeros((n, self.width)), np.zeros((n, self.width), np.int32)
        down[0] = -log(np.array(left))
        for k in range(ORDER + 1):
            rows = np.flatnonzero(orders == k)
            for i in range(0, len(rows) if k else 0, 4096):
                r = rows[i : i + 4096]
                p = parent[r]
                share, escape = shares(p, total[p] - (counts[p] * has[r]).sum(axis=1, dtype=float), distinct[p] - distinct[r])
                down[r] = np.where(has[p], share, escape + down[p])
                self.next[r] = self.next[p]
            longer = np.flatnonzero(orders == k + 1)
            if len(longer):
                before = place((bits[longer] >> SYMBOL_BITS) << ORDER_BITS | k)
                self.next[before, self.column[bits[longer] & SYMBOL_MASK]] = longer
        for i in range(0, n, 4096):
            r = np.arange(i, min(n, i + 4096))
            share, escape = shares(r, total[r], distinct[r])
            down[r] = np.where(has[r], share, escape + down[r])
        self.score, self.next, self.short = down.ravel(), self.next.ravel(), orders < ORDER

    def leave_short(self) -> None:
        """From now on, contexts below full length score nothing: longer ones may be missing here."""
        self.score.reshape(-1, self.width)[self.short] = 0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text, its end included."""
        return self.walk(texts)[0]

    def walk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of texts, and the distinct places after contexts below full length with their counts, as ``place_keys``
        has them. Texts are scored in lanes side by side; a lane inside a text
        first reads the symbols before it, which settle its context.
        """
        if not texts:
            return np.zeros(0), np.zeros((2, 0), np.int64)
        symbols, starts = stream(texts)
        columns = self.column[symbols]
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        lanes = -(-lengths // LANE)
        text = np.repeat(np.arange(len(texts)), lanes)
        part = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = starts[text] + part * LANE
        size = np.minimum(LANE, lengths[text] - part * LANE)
        order = np.argsort(-size, kind="stable")
        text, start, size = text[order], start[order], size[order]
        state, total = np.zeros(len(text), np.int64), np.zeros(len(text))
        for back in range(ORDER, 0, -1):
            state = self.next[state * self.width + columns[start - back]].astype(np.int64)
        active = np.searchsorted(-size, -np.arange(LANE), side="left")  # lanes longer than t
        left = np.zeros(len(symbols), bool)
        for t in range(int(size.max())):
            m = active[t]
            at = state[:m] * self.width + columns[start[:m] + t]
            total[:m] += self.score[at]
            left[start[:m] + t] = self.short[state[:m]]
            state[:m] = self.next[at]
        return np.bincount(text, weights=total, minlength=len(texts)), place_keys(symbols, starts, np.flatnonzero(left))


def place_keys(symbols: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Distinct keys as ``gram_keys`` has them, with the text's number below, and how often each occurs."""
    keys = np.searchsorted(starts, places, side="right") - 1
    for back in range(ORDER + 1):
        keys |= symbols[places - back].astype(np.int64) << (SYMBOL_BITS * back + TEXT_BITS)
    return np.stack(np.unique(keys, return_counts=True))


def low_bits(grams: np.ndarray, symbols: int) -> np.ndarray:
    return grams & ((1 << (SYMBOL_BITS * symbols)) - 1)


def packed(grams: np.ndarray, columns: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """``columns`` in pieces, one to a bucket of ``grams``. Bytes of the same weight lie together and are compressed."""
    mixed = low_bits(grams >> SYMBOL_BITS, NEAR) * 0x9E3779B1 >> 16
    bucket = (mixed % buckets).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(bucket)]):
        part = columns[:, order[begin:end]]
        planes = np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8).T.tobytes()
        yield int(bucket[begin]), len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(piece: bytes, columns: int) -> np.ndarray:
    planes = pa.decompress(piece[8:], int.from_bytes(piece[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.int64).reshape(columns, -1)


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def gram_scores(asked: np.ndarray, grams: np.ndarray, counts: np.ndarray, low: np.ndarray, low_counts: np.ndarray) -> np.ndarray:
    """log10 probability of each asked symbol after its context, from the counts of all contexts.

    ``grams`` are at least those that share the ``NEAR`` nearest symbols of a context with one that is asked;
    ``low`` are all of order ``NEAR - 1``.
    """
    score, open_ = np.zeros(len(asked)), np.ones(len(asked), bool)
    pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(ORDER + 1):
        g, n = (low, low_counts) if k < NEAR else (grams, counts)
        pairs[k] = added([low_bits(g, k + 1)], [n]) if len(g) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    kinds_all = len(pairs[0][0])
    over_mass, over_kinds = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    for k in range(ORDER, -1, -1):
        pair, n = pairs[k]
        if not len(pair):
            continue
        context = pair >> SYMBOL_BITS
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        names, total, kinds = context[first], np.add.reduceat(n, first), np.diff(first, append=len(pair))
        at, there = found(names, low_bits(asked >> SYMBOL_BITS, k))
        mass, fresh_kinds = np.where(there, total[at] - over_mass, 1), np.where(there, kinds[at] - over_kinds, 0)
        place, seen = found(pair, low_bits(asked, k + 1))
        whole = mass - DISCOUNT * fresh_kinds * (k == 0 and kinds_all == SYMBOLS)  # nothing to escape to
        hit, miss = open_ & seen, open_ & there & ~seen & (fresh_kinds > 0)
        score[hit] += np.log10((n[place[hit]] - DISCOUNT) / whole[hit])
        score[miss] += np.log10(DISCOUNT * fresh_kinds[miss] / whole[miss])
        open_ &= ~seen
        if k:  # what the context one symbol shorter holds of the symbols seen here
            below, below_n = pairs[k - 1]
            covered = np.add.reduceat(below_n[np.searchsorted(below, low_bits(pair, k))], first)
            over_mass, over_kinds = np.where(there, covered[at], 0), np.where(there, kinds[at], 0)
    score[open_] -= np.log10(SYMBOLS - kinds_all) if kinds_all < SYMBOLS else 0
    return score


def learn_bytes(texts: DataFrame, nodes: int = NODES) -> tuple[DataFrame, tuple[np.ndarray, ...]]:
    """Counts of all symbols after all contexts as a written table, from a frame with one column of texts as bytes, and
    the contexts seen most often with their symbol counts; the sizes of these are bounded by ``nodes``.
    """
    grams = written(texts.mapInArrow(count_grams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    ids = F.array(*[
        (F.shiftleft(F.shiftright(F.col("gram"), SYMBOL_BITS).bitwiseAND(F.lit((1 << (SYMBOL_BITS * k)) - 1)), ORDER_BITS)).bitwiseOR(F.lit(k).cast("bigint"))
        for k in range(ORDER + 1)
    ])
    spread = grams.select(F.explode(ids).alias("context"), F.col("gram").bitwiseAND(F.lit(SYMBOL_MASK).cast("bigint")).alias("symbol"), "n")
    contexts = written(spread.groupBy("context").agg(F.sum("n").alias("n")), "contexts")
    kept = written(most_frequent(contexts, F.col("n"), nodes).select("context"), "trie")  # at most ``nodes`` rows
    entries = spread.join(F.broadcast(kept), "context").groupBy("context", "symbol").agg(F.sum("n").alias("n")).toArrow()
    return grams, (kept.toArrow()["context"].to_numpy(), *(entries[c].to_numpy() for c in ("context", "symbol", "n")))


def bucket_slices(places: DataFrame) -> DataFrame:
    """``cell, slices`` of the buckets with more than ``SLICE_PLACES`` places; all others are one slice."""
    loads = places.groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") > SLICE_PLACES)
    return written(loads.select("cell", F.ceil(F.col("n") / SLICE_PLACES).cast("int").alias("slices")), "slices")


def dealt_counts(grams: DataFrame, heavy: DataFrame, buckets: int) -> DataFrame:
    """``cell, slice, piece``: the counts packed by bucket, once, and once a slice for the buckets in ``heavy``.

    Buckets are named by three symbols, so the counts of one that can't be cut further have a bound whatever the input (257 to
    the third power), and their copies grow with the share of its places only.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (0, 1)]))
            size += batch.num_rows
            if size >= GATHERED:
                yield from taken(held)
                held, size = [], 0
        if held:
            yield from taken(held)

    def taken(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        columns = np.concatenate(held, axis=1)
        pieces = list(packed(columns[0], columns, buckets))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in pieces], pa.int32()), pa.array([p for _, p in pieces], pa.binary())], ["cell", "piece"])

    known = grams.select("gram", "n").mapInArrow(pack, "cell int, piece binary")
    slices = F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)
    return known.join(if_small(heavy), "cell", "left").select("cell", F.explode(slices).alias("slice"), "piece")


def left_scores(grams: DataFrame, places: DataFrame, buckets: int) -> DataFrame:
    """``row, gain``: what the places that the automaton left add to the score of their text. The places of a bucket meet
    its counts in one task, or in one for each slice of them.
    """
    context = grams.sparkSession.sparkContext
    lowest = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (SYMBOL_BITS * NEAR)) - 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    low = context.broadcast((lowest["gram"].to_numpy(), lowest["n"].to_numpy()))

    def meet(known: pa.Table, wanted: pa.Table) -> pa.Table:
        _WORKER.clear()
        if not wanted.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64())], ["row", "gain"])
        pieces = [unpacked(p, 2) for p in known["piece"].to_pylist()] or [np.zeros((2, 0), np.int64)]
        keys, counts = np.concatenate(pieces, axis=1)
        pieces = [unpacked(p, 3) for p in wanted["piece"].to_pylist()]
        row = np.repeat(wanted["row"].to_numpy(), [p.shape[1] for p in pieces])
        places, n, offset = np.concatenate(pieces, axis=1)
        row = row + offset
        asked, which = np.unique(places, return_inverse=True)
        gain = gram_scores(asked, keys, counts, *low.value)[which] * n
        rows, which = np.unique(row, return_inverse=True)
        return pa.table([pa.array(rows), pa.array(np.bincount(which, weights=gain))], ["row", "gain"])

    heavy = bucket_slices(places)
    known = dealt_counts(grams, heavy, buckets)
    slice_ = F.pmod(F.xxhash64("row"), F.coalesce("slices", F.lit(1))).cast("int")
    wanted = places.join(if_small(heavy), "cell", "left").select("cell", slice_.alias("slice"), "row", "piece")
    parts = known.groupBy("cell", "slice").cogroup(wanted.groupBy("cell", "slice")).applyInArrow(meet, "row bigint, gain double")
    return parts.groupBy("row").agg(F.sum("gain").alias("gain"))


def learn_words(texts: DataFrame, most: int = FREQUENT_WORDS) -> tuple[DataFrame, dict[bytes, int], int, int, int]:
    """Word counts as a written table, the frequent ones as a table in memory, and the numbers of words, kinds and texts."""
    words = written(texts.mapInArrow(count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_frequent(words.filter(F.octet_length("word") <= LONG_WORD), F.col("n"), most).toArrow()
    frequent = dict(zip(top["word"].to_pylist(), top["n"].to_pylist()))
    return words, frequent, total, kinds, texts.count()


def _batches(whole: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``TEXTS`` texts and, beyond the first text, ``BATCH_BYTES`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < whole.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, min(begin + TEXTS, int(np.searchsorted(ends, before + BATCH_BYTES, side="right"))))
        yield whole.slice(begin, end - begin)
        begin = end


_WORKER: dict = {}


def _prepared(name: str, trie, table) -> tuple[Automaton, dict[bytes, float]]:
    """The automaton and the table of one run, built once per worker."""
    if _WORKER.get("name") != name:
        words = table.value
        automaton = Automaton(*trie.value)
        automaton.leave_short()
        _WORKER.update(name=name, model=(automaton, dict(zip(words, np.log10(np.array(list(words.values()), float) + 1).tolist()))))
    return _WORKER["model"]


DOC = "row bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, word binary, n bigint, cell int, piece binary"
_NAMES = [c.split()[0] for c in DOC.split(", ")]
_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]


def score_texts(docs: DataFrame, held_out: Column, nodes: int = NODES, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows whose ``held_out`` isn't true are learnt from; all rows are scored. A to Z count as lower case. ``base_score`` is
    that of single words and one end token, add-one smoothed; ``score`` is the log10 probability of the text's bytes
    and its end, from all contexts whatever ``nodes``. A null text is empty. Repeated rows count as often as they occur. Without any training row all
    byte symbols are equally likely. An empty table gives no rows; other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    (id_type,) = [t for c, t in docs.dtypes if c == "doc_id"]
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), whole_text(F.col("text")).cast("binary").alias("b"))
    training = rows.filter(~F.col("held_out")).select("b")
    words, frequent, n_words, kinds, n_texts = learn_words(training, frequent_words)
    train_tokens, kinds = n_words + n_texts, kinds + (n_texts > 0)
    spread = float(np.log10(train_tokens + kinds + 1))
    grams, trie = learn_bytes(training, nodes)
    trie, table = context.broadcast(trie), context.broadcast(frequent)
    size = rows.agg(F.sum(F.octet_length("b"))).first()[0] or 0
    buckets = min(SYMBOLS**NEAR, max(LEAST_BUCKETS, size // BUCKET_BYTES))
    name = uuid.uuid4().hex
    end_score, end_known = float(np.log10(n_texts + 1)), int(n_texts > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, log = _prepared(name, trie, table)
        left, n_left = [], 0

        def pieces() -> pa.RecordBatch:
            key, n, row = np.concatenate(left, axis=1)
            first = int(row.min()) if len(row) else 0
            cut = list(packed(key, np.stack([key, n, row - first]), buckets))
            sizes = [int.from_bytes(p[:8], "little") // 24 for _, p in cut]
            nobody = pa.nulls(len(cut), id_arrow)
            return _batch(nobody, [[first] * len(cut), None, None, None, None, None, None, sizes, [b for b, _ in cut], [p for _, p in cut]])

        for whole in batches:
            id_arrow = whole.column(0).type
            for batch in _batches(whole, 3):
                texts = [t.as_buffer().to_pybytes().lower() for t in batch.column(3)]
                scores, places = automaton.walk(texts)
                numbers = batch.column(1).to_pylist()  # follow each other inside a task
                left.append(np.stack([places[0] >> TEXT_BITS, places[1], (places[0] & (TEXTS - 1)) + numbers[0]]))
                n_left += left[-1].shape[1]
                tokens, hits, base = [], [], []
                rare_rows, rare_words, rare_n = [], [], []
                for row, text in zip(numbers, texts):
                    counts = Counter(text.split())
                    hit, value = end_known, end_score
                    for word, n in counts.items():
                        if word in log:
                            hit += n
                            value += n * log[word]
                        else:
                            rare_rows.append(row)
                            rare_words.append(word)
                            rare_n.append(n)
                    total = sum(counts.values()) + 1
                    tokens.append(total)
                    hits.append(hit)
                    base.append(value - total * spread)
                yield _batch(batch.column(0), [numbers, batch.column(2), tokens, hits, base, scores, None, None, None, None])
                nobody = pa.nulls(len(rare_rows), batch.column(0).type)
                yield _batch(nobody, [rare_rows, None, None, None, None, None, rare_words, rare_n, None, None])
                if n_left >= GATHERED:
                    yield pieces()
                    left, n_left = [], 0
        if left:
            yield pieces()

    numbered = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "held_out", "b")
    mixed = written(numbered.mapInArrow(run, f"doc_id {id_type}, {DOC}"), "scored")
    rare = mixed.filter("word is not null").select("row", "word", "n")
    counted = words.withColumnRenamed("n", "c")
    more = rare.join(counted, "word").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("gain"))
    left = left_scores(grams, mixed.filter("cell is not null").select("cell", "row", "piece", "n"), buckets)
    return mixed.filter("n_tokens is not null").join(more, "row", "left").join(left, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce(more["gain"], F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce(left["gain"], F.lit(0.0))).alias("score"))


def _batch(ids, columns: list) -> pa.RecordBatch:
    arrays = [pa.nulls(len(ids), t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _TYPES)]
    return pa.RecordBatch.from_arrays([ids, *arrays], ["doc_id", *_NAMES])


def every_seventh(doc_id: Column) -> Column:
    """Rows whose id, as text, has a CRC-32 with remainder 2 modulo 7."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2
