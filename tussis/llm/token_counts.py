"""Token counts by a map-side two-tier lookup.

A text is cut at ASCII white space, which the tokenizer's own rules never cross, and the tokens of the pieces add up.
The first tier is a table of the lengths of frequent pieces, sent to every task; the second is a cache in each Python
worker, filled by encoding what the table lacks. Nothing is shuffled by piece: frequent pieces are found by
mergeable summaries of bounded size over the whole corpus, and any piece with more than 1/(k+1) of
all occurrences is in the table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tussis.llm.common import whole_text

#: Pieces in the broadcast table and in every summary, summaries merged by one task, cached pieces of a worker.
TABLE = 16_384
MERGED = 64
CACHE = 400_000
#: Longer pieces are encoded, but not kept.
LONG = 64

_WORKER: dict = {}


def load(path: str):
    """The tokenizer of a file, once per worker."""
    key = ("tokenizer", path)
    if key not in _WORKER:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _WORKER[key] = tokenizer
    return _WORKER[key]


class Lengths(dict):
    """Token counts of pieces: the table, then what this worker had to encode."""

    def __init__(self, tokenizer, table: dict[bytes, int], room: int = CACHE):
        super().__init__(table)
        self.tokenizer, self.table, self.room = tokenizer, table, len(table) + room

    def __missing__(self, piece: bytes) -> int:
        n = len(self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if len(piece) <= LONG:
            if len(self) >= self.room:
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n


def shrunk(counts: Counter, k: int) -> Counter:
    """The summary cut to ``k`` pieces: the next largest count is taken from all, which keeps its error bound."""
    if len(counts) <= k:
        return counts
    least = sorted(counts.values(), reverse=True)[k]
    return Counter({p: n - least for p, n in counts.items() if n > least})


SUMMARY = "pieces array<binary>, counts array<bigint>"


def _summary_batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([list(counts)], pa.list_(pa.binary())), pa.array([list(counts.values())], pa.list_(pa.int64()))], ["pieces", "counts"])


def frequent_pieces(docs: DataFrame, k: int = TABLE) -> list[bytes]:
    """The pieces of the merged summary of all texts, at most ``k``."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(p for p in text.as_buffer().to_pybytes().split() if len(p) <= LONG)
                if len(counts) > 16 * k:
                    counts = shrunk(counts, 4 * k)
        yield _summary_batch(shrunk(counts, k))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for pieces, numbers in zip(batch.column(0), batch.column(1)):
                counts.update(dict(zip(pieces.as_py(), numbers.as_py())))
                counts = shrunk(counts, 4 * k)
        yield _summary_batch(shrunk(counts, k))

    texts = docs.select(whole_text(F.col("text")).cast("binary").alias("b"))
    parts = texts.rdd.getNumPartitions()
    summaries = texts.mapInArrow(summarise, SUMMARY)
    while parts > 1:
        parts = math.ceil(parts / MERGED)
        summaries = summaries.repartition(parts).mapInArrow(merge, SUMMARY)
    row = summaries.first()  # one summary of at most k short pieces
    return [bytes(p) for p in row.pieces] if row else []


def token_counts(docs: DataFrame, tokenizer_path: str, table_size: int = TABLE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row, as the tokenizer file at ``tokenizer_path`` counts the whole text.

    No begin, end or added special tokens, no truncation, no padding; strings of special tokens inside a text count as the
    library's default does. A null text is empty and has none. Rows are counted one by one: repeated rows
    get equal rows, an empty table gives none, other columns are ignored. The file has to be
    at the same place on every machine.
    """
    tokenizer = load(tokenizer_path)
    table = {p: len(tokenizer.encode(p.decode("utf-8", "replace"), add_special_tokens=False).ids) for p in frequent_pieces(docs, table_size)}
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(load(tokenizer_path), shared.value)
        for batch in batches:
            counts = [sum(map(lengths.__getitem__, t.as_buffer().to_pybytes().split())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = whole_text(F.col("text"))
    narrow = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), text.cast("binary").alias("b"))
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint")
