"""Repeated passages, by content-defined chunks.

A gear hash rolls over the bytes of a text, and a chunk starts wherever the hash is the largest within ``REACH`` bytes on
either side. A cut so depends on nothing but the bytes around it: an insertion moves the cuts near it and no others, chunks
are longer than ``REACH``, and two texts that share a passage cut it alike. Chunks are compared
by digest; runs of neighbouring repeated chunks make up the repeated passages.

Because a cut looks ``REACH`` bytes ahead, two equal chunks inside two texts mean some 90 equal bytes at least, so shared
short lines don't count; ``MIN_RUN_WORDS`` guards the ends of texts, where a cut sees less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tussis.llm.common import fresh, if_small, whole_text, written

REACH = 24
MIN_RUN_WORDS = 20
#: Enough bytes are a passage whatever their words, as scripts without blanks have few.
MIN_RUN_BYTES = 256
#: Bytes that the rolling hash sees.
ROLL = 16
#: Texts longer than this are cut piece by piece, with what a cut can see on either side.
PIECE = 1 << 20
#: Gear values: the first four bytes of the byte's SHA-256.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "little") for i in range(256)], np.uint32)
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Sum of gear[byte] << age over the last ``ROLL`` bytes, at every byte."""
    h = GEAR[data]
    step = 1
    while step < ROLL:
        earlier = np.zeros_like(h)
        earlier[step:] = h[:-step] << np.uint32(step)
        h = h + earlier
        step *= 2
    return h


def cuts(data: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Positions where a new chunk starts, the text's start not included. Never inside a UTF-8 character."""
    found = []
    margin = reach + ROLL
    for begin in range(0, len(data), PIECE):
        low, high = max(0, begin - margin), min(len(data), begin + PIECE + reach)
        part = data[low:high]
        h = gear_hash(part).astype(np.int64) + 1
        h[(part & 0xC0) == 0x80] = 0
        padded = np.concatenate([np.zeros(reach, np.int64), h, np.zeros(reach, np.int64)])
        most, span = padded, 1
        while span * 2 <= reach:
            most = np.maximum(most[:-span], most[span:])
            span *= 2
        if span < reach:  # two overlapping stretches make up one of ``reach``
            most = np.maximum(most[: len(most) - (reach - span)], most[reach - span :])
        before, after = most[: len(h)], most[reach + 1 : reach + 1 + len(h)]
        at = np.flatnonzero((h > before) & (h >= after) & (h > 0)) + low
        found.append(at[(at >= max(begin, 1)) & (at < begin + PIECE)])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_spans(raw: bytes, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number of words begun of each chunk of a text."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    starts = np.concatenate([[0], cuts(data, reach)])
    blank = BLANK[data]
    begun = ~blank
    begun[1:] &= blank[:-1]
    return starts, np.append(starts[1:], len(data)), np.add.reduceat(begun.astype(np.int64), starts)


def row_key(doc_id: Column, text: Column) -> Column:
    """What makes a row a document: id and text together."""
    return F.xxhash64(doc_id, whole_text(text))


CHUNK = "row bigint, at int, start bigint, end bigint, n_words bigint, d1 bigint, d2 bigint"


def chunks(docs: DataFrame) -> DataFrame:
    """All chunks of all texts: ``doc_id, row`` (a hash of id and text), ``at`` (place in the text), byte span, words, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            rows, held = [], 0

            def flushed() -> pa.RecordBatch:
                counts, at, start, end, words, names = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
                index = np.repeat(np.array(rows, np.int64), counts)
                pair = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2) if len(names) else np.zeros((0, 2), np.int64)
                arrays = [batch.column(0).take(pa.array(index)), batch.column(1).take(pa.array(index)), pa.array(at, pa.int32()), *map(pa.array, (start, end, words)), pa.array(pair[:, 0]), pa.array(pair[:, 1])]
                return pa.RecordBatch.from_arrays(arrays, ["doc_id", *[c.split()[0] for c in CHUNK.split(", ")]])

            for i, text in enumerate(batch.column(2)):
                raw = text.as_buffer().to_pybytes()
                start, end, words = chunk_spans(raw)
                n = len(start)
                if not n:
                    continue
                names = np.empty(n, object)
                names[:] = [digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())]
                rows.append(i)
                for column, value in zip(columns, ([n], np.arange(n), start, end, words, names)):
                    column.append(value)
                held += n
                if held >= 100_000:
                    yield flushed()
                    columns, rows, held = [[] for _ in range(6)], [], 0
            if held:
                yield flushed()

    narrow = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), whole_text(F.col("text")).cast("binary").alias("b"))
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, {CHUNK}")


def repeated_runs(docs: DataFrame, min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """``doc_id, row, first_id, start, end, n_words, kept_before``: every passage that other documents hold too.

    ``start`` and ``end`` are bytes. ``first_id`` is the smallest id among the holders of any of its chunks. The
    minimum is asked of the whole passage, whoever holds its chunks first; ``kept_before`` are the spans of those that
    a smaller id keeps.
    """
    table = written(chunks(docs), "chunks")
    key = ["d1", "d2"]
    repeated = table.groupBy(*key).agg(F.min("row").alias("low"), F.max("row").alias("high"), F.min("doc_id").alias("first_id")).filter("low <> high")
    repeated = written(repeated.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "first_id"), "repeated-chunks")
    found = table.join(if_small(repeated), (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    found = found.dropDuplicates(["row", "at"]).withColumn("is_first", F.col("doc_id").eqNullSafe(F.col("first_id")))
    order = Window.partitionBy("row").orderBy("at")  # the chunks of one text
    runs = found.withColumn("run", F.col("at") - F.row_number().over(order)).groupBy("doc_id", "row", "run").agg(
        F.min("first_id").alias("first_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"),
        F.collect_list(F.when(~F.col("is_first"), F.struct("start", "end"))).alias("kept_before"))
    return runs.filter((F.col("n_words") >= min_run_words) | (F.col("end") - F.col("start") >= MIN_RUN_BYTES)).drop("run")


def repeats(docs: DataFrame, min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """One row per document that holds a repeated passage: ``doc_id, first_id, n_runs, n_words, n_bytes, spans``.

    ``first_id`` is the smallest id that shares a passage with the row (its own, where it is that). ``spans`` are
    ``start:end`` in bytes, in order. Null and empty texts hold none, a null id is
    first only where all are null. Rows that repeat both id and text are one document, and passages that repeat only
    within one text don't count. An empty table gives no rows; other columns are ignored.
    """
    span = F.struct("start", F.concat_ws(":", "start", "end").alias("text"))
    whole = repeated_runs(docs, min_run_words).groupBy("doc_id", "row").agg(
        F.min("first_id").alias("first_id"), F.count(F.lit(1)).alias("n_runs"), F.sum("n_words").alias("n_words"), F.sum(F.col("end") - F.col("start")).alias("n_bytes"),
        F.sort_array(F.collect_list(span)).alias("s"))  # the runs of one text
    return whole.select("doc_id", "first_id", "n_runs", "n_words", "n_bytes", F.concat_ws(",", "s.text").alias("spans"))


def remove_repeats(docs: DataFrame, min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """``docs`` without the passages that a document with a smaller id keeps, all columns in place."""
    key, own, spans = fresh(docs, "__cut_key", "__row_key", "__spans")
    keyed = docs.withColumn(own, row_key(docs["doc_id"], docs["text"]))
    runs = repeated_runs(docs, min_run_words).select("row", F.inline("kept_before"))
    cut = runs.groupBy(F.col("row").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(spans))  # the runs of one text
    cut = written(cut, "cuts")

    @F.arrow_udf("string")
    def without(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts, lists.to_pylist()):
            raw, pieces, at = text.as_buffer().to_pybytes(), [], 0
            for span in found or []:
                pieces.append(raw[at : span["start"]])
                at = span["end"]
            out.append(b"".join([*pieces, raw[at:]]).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    joined = keyed.join(if_small(cut), F.col(own) == F.col(key), "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(without(whole_text(F.col("text")).cast("binary"), F.col(spans)))
    return joined.withColumn("text", text).select(*docs.columns)
