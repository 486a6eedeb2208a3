import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tussis.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [
    (1, "The quick brown fox. It's 2024, isn't it?", 1), (1, "The quick brown fox. It's 2024, isn't it?", 1), (2, None, 2), (3, "", 3), (None, " \n\t\v ", 4),
    (4, "a<|endoftext|>b <|startoftext|> <|endoftext|", 5), (5, "Σ ΑΣ J̌ İstanbul ẛ̣ ẹ́x", 6), (6, "中文字 ไทย हिन्दी 👩‍👩‍👧 ٣٤", 7),
    (7, "x\x1cy\x1fz\x85w\xa0v　u t", 8), (8, "word " * 30_000 + "q" * 20_000, 9), (9, "# $%& 'll 'S we'RE ..!?", 10),
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_equal_to_the_library(spark, library):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, n_tokens int")
    for size in (token_counts.TABLE, 2):
        got = token_counts.token_counts(df.repartition(3), PATH, size).collect()
        want = [(i, len((t or "").encode()), library(t)) for i, t, _ in ROWS]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_documents(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {r.doc_id: library(r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PATH, 500).collect()} == want


def test_summary_keeps_every_frequent_piece(spark):
    rows = [(i, " ".join(["often"] * 3 + [f"once{i}_{j}" for j in range(20)])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(130)
    assert b"often" in token_counts.frequent_pieces(df, 12)


def test_cache_is_bounded(library):
    lengths = token_counts.Lengths(Tokenizer.from_file(PATH), {b"the": 1}, room=10)
    for i in range(100):
        assert lengths[f"word{i}".encode()] == library(f"word{i}")
        assert len(lengths) <= 11 and lengths[b"the"] == 1


def test_empty_table(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0
