"""Collections keep a row a text with its counted words; statistics are summed by term before they move."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tidewell.operators import retrieval
from tidewell.operators.best import latin_words
from tidewell.sources.collections import Collections

ROWS = "chunk_id string, document_id string, text string, embedding array<float>"


def test_a_collection_has_a_row_a_text(spark, tmp_path):
    store = Collections(spark, f"file://{tmp_path}/chunks", buckets=3)
    store.create("t", 2)
    store.append("t", spark.createDataFrame([("a", "d", "Red red fox", [1.0, 0.0]), ("b", "e", "", [1.0, 0.0]), ("c", "f", None, None)], ROWS))
    store.append("t", spark.createDataFrame([("a", "d", "the fox", [1.0, 0.0])], ROWS))
    index = store.keyword_index("t")
    assert {r.chunk_id: (r.dl, dict(zip(r.terms, r.tfs, strict=True))) for r in index.texts.collect()} == {"a": (2, {"the": 1, "fox": 1}), "b": (0, {}), "c": (0, {})}
    assert sorted((r.term, r.df) for r in index.terms.collect()) == [("fox", 1), ("the", 1)]
    assert not (tmp_path / "chunks/t/postings").exists()  # a row a word and text, shuffled twice


def test_statistics_of_terms(spark):
    texts = spark.createDataFrame([(1, 3, ["red", "fox"], [2, 1]), (2, 1, ["fox"], [1]), (3, 0, [], [])], "chunk_id long, dl int, terms array<string>, tfs array<long>")
    assert sorted(map(tuple, retrieval.term_rows(texts).collect())) == [("fox", 1, 1, 1), ("fox", 1, 1, 3), ("red", 1, 2, 3)]


def test_words_of_latin_and_other_texts_are_those_of_the_pattern(spark):
    odd = "".join(chr(c) for c in [*range(1, 0x250), *range(0x2000, 0x2080), 0x370, 0x3A3, 0x416, 0x4E2D, 0x660, 0x1E9E, 0x212A, 0x1F600])
    texts = [None, "", " ", "a", "é", "éa’b", "A_1 a_1 ÉTÉ été x² ½", "İstanbul Latin", "ΟΔΟΣ", "——", "ß", "ends", "starts ends\n", *(f"a{c}B{c}{c}" for c in odd), odd[:300], *(odd[i:i + 40] for i in range(0, len(odd), 7))]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(3)
    got = {r.chunk_id: (r.dl, dict(zip(r.terms, r.tfs, strict=True))) for r in retrieval.counted_texts(df).collect()}
    want = {r.chunk_id: r.words for r in df.select("chunk_id", retrieval.tokens(F.col("text")).alias("words")).collect()}
    assert got == {i: (len(w), dict(Counter(w))) for i, w in want.items()}


def test_latin_words_are_split_without_patterns():
    lengths, words = latin_words(pa.array(["x", "Été l’Œuvre", None, "xx_1", ""]).slice(1))
    assert lengths.tolist() == [3, 0, 1, 0] and words.to_pylist() == ["été", "l", "œuvre", "xx_1"]
