"""Nulls, empties, long texts, repeated rows, empty tables and clashing names in every stage of the pipeline."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["gone", "gone_id", "_row", "key", "score", "lang_pred", "_n_lines", "_n_dropped", "_bm_id", "t_id", "t_hash", "lines", "runs", "m_id", "m_hash", "text_hash", "row", "class_id", "id", "a.b"]


def frame(spark, rows, clashing=True):
    df = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], COLUMNS)
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES)) if clashing else df


def ids_and_texts(df):
    rows = df.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES])
def test_an_empty_table_stays_empty(spark, sf, stage):
    out = stage(spark, frame(spark, [(1, "a", "en")]).where("doc_id = 2"), sf)
    assert out.count() == 0 and (stage is cp.packed or out.columns == [*(c.split()[0] for c in COLUMNS.split(", ")), *CLASHES])


def test_language_keeps_the_callers_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 200")
    some = {r.lang: r.text for r in docs.orderBy("doc_id").collect()}
    table = [(100 + i, r.text, r.lang) for i, r in enumerate(docs.collect())]
    long = (some["en"] + " ") * 300
    odd = [(1, None, "en"), (2, "", "en"), (3, "12 !", None), (4, some["fr"], None), (4, some["fr"], None), (None, some["de"], "xx"), (5, long, "en"), (6, "\u0301\u0301", "en")]
    out = cp.by_language(spark, frame(spark, table + odd), sf)
    assert ids_and_texts(out.where("doc_id < 100 OR doc_id IS NULL")) == sorted([(4, some["fr"]), (4, some["fr"]), (None, some["de"]), (5, long)], key=str)
    langs = {r.doc_id: r.lang for r in out.where("doc_id < 100 OR doc_id IS NULL").collect()}
    assert langs == {4: "fr", None: "xx", 5: "en"}


def test_lines_of_a_repeated_id_are_judged_by_row(spark, sf):
    head = "A heading line that many documents of this table share"
    rows = [(i, f"{head}\nbody {i}", "en") for i in range(1, 7)] + [(3, "head\nTHE ONLY COPY OF THIS LINE, WHICH IS LONG ENOUGH", "en"), (2, f"x\n{head}", "en"), (8, None, "en"), (9, "", "en"), (None, head, "en"), (6, head, "en")]
    got = ids_and_texts(cp.without_repeated_lines(spark, frame(spark, rows), sf))
    want = [(i, f"body {i}") for i in range(1, 6)] + [(6, f"{head}\nbody 6"), (3, "head\nTHE ONLY COPY OF THIS LINE, WHICH IS LONG ENOUGH"), (2, "x"), (8, None), (9, ""), (None, head), (6, head)]
    assert got == sorted(want, key=str)
    out = cp.without_repeated_lines(spark, frame(spark, rows), sf)
    assert {(r.text, r.n_chars) for r in out.collect()} == {(t, None if t is None else len(t)) for _, t in want}


def test_a_unique_text_of_a_repeated_id_stays(spark, sf):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, "en"), (2, a, "en"), (2, b, "en"), (3, None, "en"), (3, None, "en"), (4, "", "en"), (5, a + " c" * 2, "en"), (None, b, "en"), (7, "z " * 50_000, "en")]
    got = ids_and_texts(cp.without_near_copies(spark, frame(spark, rows), sf))
    assert got == sorted([(1, a), (2, b), (3, None), (3, None), (4, ""), (7, "z " * 50_000)], key=str)
    single = ids_and_texts(cp.without_near_copies(spark, frame(spark, [(4, a, "en"), (1, a + " more", "en"), (8, "other words", "en")]), sf))
    assert single == [(1, a + " more"), (8, "other words")]


def test_packing_of_odd_rows(spark, sf):
    rows = [(1, None, "en"), (2, "", "en"), (3, "some words", "en"), (3, "some words", "en"), (None, "no id", "en"), (4, "long " * 9000, "en")]
    got = {}
    for r in cp.packed(spark, frame(spark, rows), sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got[1] == got[2] == 1 and got[3] == 2 * 3 and got[None] == 3 and got[4] == 9001


@pytest.mark.parametrize("share, stays", [(0.55, False), (0.65, True)])
def test_the_language_threshold_decides(spark, sf, share, stays):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 3000")
    words = {r.lang: " ".join(r.t).split() for r in docs.groupBy("lang").agg(F.sort_array(F.collect_list("text")).alias("t")).collect()}

    def letters(lang, n):
        out, had = [], 0
        for w in words[lang][200:]:
            if had >= n:
                return " ".join(out)
            out.append(w)
            had += sum(map(str.isalpha, w))

    mixed = letters("en", 4000 * share) + "\n" + letters("de", 4000 * (1 - share))
    table = docs.unionByName(spark.createDataFrame([(-1, mixed, "en", "s", len(mixed))], COLUMNS))
    assert (cp.by_language(spark, table, sf).where("doc_id = -1").count() == 1) == stays
